"""Lifting dialogue off the art: which cells are ink, the sprite that takes
them, and the art without them.  Arrays of cells, inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paper is at least this bright; its least share; where its tone stands in order.
PAPER, PAPER_SHARE, PAPER_PLACE = 195, 0.22, 0.85
#: Distance from the backdrop at which ink begins and is full; least share of plain backdrop.
INK_FROM, INK_FULL, FLAT_SHARE = 40, 140, 0.3
#: Alpha above which a cell counts as taken.
TAKEN = 40


def paper_tone(levels: Column) -> Column:
    return F.get(F.sort_array(levels), F.floor(F.size(levels) * PAPER_PLACE).cast("int"))


def safe(levels: Column) -> Column:
    """Whether a block is mostly paper, so that nothing but letters is lifted."""
    return (paper_tone(levels) >= PAPER) & (F.size(F.filter(levels, lambda v: v >= PAPER)) >= F.size(levels) * PAPER_SHARE)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, not for each cell."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _alpha(value: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("long")


def ink_by_light(levels: Column) -> Column:
    """Alpha by how much darker than paper a cell is; null where it isn't safe."""
    alpha = lambda t: F.transform(levels, lambda v: _alpha((t - v) * 255 / F.greatest(t, F.lit(1))))
    return F.when(safe(levels), _bound(paper_tone(levels), alpha))


def border_median(levels: Column, side: int) -> Column:
    """Upper median of the cells on a square's border."""
    rim = F.sort_array(F.filter(levels, lambda v, p: (p % side == 0) | (p % side == side - 1) | (p < side) | (p >= side * (side - 1))))
    return F.get(rim, F.floor(F.size(rim) / 2).cast("int"))


def ink_by_color(red: Column, green: Column, blue: Column, side: int) -> Column:
    """Alpha by distance from the backdrop's colour; null without a plain one."""
    names = ("red", "green", "blue")

    def measured(of: Column) -> Column:
        medians = F.struct(*(border_median(of[n], side).alias(n) for n in names))
        squares = lambda m, p: sum((F.get(of[n], p) - m[n]) * (F.get(of[n], p) - m[n]) for n in names)
        return _bound(medians, lambda m: F.transform(of["red"], lambda _, p: _alpha((F.sqrt(squares(m, p)) - INK_FROM) * 255 / (INK_FULL - INK_FROM))))

    alpha = _bound(F.struct(*(c.alias(n) for c, n in zip((red, green, blue), names, strict=True))), measured)
    return _bound(alpha, lambda a: F.when(F.size(F.filter(a, lambda v: v == 0)) >= F.size(a) * FLAT_SHARE, a))


def sprite_alpha(alpha: Column, cover: Column) -> Column:
    """What of each cell the sprite takes: its ink times its cover."""
    return F.zip_with(alpha, cover, lambda a, c: F.floor(a * c + 0.5).cast("long"))


def taken(alpha: Column) -> Column:
    return F.size(F.filter(alpha, lambda a: a > TAKEN))


def erased(levels: Column, alpha: Column, tone: Column) -> Column:
    """The art with the taken cells as paper."""
    return _bound(tone, lambda t: F.zip_with(levels, alpha, lambda v, a: F.when(a > TAKEN, t).otherwise(v)))
