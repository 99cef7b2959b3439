"""What the camera does with a frame: fits, zooms, looks, moods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import Box


# The limits of zooming, in views of the whole page.
ZOOM_OUT, ZOOM_IN = 0.8, 6


def fit(box: Box, width: float, height: float, zoom: Column | float = 1.0) -> Column:
    """The transform that shows a box whole and centred: scale, x, y."""
    scale = F.least(F.lit(float(width)) / box.w, F.lit(float(height)) / box.h) * zoom
    centre = lambda view, start, size: F.lit(view / 2.0) - (start + size / 2.0) * scale
    return F.struct(scale.alias("scale"), centre(width, box.x, box.w).alias("x"), centre(height, box.y, box.h).alias("y"))


def zoomed(scale: Column, factor: Column, low: Column | float = 0.05, high: Column | float = 8.0) -> Column:
    """A scale after zooming; limits stop it but never push it back."""
    closer = F.least(scale * factor, F.greatest(F.lit(high), scale))
    return F.when(factor > 1, closer).otherwise(F.greatest(scale * factor, F.least(F.lit(low), scale)))


def zoom_limits(page_width: Column, page_height: Column, width: float, height: float) -> Column:
    """How far a view of that size may zoom on a page: ``low`` shows it whole
    with air around it, ``high`` the screen of its print."""
    whole = F.least(F.lit(float(width)) / page_width, F.lit(float(height)) / page_height)
    return F.struct((whole * ZOOM_OUT).alias("low"), (whole * ZOOM_IN).alias("high"))


def zoomed_at(scale: Column, x: Column, y: Column, factor: Column, at_x: Column, at_y: Column, limits: Column) -> Column:
    """The transform after zooming within limits, which leaves a place where it is: scale, x, y."""
    after = zoomed(scale, factor, limits["low"], limits["high"])
    moved = lambda at, start: at - (at - start) * (after / scale)
    return F.struct(after.alias("scale"), moved(at_x, x).alias("x"), moved(at_y, y).alias("y"))


def glided(start: Column, target: Column, elapsed_ms: Column, glide_ms: float) -> Column:
    """Where an exponential glide is after a time; there at once without one."""
    left = F.exp(F.lit(-5.0) * elapsed_ms / glide_ms) if glide_ms > 0 else F.lit(0.0)
    return target + (start - target) * left


def punch(ink: Column, streaks: Column) -> Column:
    return F.least(F.lit(1.0), ink * 1.15 + streaks * 0.75)


def look_flags(scale: Column, aspect: Column, ink: Column, streaks: Column) -> dict[str, Column]:
    return {"splash": scale >= 0.55, "wide": aspect >= 2.1, "tall": aspect <= 0.62, "action": (ink >= 0.34) & (streaks >= 0.22)}


def enter_ms(flags: dict[str, Column], hit: Column) -> Column:
    """How long the camera takes to settle, by the command-line rules."""
    action = (F.lit(150.0) + F.lit(120.0) * (F.lit(1.0) - hit)).cast("int")
    return F.when(flags["splash"], 900).when(flags["action"], action).when(flags["wide"] | flags["tall"], 700).otherwise(450)


def hold_ms(flags: dict[str, Column], scale: Column) -> Column:
    """The rest of a panel without dialogue."""
    base = F.lit(420.0) + F.lit(1400.0) * F.least(scale * 2.2, F.lit(1.0))
    return (base * F.when(flags["action"], 0.62).otherwise(1.0)).cast("int")


def grown(box: Box, width: int, height: int) -> Column:
    """A text box grown by 8 % of its side, 3 to 12 pixels, within the page."""
    margin = lambda side: F.least(F.greatest(side * 0.08, F.lit(3.0)), F.lit(12.0))
    x, y = F.greatest(box.x - margin(box.w), F.lit(0.0)), F.greatest(box.y - margin(box.h), F.lit(0.0))
    right, bottom = F.least(box.right + margin(box.w), F.lit(float(width))), F.least(box.bottom + margin(box.h), F.lit(float(height)))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"))


def letterbox(width: Column, height: Column, side: int) -> Column:
    """The scale that fits a page in a square, and the size it has there."""
    scale = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    return F.struct(scale.alias("scale"), F.floor(width * scale + 0.5).alias("w"), F.floor(height * scale + 0.5).alias("h"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114


def note_frequency(midi: Column) -> Column:
    return F.pow(F.lit(2.0), (midi - 69) / 12.0) * 440


def shake_amplitude(amp: Column, ms: Column, elapsed: Column) -> Column:
    """How far a shake of ``ms`` still throws the picture: it dies away as the
    square of what is left of it; 0 once it is over."""
    left = F.greatest(ms - elapsed, F.lit(0)) / F.greatest(ms, F.lit(1))
    return amp * left * left


def shaken(at: Column, amplitude: Column, chance: Column) -> Column:
    """A coordinate thrown by a shake, for a chance of 0 to 1 that is drawn anew each time."""
    return at + (chance * 2 - 1) * amplitude
