"""What a detector puts out, as tables: text boxes and masks.

A page's raw output is a row of flat arrays.  Text boxes are unpacked inside
Catalyst; masks are products of a detection's coefficients with a few shared
prototypes, taken batch by batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import grown
from ..functions.geometry import Box

#: Labels of a text box: none, inside a balloon, free on the page.
NO_TEXT, FREE_TEXT = 0, 2
#: A decoded box has at least this side.
LEAST_SIDE = 2


def decoded_text(outputs: DataFrame, width: int, height: int, floor: float) -> DataFrame:
    """(page_id, labels, boxes, scores) to a row for each text: page_id, place,
    conf, free, x, y, w, h.

    ``boxes`` holds four corners for each score.  Texts below ``floor`` or
    without a label go; the others grow by a margin within the page.
    """
    corner = lambda i, k: F.get("boxes", i * 4 + k).cast("double")
    one = lambda s, i: F.struct(i.cast("long").alias("place"), s.cast("double").alias("conf"), F.get("labels", i).alias("label"), corner(i, 0).alias("x"), corner(i, 1).alias("y"), (corner(i, 2) - corner(i, 0)).alias("w"), (corner(i, 3) - corner(i, 1)).alias("h"))
    found = F.filter(F.transform("scores", one), lambda d: (d.conf >= floor) & (d.label != NO_TEXT))
    rows = outputs.select("page_id", F.explode(found).alias("d")).select("page_id", "d.*")
    rows = rows.select("page_id", "place", "conf", (F.col("label") == FREE_TEXT).alias("free"), grown(Box.of(), width, height).alias("box"))
    return rows.select("page_id", "place", "conf", "free", "box.*").where((F.col("w") >= LEAST_SIDE) & (F.col("h") >= LEAST_SIDE))


def decoded_masks(rows: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """(id, coefficients, x1, y1, x2, y2) to (id, mask): probabilities of the
    prototypes' cells, 0 outside the box.

    ``prototypes`` (channel, row, column) are a model's, so few and of fixed size.
    """
    channels, height, width = prototypes.shape
    xs, ys = np.meshgrid(np.arange(width), np.arange(height))

    def decode(batches):
        for batch in batches:
            weights = np.stack(batch["coefficients"].to_numpy()) if len(batch) else np.zeros((0, channels))
            total = np.zeros((len(batch), height, width))
            for c in range(channels):
                total += weights[:, c, None, None] * prototypes[c]
            edge = {n: batch[n].to_numpy()[:, None, None] for n in ("x1", "y1", "x2", "y2")}
            inside = (xs >= edge["x1"]) & (xs < edge["x2"]) & (ys >= edge["y1"]) & (ys < edge["y2"])
            masks = np.where(inside, 1 / (1 + np.exp(-total)), 0.0)
            yield pd.DataFrame({"id": batch["id"], "mask": list(masks.reshape(len(batch), -1))})

    return rows.select("id", "coefficients", "x1", "y1", "x2", "y2").mapInPandas(decode, "id long, mask array<double>")
