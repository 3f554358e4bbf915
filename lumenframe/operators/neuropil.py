"""Neuropil rings around regions, grown on the sparse masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Rois


def core_pixels(weights: np.ndarray, percentile: float) -> np.ndarray:
    """Which of a region's pixels count as its own: binary masks whole, weighted ones from a percentile of the weights up."""
    if len(weights) < 2 or np.ptp(weights) == 0 or percentile <= 0:
        return np.ones(len(weights), bool)
    return weights >= np.percentile(weights, percentile)


def ring(y: np.ndarray, x: np.ndarray, taken: np.ndarray, inner: int, least: int, circular: bool = False) -> np.ndarray:
    """Flat places of the free pixels around a region beyond the inner distance: a box or disc that grows until it holds enough.

    A window around the region is looked at, not the field, and grows with the box.
    """
    h, w = taken.shape
    y0, y1, x0, x1 = y.min(), y.max(), x.min(), x.max()
    cy, cx = np.median(y), np.median(x)
    reach = np.hypot(y - cy, x - cx).max()
    for grow in range(inner + 1, h + w):
        far = grow if not circular else int(np.ceil(reach + grow + max(cy - y0, y1 - cy, cx - x0, x1 - cx)))
        a, b, c, d = max(0, y0 - far), min(h, y1 + far + 1), max(0, x0 - far), min(w, x1 + far + 1)
        free = ~taken[a:b, c:d]
        gap = np.zeros(free.shape, bool)
        gap[y - a, x - c] = True
        free &= ~_widened(gap, inner)
        if circular:
            yy, xx = np.mgrid[a:b, c:d]
            free &= np.hypot(yy - cy, xx - cx) <= reach + grow
        if free.sum() >= least or (a, b, c, d) == (0, h, 0, w) and (not circular or reach + grow >= np.hypot(h, w)):
            break
    py, px = np.nonzero(free)
    return (py + a) * w + px + c


def _widened(x: np.ndarray, by: int) -> np.ndarray:
    """True within ``by`` rows and columns of a true place."""
    for axis in (0, 1):
        out = x.copy()
        for k in range(1, by + 1):
            fore, back = [slice(None)] * 2, [slice(None)] * 2
            fore[axis], back[axis] = slice(k, None), slice(None, -k)
            out[tuple(fore)] |= x[tuple(back)]
            out[tuple(back)] |= x[tuple(fore)]
        x = out
    return x


def surround_masks(rois: Rois, inner: int = 2, least: int = 350, percentile: float = 50.0, circular: bool = False) -> DataFrame:
    """(roi, plane_index, pix, w): ring weights that sum to 1; no rows for a region without pixels or without free ones.

    A region is a task's row of its own; what executors share is which pixels of each plane are taken (as large as the field).
    """
    h, w, spark = rois.height, rois.width, rois.masks.sparkSession
    solid = rois.masks.where("w <> 0")
    if not solid.groupBy("roi_id").agg(F.countDistinct("plane_index").alias("n")).where("n > 1").isEmpty():
        raise NotImplementedError("regions that span planes have no ring")
    taken: dict[int, np.ndarray] = {}
    pixels = solid.select("plane_index", (F.col("y") * w + F.col("x")).alias("pix")).distinct().toArrow()
    for plane, pix in zip(pixels.column(0).to_pylist(), pixels.column(1).to_pylist(), strict=True):
        taken.setdefault(plane, np.zeros(h * w, bool))[pix] = True
    shared = spark.sparkContext.broadcast({p: x.reshape(h, w) for p, x in taken.items()})

    def grow(pdf):
        core = core_pixels(pdf["w"].to_numpy(), percentile)
        plane = int(pdf["plane_index"].iloc[0])
        found = ring(pdf["y"].to_numpy()[core], pdf["x"].to_numpy()[core], shared.value[plane], inner, least, circular)
        return pd.DataFrame({"roi": pdf["roi_id"].iloc[0], "plane_index": np.int32(plane), "pix": found.astype("int32"), "w": np.full(len(found), 1.0 / max(1, len(found)))})

    return solid.groupBy("roi_id", "plane_index").applyInPandas(grow, "roi string, plane_index int, pix int, w double")
