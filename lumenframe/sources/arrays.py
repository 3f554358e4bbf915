"""Movies and regions from arrays."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

from ..model import MASKS, Epoch, Imaging, Rois
from .recording import read_binary  # noqa: F401


def imaging_from_numpy(spark: SparkSession, series, fs: float, t_starts=None, plane_ids=None) -> Imaging:
    """A movie from one array or a list of them, (T, H, W[, P]); each is an epoch."""
    arrays = [np.asarray(a) for a in (series if isinstance(series, list | tuple) else [series])]
    arrays = [a[..., None] if a.ndim == 3 else a for a in arrays]
    if any(a.ndim != 4 or a.shape[1:] != arrays[0].shape[1:] for a in arrays):
        raise ValueError("epochs need equal shapes (T, H, W[, P])")
    _, h, w, p = arrays[0].shape
    parts = []
    for e, a in enumerate(arrays):
        flat = np.ascontiguousarray(a.transpose(0, 3, 1, 2), dtype=np.float32).reshape(len(a) * p, h * w)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * h * w, pa.int32()), pa.array(flat.ravel()))
        parts.append(pa.table({"epoch_index": pa.array(np.full(len(flat), e, np.int32)), "frame": pa.array(np.repeat(np.arange(len(a)), p)), "plane_index": pa.array(np.tile(np.arange(p, dtype=np.int32), len(a))), "pixels": values}))
    starts = t_starts or [0.0] * len(arrays)
    epochs = tuple(Epoch(len(a), t) for a, t in zip(arrays, starts, strict=True))
    return Imaging(spark.createDataFrame(pa.concat_tables(parts)), fs, h, w, epochs, tuple(plane_ids or range(p)), str(arrays[0].dtype))


def to_numpy(movie: Imaging, **which) -> np.ndarray:
    """(T, H, W, P) of what get_series returns. For small selections."""
    rows = movie.get_series(**which).orderBy("frame", "plane_index").toArrow()
    planes = len(set(rows.column("plane_index").to_pylist())) or 1
    flat = np.array(rows.column("pixels").to_pylist(), dtype=np.float32).reshape(-1, planes, movie.height, movie.width)
    return flat.transpose(0, 2, 3, 1)


def rois_from_numpy(spark: SparkSession, masks: np.ndarray, ids=None, fs: float | None = None) -> Rois:
    """Regions from (N, H, W[, P])."""
    masks = masks[..., None] if masks.ndim == 3 else masks
    n, h, w, p = masks.shape
    ids = [str(i) for i in (ids if ids is not None else range(n))]
    if len(ids) != n or len(set(ids)) != n:
        raise ValueError("one distinct id for each mask")
    i, y, x, z = np.nonzero(masks)
    data = pd.DataFrame({"roi_id": np.array(ids, dtype=object)[i], "plane_index": z.astype("int32"), "y": y.astype("int32"), "x": x.astype("int32"), "w": masks[i, y, x, z].astype(float)})
    return Rois(spark.createDataFrame(data, MASKS), h, w, tuple(ids), p, fs)


def rois_from_stat(spark: SparkSession, stats: list[dict], height: int, width: int, fs: float | None = None, planes=None, iscell=None) -> Rois:
    """Regions from a detector's list of dicts: binary masks of ypix and xpix; scalars become properties."""
    masks, props = [], []
    for i, s in enumerate(stats):
        plane = int(planes[i]) if planes is not None else 0
        masks += [(str(i), plane, int(y), int(x), 1.0) for y, x in zip(s["ypix"], s["xpix"], strict=True)]
        row = {k: float(v) for k, v in s.items() if np.isscalar(v) and not isinstance(v, str | bytes)}
        if iscell is not None:
            row |= {"iscell": float(iscell[i][0]), "iscell_probability": float(iscell[i][1])}
        props.append((str(i), row))
    n_planes = 1 + max((int(p) for p in planes), default=0) if planes is not None else 1
    properties = spark.createDataFrame(props, "roi_id string, properties map<string,double>")
    return Rois(spark.createDataFrame(masks, MASKS), height, width, tuple(str(i) for i in range(len(stats))), n_planes, fs, properties)


def describe(movie: Imaging) -> str:
    """A movie's metadata as JSON."""
    return json.dumps({"fs": movie.fs, "height": movie.height, "width": movie.width, "plane_ids": list(movie.plane_ids), "dtype": movie.dtype, "epochs": [[e.n_frames, e.t_start] for e in movie.epochs], "annotations": movie.annotations})
