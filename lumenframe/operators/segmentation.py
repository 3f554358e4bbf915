"""Region detection: bins of frames and tiles of the field on the executors, peaks grown within a tile.

Detection correlates each pixel's high-passed course with its neighbourhood's:
peaks of that image seed regions, which take connected pixels that follow the
seed's course.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kernels import band_pass, smooth, smooth_image
from ..functions.text import stamp
from ..model import MASKS, Imaging, Rois
from ..settings import SegmentationSettings
from ..sources.arrays import describe, rois_from_stat
from ..sources.store import _meta, save_rois
from .algebra import bad_frame_union, range_intersection
from .reduce import kept_batches

METHODS: dict[str, Callable] = {}


def register_method(name: str, detect: Callable) -> None:
    """``detect(stack, shape, **settings)`` gives region dicts of a binned movie (bins x pixels).

    A method with an attribute ``by_tiles`` is given the distributed bins in place
    of the stack; others get the whole stack on the driver.
    """
    if name in METHODS:
        raise ValueError(f"segmentation method {name} is registered")
    METHODS[name] = detect


def bin_size(n_frames: int, fs: float, tau: float, nbins: int, given: int | None = None) -> int:
    return given or max(1, n_frames // nbins, round(tau * fs))


def normal_bad_frames(spark: SparkSession, movie: Imaging, bad) -> DataFrame | None:
    """(epoch_index, frame, bad) from a flat array over all frames, or a list with an array or None for each epoch."""
    if bad is None or isinstance(bad, DataFrame):
        return bad
    if isinstance(bad, list | tuple):
        if len(bad) != len(movie.epochs):
            raise ValueError("one array or None for each epoch")
        parts = [np.zeros(e.n_frames, bool) if b is None else np.asarray(b, bool) for b, e in zip(bad, movie.epochs, strict=True)]
    else:
        flat = np.asarray(bad, bool)
        if len(flat) != movie.n_frames:
            raise ValueError("one flag for each frame")
        parts = np.split(flat, movie.offsets[1:])
    if any(len(p) != e.n_frames for p, e in zip(parts, movie.epochs, strict=True)):
        raise ValueError("one flag for each frame")
    rows = [(e, int(f), True) for e, p in enumerate(parts) for f in np.flatnonzero(p)]
    return spark.createDataFrame(rows, "epoch_index int, frame long, bad boolean")


def broadcast_ranges(ranges, n_epochs: int) -> list[tuple[int, int] | None]:
    """None, one pair, or one pair for each epoch."""
    if ranges is None:
        return [None] * n_epochs
    r = np.asarray(ranges)
    if r.shape == (2,):
        return [tuple(int(v) for v in r)] * n_epochs
    if r.shape != (n_epochs, 2):
        raise ValueError("ranges need a pair, or one for each epoch")
    return [tuple(int(v) for v in x) for x in r]


def bins_table(movie: Imaging, size: int, nbins: int | None = None, batch: int = 500, bad: DataFrame | None = None) -> DataFrame:
    """(epoch_index, frame, batch, bin) of the frames that are read: a table of frame numbers, no pixels.

    Batches run over all epochs. With ``nbins``, if there would be more bins, evenly
    spaced batches are read, the last one included; without, all are. Bad frames go where more than
    half of their batch is good; a batch's incomplete last bin goes, unless it is
    the only one.
    """
    spark, total = movie.spark, movie.n_frames
    kept = kept_batches(total, size, nbins, batch) if nbins else list(range(-(-total // batch)))
    epochs = F.broadcast(movie.epoch_frame().select("epoch_index", "n_frames", "frame_offset"))
    frames = spark.createDataFrame([(k,) for k in kept], "batch long").withColumn("g", F.explode(F.sequence(F.col("batch") * batch, F.least(F.lit(total), (F.col("batch") + 1) * batch) - 1)))
    frames = frames.join(epochs, (F.col("g") >= F.col("frame_offset")) & (F.col("g") < F.col("frame_offset") + F.col("n_frames"))).select("epoch_index", (F.col("g") - F.col("frame_offset")).alias("frame"), "g", "batch")
    if bad is not None:
        frames = frames.join(bad.select("epoch_index", "frame", "bad"), ["epoch_index", "frame"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
        good = F.avg((~F.col("bad")).cast("int")).over(Window.partitionBy("batch"))
        frames = frames.withColumn("good", good).where("not bad or good <= 0.5")
    of = Window.partitionBy("batch")
    placed = frames.withColumns({"at": F.row_number().over(of.orderBy("g")) - 1, "length": F.count("*").over(of)}).withColumn("bin", F.floor(F.col("at") / size))
    return placed.where((F.col("length") <= size) | ((F.col("bin") + 1) * size <= F.col("length"))).select("epoch_index", "frame", "batch", "bin")


def binned_frames(movie: Imaging, size: int, nbins: int | None = None, batch: int = 500, bad: DataFrame | None = None, ranges=None) -> DataFrame:
    """(batch, bin, pixels): means of runs of good frames of plane 0, cropped to ((y0, y1), (x0, x1)).

    A task holds the frames of a bin, never of a batch.
    """
    h, w = movie.height, movie.width
    (y0, y1), (x0, x1) = ranges or ((0, h), (0, w))
    frames = movie.frames.where("plane_index = 0").join(bins_table(movie, size, nbins, batch, bad), ["epoch_index", "frame"])

    def mean(table: pa.Table) -> pa.Table:
        pixels = table.column("pixels").combine_chunks()
        x = pixels.flatten().to_numpy(zero_copy_only=False).reshape(len(pixels), h, w)[:, y0:y1, x0:x1].astype(float).mean(axis=0)
        return pa.table({"batch": table.column("batch")[:1], "bin": table.column("bin")[:1], "pixels": pa.array([x.astype(np.float32).ravel()], pa.list_(pa.float32()))})

    done = frames.select("batch", "bin", "pixels").groupBy("batch", "bin").applyInArrow(mean, "batch long, bin long, pixels array<float>")
    return done


def prepared(stack: np.ndarray, shape: tuple[int, int], diameter: float, smoothing: float, high_pass: float) -> tuple[np.ndarray, np.ndarray]:
    """(normalised bins, score of each pixel) of a binned movie (bins x pixels)."""
    h, w = shape
    y = stack.reshape(-1, h, w).astype(float)
    y = y - smooth(y, high_pass, axis=0) if len(y) > 2 * high_pass else y - y.mean(axis=0)
    # what changes everywhere at once is no region
    y = np.stack([band_pass(x, smoothing, 2 * diameter) for x in y])
    y /= np.maximum(y.std(axis=0), 1e-9)
    around = np.stack([smooth_image(x, diameter / 4) for x in y])
    return y, np.mean(y * around, axis=0) * y.max(axis=0)


SCALE = 99.5


def detect_peaks(stack: np.ndarray, shape: tuple[int, int], diameter: float = 8, threshold: float = 0.3, most: int = 2000, smoothing: float = 1.0, high_pass: float = 10.0, scale: float | None = None) -> list[dict]:
    """Region dicts from a binned movie (bins x pixels). ``scale`` is the whole field's SCALE percentile of the score, if this is a tile of it."""
    h, w = shape
    y, score = prepared(stack, shape, diameter, smoothing, high_pass)
    score = score / max(np.percentile(score, SCALE) if scale is None else scale, 1e-9)
    taken, out, r = np.zeros((h, w), bool), [], int(np.ceil(diameter))
    for place in np.argsort(-score, axis=None, kind="stable"):
        cy, cx = divmod(int(place), w)
        if score[cy, cx] < threshold or len(out) >= most:
            break
        if taken[cy, cx]:
            continue
        y0, y1, x0, x1 = max(0, cy - r), min(h, cy + r + 1), max(0, cx - r), min(w, cx + r + 1)
        course = y[:, max(0, cy - 1) : cy + 2, max(0, cx - 1) : cx + 2].mean(axis=(1, 2))
        course = (course - course.mean()) / max(course.std(), 1e-9)
        fit = np.tensordot(course, y[:, y0:y1, x0:x1], (0, 0)) / len(y)
        good = (fit > 0.5) & ~taken[y0:y1, x0:x1]
        grown, edge = np.zeros_like(good), [(cy - y0, cx - x0)]
        while edge:
            a, b = edge.pop()
            if 0 <= a < good.shape[0] and 0 <= b < good.shape[1] and good[a, b] and not grown[a, b]:
                grown[a, b] = True
                edge += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
        ys, xs = np.nonzero(grown)
        taken[y0:y1, x0:x1] |= grown
        taken[cy, cx] = True
        if len(ys) < max(4, diameter**2 / 8):
            continue
        lam = fit[ys, xs]
        ys, xs = ys + y0, xs + x0
        spread = np.hypot(ys - ys.mean(), xs - xs.mean())
        skew = float(np.mean(course**3))
        out.append({"ypix": ys, "xpix": xs, "lam": lam, "npix": len(ys), "radius": float(np.sqrt(len(ys) / np.pi)), "compact": float(spread.mean() / max(np.sqrt(len(ys) / np.pi) * 2 / 3, 1e-9)), "skew": skew, "score": float(score[cy, cx])})
    return out


#: Pixels of a tile's side, and of the margin that its filters reach into, in diameters.
TILE, MARGIN = 192, 8


def tiles_of(shape: tuple[int, int], diameter: float) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(core y0, y1, x0, x1, with margin y0, y1, x0, x1) of tiles that cover a field; one tile if it is small."""
    h, w = shape
    edge = int(np.ceil(MARGIN * diameter))
    cut = lambda n: [(a, min(n, a + TILE)) for a in range(0, n, TILE)] if n > TILE + edge else [(0, n)]
    return [(a, b, c, d, max(0, a - edge), min(h, b + edge), max(0, c - edge), min(w, d + edge)) for a, b in cut(h) for c, d in cut(w)]


def detect_by_tiles(bins: DataFrame, shape: tuple[int, int], **how) -> list[dict]:
    """``detect_peaks`` on tiles with margins, a task each; a region is kept by the tile that its middle lies in.

    What reaches the driver is one number a tile's pixels and the regions, never the binned movie.
    """
    diameter = how.get("diameter", 8)
    tiles = tiles_of(shape, diameter)
    if bins.isEmpty():
        return []

    def cut(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, *shape) if batch.num_rows else np.zeros((0, *shape), np.float32)
            for k, (_, _, _, _, y0, y1, x0, x1) in enumerate(tiles):
                part = np.ascontiguousarray(x[:, y0:y1, x0:x1]).reshape(batch.num_rows, -1)
                values = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, k, np.int32)), batch.column(0), batch.column(1), values], names=["tile", "batch", "bin", "pixels"])

    parts = bins.mapInArrow(cut, "tile int, batch long, bin long, pixels array<float>")
    if len(tiles) > 1:
        parts = parts.persist(StorageLevel.DISK_ONLY)

    def stack_of(table: pa.Table) -> tuple[int, np.ndarray, tuple[int, int]]:
        order = np.lexsort((table.column("bin").to_numpy(), table.column("batch").to_numpy()))
        k = table.column("tile")[0].as_py()
        pixels = table.column("pixels").combine_chunks()
        _, _, _, _, y0, y1, x0, x1 = tiles[k]
        return k, pixels.flatten().to_numpy(zero_copy_only=False).reshape(len(pixels), -1)[order], (y1 - y0, x1 - x0)

    scale = None
    if len(tiles) > 1:
        filters = {k: how.get(k, v) for k, v in (("diameter", 8), ("smoothing", 1.0), ("high_pass", 10.0))}

        def scores(table: pa.Table) -> pa.Table:
            k, stack, size = stack_of(table)
            a, b, c, d, y0, _, x0, _ = tiles[k]
            score = prepared(stack, size, **filters)[1][a - y0 : b - y0, c - x0 : d - x0]
            return pa.table({"score": pa.array(score.ravel())})

        every = parts.groupBy("tile").applyInArrow(scores, "score double")
        scale = every.agg(F.percentile("score", SCALE / 100)).first()[0]

    def detect(table: pa.Table) -> pa.Table:
        k, stack, size = stack_of(table)
        a, b, c, d, y0, _, x0, _ = tiles[k]
        found = []
        for s in detect_peaks(stack, size, scale=scale, **how):
            cy, cx = np.median(s["ypix"]) + y0, np.median(s["xpix"]) + x0
            if len(tiles) == 1 or a <= cy < b and c <= cx < d:
                found.append({n: (v + (y0 if n == "ypix" else x0 if n == "xpix" else 0)).tolist() if isinstance(v, np.ndarray) else v for n, v in s.items()})
        return pa.table({"stat": pa.array([json.dumps(f) for f in found], pa.string())})

    rows = parts.groupBy("tile").applyInArrow(detect, "stat string").collect()
    if len(tiles) > 1:
        parts.unpersist()
    stats = [{n: np.array(v) if isinstance(v, list) else v for n, v in json.loads(r.stat).items()} for r in rows]
    return sorted(stats, key=lambda s: (-s["score"], int(s["ypix"][0]), int(s["xpix"][0])))


def collected(bins: DataFrame) -> np.ndarray:
    """All bins as one array on the driver: for plug-ins that want the whole stack."""
    rows = bins.orderBy("batch", "bin").select("pixels").toArrow().column("pixels").combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


FEATURES = ("skew", "compact")
#: Weights of skew, compactness and a constant; a fit on own labels replaces them.
WEIGHTS = np.array([2.0, -4.0, 4.8])


def fit_classifier(stats: list[dict], cell: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on the features of labelled regions (Newton steps)."""
    x = np.array([[*(s[f] for f in FEATURES), 1.0] for s in stats])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (np.asarray(cell, float) - p) - ridge * w)
    return w


def classify(stats: list[dict], weights: np.ndarray = WEIGHTS) -> np.ndarray:
    """(is a cell, probability) from shape and skewness."""
    if not len(stats):
        return np.zeros((0, 2))
    p = 1 / (1 + np.exp(-np.clip(np.array([[*(s[f] for f in FEATURES), 1.0] for s in stats]) @ weights, -500, 500)))
    return np.stack([(p >= 0.5).astype(float), p], axis=1)


def pooled_ranges(ranges: DataFrame) -> tuple[tuple[int, int], tuple[int, int]]:
    """((y0, y1), (x0, x1)) that all planes and epochs agree on, from (axis, lo, hi)."""
    met = {r.axis: (r.lo, r.hi) for r in range_intersection(ranges, "axis").collect()}
    return met["y"], met["x"]


def run_segmentation(movie: Imaging, method: str | None = None, settings: SegmentationSettings | dict | None = None, badframes=None, bounds=None, motion=None, folder: str | None = None, raise_errors: bool = True, size: int | None = None, batch: int | None = None, weights: np.ndarray = WEIGHTS, **given) -> Rois:
    """Regions of a single-plane movie, with a detector's scalars and a classification as properties.

    A motion gives its ranges and bad frames where none are given. With a folder,
    settings, a log and the regions are written there; with ``raise_errors`` off an
    error goes to the log and no regions are returned.
    """
    told = SegmentationSettings.resolve(settings, **({"method": method} if method else {}), **({"bin_size": size} if size else {}), **({"batch_size": batch} if batch else {}), **given)
    if told.method not in METHODS:
        raise ValueError(f"unknown segmentation method {told.method!r}")
    if movie.n_planes > 1:
        raise ValueError("one plane at a time")
    log = {"started": stamp(), "settings": told.as_dict(), "movie": describe(movie), "error": None}
    began = time.time()
    spark, stats = movie.spark, []
    try:
        bad = normal_bad_frames(spark, movie, badframes)
        if motion is not None:
            found = motion.bad_frames()
            bad = found if bad is None else bad_frame_union(found, bad)
            bounds = bounds or pooled_ranges(motion.ranges(movie.height, movie.width))
        length = bin_size(movie.n_frames, movie.fs, told.tau, told.nbins, told.bin_size)
        (y0, y1), (x0, x1) = bounds or ((0, movie.height), (0, movie.width))
        bins = binned_frames(movie, length, told.nbins if told.sampled else None, told.batch_size, bad, ((y0, y1), (x0, x1)))
        detect, shape = METHODS[told.method], (y1 - y0, x1 - x0)
        how = {k: getattr(told, k) for k in ("diameter", "threshold", "most", "smoothing", "high_pass")}
        stats = detect(bins if getattr(detect, "by_tiles", False) else collected(bins), shape, **how)
        for s in stats:
            s["ypix"], s["xpix"] = s["ypix"] + y0, s["xpix"] + x0
    except Exception as error:
        log["error"] = f"{type(error).__name__}: {error}"
        if raise_errors:
            raise
    finally:
        log |= {"seconds": time.time() - began, "regions": len(stats)}
        if folder is not None:
            _meta(spark, folder, "segmentation", json.dumps(log), "overwrite")
    if not stats:
        return Rois(spark.createDataFrame([], MASKS), movie.height, movie.width, (), fs=movie.fs)
    rois = rois_from_stat(spark, stats, movie.height, movie.width, movie.fs, iscell=classify(stats, weights) if told.classify else None)
    if folder is not None:
        save_rois(rois, f"{folder}/rois", "overwrite")
    return rois


detect_by_tiles.by_tiles = True
register_method("peaks", detect_by_tiles)
