"""Motion estimation and correction.

Estimation is a loop of jobs on the driver: each pass registers every frame to
the template on the executors and returns a template for each split, whose
median is the next template. Correction is a lazy join of frames and shifts
with a kernel on top.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registration as R
from ..model import FRAMES, Imaging
from ..settings import IntegerSettings, PiecewiseSettings

METHODS: dict[str, Callable] = {}


def register_method(name: str, estimate: Callable) -> None:
    if name in METHODS:
        raise ValueError(f"motion method {name} is registered")
    METHODS[name] = estimate


RIGID = "epoch_index int, frame long, plane_index int, dy double, dx double, bad boolean"
PATCHES = "epoch_index int, frame long, plane_index int, shifts array<double>"


def packed(value):
    """A value as JSON can hold it; arrays and tuples are marked, so that they come back as what they were."""
    if isinstance(value, np.ndarray):
        return {"array": value.ravel().tolist(), "dtype": value.dtype.name, "shape": list(value.shape)}
    if isinstance(value, tuple):
        return {"tuple": [packed(v) for v in value]}
    if isinstance(value, list):
        return [packed(v) for v in value]
    if isinstance(value, dict):
        return {"dict": [[k, packed(v)] for k, v in value.items()]}
    return value.item() if isinstance(value, np.generic) else value


def unpacked(value):
    if isinstance(value, dict):
        if "array" in value:
            return np.array(value["array"], dtype=value["dtype"]).reshape(value["shape"])
        if "tuple" in value:
            return tuple(unpacked(v) for v in value["tuple"])
        return {k: unpacked(v) for k, v in value["dict"]}
    return [unpacked(v) for v in value] if isinstance(value, list) else value


@dataclass(frozen=True)
class Motion:
    """Displacements (the motion, not its correction) by frame and, if any, by patch."""

    rigid: DataFrame  # epoch_index, frame, plane_index, dy, dx, bad
    method: str
    template: dict = field(default_factory=dict)
    patches: DataFrame | None = None  # ..., shifts array<double>
    centres: tuple | None = None
    params: dict = field(default_factory=dict)

    def at(self, frames, plane: int | None = None) -> DataFrame:
        out = self.rigid.where(F.col("frame").isin(list(frames)))
        return out if plane is None else out.where(F.col("plane_index") == plane)

    def to_dict(self) -> dict:
        """Plain lists, numbers and texts, ready for JSON: displacements frame by frame, arrays with their type and shape."""
        rows = [list(r) for r in self.rigid.orderBy("epoch_index", "plane_index", "frame").collect()]
        patches = None
        if self.patches is not None:
            patches = [[*r[:3], list(r[3])] for r in self.patches.orderBy("epoch_index", "plane_index", "frame").collect()]
        return {"object": "Motion", "method": self.method, "rigid": rows, "patches": patches, "template": {str(k): packed(v) for k, v in self.template.items()}, "centres": [packed(c) for c in self.centres] if self.centres else None, "params": packed(self.params)}

    @staticmethod
    def from_dict(spark, told: dict) -> Motion:
        """From ``to_dict``, as it is or reread from JSON."""
        if told.get("object") != "Motion" or told["method"] not in METHODS:
            raise ValueError("not a motion of a registered method")
        rigid = spark.createDataFrame([tuple(r) for r in told["rigid"]], RIGID)
        patches = spark.createDataFrame([tuple(r) for r in told["patches"]], PATCHES) if told["patches"] is not None else None
        centres = tuple(unpacked(c) for c in told["centres"]) if told["centres"] else None
        return Motion(rigid, told["method"], {int(k): unpacked(v) for k, v in told["template"].items()}, patches, centres, unpacked(told["params"]))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Displacements as tables, the rest as JSON beside them: what long recordings need."""
        self.rigid.write.mode(mode).parquet(f"{path}/rigid")
        if self.patches is not None:
            self.patches.write.mode(mode).parquet(f"{path}/patches")
        told = {"method": self.method, "patches": self.patches is not None, "template": {str(k): packed(v) for k, v in self.template.items()}, "centres": [packed(c) for c in self.centres] if self.centres else None, "params": packed(self.params)}
        spark = self.rigid.sparkSession
        spark.createDataFrame([(json.dumps(told),)], "content string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> Motion:
        told = json.loads(spark.read.parquet(f"{path}/meta").first().content)
        patches = spark.read.parquet(f"{path}/patches") if told["patches"] else None
        centres = tuple(unpacked(c) for c in told["centres"]) if told["centres"] else None
        return Motion(spark.read.parquet(f"{path}/rigid"), told["method"], {int(k): unpacked(v) for k, v in told["template"].items()}, patches, centres, unpacked(told["params"]))

    def bad_frames(self) -> DataFrame:
        return self.rigid.groupBy("epoch_index", "frame").agg(F.bool_or("bad").alias("bad"))

    def ranges(self, height: int, width: int) -> DataFrame:
        """(plane_index, axis, lo, hi): rows and columns that stay inside the field."""
        m = self.rigid.groupBy("plane_index").agg(*[f(c).alias(f"{n}_{c}") for c in ("dy", "dx") for n, f in (("lo", F.min), ("hi", F.max))])
        one = lambda axis, c, size: m.select("plane_index", F.lit(axis).alias("axis"), F.greatest(F.lit(0), F.ceil(-F.col(f"lo_{c}"))).cast("int").alias("lo"), (F.lit(size) - F.greatest(F.lit(0), F.ceil(F.col(f"hi_{c}")))).cast("int").alias("hi"))
        return one("y", "dy", height).unionByName(one("x", "dx", width))


def compute_motion(movie: Imaging, method: str = "piecewise", **params) -> Motion:
    if method not in METHODS:
        raise ValueError(f"unknown motion method {method!r}: {sorted(METHODS)}")
    return METHODS[method](movie, **params)


SHIFTS = "epoch_index int, frame long, plane_index int, dy double, dx double, shifts array<double>"


def _pass(frames: DataFrame, template: np.ndarray, patches: dict | None, max_shift, upsample: int, bounds, size: int | None):
    h, w = template.shape
    window = tuple(slice(*b) for b in bounds) if bounds else (slice(None), slice(None))
    fixed = R.high_pass(template, size)[window] if size else template[window]

    def run(batches):
        for batch in batches:
            dy, dx, shifts = [], [], []
            for p in batch["pixels"]:
                x = np.asarray(p, float).reshape(h, w)
                x = (R.high_pass(x, size) if size else x)[window]
                if patches is None:
                    r, s = R.shift_of(x, fixed, max_shift, upsample), None
                else:
                    r, s, _ = R.patch_shifts(x, fixed, max_shift=max_shift, upsample=upsample, **patches)
                dy.append(r[0])
                dx.append(r[1])
                shifts.append(None if s is None else s.ravel().tolist())
            yield pd.DataFrame({"epoch_index": batch["epoch_index"], "frame": batch["frame"], "plane_index": batch["plane_index"], "dy": dy, "dx": dx, "shifts": shifts})

    return frames.mapInPandas(run, SHIFTS)


#: Pixels of a template's part that one task takes the median of; what reaches the driver is one image.
TILE = 1 << 14


def _corrected_mean(frames: DataFrame, shifts: DataFrame, shape, split: int, total: int) -> np.ndarray:
    """Median over splits of the mean corrected frame of each, combined on the executors, part by part of the image."""
    h, w = shape
    chunks = max(total // max(split, 10), 1)
    joined = frames.join(shifts, ["epoch_index", "frame", "plane_index"]).withColumn("chunk", F.floor(F.col("frame") * chunks / total))

    def partial(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for c, p, dy, dx in zip(batch["chunk"], batch["pixels"], batch["dy"], batch["dx"], strict=True):
                x = R.move(np.asarray(p, float).reshape(h, w), dy, dx)
                if c in sums:
                    sums[c][0] += x.ravel()
                    sums[c][1] += 1
                else:
                    sums[c] = [x.ravel(), 1]
        if sums:
            for c, (x, n) in sums.items():
                parts = [x[t : t + TILE] for t in range(0, len(x), TILE)]
                yield pd.DataFrame({"chunk": c, "tile": np.arange(len(parts), dtype="int32"), "s": parts, "n": n})

    sums = joined.select("chunk", "pixels", "dy", "dx").mapInPandas(partial, "chunk long, tile int, s array<double>, n long")

    def middle(pdf):
        # of a tile: the mean of each split, then the median over splits
        means = [np.sum(np.stack(g["s"].to_list()), axis=0) / g["n"].sum() for _, g in pdf.groupby("chunk")]
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1].to_numpy(), "v": [np.nanmedian(np.stack(means), axis=0)]})

    tiles = sums.groupBy("tile").applyInPandas(middle, "tile int, v array<double>").collect()
    out = np.zeros(h * w)
    for r in tiles:
        out[r.tile * TILE : r.tile * TILE + len(r.v)] = r.v
    return out.reshape(h, w)


def estimate_piecewise(
    movie: Imaging, settings: PiecewiseSettings | dict | None = None, badframes=None, **given,
) -> Motion:
    """Template matching by DFT cross-correlation; the template is carried from epoch to epoch."""
    if badframes is not None:
        raise ValueError("bad frames are not supported by this method")
    told = PiecewiseSettings.resolve(settings, **given)
    nonrigid, max_shift, strides, overlaps, max_deviation = told.nonrigid, told.max_shift, told.strides, told.overlaps, told.max_deviation
    rounds, split, upsample, bounds, filter_size = told.rounds, told.split, told.upsample, told.bounds, told.filter_size
    h, w = movie.height, movie.width
    rigid = patches = None
    templates, centres = {}, None
    if nonrigid:
        ys, sy = R.patch_starts(h if not bounds else bounds[0][1] - bounds[0][0], strides[0], overlaps[0])
        xs, sx = R.patch_starts(w if not bounds else bounds[1][1] - bounds[1][0], strides[1], overlaps[1])
        off = (bounds[0][0], bounds[1][0]) if bounds else (0, 0)
        centres = tuple(np.array(s) + (n - 1) / 2 + o for s, n, o in ((ys, sy, off[0]), (xs, sx, off[1])))
    for plane in range(movie.n_planes):
        own = movie.frames.where(F.col("plane_index") == plane)
        total = movie.epochs[0].n_frames
        step = total // 50 + 1
        sample = own.where((F.col("epoch_index") == 0) & (F.col("frame") % step == 0)).select("pixels").toPandas()["pixels"]
        stack = np.stack([np.asarray(p, float).reshape(h, w) for p in sample])
        if not np.isfinite(stack).all():
            raise ValueError("the movie holds NaN")
        template = np.median(stack, axis=0)
        for _ in range(3):
            template = np.median([R.move(x, *R.match_shift(x - stack.min(), template - stack.min(), clamped(max_shift, (h, w)))) for x in stack], axis=0)
        for e, epoch in enumerate(movie.epochs):
            frames = own.where(F.col("epoch_index") == e)
            for _ in range(rounds):
                found = _pass(frames, template, None, max_shift, upsample, bounds, filter_size)
                template = _corrected_mean(frames, found, (h, w), split, epoch.n_frames)
            how = {"stride": strides, "overlap": overlaps, "deviation": max_deviation} if nonrigid else None
            done = _pass(frames, template, how, max_shift, upsample, bounds, filter_size)
            rigid = done if rigid is None else rigid.unionByName(done)
        templates[plane] = template
    # what corrects a frame is the opposite of its motion
    motion = rigid.select("epoch_index", "frame", "plane_index", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), F.lit(False).alias("bad"))
    patches = rigid.select("epoch_index", "frame", "plane_index", F.transform("shifts", lambda s: -s).alias("shifts")) if nonrigid else None
    return Motion(motion, "piecewise", templates, patches, centres, told.as_dict() | {"n_epochs": len(movie.epochs)})


def clamped(max_shift, shape: tuple[int, int]) -> tuple[int, int]:
    """Shifts that leave at least a third of the template to be matched."""
    return tuple(int(min(m, n // 3)) for m, n in zip(max_shift, shape, strict=True))


def reference_image(stack: np.ndarray, most, sigma: float, edge: float, rounds: int = 4) -> np.ndarray:
    """Mean of the frames that agree best, each moved onto the mean of the round before."""
    flat = stack.reshape(len(stack), -1)
    centred = flat - flat.mean(axis=1, keepdims=True)
    similar = centred @ centred.T / np.maximum(np.linalg.norm(centred, axis=1)[:, None] * np.linalg.norm(centred, axis=1)[None, :], 1e-12)
    near = np.argsort(-similar, axis=1, kind="stable")[:, : min(20, len(stack))]
    seed = near[np.take_along_axis(similar, near, axis=1).mean(axis=1).argmax()]
    image = stack[seed].mean(axis=0)
    for k in range(rounds):
        found = [R.phase_shift(x, image, most, sigma, edge) for x in stack]
        best = np.argsort([-peak for _, _, peak in found], kind="stable")[: max(2, len(stack) * (2 + k) // (2 + 2 * rounds))]
        image = np.mean([np.roll(stack[i], (int(found[i][0]), int(found[i][1])), (0, 1)) for i in best], axis=0)
    return image


def estimate_integer(movie: Imaging, settings: IntegerSettings | dict | None = None, max_shift=None, badframes: DataFrame | None = None, **given) -> Motion:
    """Whole-pixel shifts by smoothed phase correlation to a reference of evenly spaced frames of the first epoch; then, if asked for, block shifts."""
    told = IntegerSettings.resolve(settings, **given)
    h, w = movie.height, movie.width
    most = tuple(max_shift) if max_shift else tuple(max(1, round(told.max_shift_share * min(h, w))) for _ in range(2))
    (y0, y1), (x0, x1) = told.bounds or ((0, h), (0, w))
    window = (slice(y0, y1), slice(x0, x1))
    rigid, templates = None, {}
    for plane in range(movie.n_planes):
        own = movie.frames.where(F.col("plane_index") == plane)
        n = movie.epochs[0].n_frames
        picks = np.unique(np.linspace(0, n, 1 + min(told.reference_frames, n)).astype(int)[:-1]).tolist()
        sample = own.where((F.col("epoch_index") == 0) & F.col("frame").isin(picks)).select("frame", "pixels").toPandas().sort_values("frame")["pixels"]
        stack = np.stack([np.asarray(p, float).reshape(h, w)[window] for p in sample])
        template = reference_image(stack, most, told.smooth_sigma, told.spatial_taper)
        blocks = told.block_size if told.nonrigid else None
        sigma, edge, far = told.smooth_sigma, told.spatial_taper, told.max_nonrigid_shift

        def run(batches, template=template, blocks=blocks):
            for batch in batches:
                dy, dx, shifts = [], [], []
                for p in batch["pixels"]:
                    x = np.asarray(p, float).reshape(h, w)[window]
                    a, b, _ = R.phase_shift(x, template, most, sigma, edge)
                    dy.append(a)
                    dx.append(b)
                    shifts.append(R.block_shifts(np.roll(x, (int(a), int(b)), (0, 1)), template, blocks, far).ravel().tolist() if blocks else None)
                yield pd.DataFrame({"epoch_index": batch["epoch_index"], "frame": batch["frame"], "plane_index": batch["plane_index"], "dy": dy, "dx": dx, "shifts": shifts})

        found = own.mapInPandas(run, SHIFTS)
        rigid = found if rigid is None else rigid.unionByName(found)
        templates[plane] = template
    moved = rigid.select("epoch_index", "frame", "plane_index", (-F.col("dy")).alias("dy"), (-F.col("dx")).alias("dx"), "shifts")
    bad = moved.select("epoch_index", "frame", "plane_index", "dy", "dx", far_frames(most, told.bad_threshold).alias("bad"))
    if badframes is not None:
        bad = bad.join(badframes.select("epoch_index", "frame", F.col("bad").alias("given")), ["epoch_index", "frame"], "left").select("epoch_index", "frame", "plane_index", "dy", "dx", (F.col("bad") | F.coalesce("given", F.lit(False))).alias("bad"))
    patches = moved.select("epoch_index", "frame", "plane_index", F.transform("shifts", lambda s: -s).alias("shifts")) if told.nonrigid else None
    return Motion(bad, "integer", templates, patches, R.block_centres((h, w), told.block_size) if told.nonrigid else None, told.as_dict() | {"max_shift": list(most)})


def far_frames(most, threshold: float) -> Column:
    """Frames whose shift reaches so much of the largest one allowed, to 95 %."""
    reach = F.greatest(F.abs("dy") / F.lit(float(most[0])), F.abs("dx") / F.lit(float(most[1])))
    return reach > F.lit(0.95 * threshold)


register_method("piecewise", estimate_piecewise)
register_method("integer", estimate_integer)


def register_motion(movie: Imaging, motion: Motion, border: str | bool = "copy", fourier: bool = True, patchwise: bool = False) -> Imaging:
    """The corrected movie, float32, still lazy.

    Whole-pixel shifts roll; others move by a phase ramp or, with ``fourier`` off,
    by cubic sampling. Patch shifts are sampled along a field between the patches'
    centres, or with ``patchwise`` moved patch by patch and blended.
    """
    h, w, whole = movie.height, movie.width, motion.method == "integer"
    epochs = motion.params.get("n_epochs")
    if epochs is not None and epochs != len(movie.epochs):
        raise ValueError("motion and movie differ in epochs")
    shifts = motion.rigid.select("epoch_index", "frame", "plane_index", "dy", "dx")
    if motion.patches is not None:
        shifts = shifts.join(motion.patches, ["epoch_index", "frame", "plane_index"])
    else:
        shifts = shifts.withColumn("shifts", F.lit(None).cast("array<double>"))
    centres = motion.centres
    stride, overlap = motion.params.get("strides", (48, 48)), motion.params.get("overlaps", (24, 24))

    def run(batches):
        for batch in batches:
            out = []
            for p, dy, dx, s in zip(batch["pixels"], batch["dy"], batch["dx"], batch["shifts"], strict=True):
                x = np.asarray(p, float).reshape(h, w)
                if whole:
                    x = np.roll(x, (-int(dy), -int(dx)), (0, 1))
                if s is not None:
                    grid = -np.asarray(s, float).reshape(len(centres[0]), len(centres[1]), 2)
                    y = R.patchwise_move(x, grid, centres, stride, overlap, border=border) if patchwise else R.warp(x, R.field_of(grid, centres, (h, w)))
                elif whole:
                    y = x
                elif fourier:
                    y = R.move(x, -dy, -dx, border)
                else:
                    y = R.fill_border(R.warp(x, np.broadcast_to(np.array([-dy, -dx]), (h, w, 2))), -dy, -dx, border, x.min())
                out.append(y.astype(np.float32).ravel())
            yield pd.DataFrame({"epoch_index": batch["epoch_index"], "frame": batch["frame"], "plane_index": batch["plane_index"], "pixels": out})

    joined = movie.frames.join(shifts, ["epoch_index", "frame", "plane_index"])
    notes = movie.annotations | {"motion_method": motion.method}
    return movie.with_frames(joined.mapInPandas(run, FRAMES), dtype="float32", annotations=notes)


def registered_series(movie: Imaging, start: int | None = None, end: int | None = None, plane_ids=None, epoch_index: int | None = None) -> DataFrame:
    """``get_series`` of a corrected movie: an end past the last frame is cut back with a warning, a start past it raises."""
    n = movie.epochs[epoch_index or 0].n_frames
    if start is not None and start > n:
        raise IndexError(f"start {start} lies past the last frame")
    if end is not None and end > n:
        warnings.warn(f"end {end} lies past the last frame; {n} is used", stacklevel=2)
        end = n
    return movie.get_series(start, end, plane_ids, epoch_index)
