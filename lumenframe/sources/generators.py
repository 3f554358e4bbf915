"""Synthetic recordings. Stages draw their seeds in a fixed order (imaging, regions, fluorescence, noise, baselines, neuropil); new stages come last."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.kernels import ar1
from ..model import FRAMES, MASKS, Epoch, Imaging, Rois
from .arrays import imaging_from_numpy
from .recording import batch_of


def generate_random_imaging(spark: SparkSession, n_frames=(100,), height: int = 32, width: int = 32, n_planes: int = 1, fs: float = 30.0, seed: int = 0) -> Imaging:
    """Uniform [0, 1) frames from one generator that runs through the epochs in order."""
    lengths = (n_frames,) if isinstance(n_frames, int) else tuple(n_frames)
    rng = np.random.default_rng(seed)
    return imaging_from_numpy(spark, [rng.random((n, height, width, n_planes)).astype(np.float32) for n in lengths], fs)


def random_frames(spark: SparkSession, n_frames: int, height: int, width: int, fs: float = 30.0, seed: int = 0, per_epoch: int | None = None) -> Imaging:
    """The same at scale: every frame has a generator of its own (seed, frame), so it may be made on any executor."""
    per_epoch = per_epoch or n_frames

    def make(batches):
        for batch in batches:
            pixels = [np.random.default_rng([seed, int(i)]).random(height * width).astype(np.float32) for i in batch["id"]]
            yield pd.DataFrame({"epoch_index": (batch["id"] // per_epoch).astype("int32"), "frame": batch["id"] % per_epoch, "plane_index": np.int32(0), "pixels": pixels})

    frames = spark.range(n_frames).mapInPandas(make, FRAMES)
    epochs = tuple(Epoch(min(per_epoch, n_frames - a), a / fs) for a in range(0, n_frames, per_epoch))
    return Imaging(frames, fs, height, width, epochs)


def ellipsoid(shape: tuple[int, int, int], centre, radius: float, depth: float | None = None, weighted: bool = False) -> np.ndarray:
    """Weights (H, W, P) of a disc, or with a depth of an ellipsoid: 1 inside, or falling from 1 at the centre to 0 at the edge."""
    y, x, z = np.ogrid[: shape[0], : shape[1], : shape[2]]
    flat = (y - centre[0]) ** 2 + (x - centre[1]) ** 2 + 0 * z
    if depth is None:
        inside, far = (flat <= radius**2) & (z == centre[2]), np.sqrt(flat) / radius
    else:
        far = np.sqrt(flat / radius**2 + (z - centre[2]) ** 2 / depth**2)
        inside = far <= 1
    return np.where(inside, np.clip(1 - far, 0, 1) if weighted else 1.0, 0.0)


def generate_rois(spark: SparkSession, n: int, height: int, width: int, radius: tuple[int, ...] = (4, 6), weighted: bool = False, fs: float | None = None, seed: int = 0, n_planes: int = 1, ids=None) -> Rois:
    """Discs with integer radii that fit the field, or over several planes ellipsoids (a third radius is their depth)."""
    low, high = radius[:2]
    depth = radius[2] if len(radius) > 2 else high
    if low < 1 or high < low or 2 * high >= min(height, width):
        raise ValueError("radius does not fit the field")
    names = [str(i) for i in (ids if ids is not None else range(n))]
    if len(names) != n or len(set(names)) != n:
        raise ValueError("one distinct id for each region")
    rng, rows = np.random.default_rng(seed), []
    for name in names:
        r = int(rng.integers(low, high + 1))
        cy, cx = int(rng.integers(r, height - r)), int(rng.integers(r, width - r))
        cz = 0 if n_planes == 1 else int(rng.integers(depth, n_planes - depth)) if n_planes > 2 * depth else n_planes // 2
        w = ellipsoid((height, width, n_planes), (cy, cx, cz), r, None if n_planes == 1 else depth, weighted)
        rows += [(name, int(z), int(y), int(x), float(w[y, x, z])) for y, x, z in zip(*np.nonzero(w))]
    return Rois(spark.createDataFrame(rows, MASKS), height, width, tuple(names), n_planes, fs)


@dataclass(frozen=True)
class Fluorescence:
    """Ground truth, frames x regions."""

    traces: np.ndarray
    spikes: np.ndarray
    clean: np.ndarray
    neuropil: np.ndarray | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        t, n = self.traces.shape
        frame, roi = np.repeat(np.arange(t), n), np.tile([str(i) for i in range(n)], t)
        data = {"roi": roi, "frame": frame, "trace": self.traces.ravel(), "spikes": self.spikes.ravel().astype(float), "clean": self.clean.ravel()}
        return spark.createDataFrame(pd.DataFrame(data | ({"neuropil": self.neuropil.ravel()} if self.neuropil is not None else {})))


def generate_fluorescence(n_frames: int, n: int, fs: float = 30.0, rate: float = 0.2, decay: float = 1.0, noise: float = 0.0, bleaching_time: float | None = None, seed: int = 0) -> Fluorescence:
    """Events at random frames, an AR(1) response, (1 + c) times bleaching, and noise."""
    rng = np.random.default_rng(seed)
    spikes = np.zeros((n_frames, n))
    for i in range(n):
        count = int(np.clip(round(rng.uniform(0.5, 1.5) * rate * n_frames / fs), 1, n_frames))
        spikes[rng.choice(n_frames, count, replace=False), i] = 1
    g = float(np.exp(-1 / (decay * fs)))
    clean = np.stack([ar1(spikes[:, i], g) for i in range(n)], axis=1)
    bleach = np.exp(-np.arange(n_frames) / fs / bleaching_time) if bleaching_time else np.ones(n_frames)
    traces = (1 + clean) * bleach[:, None]
    if noise:
        traces = traces + rng.normal(0, noise, traces.shape)
    return Fluorescence(traces, spikes, clean)


def vignette(height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    d = np.hypot(y - (height - 1) / 2, x - (width - 1) / 2)
    p = 1 - 0.25 * d / max(d.max(), 1e-12)
    return p / p.mean()


def fluctuation(n_frames: int, fs: float, rng, tau: float = 5.0) -> np.ndarray:
    """Ornstein-Uhlenbeck course of unit variance, centred."""
    phi = float(np.exp(-1 / (tau * fs)))
    out = ar1(rng.normal(0, np.sqrt(1 - phi**2), n_frames), phi)
    return out - out.mean()


def compose_movie(spark: SparkSession, signal: np.ndarray, masks: np.ndarray, course: np.ndarray, profile: np.ndarray, shape: tuple[int, int, int], fs: float, lengths: tuple[int, ...], noise: str | None = None, sigma: float = 0.0, seed: int = 0) -> Imaging:
    """signal @ masks + course x profile (+ noise), made frame by frame on the executors.

    What is sent out is the size of the traces (frames x regions) and of the masks;
    a frame's noise comes from a generator of its own (seed, frame).
    """
    h, w, p = shape
    edges = np.concatenate(([0], np.cumsum(lengths)))
    shared = spark.sparkContext.broadcast((masks.astype(np.float64), profile.astype(np.float64)))
    table = pa.table({"frame": pa.array(np.arange(len(signal))), "signal": pa.array(list(signal.astype(float)), pa.list_(pa.float64())), "course": pa.array(course.astype(float))})

    def make(batches):
        a, b = shared.value
        for batch in batches:
            frames = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(frames), -1) @ a + batch.column(2).to_numpy()[:, None] * b
            for i, t in enumerate(frames):
                if noise == "gaussian":
                    x[i] += np.random.default_rng([seed, int(t)]).normal(0, sigma, x.shape[1])
                elif noise == "poisson":
                    x[i] = np.random.default_rng([seed, int(t)]).poisson(np.maximum(0, x[i]))
            epoch = np.searchsorted(edges, frames, side="right") - 1
            for e in np.unique(epoch):
                mine = epoch == e
                yield batch_of(int(e), frames[mine] - edges[e], list(range(p)), x[mine].reshape(-1, h, w, p).astype(np.float32))

    rows = spark.createDataFrame(table).repartitionByRange(max(1, min(len(signal) // 16, 4 * spark.sparkContext.defaultParallelism)), "frame")
    epochs = tuple(Epoch(int(n), float(o / fs)) for n, o in zip(lengths, edges, strict=False))
    return Imaging(rows.mapInArrow(make, FRAMES), fs, h, w, epochs, tuple(range(p)))


def generate_recording(spark: SparkSession, n_frames=1000, height: int = 64, width: int = 64, n: int = 20, fs: float = 30.0, radius: tuple[int, ...] = (4, 6), weighted: bool = False, decay: float = 1.0, rate: float = 0.2, baseline: float = 100.0, background: float = 50.0, roi_coefficient: float | None = None, fluctuating: float = 0.1, vignetted: bool = False, bleaching_time: float | None = None, noise: str | None = "gaussian", sigma: float = 2.0, seed: int = 0, n_planes: int = 1):
    """(movie, regions, truth): (baseline x traces) @ masks + background, then noise; ``n_frames`` is a number or one for each epoch.

    The background bleaches too; on pixels of a region it counts ``roi_coefficient``
    times (by default 1, or 0.7 under a vignette); before Poisson noise its course
    is not below 0.
    """
    lengths = (n_frames,) if isinstance(n_frames, int) else tuple(n_frames)
    total = sum(lengths)
    seeds = np.random.default_rng(seed).integers(0, 2**31, 6)
    rois = generate_rois(spark, n, height, width, radius, weighted, fs, int(seeds[1]), n_planes)
    truth = generate_fluorescence(total, n, fs, rate, decay, 0.0, bleaching_time, int(seeds[2]))
    masks = np.zeros((n, height * width * n_planes))
    for r in rois.masks.collect():
        masks[int(r.roi_id), (r.y * width + r.x) * n_planes + r.plane_index] = r.w
    base = baseline * np.random.default_rng(int(seeds[4])).uniform(0.8, 1.2, n)
    bleach = np.exp(-np.arange(total) / fs / bleaching_time) if bleaching_time else np.ones(total)
    course = background * bleach * (1 + fluctuating * fluctuation(total, fs, np.random.default_rng(int(seeds[5]))))
    if noise == "poisson":
        course = np.maximum(course, 0)
    flat = vignette(height, width) if vignetted else np.ones((height, width))
    coefficient = roi_coefficient if roi_coefficient is not None else 0.7 if vignetted else 1.0
    profile = np.repeat(flat.ravel(), n_planes)
    profile = np.where(masks.any(axis=0), coefficient, 1.0) * profile
    movie = compose_movie(spark, truth.traces * base, masks, course, profile, (height, width, n_planes), fs, lengths, noise, sigma, int(seeds[3]))
    neuropil = course[:, None] * ((masks @ profile) / np.maximum(masks.sum(axis=1), 1e-12))
    return movie, rois, Fluorescence(truth.traces, truth.spikes, truth.clean, neuropil)
