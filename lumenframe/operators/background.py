"""Low-rank background: the movie is modelled as C A + f b with masks A given, fitted by alternating non-negative updates.

Spark scans the movie once for an evenly spaced subsample of frames (bounded by
``frames``) and once for nothing else; the subsample is fitted on the driver.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import band_pass, nnls_descent, regularise, ridge_inverse, smooth_image
from ..model import Imaging, Rois
from .reduce import sampled_frames


def unit_partition(height: int, width: int, n: int) -> np.ndarray:
    """n triangular bumps along x that add up to 1 at every pixel."""
    at = np.linspace(0, width - 1, n) if n > 1 else np.zeros(1)
    x = np.arange(width)
    bumps = np.stack([np.interp(x, at, np.eye(n)[i]) for i in range(n)]) if n > 1 else np.ones((1, width))
    return np.repeat(bumps[:, None, :], height, axis=1).reshape(n, -1)


def inpaint(image: np.ndarray, holes: np.ndarray, sigma: float) -> np.ndarray:
    """Fills holes by a normalised Gaussian mean of what lies around."""
    free = (~holes).astype(float)
    top, bottom = smooth_image(image * free, sigma, "edge"), smooth_image(free, sigma, "edge")
    filled = np.where(bottom > 1e-6, top / np.maximum(bottom, 1e-6), image)
    return np.where(holes, filled, image)


class Fit:
    """Alternating updates of C A + f b on a subsample held in memory (rows are frames)."""

    def __init__(self, movie: np.ndarray, masks: np.ndarray, shape: tuple[int, int], ridge: float = 1e-6, nonnegative: bool = True, nonnegative_background: bool = True) -> None:
        self.y, self.a, self.shape, self.ridge = movie.astype(float), masks.astype(float), shape, ridge
        self.nonnegative, self.nonnegative_background = nonnegative, nonnegative_background
        self.support = self.a.any(axis=0)
        self.gram = self.a @ self.a.T
        self.inverse = ridge_inverse(self.gram, ridge)
        self.ya, self.total = self.y @ self.a.T, float(np.sum(self.y**2))
        self.c = self.b = self.f = None

    def clipped(self, c: np.ndarray) -> np.ndarray:
        return np.maximum(c, 0) if self.nonnegative else c

    def seed(self, low: float, high: float) -> None:
        """First traces, from band-passed frames: a broad background must not leak into them."""
        soft = np.stack([band_pass(x.reshape(self.shape), low, high).ravel() for x in self.y]) if low or high else self.y
        self.c = self.clipped(soft @ self.a.T @ self.inverse)

    def start(self, components: int, init: str, high: float) -> None:
        """First background: bumps of the mean residual image, or its leading directions; regions are filled from around."""
        sigma = np.sqrt(max(np.diag(self.gram).max(initial=0.0), 1.0) / np.pi) + 1
        sigma = min(sigma, high) if high else sigma
        image = (self.y.mean(axis=0) - self.c.mean(axis=0) @ self.a).reshape(self.shape)
        mean = np.maximum(inpaint(image, self.support.reshape(self.shape), sigma).ravel(), 0)
        if init == "ramp":
            b = unit_partition(*self.shape, components) * mean
        elif init == "svd":
            left = np.where(self.support, 0.0, self.y - self.c @ self.a)
            rank = min(components, min(left.shape) - 1)
            b = np.repeat(mean[None], components, axis=0)
            if rank > 0:
                v = np.abs(np.linalg.svd(left, full_matrices=False)[2][:rank])
                b = v[np.minimum(np.arange(components), rank - 1)]
        else:
            raise ValueError(f"unknown start {init!r}")
        # a component of zeros could never grow
        self.b = np.where((b > 0).any(axis=1, keepdims=True), b, 1.0)
        wanted = self.y @ self.b.T - self.c @ (self.a @ self.b.T)
        own = self.b @ self.b.T
        self.f = wanted @ ridge_inverse(own, self.ridge)
        if self.nonnegative_background:
            self.f = nnls_descent(regularise(own, self.ridge), wanted, self.f)

    def _solve(self, gram: np.ndarray, wanted: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Rows that minimise 1/2 xGx - wanted x, from where they are."""
        return nnls_descent(regularise(gram, self.ridge), wanted, now) if self.nonnegative_background else wanted @ ridge_inverse(gram, self.ridge)

    def update(self) -> float:
        """Traces, then background, then its courses, each from the newest of the others; the objective."""
        if len(self.a):
            self.c = self.clipped((self.ya - self.f @ (self.b @ self.a.T)) @ self.inverse)
        self.b = self._solve(self.f.T @ self.f, (self.f.T @ self.y - (self.f.T @ self.c) @ self.a).T, self.b.T).T
        self.f = self._solve(self.b @ self.b.T, self.y @ self.b.T - self.c @ (self.a @ self.b.T), self.f)
        return self.objective()

    def objective(self) -> float:
        """|Y - C A - f b|^2, from inner products."""
        d = np.vstack((self.a, self.b))
        x = np.hstack((self.c, self.f))
        return float(self.total - 2 * np.sum(x * np.hstack((self.ya, self.y @ self.b.T))) + np.sum((x.T @ x) * (d @ d.T)))

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """(b of unit norm by falling energy of its course, f)."""
        norm = np.linalg.norm(self.b, axis=1)
        norm = np.where(norm > 0, norm, 1.0)
        b, f = self.b / norm[:, None], self.f * norm
        order = np.argsort(-np.linalg.norm(f, axis=0), kind="stable")
        return b[order], f[:, order]


ILL = 1e6


def fit(movie: np.ndarray, masks: np.ndarray, shape: tuple[int, int], components: int = 1, init: str = "ramp", low: float = 1.0, high: float = 20.0, ridge: float = 1e-6, rounds: int = 30, tol: float = 1e-4, nonnegative: bool = True, nonnegative_background: bool = True):
    """(b [components, pixels] of unit norm by falling energy, f [frames, components], objective by round)."""
    model, seen = Fit(movie, masks, shape, ridge, nonnegative, nonnegative_background), []
    model.seed(low, high)
    model.start(components, init, high)
    for _ in range(rounds):
        seen.append(model.update())
        if len(seen) > 1 and abs(seen[-2] - seen[-1]) < tol * (abs(seen[-2]) or 1.0):
            break
    b, f = model.ordered()
    joint = np.vstack((model.a, b))
    worst = max([np.linalg.cond(g @ g.T) for g in (model.a, joint) if len(g)], default=1.0)
    if worst > ILL:
        warnings.warn("masks and background are nearly dependent: traces are ill-determined", stacklevel=2)
    return b, f, seen


def check_settings(components: int, frames: int | None, rounds: int, low: float, high: float, ridge: float, tol: float) -> None:
    if components < 1 or frames is not None and (frames < 2 or components >= frames):
        raise ValueError("at least one component and more frames than components")
    if rounds < 1:
        raise ValueError("at least one round")
    if any(not np.isfinite(v) or v < 0 for v in (low, high, ridge, tol)):
        raise ValueError("widths, ridge and tolerance must be finite and not negative")


def cnmf_background(movie: Imaging, rois: Rois, components: int = 1, frames: int | None = 1000, **how) -> DataFrame:
    """(component, plane_index, pix, b) of unit norm, fitted plane by plane."""
    given = {"low": 1.0, "high": 20.0, "ridge": 1e-6, "rounds": 30, "tol": 1e-4} | {k: v for k, v in how.items() if k in ("low", "high", "ridge", "rounds", "tol")}
    check_settings(components, frames, given["rounds"], given["low"], given["high"], given["ridge"], given["tol"])
    if unknown := set(how) - set(given) - {"init", "nonnegative", "nonnegative_background"}:
        raise TypeError(f"unknown settings: {sorted(unknown)}")
    rois.check(movie)
    total = movie.n_frames
    keep = sampled_frames(total, frames or total)
    base = F.element_at(F.lit(movie.offsets), F.col("epoch_index") + 1)
    spark = movie.spark
    listed = F.broadcast(spark.createDataFrame([(k,) for k in keep], "g long"))  # at most ``frames`` rows
    sample = movie.frames.withColumn("g", F.col("frame") + base).join(listed, "g", "left_semi")
    out = []
    for plane in range(movie.n_planes):
        rows = sample.where(F.col("plane_index") == plane).select("g", "pixels").toPandas().sort_values("g")
        y = np.stack(rows["pixels"].to_list()).astype(float)
        a = np.zeros((len(rois.order), movie.height * movie.width))
        at = {r: i for i, r in enumerate(rois.order)}
        for r in rois.sparse.where(F.col("plane_index") == plane).collect():
            a[at[r.roi_id], r.pix] = r.w
        b, _, _ = fit(y, a, (movie.height, movie.width), components, **how)
        out += [(k, plane, int(p), float(b[k, p])) for k in range(components) for p in np.flatnonzero(b[k])]
    return spark.createDataFrame(out, "component int, plane_index int, pix int, b double")
