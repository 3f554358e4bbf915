"""Traces from masks: movie (T x pixels) times masks, and what follows from the masks' Gram matrix.

Masks are sparse tables (roi, pix, w); a movie's pixels are (keys..., pix, v).
The mask side is broadcast while its row count, taken first, is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import nnls
from ..model import explode_pixels

BROADCAST_ROWS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table that is counted to be small; the table itself otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def norms(masks: DataFrame, roi: str = "roi") -> DataFrame:
    """L1 and squared L2 norm; zero norms count as 1."""
    return masks.groupBy(roi).agg(
        F.coalesce(F.nullif(F.sum("w"), F.lit(0.0)), F.lit(1.0)).alias("l1"),
        F.coalesce(F.nullif(F.sum(F.col("w") * F.col("w")), F.lit(0.0)), F.lit(1.0)).alias("l2"),
    )


def dots(pixels: DataFrame, masks: DataFrame, keys: list[str], roi: str = "roi") -> DataFrame:
    """(keys, roi, dot): the sum of v * w."""
    joined = pixels.join(small(masks), "pix")
    return joined.groupBy(*keys, roi).agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def projection(pixels: DataFrame, masks: DataFrame, keys: list[str], roi: str = "roi") -> DataFrame:
    """Least squares of each mask alone: sum(v w) / sum(w w)."""
    return dots(pixels, masks, keys, roi).join(small(norms(masks, roi)), roi).select(*keys, roi, (F.col("dot") / F.col("l2")).alias("value"))


def mean_trace(pixels: DataFrame, masks: DataFrame, keys: list[str], roi: str = "roi") -> DataFrame:
    """Weighted mean: sum(v w) / sum(w)."""
    return dots(pixels, masks, keys, roi).join(small(norms(masks, roi)), roi).select(*keys, roi, (F.col("dot") / F.col("l1")).alias("value"))


def surround_corrected(pixels: DataFrame, masks: DataFrame, rings: DataFrame, weight: float, keys: list[str], roi: str = "roi") -> DataFrame:
    """Ring subtraction on the scale of means, then rescaled: (F - weight * ring) * L1 / L2^2; keeps the ring on the same scale."""
    ring = dots(pixels, rings, keys, roi).withColumnRenamed("dot", "ring")
    inner = dots(pixels, masks, keys, roi).join(small(norms(masks, roi)), roi)
    both = inner.join(ring, [*keys, roi], "left").withColumn("ring", F.coalesce("ring", F.lit(0.0)))
    scale = F.col("l1") / F.col("l2")
    return both.select(*keys, roi, ((F.col("dot") / F.col("l1") - weight * F.col("ring")) * scale).alias("value"), (F.col("ring") * scale).alias("neuropil"))


def gram(masks: DataFrame, roi: str = "roi") -> DataFrame:
    """(roi_i, roi_j, g): inner products of overlapping masks."""
    a, b = masks.select("pix", F.col(roi).alias("roi_i"), F.col("w").alias("wi")), masks.select("pix", F.col(roi).alias("roi_j"), F.col("w").alias("wj"))
    return a.join(b, "pix").groupBy("roi_i", "roi_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("g"))


def overlap_fraction(masks: DataFrame, roi: str = "roi") -> DataFrame:
    """Largest share of a region's pixels that one other region has too."""
    a, b = masks.select("pix", F.col(roi).alias("roi_i")), masks.select("pix", F.col(roi).alias("roi_j"))
    shared = a.join(b, "pix").where("roi_i <> roi_j").groupBy("roi_i", "roi_j").agg(F.count("*").alias("n"))
    most = shared.groupBy("roi_i").agg(F.max("n").alias("n"))
    size = masks.groupBy(F.col(roi).alias("roi_i")).agg(F.count("*").alias("size"))
    return size.join(most, "roi_i", "left").select(F.col("roi_i").alias(roi), (F.coalesce("n", F.lit(0)) / F.col("size")).alias("overlap"))


def ring_masks(masks: DataFrame, rings: DataFrame, roi: str = "roi") -> DataFrame:
    """Candidate ring pixels that lie in no region, each of weight 1 / count; (roi, pix, w)."""
    free = rings.join(small(masks.select("pix").distinct()), "pix", "left_anti")
    count = free.groupBy(roi).agg(F.count("*").alias("n"))
    return free.join(small(count), roi).select(roi, "pix", (F.lit(1.0) / F.col("n")).alias("w"))


def reconstruct(traces: DataFrame, masks: DataFrame, keys: list[str], roi: str = "roi") -> DataFrame:
    """(keys, pix, v): traces times masks."""
    return traces.join(small(masks), roi).groupBy(*keys, "pix").agg(F.sum(F.col("value") * F.col("w")).alias("v"))


def resolve_neuropil(use: bool | str | None, computed: list[str]) -> str | None:
    """Which neuropil estimate to use: none, the named one, or the only one there is."""
    if use is False:
        return None
    if isinstance(use, str):
        if use not in computed:
            raise ValueError(f"{use} has not been computed")
        return use
    if len(computed) > 1:
        raise ValueError("several neuropil estimates: name one")
    return computed[0] if computed else None


def parts_of(n: int, pairs) -> list[np.ndarray]:
    """Connected parts of 0..n-1 under pairs of neighbours."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    by: dict[int, list[int]] = {}
    for i in range(n):
        by.setdefault(root(i), []).append(i)
    return [np.array(x) for x in by.values()]


class JointSolver:
    """Regression of all masks, and of background components if there are any, at once.

    The Gram matrix comes from the executors as its non-zero entries; its parts
    that no overlap connects are factored one by one, so a field of many regions
    needs many small matrices and never a square one of all. The background's
    time courses are free, so they are eliminated first: what is left is a
    problem in the regions alone. Without a sign constraint the background is a
    correction of as many ranks as it has components; with one, the regions that
    it couples are one problem (as many rows and columns as regions). Ridge is
    relative to the diagonal; masks without weight get the mean diagonal.
    """

    def __init__(self, masks: DataFrame, background: DataFrame | None = None, ridge: float = 1e-6, nonnegative: bool = False, order: list | None = None, roi: str = "roi") -> None:
        if not np.isfinite(ridge) or ridge < 0:
            raise ValueError("ridge must be finite and not negative")
        self.roi, self.nonnegative, self.masks = roi, nonnegative, masks
        self.order = order if order is not None else [r[0] for r in masks.select(roi).distinct().orderBy(roi).collect()]
        rows, n = {r: i for i, r in enumerate(self.order)}, len(self.order)
        entries = [(rows[r.roi_i], rows[r.roi_j], r.g) for r in gram(masks, roi).collect()]
        self.diagonal = np.zeros(n)
        for i, j, g in entries:
            if i == j:
                self.diagonal[i] = g
        good = self.diagonal > 0
        added = np.where(good, ridge * self.diagonal, self.diagonal[good].mean() if good.any() else 1.0)
        self.parts = parts_of(n, [(i, j) for i, j, _ in entries if i < j])
        place = {int(i): (k, a) for k, at in enumerate(self.parts) for a, i in enumerate(at)}
        self.blocks = [np.diag(added[at]) for at in self.parts]
        for i, j, g in entries:
            self.blocks[place[i][0]][place[i][1], place[j][1]] += g
        self.inverses = [np.linalg.pinv(b, hermitian=True) for b in self.blocks]
        self.components, self.background = [], None
        if background is not None:
            self.background = background.select(F.col("component").alias(roi), "pix", F.col("b").alias("w"))
            self.components = sorted(r[0] for r in self.background.select(roi).distinct().collect())
        at, k = {c: i for i, c in enumerate(self.components)}, len(self.components)
        own, self.cross = np.zeros((k, k)), np.zeros((n, k))
        if k:
            for r in gram(self.background, roi).collect():
                own[at[r.roi_i], at[r.roi_j]] = r.g
            met = masks.select("pix", F.col(roi).alias("i"), "w").join(background.select("pix", "component", "b"), "pix")
            for r in met.groupBy("i", "component").agg(F.sum(F.col("w") * F.col("b")).alias("g")).collect():
                self.cross[rows[r.i], at[r.component]] = r.g
        self.own_inverse = np.linalg.pinv(own, hermitian=True) if k else own
        half = self._by_part(self.cross.T, self.inverses).T
        self.correction = half, np.linalg.pinv(own - self.cross.T @ half, hermitian=True) if k else own

    def _by_part(self, y: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
        """Rows of y times the block-diagonal matrix."""
        out = np.zeros(y.shape)
        for at, m in zip(self.parts, matrices, strict=True):
            out[:, at] = y[:, at] @ m
        return out

    def solve(self, ya: np.ndarray, yb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(traces, background of each region) from inner products with masks and components; rows are frames."""
        coupled = len(self.components) > 0
        target = ya - yb @ self.own_inverse @ self.cross.T if coupled else ya
        if not self.nonnegative:
            c = self._by_part(target, self.inverses)
            if coupled:
                half, middle = self.correction
                c = c + (target @ half) @ middle @ half.T
        elif coupled:
            whole = np.zeros((len(self.order),) * 2)
            for at, b in zip(self.parts, self.blocks, strict=True):
                whole[np.ix_(at, at)] = b
            c = nnls(whole - self.cross @ self.own_inverse @ self.cross.T, target)
        else:
            c = np.zeros(target.shape)
            for at, b in zip(self.parts, self.blocks, strict=True):
                c[:, at] = nnls(b, target[:, at])
        f = (yb - c @ self.cross) @ self.own_inverse
        return c, f @ self.cross.T / np.where(self.diagonal > 0, self.diagonal, 1.0)

    def plain(self) -> JointSolver:
        """The matrices alone, without DataFrames, as executors get them."""
        out = object.__new__(JointSolver)
        out.__dict__ = {k: v for k, v in self.__dict__.items() if k not in ("masks", "background")}
        return out

    def on_frames(self, frames: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, roi, value, background) of rows that hold whole frames in ``pixels``: no shuffle."""
        solver = self.plain()
        sets = [FlatMasks(self.masks, self.order, self.roi)] + ([FlatMasks(self.background, self.components, self.roi)] if self.components else [])
        return frame_traces(frames, keys, sets, lambda ya, yb=None: solver.solve(ya, np.zeros((len(ya), 0)) if yb is None else yb), self.masks.schema[self.roi].dataType.simpleString(), self.roi)

    def __call__(self, pixels: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, roi, value, background) of pixel rows: one solve for each key."""
        order, components, roi = self.order, self.components, self.roi
        rows, place = {r: i for i, r in enumerate(order)}, {c: i for i, c in enumerate(components)}
        inner = dots(pixels, self.masks, keys, roi).groupBy(*keys).agg(F.collect_list(F.struct(F.col(roi).alias("k"), "dot")).alias("__a"))
        if components:
            outer = dots(pixels, self.background, keys, roi).groupBy(*keys).agg(F.collect_list(F.struct(F.col(roi).alias("k"), "dot")).alias("__b"))
            inner = inner.join(outer, keys, "left")
        else:
            inner = inner.withColumn("__b", F.lit(None).cast("array<struct<k: int, dot: double>>"))
        kind = {f.name: f.dataType.simpleString() for f in inner.schema.fields} | {roi: self.masks.schema[roi].dataType.simpleString()}
        solver = self.plain()

        def run(batches):
            for batch in batches:
                ya, yb = np.zeros((len(batch), len(order))), np.zeros((len(batch), len(components)))
                for out, at, column in ((ya, rows, "__a"), (yb, place, "__b")):
                    for t, pairs in enumerate(batch[column]):
                        for p in pairs if pairs is not None else ():
                            out[t, at[p["k"]]] = p["dot"]
                c, back = solver.solve(ya, yb)
                out = batch[keys].loc[batch.index.repeat(len(order))].reset_index(drop=True)
                out[roi], out["value"], out["background"] = order * len(batch), c.ravel(), back.ravel()
                yield out

        return inner.mapInPandas(run, ", ".join(f"`{k}` {kind[k]}" for k in [*keys, roi]) + ", value double, background double")


class FlatMasks:
    """Masks as flat arrays, region after region: what an executor needs to take a frame's inner products.

    As large as the region list (pixels of all regions), whatever the movie.
    """

    def __init__(self, masks: DataFrame, order: list, roi: str = "roi") -> None:
        got = masks.select(F.col(roi).alias("roi"), F.col("pix").cast("long").alias("pix"), F.col("w").cast("double").alias("w")).toArrow()
        number = {r: i for i, r in enumerate(order)}
        which = np.array([number.get(r, -1) for r in got.column("roi").to_pylist()], np.int64)
        keep = which >= 0
        sort = np.argsort(which[keep], kind="stable")
        self.order, self.pix, self.w = list(order), got.column("pix").to_numpy()[keep][sort], got.column("w").to_numpy()[keep][sort]
        self.edge = np.searchsorted(which[keep][sort], np.arange(len(order) + 1))

    @property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """L1 and squared L2 norms, zero norms as 1."""
        one = lambda x: np.where(x == 0, 1.0, x)
        total = lambda v: np.diff(np.concatenate(([0.0], np.cumsum(v)))[self.edge])
        return one(total(self.w)), one(total(self.w**2))

    def dot(self, x: np.ndarray) -> np.ndarray:
        """Frames (rows of pixels) times masks."""
        out = np.zeros((len(x), len(self.order)))
        full = np.flatnonzero(np.diff(self.edge))
        if len(full):
            step = max(1, (1 << 20) // max(1, len(self.pix)))
            for a in range(0, len(x), step):
                out[a : a + step, full] = np.add.reduceat(x[a : a + step, self.pix].astype(float) * self.w, self.edge[full], axis=1)
        return out


def frame_traces(frames: DataFrame, keys: list[str], sets: list[FlatMasks], combine, kind: str = "string", roi: str = "roi") -> DataFrame:
    """(keys, roi, value, background): ``combine`` of the inner products of each set with frames that are whole in a row."""
    order, shared = sets[0].order, frames.sparkSession.sparkContext.broadcast(sets)
    roi_type = pa.int64() if kind in ("bigint", "long") else pa.int32() if kind == "int" else pa.string()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pixels = batch.column(len(keys))
            x = pixels.flatten().to_numpy(zero_copy_only=False).reshape(len(pixels), -1)
            value, back = combine(*[s.dot(x) for s in shared.value])
            n = len(order)
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), n))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(repeat) for i in range(len(keys))], pa.array(order * batch.num_rows, roi_type), pa.array(value.ravel()), pa.array(back.ravel() if back is not None else np.full(value.size, np.nan), from_pandas=True)], names=[*keys, roi, "value", "background"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    return frames.select(*keys, "pixels").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{roi}` {kind}, value double, background double")


def projection_of_frames(frames: DataFrame, masks: DataFrame, keys: list[str], order: list, roi: str = "roi") -> DataFrame:
    """(keys, roi, value, background null): each mask's least squares, a frame at a time."""
    flat = FlatMasks(masks, order, roi)
    l2 = flat.sums[1]
    return frame_traces(frames, keys, [flat], lambda y: (y / l2, None), masks.schema[roi].dataType.simpleString(), roi)


def surround_of_frames(frames: DataFrame, masks: DataFrame, rings: DataFrame, weight: float, keys: list[str], order: list, roi: str = "roi") -> DataFrame:
    """(keys, roi, value, background): ring subtraction on the scale of means, then rescaled; the ring on that scale."""
    inner, outer = FlatMasks(masks, order, roi), FlatMasks(rings, order, roi)
    l1, l2 = inner.sums
    return frame_traces(frames, keys, [inner, outer], lambda y, r: ((y / l1 - weight * r) * (l1 / l2), r * (l1 / l2)), masks.schema[roi].dataType.simpleString(), roi)


def global_neuropil(frames: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g): mean of a frame outside all masks, one row a frame."""
    taken = masks.select("pix").distinct()
    outside = explode_pixels(frames.select(*keys, "pixels")).join(small(taken), "pix", "left_anti")
    return outside.groupBy(*keys).agg(F.avg("v").alias("g"))


def condition(gram_: np.ndarray) -> float:
    """Condition number of a Gram matrix; traces are ill-determined beyond 10^6."""
    return float(np.linalg.cond(gram_)) if len(gram_) else 1.0


def weighted(value: Column, background: Column, weight: float) -> Column:
    """A joint solution with only part of its background removed."""
    return value + (1.0 - weight) * background
