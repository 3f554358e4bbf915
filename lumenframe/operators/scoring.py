"""Scores, rankings and whole-pixel registration as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def footprint_correlation(a: DataFrame, b: DataFrame, field: int, roi: str = "roi", every: bool = True) -> DataFrame:
    """Pearson correlation of every two footprints over a field of so many pixels, from sparse sums.

    With ``every`` off only footprints that share a pixel are paired: no others of
    non-negative weights correlate above 0, and the pairs are as many as overlaps.
    """
    stats = lambda m, s: m.groupBy(F.col(roi).alias(f"roi_{s}")).agg(F.sum("w").alias(f"s_{s}"), F.sum(F.col("w") * F.col("w")).alias(f"q_{s}"))
    met = a.select("pix", F.col(roi).alias("roi_i"), F.col("w").alias("wi")).join(b.select("pix", F.col(roi).alias("roi_j"), F.col("w").alias("wj")), "pix")
    met = met.groupBy("roi_i", "roi_j").agg(F.sum(F.col("wi") * F.col("wj")).alias("c"))
    if every:  # all pairs are what is asked for
        paired = stats(a, "i").crossJoin(stats(b, "j")).join(met, ["roi_i", "roi_j"], "left")
    else:
        paired = met.join(stats(a, "i"), "roi_i").join(stats(b, "j"), "roi_j")
    n = float(field)
    top = n * F.coalesce("c", F.lit(0.0)) - F.col("s_i") * F.col("s_j")
    spread = lambda s: n * F.col(f"q_{s}") - F.col(f"s_{s}") * F.col(f"s_{s}")
    return paired.select("roi_i", "roi_j", (top / F.nullif(F.sqrt(spread("i") * spread("j")), F.lit(0.0))).alias("corr"))


def assign_footprints(corr: DataFrame, least: float = 0.5) -> DataFrame:
    """(roi_i, roi_j, corr): the one-to-one matching of the largest total correlation, pairs above ``least`` only.

    Only pairs above the limit can stay, so the matching falls into their connected
    parts; the pairs are as many as overlaps of footprints.
    """
    rows = [(r.roi_i, r.roi_j, r["corr"]) for r in corr.where(F.col("corr") > least).collect()]
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    worth = np.zeros((len(left), len(right)))
    at_l, at_r = {v: i for i, v in enumerate(left)}, {v: i for i, v in enumerate(right)}
    for i, j, c in rows:
        worth[at_l[i], at_r[j]] = c
    found = [(left[i], right[j], float(worth[i, j])) for i, j in best_matching(worth) if worth[i, j] > least]
    kinds = {f.name: f.dataType.simpleString() for f in corr.schema.fields}
    return corr.sparkSession.createDataFrame(found, f"roi_i {kinds['roi_i']}, roi_j {kinds['roi_j']}, corr double")


def best_matching(worth: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total worth, by shortest augmenting paths with prices (Jonker and Volgenant 1987)."""
    rows, cols = worth.shape
    if rows > cols:
        return sorted((i, j) for j, i in best_matching(worth.T))
    cost = worth.max(initial=0.0) - worth
    price_row, price_col, owner = np.zeros(rows), np.zeros(cols), np.full(cols, -1)
    for row in range(rows):
        far, came, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        now, base, last = row, 0.0, -1
        while True:
            step = base + cost[now] - price_row[now] - price_col
            closer = ~done & (step < far)
            far[closer], came[closer] = step[closer], last
            last = int(np.where(done, np.inf, far).argmin())
            base, done[last] = far[last], True
            if owner[last] < 0:
                break
            now = owner[last]
        # prices of what was reached, then the path is turned over
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                price_row[owner[j]] += base - far[j]
            price_col[j] -= base - far[j]
        price_row[row] += base
        while last >= 0:
            before = came[last]
            owner[last] = owner[before] if before >= 0 else row
            last = before
    return sorted((int(i), j) for j, i in enumerate(owner) if i >= 0)


def smallest_files(files: DataFrame, k: int, size: str, path: str, tie: str) -> DataFrame:
    """The smallest file of each animal, then the k smallest of each indicator."""
    order = [size, path, tie]
    own = F.row_number().over(Window.partitionBy("indicator", "animal").orderBy(*order))
    best = files.withColumn("__r", own).where("__r = 1")
    return best.withColumn("__r", F.row_number().over(Window.partitionBy("indicator").orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def ranked(rows: DataFrame, score: str, tie: str, *by: str) -> DataFrame:
    """Adds ``rank``, 1 for the highest score of its group; ties by the given column."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def first_that(rows: DataFrame, condition: Column, by: str, order: str) -> DataFrame:
    return rows.where(condition).groupBy(by).agg(F.min_by(order, order).alias("first_id"))


def summary(scores: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Mean score by either grouping and over all, in one pass."""
    grouped = scores.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b))
    return grouped.agg(F.avg(score).alias(score), F.count("*").alias("n"))


def shift_pixels(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Moves each pixel by whole (dy, dx); what leaves the field is dropped."""
    y, x = F.floor(F.col("pix") / width) + F.col("dy"), F.col("pix") % width + F.col("dx")
    moved = pixels.withColumns({"__y": y, "__x": x}).where(f"__y >= 0 and __y < {height} and __x >= 0 and __x < {width}")
    return moved.withColumn("pix", F.col("__y") * width + F.col("__x")).drop("__y", "__x", "dy", "dx")


def best_integer_shift(frames: DataFrame, reference: np.ndarray, most: int) -> DataFrame:
    """(frame, dy, dx, score): the cyclic shift of each frame that fits a reference image best; ties to the smaller.

    All shifts of a frame at once, by Fourier transforms in the frame's own row.
    """
    h, w = reference.shape
    wave = np.conj(np.fft.fft2(reference))
    steps = np.arange(-most, most + 1)

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, h, w).astype(float)
            # entry (a, b) is the sum of v[y, x] r[y - a, x - b]: the frame moved by (-a, -b)
            every = np.fft.ifft2(np.fft.fft2(x) * wave).real
            score = every[:, -steps % h][:, :, -steps % w]
            best = np.round(score, 9).reshape(batch.num_rows, -1).argmax(axis=1)
            dy, dx = steps[best // len(steps)], steps[best % len(steps)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dy.astype(np.int32)), pa.array(dx.astype(np.int32)), pa.array(score.reshape(batch.num_rows, -1)[np.arange(batch.num_rows), best])], names=["frame", "dy", "dx", "score"])

    return frames.select("frame", "pixels").mapInArrow(run, "frame long, dy int, dx int, score double")
