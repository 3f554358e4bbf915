"""Images and reductions of a movie's pixels (keys..., frame, pix, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image(pixels: DataFrame, how=F.avg, by: tuple[str, ...] = (), name: str = "v") -> DataFrame:
    """One aggregate for each pixel: mean, deviation, maximum, ..."""
    return pixels.groupBy(*by, "pix").agg(how("v").alias(name))


def sampled_frames(total: int, count: int) -> list[int]:
    """Evenly spaced frame numbers, ends included."""
    if count >= total:
        return list(range(total))
    return sorted({round(i * (total - 1) / max(1, count - 1)) for i in range(count)})


def average_image(frames: DataFrame, total: int, chunks: int = 20, chunk: int = 30) -> DataFrame:
    """Mean over evenly spaced chunks of frames."""
    from ..model import explode_pixels

    starts = sampled_frames(max(1, total - chunk + 1), chunks)
    keep = sorted({f for s in starts for f in range(s, min(total, s + chunk))})
    return image(explode_pixels(frames.where(F.col("frame").isin(keep))), F.avg, ("plane_index",))


def temporal_bins(pixels: DataFrame, size: int, batch: int) -> DataFrame:
    """Mean of runs of ``size`` frames in each batch; a batch's incomplete last run goes, unless the batch is one."""
    numbered = pixels.withColumns({"batch": F.floor(F.col("frame") / batch), "at": F.col("frame") % batch})
    length = numbered.groupBy("batch").agg((F.max("at") + 1).alias("length"))
    binned = numbered.join(length, "batch").withColumn("bin", F.floor(F.col("at") / size))
    whole = binned.where((F.col("length") <= size) | ((F.col("bin") + 1) * size <= F.col("length")))
    return whole.groupBy("batch", "bin", "pix").agg(F.avg("v").alias("v"))


def bin_median(pixels: DataFrame, windows: int) -> DataFrame:
    """Median over strided bins (frame mod windows) of the bins' means."""
    means = pixels.groupBy("pix", (F.col("frame") % windows).alias("bin")).agg(F.avg("v").alias("v"))
    return means.groupBy("pix").agg(F.median("v").alias("v"))


def split_templates(pixels: DataFrame, chunks: int, total: int) -> DataFrame:
    """(chunk, pix, v): mean of each run of frames without NaN; a pixel that is NaN throughout gets its chunk's least."""
    clean = F.when(~F.isnan("v"), F.col("v"))
    means = pixels.groupBy(F.floor(F.col("frame") * chunks / total).alias("chunk"), "pix").agg(F.avg(clean).alias("v"))
    least = means.groupBy("chunk").agg(F.min("v").alias("least"))
    return means.join(least, "chunk").select("chunk", "pix", F.coalesce("v", "least").alias("v"))


def template(pixels: DataFrame, chunks: int, total: int) -> DataFrame:
    """(pix, v): median over the split templates."""
    return split_templates(pixels, chunks, total).groupBy("pix").agg(F.median("v").alias("v"))


def temporal_projection(pixels: DataFrame, courses: DataFrame) -> DataFrame:
    """(component, pix, v): the sum over frames of a course (component, frame, f) times the movie."""
    return pixels.join(courses, "frame").groupBy("component", "pix").agg(F.sum(F.col("f") * F.col("v")).alias("v"))


def padded_histogram(traces: DataFrame, bins: int, value: str = "value", roi: str = "roi") -> DataFrame:
    """(roi, bin, n): counts of each trace over its range widened by a tenth at both ends; constant traces have none.

    A bin is the whole part of the distance from the lower end over the bin's width: a value on an edge goes where that quotient puts it.
    """
    span = traces.groupBy(roi).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).where("__b > __a")
    extent = F.col("__b") - F.col("__a")
    at = F.floor((F.col(value) - (F.col("__a") - extent / 10)) / (extent * F.lit(1.2) / F.lit(float(bins))))
    return traces.join(span, roi).groupBy(roi, at.alias("bin")).agg(F.count("*").alias("n"))


def binned(pixels: DataFrame, width: int, time: int, space: int) -> DataFrame:
    """Mean over blocks of time x space x space."""
    y, x = F.floor(F.col("pix") / width), F.col("pix") % width
    return pixels.groupBy(F.floor(F.col("frame") / time).alias("t"), F.floor(y / space).alias("by"), F.floor(x / space).alias("bx")).agg(F.avg("v").alias("v"))


def norm_squared(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.sum(F.col("v") * F.col("v")).alias("norm_sq"))


def kept_batches(total: int, size: int, nbins: int, batch: int = 500) -> list[int]:
    """Numbers of the batches read when at most ``nbins`` bins are wanted: all, or evenly spaced ones from the first to the last."""
    count = -(-total // batch)
    n = max(1, min(nbins // max(1, batch // size), count))
    return [int(i * (count - 1) / max(1, n - 1)) for i in range(n)]


def percentile(value: Column, level: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(value, level)
