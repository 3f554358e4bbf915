"""Streaming ingestion of frame files: mask sums by frame as frames arrive, and running images by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FRAMES, explode_pixels

TIMED = FRAMES + ", ts timestamp"


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(TIMED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trace_stream(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """(epoch_index, frame, plane_index, roi, value): a frame is whole in one row, so no state is kept."""
    weights = masks.groupBy("roi").agg(F.collect_list(F.struct("pix", "w")).alias("m"), F.sum(F.col("w") * F.col("w")).alias("l2"))
    dot = F.aggregate("m", F.lit(0.0), lambda s, p: s + p["w"] * F.element_at("pixels", (p["pix"] + 1).cast("int")).cast("double"))
    return frames.crossJoin(F.broadcast(weights)).select("epoch_index", "frame", "plane_index", "roi", (dot / F.col("l2")).alias("value"))  # one row a region


def image_stream(frames: DataFrame, window: str = "10 seconds", late: str = "5 seconds") -> DataFrame:
    """Mean image of each tumbling window; frames later than the watermark are dropped."""
    p = explode_pixels(frames.withWatermark("ts", late))
    return p.groupBy(F.window("ts", window), "plane_index", "pix").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
