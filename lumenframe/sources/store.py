"""Parquet store for movies, regions and derived tables, one loader for all stored forms, and a registry for other formats."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import Epoch, Imaging, Rois
from .arrays import describe

READERS: dict[str, Callable] = {}


def reader_name(name: str) -> str:
    """CamelCase extractor names as read_ functions."""
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    return "read_" + snake.removesuffix("_extractor").replace("_imaging", "").replace("_extractor", "")


def register_source(name: str, reader: Callable) -> str:
    """Adds a reader, a function (spark, path, **options) -> Imaging or Rois, under its read_ name."""
    key = reader_name(name)
    if key in READERS:
        raise ValueError(f"{key} is registered")
    READERS[key] = reader
    return key


def read(spark: SparkSession, name: str, path, **options):
    """Reads with a registered reader, given by its name or by its read_ name; options by keyword only."""
    key = name if name in READERS else reader_name(name)
    if key not in READERS:
        raise ValueError(f"no reader {key}: {sorted(READERS)}")
    return READERS[key](spark, path, **options)


def reader_class(name: str) -> type:
    """A class of a registered reader: constructing it reads, and its attributes are those of what was read."""
    key = name if name in READERS else reader_name(name)
    if key not in READERS:
        raise ValueError(f"no reader {key}: {sorted(READERS)}")

    class Reader:
        def __init__(self, spark: SparkSession, path, **options) -> None:
            self.content, self.path, self.options = READERS[key](spark, path, **options), path, options

        def __getattr__(self, attribute):
            return getattr(self.content, attribute)

    Reader.__name__ = Reader.__qualname__ = "".join(w.capitalize() for w in key.removeprefix("read_").split("_"))
    return Reader


def _meta(spark: SparkSession, path: str, kind: str, content: str, mode: str) -> None:
    spark.createDataFrame([(kind, content)], "kind string, content string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def save_imaging(movie: Imaging, path: str, mode: str = "errorifexists", compression: str = "zstd") -> None:
    """Frames by epoch, sorted by frame so that frame ranges are pruned."""
    _meta(movie.spark, path, "imaging", describe(movie), mode)
    # ranges of frames: a long epoch is many tasks and many files
    by = movie.frames.repartitionByRange("epoch_index", "frame").sortWithinPartitions("epoch_index", "frame", "plane_index")
    by.write.mode(mode).option("compression", compression).partitionBy("epoch_index").parquet(f"{path}/frames")
    if movie.times is not None:
        movie.times.write.mode(mode).parquet(f"{path}/times")


def save_rois(rois: Rois, path: str, mode: str = "errorifexists") -> None:
    spark = rois.masks.sparkSession
    _meta(spark, path, "rois", json.dumps({"height": rois.height, "width": rois.width, "order": list(rois.order), "n_planes": rois.n_planes, "fs": rois.fs, "properties": rois.properties is not None}), mode)
    rois.masks.repartitionByRange("roi_id").sortWithinPartitions("roi_id").write.mode(mode).parquet(f"{path}/masks")
    if rois.properties is not None:
        rois.properties.write.mode(mode).parquet(f"{path}/properties")


def load(spark: SparkSession, path: str, group: str = "rois"):
    """Whatever was saved there, told by its own marker: a chunked store, a folder of flat files or arrays, a detector's folder, or tables."""
    from . import files, regions
    from .chunked import group_attributes, is_store
    from .recording import read_binary_folder, read_chunked

    if not files.reachable(path):
        return _load_tables(spark, path)
    if is_store(path):
        if files.exists(f"{path}/video_epoch0"):
            return read_chunked(spark, path)
        if "shape" in group_attributes(f"{path}/{group}"):
            return regions.read_rois_chunked(spark, path, group)
        raise ValueError(f"{path} holds neither a movie nor regions")
    if files.exists(f"{path}/metadata.json") and any(files.exists(f"{path}/roi_image_masks.{e}") for e in ("npy", "npz")):
        return regions.read_rois_folder(spark, path)
    if files.exists(f"{path}/binary.json"):
        return read_binary_folder(spark, path)
    if files.exists(f"{path}/stat.npy"):
        return regions.read_detector_folder(spark, path)
    if not files.exists(f"{path}/meta"):
        raise ValueError(f"nothing that can be loaded at {path}")
    return _load_tables(spark, path)


def _load_tables(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/meta").first()
    told = json.loads(row.content)
    if row.kind == "imaging":
        frames = spark.read.parquet(f"{path}/frames").select(F.col("epoch_index").cast("int"), "frame", "plane_index", "pixels")
        epochs = tuple(Epoch(n, t) for n, t in told["epochs"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/times")
        has = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        return Imaging(frames, told["fs"], told["height"], told["width"], epochs, tuple(told["plane_ids"]), told["dtype"], spark.read.parquet(f"{path}/times") if has else None, told["annotations"])
    if row.kind == "rois":
        props = spark.read.parquet(f"{path}/properties") if told.pop("properties") else None
        return Rois(spark.read.parquet(f"{path}/masks"), told["height"], told["width"], tuple(told["order"]), told["n_planes"], told["fs"], props)
    if row.kind == "analysis":
        from ..plans.graph import Analysis

        return Analysis.load(spark, path)
    raise ValueError(f"unknown kind {row.kind}")


def _register_own() -> None:
    from . import recording, regions

    own = {"BinaryImaging": recording.read_binary, "BinaryFolderImaging": recording.read_binary_folder, "ZarrImaging": recording.read_chunked}
    own |= {"BinaryFolderRois": regions.read_rois_folder, "ZarrRois": regions.read_rois_chunked, "DetectorRois": regions.read_detector_folder}
    for name, reader in own.items():
        READERS.setdefault("read_" + "_".join(w.lower() for w in re.findall("[A-Z][a-z]+", name)), reader)


_register_own()
