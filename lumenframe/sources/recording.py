"""A Spark data source of frame ranges: flat binary files and chunked arrays, read by as many tasks as there are ranges.

Filters on epoch, frame and plane reach the reader, so a frame range reads just
its own bytes (of a flat file) or the chunks that it meets (of a chunked array).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..model import FRAMES, Epoch, Imaging
from . import files
from .chunked import Chunked

#: Bytes of pixels of one task, and of one Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Pixel types of flat files: plain names for the user, byte order as stored.
KINDS = {"uint8": "u1", "int8": "i1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


class Range(InputPartition):
    def __init__(self, epoch: int, start: int, stop: int) -> None:
        self.epoch, self.start, self.stop = epoch, start, stop


class FrameSource(DataSource):
    """Option ``plan``: JSON of the epochs, each with its kind, place, shape and number of frames."""

    @classmethod
    def name(cls) -> str:
        return "recording_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(json.loads(self.options["plan"]), int(self.options.get("bytes", PARTITION_BYTES)))


class FrameReader(DataSourceReader):
    def __init__(self, epochs: list[dict], size: int) -> None:
        self.epochs, self.size = epochs, size
        self.low, self.high = 0, None
        self.only: dict[str, set[int] | None] = {"epoch_index": None, "plane_index": None, "frame": None}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In) and name in self.only:
                told = {int(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)}
                self.only[name] = told if self.only[name] is None else self.only[name] & told
            elif name == "frame" and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == "frame" and isinstance(f, LessThan | LessThanOrEqual):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            else:
                yield f

    def partitions(self):
        out = []
        for e, told in enumerate(self.epochs):
            if self.only["epoch_index"] is not None and e not in self.only["epoch_index"]:
                continue
            low, high = self.low, told["n"] if self.high is None else min(self.high, told["n"])
            if (some := self.only["frame"]) is not None:
                some = [f for f in some if low <= f < high]
                low, high = (min(some), max(some) + 1) if some else (0, 0)
            step = max(1, self.size // (4 * told["shape"][0] * told["shape"][1] * told["shape"][2]))
            if told["kind"] == "chunked":  # a chunk is read by one task only
                length = told["array"]["chunks"][0]
                step = max(1, step // length) * length
            out += [Range(e, max(low, a), min(high, a + step)) for a in range(low // step * step, high, step) if min(high, a + step) > max(low, a)]
        return out or [Range(0, 0, 0)]

    def read(self, part: Range):
        told = self.epochs[part.epoch] if self.epochs else None
        if told is None or part.stop <= part.start:
            return
        h, w, p = told["shape"]
        planes = [i for i in range(p) if self.only["plane_index"] is None or i in self.only["plane_index"]]
        step = max(1, BATCH_BYTES // (4 * h * w * p))
        if told["kind"] == "chunked":
            step = max(1, step // told["array"]["chunks"][0]) * told["array"]["chunks"][0]
        for a in range(part.start // step * step, part.stop, step):
            a, b = max(a, part.start), min(part.stop, a + step)
            if (some := self.only["frame"]) is not None and not any(a <= f < b for f in some):
                continue
            x = block(told, a, b)[:, :, :, planes]
            numbers = np.arange(a, b)
            if some is not None:
                keep = np.isin(numbers, list(some))
                x, numbers = x[keep], numbers[keep]
            yield batch_of(part.epoch, numbers, planes, x)


def batch_of(epoch: int, frames: np.ndarray, planes: list[int], x: np.ndarray) -> pa.RecordBatch:
    """Rows of frames (T, H, W, P)."""
    n, area = len(frames) * len(planes), x.shape[1] * x.shape[2]
    flat = np.ascontiguousarray(x.transpose(0, 3, 1, 2), dtype=np.float32).reshape(-1)
    pixels = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * area, pa.int32()), pa.array(flat))
    columns = [pa.array(np.full(n, epoch, np.int32)), pa.array(np.repeat(frames, len(planes)).astype(np.int64)), pa.array(np.tile(np.array(planes, np.int32), len(frames))), pixels]
    return pa.RecordBatch.from_arrays(columns, names=["epoch_index", "frame", "plane_index", "pixels"])


def block(told: dict, start: int, stop: int) -> np.ndarray:
    """Frames [start, stop) of an epoch, (T, H, W, P)."""
    h, w, p = told["shape"]
    if told["kind"] == "flat":
        kind = np.dtype(told["dtype"])
        size = h * w * p * kind.itemsize
        data = files.read_bytes(told["path"], told["offset"] + start * size, (stop - start) * size)
        return np.frombuffer(data, kind).reshape(stop - start, h, w, p)
    return Chunked(**told["array"]).read((start, stop)).reshape(stop - start, h, w, p)


def frames_of(spark: SparkSession, epochs: list[dict], size: int = PARTITION_BYTES) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    return spark.read.format("recording_frames").option("plan", json.dumps(epochs)).option("bytes", size).load()


def times_of(spark: SparkSession, told: list[dict | None], step: int = 1 << 20) -> DataFrame | None:
    """(epoch_index, frame, t) of the epochs with a time vector: a flat file of float64, or a chunked array."""
    rows = [(e, a, min(a + step, x["n"])) for e, x in enumerate(told) if x for a in range(0, x["n"], step)]
    if not rows:
        return None

    def read(batches):
        for batch in batches:
            for e, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = told[e]
                t = Chunked(**x["array"]).read((a, b)) if x["kind"] == "chunked" else np.frombuffer(files.read_bytes(x["path"], 8 * a, 8 * (b - a)), "<f8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, e, np.int32)), pa.array(np.arange(a, b)), pa.array(t.astype(float))], names=["epoch_index", "frame", "t"])

    parts = spark.createDataFrame(rows, "epoch_index int, a long, b long").repartition(min(len(rows), 1000))
    return parts.mapInArrow(read, "epoch_index int, frame long, t double")


def read_binary(spark: SparkSession, paths, fs: float, shape: tuple[int, ...], dtype: str = "uint16", t_starts=None, offset: int = 0, timestamps=None, plane_ids=None, partition_bytes: int = PARTITION_BYTES) -> Imaging:
    """Flat files of frames (H, W[, P]), one to an epoch; a trailing part of a frame is not read.

    ``timestamps`` are files of float64 seconds, one value a frame. A frame range
    reads its own bytes only; a file of any size is read by many tasks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    timestamps = [timestamps] if isinstance(timestamps, str) else list(timestamps or [None] * len(paths))
    starts = list(t_starts) if t_starts is not None else [0.0] * len(paths)
    if len(starts) != len(paths) or len(timestamps) != len(paths):
        raise ValueError("one start and one file of times for each file")
    h, w, p = (*shape, 1)[:3]
    kind = np.dtype(KINDS.get(dtype, dtype))
    plan = [{"kind": "flat", "path": x, "offset": offset, "dtype": kind.str, "shape": [h, w, p], "n": max(0, files.size_of(x) - offset) // (h * w * p * kind.itemsize)} for x in paths]
    times = times_of(spark, [{"kind": "flat", "path": t, "n": e["n"]} if t else None for t, e in zip(timestamps, plan, strict=True)])
    epochs = tuple(Epoch(e["n"], float(t or 0.0)) for e, t in zip(plan, starts, strict=True))
    return Imaging(frames_of(spark, plan, partition_bytes), fs, h, w, epochs, tuple(plane_ids or range(p)), kind.name, times)


def read_chunked(spark: SparkSession, path: str, compression: bool = False) -> Imaging:
    """A movie in a zarr store: arrays ``video_epoch{i}``, ``times_epoch{i}`` where there are times, ``t_starts`` and ``shape``."""
    told = group_attributes_of(path)
    shape = [int(v) for v in Chunked.open(f"{path}/shape").read()]
    h, w, p = (*shape, 1)[:3]
    arrays = [Chunked.open(f"{path}/video_epoch{i}") for i in range(told["num_epochs"])]
    plan = [{"kind": "chunked", "array": a.spec(), "shape": [h, w, p], "n": a.shape[0]} for a in arrays]
    starts = Chunked.open(f"{path}/t_starts").read() if files.exists(f"{path}/t_starts") else np.zeros(len(arrays))
    clocks = [Chunked.open(f"{path}/times_epoch{i}") if files.exists(f"{path}/times_epoch{i}") else None for i in range(len(arrays))]
    times = times_of(spark, [{"kind": "chunked", "array": c.spec(), "n": c.shape[0]} if c else None for c in clocks])
    notes = dict(told.get("annotations") or {})
    if compression:
        raw = [int(np.prod(a.shape)) * np.dtype(a.dtype).itemsize for a in arrays]
        stored = [a.stored_bytes() for a in arrays]
        notes |= {"compression_ratio": sum(raw) / max(1, sum(stored)), "compression_ratio_epochs": [r / max(1, s) for r, s in zip(raw, stored, strict=True)]}
    epochs = tuple(Epoch(a.shape[0], 0.0 if np.isnan(t) else float(t)) for a, t in zip(arrays, starts, strict=True))
    return Imaging(frames_of(spark, plan), told["sampling_frequency"], h, w, epochs, tuple(told.get("plane_ids") or range(p)), np.dtype(arrays[0].dtype).name, times, notes)


def group_attributes_of(path: str) -> dict:
    from .chunked import group_attributes

    told = group_attributes(path)
    if "sampling_frequency" not in told or "num_epochs" not in told:
        raise ValueError(f"{path} holds no movie")
    return told


# -- writing ------------------------------------------------------------------


def whole_frames(movie: Imaging) -> DataFrame:
    """(epoch_index, frame, planes): the planes of a frame in order, in one row."""
    if movie.n_planes == 1:
        return movie.frames.select("epoch_index", "frame", F.array("pixels").alias("planes"))
    rows = movie.frames.groupBy("epoch_index", "frame").agg(F.sort_array(F.collect_list(F.struct("plane_index", "pixels"))).alias("x"))
    return rows.select("epoch_index", "frame", F.transform("x", lambda v: v["pixels"]).alias("planes"))


def _volume(planes, h: int, w: int) -> np.ndarray:
    return np.stack([np.asarray(p.values if hasattr(p, "values") else p, np.float32).reshape(h, w) for p in planes], axis=-1)


def _cast(x: np.ndarray, kind: np.dtype) -> np.ndarray:
    if kind.kind in "iu":
        limits = np.iinfo(kind)
        x = np.clip(np.rint(x), limits.min, limits.max)
    return x.astype(kind)


def save_binary(movie: Imaging, folder: str, dtype: str | None = None, overwrite: bool = False) -> None:
    """A folder with a flat file for each epoch, files of times where there are any, and ``binary.json``.

    Tasks write their frames into their places of the files, so the folder must lie in a file system that all executors mount.
    """
    fs, root = files.at(folder)
    if fs.type_name != "local":
        raise ValueError("flat files are written in place: this needs a mounted folder; use a chunked store elsewhere")
    _prepare(folder, overwrite)
    fs.create_dir(root, recursive=True)
    kind, h, w, p = np.dtype(KINDS.get(dtype or movie.dtype, dtype or movie.dtype)), movie.height, movie.width, movie.n_planes
    size = h * w * p * kind.itemsize
    names = [f"traces_cached_seg{i}.raw" for i in range(len(movie.epochs))]
    for name, e in zip(names, movie.epochs, strict=True):
        with open(f"{root}/{name}", "wb") as f:
            f.truncate(e.n_frames * size)

    def write(batches):
        for batch in batches:
            for e, t, planes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with open(f"{root}/{names[e]}", "r+b") as f:
                    f.seek(t * size)
                    f.write(_cast(_volume(planes, h, w), kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    whole_frames(movie).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    times = None
    if movie.times is not None:
        times = [f"times_cached_seg{i}.raw" for i in range(len(movie.epochs))]

        def clock(batches):
            for batch in batches:
                for e, t, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    with open(f"{root}/{times[e]}", "r+b") as f:
                        f.seek(t * 8)
                        f.write(np.float64(v).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

        for name, e in zip(times, movie.epochs, strict=True):
            with open(f"{root}/{name}", "wb") as f:
                f.truncate(8 * e.n_frames)
        movie.with_times().select("epoch_index", "frame", "t").mapInArrow(clock, "n long").agg(F.sum("n")).collect()
    told = {"file_paths": names, "file_timestamps_paths": times, "sampling_frequency": movie.fs, "t_starts": [e.t_start for e in movie.epochs], "shape": [h, w, p], "dtype": kind.str, "file_offset": 0}
    files.write_bytes(f"{root}/binary.json", json.dumps({"class": "lumenframe.sources.BinaryImaging", "relative_paths": True, "kwargs": told, "annotations": movie.annotations, "plane_ids": list(movie.plane_ids)}).encode())


def read_binary_folder(spark: SparkSession, folder: str) -> Imaging:
    """A folder with ``binary.json``."""
    d = files.read_json(f"{folder}/binary.json")
    if not d["class"].endswith("BinaryImaging"):
        raise ValueError("not a folder of a flat movie")
    k = d["kwargs"]
    full = lambda names: [f"{folder}/{n}" if n and not n.startswith("/") else n for n in names] if names else None
    movie = read_binary(spark, full(k["file_paths"]), k["sampling_frequency"], tuple(k["shape"]), k["dtype"], k.get("t_starts"), k.get("file_offset", 0), full(k.get("file_timestamps_paths")), d.get("plane_ids"))
    movie.annotations.update(d.get("annotations") or {})
    return movie


def _prepare(folder: str, overwrite: bool) -> None:
    if files.exists(folder):
        if not overwrite:
            raise FileExistsError(folder)
        files.remove(folder)


def save_chunked(movie: Imaging, path: str, dtype: str | None = None, frames_per_chunk: int | None = None, overwrite: bool = False) -> None:
    """A zarr store (format 3, zstd): a chunk is a run of whole frames, written by one task."""
    from .chunked import create, write_array, write_chunk, write_group

    _prepare(path, overwrite)
    kind, h, w, p = np.dtype(KINDS.get(dtype or movie.dtype, dtype or movie.dtype)), movie.height, movie.width, movie.n_planes
    run = frames_per_chunk or max(1, BATCH_BYTES // (h * w * p * kind.itemsize))
    write_group(path, {"sampling_frequency": movie.fs, "num_epochs": len(movie.epochs), "annotations": movie.annotations, "plane_ids": list(movie.plane_ids)})
    write_array(f"{path}/shape", np.array([h, w, p]))
    write_array(f"{path}/t_starts", np.array([e.t_start for e in movie.epochs]))
    specs = [create(f"{path}/video_epoch{i}", (e.n_frames, h, w, p), (run, h, w, p), kind.name).spec() for i, e in enumerate(movie.epochs)]

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("epoch_index", "frame", "planes")), strict=True), key=lambda r: r[:2])
        write_chunk(Chunked(**specs[rows[0][0]]), (rows[0][1] // run, 0, 0, 0), _cast(np.stack([_volume(r[2], h, w) for r in rows]), kind))
        return pa.table({"n": pa.array([len(rows)], pa.int64())})

    whole = whole_frames(movie).withColumn("chunk", F.floor(F.col("frame") / run))
    whole.groupBy("epoch_index", "chunk").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    if movie.times is not None:
        step = 1 << 16
        clocks = [create(f"{path}/times_epoch{i}", (e.n_frames,), (min(step, max(1, e.n_frames)),), "float64").spec() for i, e in enumerate(movie.epochs)]

        def clock(table: pa.Table) -> pa.Table:
            rows = sorted(zip(*(table.column(c).to_pylist() for c in ("epoch_index", "frame", "t")), strict=True))
            array = Chunked(**clocks[rows[0][0]])
            write_chunk(array, (rows[0][1] // array.chunks[0],), np.array([r[2] for r in rows]))
            return pa.table({"n": pa.array([len(rows)], pa.int64())})

        size = F.element_at(F.lit([c["chunks"][0] for c in clocks]), F.col("epoch_index") + 1)
        movie.with_times().withColumn("chunk", F.floor(F.col("frame") / size)).groupBy("epoch_index", "chunk").applyInArrow(clock, "n long").agg(F.sum("n")).collect()
