"""Movies and regions of interest as DataFrames.

A movie is a frame table ``(epoch_index, frame, plane_index, pixels)`` with
row-major pixels and a small epoch table; frames are numbered from 0 in each
epoch. Regions are a sparse mask table ``(roi_id, plane_index, y, x, w)``.
Everything is lazy: an operator returns a new object around a new plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = "epoch_index int, frame long, plane_index int, pixels array<float>"
MASKS = "roi_id string, plane_index int, y int, x int, w double"


@dataclass(frozen=True)
class Epoch:
    """A contiguous recording: its length and its start in seconds."""

    n_frames: int
    t_start: float = 0.0


@dataclass(frozen=True)
class Imaging:
    """A movie of one channel."""

    frames: DataFrame
    fs: float
    height: int
    width: int
    epochs: tuple[Epoch, ...]
    plane_ids: tuple = (0,)
    dtype: str = "float32"
    times: DataFrame | None = None
    annotations: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.fs <= 0 or self.height <= 0 or self.width <= 0:
            raise ValueError("sampling rate and shape must be positive")
        if len(set(self.plane_ids)) != len(self.plane_ids) or not self.plane_ids:
            raise ValueError("plane ids must be distinct and at least one")

    @property
    def spark(self) -> SparkSession:
        return self.frames.sparkSession

    @property
    def n_planes(self) -> int:
        return len(self.plane_ids)

    @property
    def n_frames(self) -> int:
        return sum(e.n_frames for e in self.epochs)

    @property
    def offsets(self) -> list[int]:
        """Global number of each epoch's first frame."""
        out, n = [], 0
        for e in self.epochs:
            out.append(n)
            n += e.n_frames
        return out

    @property
    def duration(self) -> float:
        return self.n_frames / self.fs

    def __str__(self) -> str:
        from .functions.text import bytes_text, seconds_text

        lengths = ", ".join(seconds_text(e.n_frames / self.fs) for e in self.epochs)
        sizes = ", ".join(bytes_text(e.n_frames * self.height * self.width * self.n_planes * 4) for e in self.epochs)
        return f"{self.fs} Hz - {len(self.epochs)} epochs - {self.height} rows x {self.width} columns x {self.n_planes} planes - {lengths} - {self.dtype} - {sizes}"

    def totals(self) -> DataFrame:
        """(epoch_index, frames, pixels, bytes, seconds) by epoch and, with a null epoch, in all."""
        e = self.epoch_frame().select("epoch_index", F.col("n_frames").alias("frames"))
        area = self.height * self.width * self.n_planes
        rows = e.rollup("epoch_index").agg(F.sum("frames").alias("frames"))
        return rows.select("epoch_index", "frames", (F.col("frames") * area).alias("pixels"), (F.col("frames") * area * 4).alias("bytes"), (F.col("frames") / F.lit(self.fs)).alias("seconds"))

    def raw_bytes(self, itemsize: int = 4) -> int:
        return self.n_frames * self.height * self.width * self.n_planes * itemsize

    def with_frames(self, frames: DataFrame, **changes) -> Imaging:
        return replace(self, frames=frames, **changes)

    def epoch_frame(self) -> DataFrame:
        """(epoch_index, n_frames, frame_offset, t_start)."""
        rows = [(i, int(e.n_frames), int(o), float(e.t_start)) for i, (e, o) in enumerate(zip(self.epochs, self.offsets, strict=True))]
        return self.spark.createDataFrame(rows, "epoch_index int, n_frames long, frame_offset long, t_start double")

    def plane_indices(self, plane_ids) -> list[int]:
        unknown = [p for p in plane_ids if p not in self.plane_ids]
        if unknown or not len(plane_ids):
            raise ValueError(f"unknown or no plane ids: {unknown}")
        return [self.plane_ids.index(p) for p in plane_ids]

    def get_series(self, start: int | None = None, end: int | None = None, plane_ids=None, epoch_index: int | None = None) -> DataFrame:
        """Frames ``start <= frame < end`` of one epoch; a movie of several epochs needs to be told which."""
        if epoch_index is None:
            if len(self.epochs) > 1:
                raise ValueError("epoch_index is needed for a movie of several epochs")
            epoch_index = 0
        if not 0 <= epoch_index < len(self.epochs):
            raise IndexError(f"no epoch {epoch_index}")
        n = self.epochs[epoch_index].n_frames
        out = self.frames.where((F.col("epoch_index") == epoch_index) & (F.col("frame") >= (start or 0)) & (F.col("frame") < (n if end is None else end)))
        return out if plane_ids is None else out.where(F.col("plane_index").isin(self.plane_indices(plane_ids)))

    def with_times(self) -> DataFrame:
        """(epoch_index, frame, t): given times where there are some, else start and rate."""
        seen = self.frames.select("epoch_index", "frame").distinct().join(F.broadcast(self.epoch_frame()), "epoch_index")
        t = F.col("t_start") + F.col("frame") / F.lit(self.fs)
        if self.times is not None:
            seen = seen.join(self.times.withColumnRenamed("t", "given"), ["epoch_index", "frame"], "left")
            t = F.coalesce("given", t)
        return seen.select("epoch_index", "frame", t.alias("t"))

    def time_of(self, frame: int, epoch_index: int = 0) -> float:
        return self.epochs[epoch_index].t_start + frame / self.fs

    def frame_at(self, t: float, epoch_index: int = 0) -> int:
        return round((t - self.epochs[epoch_index].t_start) * self.fs)

    def shift_times(self, by: float) -> Imaging:
        times = self.times.withColumn("t", F.col("t") + by) if self.times is not None else None
        return replace(self, epochs=tuple(replace(e, t_start=e.t_start + by) for e in self.epochs), times=times)

    def reset_times(self) -> Imaging:
        return replace(self, epochs=tuple(replace(e, t_start=0.0) for e in self.epochs), times=None)

    def pixels(self) -> DataFrame:
        """(epoch_index, frame, plane_index, pix, v), one row for each pixel, v in double precision."""
        return explode_pixels(self.frames)


def explode_pixels(frames: DataFrame) -> DataFrame:
    keep = [c for c in frames.columns if c != "pixels"]
    return frames.select(*keep, F.posexplode("pixels").alias("pix", "v")).withColumn("v", F.col("v").cast("double"))


@dataclass(frozen=True)
class Rois:
    """Regions over one field of view; ``order`` lists their ids."""

    masks: DataFrame
    height: int
    width: int
    order: tuple[str, ...]
    n_planes: int = 1
    fs: float | None = None
    properties: DataFrame | None = None

    @property
    def sparse(self) -> DataFrame:
        """(roi_id, plane_index, pix, w) without zeros."""
        return self.masks.where("w <> 0").select("roi_id", "plane_index", (F.col("y") * self.width + F.col("x")).alias("pix"), "w")

    def check(self, movie: Imaging) -> None:
        """Raises unless regions and movie have one rate (to 0.1 Hz) and one shape."""
        if (self.height, self.width, self.n_planes) != (movie.height, movie.width, movie.n_planes):
            raise ValueError("regions and movie differ in shape")
        if self.fs is not None and abs(self.fs - movie.fs) > 0.1:
            raise ValueError("regions and movie differ in sampling rate")

    def select(self, ids) -> Rois:
        """These regions in this order."""
        ids = [str(i) for i in ids]
        if missing := [i for i in ids if i not in self.order]:
            raise ValueError(f"unknown region ids: {missing}")
        listed = self.masks.sparkSession.createDataFrame([(i,) for i in ids], "roi_id string")
        props = self.properties.join(F.broadcast(listed), "roi_id", "left_semi") if self.properties is not None else None
        return replace(self, masks=self.masks.join(F.broadcast(listed), "roi_id", "left_semi"), order=tuple(ids), properties=props)

    def remove(self, ids) -> Rois:
        gone = {str(i) for i in ids}
        if missing := gone - set(self.order):
            raise ValueError(f"unknown region ids: {sorted(missing)}")
        return self.select([i for i in self.order if i not in gone])

    def pixel_masks(self, ids=None) -> DataFrame:
        """Rows (roi_id, plane_index, y, x, w) of the given regions."""
        return (self.select(ids) if ids is not None else self).masks.where("w <> 0")

    def geometry(self) -> DataFrame:
        """Centre and bounding box of each region."""
        return self.masks.where("w <> 0").groupBy("roi_id").agg(
            F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("npix")
        )
