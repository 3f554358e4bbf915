"""Epoch, frame and plane algebra: every operator is a filter, a renumbering or a union."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Epoch, Imaging


def _mapped(frames: DataFrame, column: str, old_to_new: list[tuple[int, int]]) -> DataFrame:
    """Renumbers a column by a small mapping; values without a new number go, repeated ones are repeated."""
    table = F.broadcast(frames.sparkSession.createDataFrame(old_to_new, "old int, new int"))
    return frames.join(table, F.col(column) == F.col("old")).withColumn(column, F.col("new")).drop("old", "new")


def select_planes(movie: Imaging, plane_ids) -> Imaging:
    """Planes by id, in the order given."""
    at = movie.plane_indices(plane_ids)
    return movie.with_frames(_mapped(movie.frames, "plane_index", [(p, i) for i, p in enumerate(at)]), plane_ids=tuple(plane_ids))


def split_epochs(movie: Imaging, epochs) -> Imaging:
    """Keeps the listed epochs in the order given."""
    epochs = list(epochs)
    if not epochs or any(isinstance(e, bool) or not isinstance(e, int) for e in epochs):
        raise ValueError("epochs must be a non-empty list of integers")
    if any(not 0 <= e < len(movie.epochs) for e in epochs):
        raise IndexError("epoch out of range")
    table = [(e, i) for i, e in enumerate(epochs)]
    times = _mapped(movie.times, "epoch_index", table) if movie.times is not None else None
    return movie.with_frames(_mapped(movie.frames, "epoch_index", table), epochs=tuple(movie.epochs[e] for e in epochs), times=times)


def split_by_epochs(movie: Imaging) -> list[Imaging]:
    """A movie for each epoch, a filter each. What is asked of all of them goes over ``epochs_apart``, one plan however many there are."""

    def only(df: DataFrame, e: int) -> DataFrame:
        return df.where(F.col("epoch_index") == e).withColumn("epoch_index", F.lit(0))

    times = movie.times
    return [movie.with_frames(only(movie.frames, e), epochs=(epoch,), times=only(times, e) if times is not None else None) for e, epoch in enumerate(movie.epochs)]


def epochs_apart(movie: Imaging) -> DataFrame:
    """The frames of all movies that ``split_by_epochs`` lists, in one table: ``part`` is the place in that list, and every frame is of epoch 0 of its part."""
    known = (F.col("epoch_index") >= 0) & (F.col("epoch_index") < len(movie.epochs))
    return movie.frames.where(known).withColumn("part", F.col("epoch_index")).withColumn("epoch_index", F.lit(0))


def part_of(frame: Column, edges: list[int]) -> Column:
    """How many edges lie at or below a frame."""
    return sum((F.when(frame >= e, 1).otherwise(0) for e in edges), F.lit(0))


def split_epoch_at_frames(movie: Imaging, boundaries, epoch_index: int = 0) -> Imaging:
    """Cuts one epoch at strictly increasing inner boundaries; other epochs are dropped."""
    edges = list(boundaries)
    n = movie.epochs[epoch_index].n_frames
    if not edges or any(a >= b for a, b in zip(edges, edges[1:])) or edges[0] <= 0 or edges[-1] >= n:
        raise ValueError("boundaries must increase strictly within the epoch")
    low = [0, *edges]
    start = movie.epochs[epoch_index].t_start
    parts = tuple(Epoch(b - a, start + a / movie.fs) for a, b in zip(low, [*edges, n]))

    def cut(df: DataFrame) -> DataFrame:
        part = part_of(F.col("frame"), edges)
        base = F.element_at(F.lit(low), part + 1)
        return df.where(F.col("epoch_index") == epoch_index).withColumns({"epoch_index": part, "frame": F.col("frame") - base})

    return movie.with_frames(cut(movie.frames), epochs=parts, times=cut(movie.times) if movie.times is not None else None)


def frame_slice(movie: Imaging, start: int, end: int, epoch_index: int = 0) -> Imaging:
    """Frames [start, end) of one epoch as a movie of one epoch, on its old time line."""
    n = movie.epochs[epoch_index].n_frames
    if not 0 <= start < end <= n:
        raise ValueError("empty or outside range")

    def cut(df: DataFrame) -> DataFrame:
        inside = df.where((F.col("epoch_index") == epoch_index) & (F.col("frame") >= start) & (F.col("frame") < end))
        return inside.withColumns({"epoch_index": F.lit(0), "frame": F.col("frame") - start})

    epoch = Epoch(end - start, movie.epochs[epoch_index].t_start + start / movie.fs)
    return movie.with_frames(cut(movie.frames), epochs=(epoch,), times=cut(movie.times) if movie.times is not None else None)


def _alike(movies: list[Imaging], planes: bool = True) -> None:
    first = movies[0]
    for m in movies[1:]:
        same = (m.height, m.width, m.fs, m.dtype) == (first.height, first.width, first.fs, first.dtype)
        if not same or planes and m.plane_ids != first.plane_ids:
            raise ValueError("movies differ in shape, rate, type or planes")


def append(movies: list[Imaging]) -> Imaging:
    """The epochs of all movies, one after another, kept apart."""
    if len(movies) < 2:
        raise ValueError("at least two movies")
    _alike(movies)
    frames, n = None, 0
    for m in movies:
        moved = m.frames.withColumn("epoch_index", (F.col("epoch_index") + n).cast("int"))
        frames = moved if frames is None else frames.unionByName(moved)
        n += len(m.epochs)
    return movies[0].with_frames(frames, epochs=tuple(e for m in movies for e in m.epochs), times=None)


def concatenate(movies) -> Imaging:
    """All epochs of one or several movies end to end as one epoch."""
    movies = [movies] if isinstance(movies, Imaging) else list(movies)
    whole = append(movies) if len(movies) > 1 else movies[0]
    base = F.element_at(F.lit(whole.offsets), F.col("epoch_index") + 1)
    frames = whole.frames.withColumn("frame", F.col("frame") + base).withColumn("epoch_index", F.lit(0))
    return whole.with_frames(frames, epochs=(Epoch(whole.n_frames, whole.epochs[0].t_start),), times=None)


def stack_planes(*movies) -> Imaging:
    """Movies of equal epochs joined along the plane axis."""
    movies = list(movies[0]) if len(movies) == 1 and not isinstance(movies[0], Imaging) else list(movies)
    if len(movies) < 2:
        raise ValueError("at least two movies")
    _alike(movies, planes=False)
    if any([e.n_frames for e in m.epochs] != [e.n_frames for e in movies[0].epochs] for m in movies):
        raise ValueError("movies differ in epochs")
    frames, n = None, 0
    for m in movies:
        moved = m.frames.withColumn("plane_index", (F.col("plane_index") + n).cast("int"))
        frames = moved if frames is None else frames.unionByName(moved)
        n += m.n_planes
    return replace(movies[0], frames=frames, plane_ids=tuple(range(n)))


def crop(pixels: DataFrame, width: int, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Pixels (column pix) inside half-open bounds."""
    row, column = F.floor(F.col("pix") / width), F.col("pix") % width
    return pixels.where((row >= y[0]) & (row < y[1]) & (column >= x[0]) & (column < x[1]))


def range_intersection(ranges: DataFrame, *by: str) -> DataFrame:
    """[largest lo, smallest hi]."""
    return ranges.groupBy(*by).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


def bad_frame_union(*flags: DataFrame) -> DataFrame:
    """A frame is bad if any plane or any source says so."""
    every = flags[0]
    for f in flags[1:]:
        every = every.unionByName(f)
    return every.groupBy("epoch_index", "frame").agg(F.bool_or("bad").alias("bad"))


def drop_bad_frames(frames: DataFrame, bad: DataFrame, batch: int) -> DataFrame:
    """Drops bad frames of a batch only if more than half of that batch is good."""
    flagged = frames.join(bad, ["epoch_index", "frame"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    flagged = flagged.withColumn("batch", F.floor(F.col("frame") / batch))
    good = flagged.groupBy("epoch_index", "batch").agg(F.avg((~F.col("bad")).cast("int")).alias("good"))
    return flagged.join(good, ["epoch_index", "batch"]).where("not bad or good <= 0.5").drop("bad", "good")
