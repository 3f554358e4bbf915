"""Operators on blocks of frames: several of them share one pass over a movie, with nothing gathered on the way.

An operator has a name, ``width`` (values a frame) and ``compute(block)``, which takes
frames (T, H, W, P) and gives an array (T, width). It is sent to the executors
once, with whatever it holds; what it holds must not grow with the movie.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Imaging


class ChunkOperator(Protocol):
    name: str
    width: int

    def compute(self, block: np.ndarray) -> np.ndarray: ...


def run_chunks(movie: Imaging, operators: list[ChunkOperator]) -> DataFrame:
    """(operator, global_frame, k, value) of all operators, from one scan."""
    names = [o.name for o in operators]
    if not names or len(set(names)) != len(names):
        raise ValueError("operators need distinct names and at least one")
    h, w, p = movie.height, movie.width, movie.n_planes
    shared = movie.spark.sparkContext.broadcast(list(operators))
    base = F.element_at(F.lit(movie.offsets), F.col("epoch_index") + 1)
    rows = movie.frames.withColumn("global_frame", F.col("frame") + base)
    if p > 1:
        rows = rows.groupBy("global_frame").agg(F.sort_array(F.collect_list(F.struct("plane_index", "pixels"))).alias("x"))
        rows = rows.select("global_frame", F.flatten(F.transform("x", lambda v: v["pixels"])).alias("pixels"))

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            block = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, p, h, w).transpose(0, 2, 3, 1)
            frames = batch.column(0).to_numpy()
            for o in shared.value:
                value = np.asarray(o.compute(block), float)
                if value.shape != (n, o.width):
                    raise ValueError(f"{o.name} gave {value.shape}, not {(n, o.width)}")
                yield pa.RecordBatch.from_arrays([pa.array([o.name] * value.size), pa.array(np.repeat(frames, o.width)), pa.array(np.tile(np.arange(o.width), n)), pa.array(value.ravel())], names=["operator", "global_frame", "k", "value"])

    return rows.select("global_frame", "pixels").mapInArrow(run, "operator string, global_frame long, k long, value double")
