"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); one of our own only in a local session where none is set."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(told)
        return told
    if not sc.isLocal:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles that nothing refers to any more: it learns of them when the driver collects its garbage, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder of ours in whatever store it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame) -> DataFrame:
    """The rows of a checkpoint as a plan that knows nothing of them.

    A checkpoint keeps what its plan implied of order, partitioning and values;
    in a loop that grows from round to round, and so does planning.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


#: The setting that holds Arrow batches by bytes, and its value where the session was told none: Spark's own is 64 MB, which
#: a task, its worker and the executor's allocator hold at once.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session are of about ``BATCH_BYTES`` or one row, unless it was told a size itself; no result depends on them."""
    if not spark._jsparkSession.conf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named c0, c1, ...: no name of a caller's column can clash with one of our own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _trim() -> None:
    """Hands freed memory back: a worker that waits for its next task should not keep what its last one needed."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def lean(f):
    """An Arrow function over batches that trims its worker's memory when the partition is done."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _trim()

    return run
