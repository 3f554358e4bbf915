"""Training-corpus pipeline over ``documents``: stages run in order, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and keeps the columns of documents; the
last adds token columns. A document that loses its last line to line dedup
goes with it; one that had no line with content stays. Of a group of
near-duplicates the document with the smallest id stays, null ids last, then
the smallest text hash; of equal rows one. Rows are told apart by id and text,
so null and shared ids are judged row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontamination, jaccard_join, line_dedup, toxicity
from lumenframe.llm.queries import table, vocabulary
from lumenframe.llm.session import cut, ensure_checkpoint_dir, remove_folder, small_batches


#: Names of the stages' own columns beside those of docs.
OWN = ("__stage_1", "__stage_2", "__stage_3")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)  # for all stages: each hands whole texts to its workers
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=docs.columns, into=OWN).where(f"not {OWN[2]}").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs, counts=OWN[:2]).where(f"{OWN[0]} = 0 or {OWN[1]} < {OWN[0]}")
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    again = cut(jaccard_join.repeated_rows(docs).toDF("__id", "__of", "__stays"))
    few = again.count() <= decontamination.BROADCAST_ROWS
    marked = docs.withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__of"))
    marked = marked.join(F.broadcast(again) if few else again, same, "left")
    kept = marked.where("__stays is null").select(*docs.columns)
    if again.where("__stays").isEmpty():
        return kept
    # equal rows of which one stays
    return kept.unionAll(marked.where("__stays").dropDuplicates(["doc_id", "__th"]).select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_documents(docs, vocabulary(), keep=docs.columns, into=OWN)
    ids, count, decoded = OWN
    return done.select(*docs.columns, F.col(count).alias("n_tokens"), F.col(ids).alias("token_ids"), F.sha2(decoded, 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", tokenize),
]

#: Regression, edit joins, components and BPE have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's input is removed when its output is written.

    The last input stays, for the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{spark._jvm.java.util.UUID.randomUUID()}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
