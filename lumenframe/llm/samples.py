"""Bounded training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_texts(docs: DataFrame, id: str, text: str, bound: int) -> DataFrame:
    """``(id, th, text)`` of at most ``bound`` different rows, those with the smallest hashes of id and text.

    The same rows however the table is dealt and however often a row is repeated; rows with a null id or text take no part.
    """
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    rows = rows.where("id is not null and text is not null")
    chosen = rows.select("id", "th").distinct().orderBy(F.xxhash64("id", "th"), "id", "th").limit(bound)
    return rows.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id", "th"])
