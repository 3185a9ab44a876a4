"""Bounded samples of labelled documents, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; a null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_text`` (null: empty) and ``y`` of at most ``limit`` labelled ids of either class that aren't held out, chosen by the hash of the
    id. Of several rows with one id, that of the smallest text is taken; an id with both labels counts as 1. The chosen ids
    (bounded by ``limit``) are broadcast to the texts. Null labels and ids are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), folds, fold)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("y"))
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        some = part if some is None else some.unionByName(part)
    found = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text")).join(F.broadcast(some), "_id")
    return found.groupBy("_id").agg(F.min("_text").alias("_text"), F.max("y").alias("y")).select("_text", "y")
