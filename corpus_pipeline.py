"""From raw documents to packed training sequences: quality, toxicity, near duplicates, packing.

Every stage takes the documents that the one before kept (written as Parquet and read again) and uses one operator of
``evidra.llm`` with its production parameters. All but the last return the columns they were given, whatever these are called.

Null texts count as empty. Rows are judged each for itself, also where they repeat a doc_id; equal texts get equal scores. Of each group
of near duplicates, the row with the smallest doc_id stays (of several such, the one whose text has the smallest hash); rows with the same
doc_id and text are one. A document without words, and one with a null id, is in no group and stays. Very long texts are read whole.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import near_duplicates, packing, quality, toxicity
from evidra.llm.common import checkpoint_folder, free_name, table

KEEP_QUALITY, REJECT_TOXICITY = 0.7, 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    score = free_name(docs.columns, "score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, out_col=score).where(F.col(score) >= KEEP_QUALITY).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity tagger doesn't reject."""
    score, spans = free_name(docs.columns, "score"), free_name(docs.columns, "spans")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model, out_col=score, spans_col=spans).where(F.col(score) < REJECT_TOXICITY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8."""
    key = free_name(docs.columns, "text_hash")
    hashed = docs.withColumn(key, F.xxhash64("text"))
    found = near_duplicates.near_duplicates(hashed, 5, 80, keep=(key,))
    named = found.where("doc_id is not null").withColumn("_alone", F.when(F.col("n_shingles") == 0, F.col(key)))
    first = named.groupBy("component_id", "_alone").agg(F.min(F.struct("doc_id", key)).alias("first")).select("first.doc_id", f"first.{key}")
    stay = hashed.join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return stay.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The models are trained, so SQL can't express the stages.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again, and goes when the next one is
    written. The last stage returns rows that it has in the checkpoint folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    top = f"{checkpoint_folder(spark)}/pipeline-{uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        if before:
            _delete(spark, before)
        before = f"{top}/{name}"
        docs = spark.read.parquet(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    _delete(spark, top)
    return packed
