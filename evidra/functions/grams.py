"""A stored positional index of texts, for "holds as a substring" without reading the texts.

Postings are (gram, text, positions): all runs of three characters of each distinct text with where they stand, and shorter runs without. A
needle is covered by runs of three, one behind the other; a text holds it exactly where all of them stand at their distance. The
rarest run of a needle gives the candidates, the others are looked up for those only. Every gram's postings are split by text, so a
frequent gram is never one task's, whatever the needles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram, and tasks among which a gram's postings are split.
GRAM, SPLITS = 3, 8
POSTINGS = "gram string, split int, vid long, positions array<int>, bucket int"


@dataclass(frozen=True)
class GramIndex:
    """``values``: the indexed rows with ``vid`` (hash of the text) and folder; ``postings``: gram, split, vid, positions; ``grams``: how many texts hold each."""

    values: DataFrame
    postings: DataFrame
    grams: DataFrame
    text: str
    splits: int
    buckets: int


def _folder(gram: str, split: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram, split), F.lit(buckets)).cast("int")


def write_index(rows: DataFrame, text: str, folder: str, splits: int = SPLITS, buckets: int | None = None) -> None:
    """Index ``text`` of ``rows`` (all columns are kept) into a new folder, in ``buckets`` parts (by default as many as shuffles have). Null and
    empty texts hold nothing and aren't found."""
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vid = F.xxhash64(text)
    known = rows.where(F.length(text) > 0).withColumn("vid", vid).withColumn("vid_bucket", F.pmod("vid", F.lit(buckets)).cast("int"))
    known.repartition(buckets, "vid_bucket").write.partitionBy("vid_bucket").parquet(f"{folder}/values")
    known.limit(0).write.parquet(f"{folder}/shape")  # an empty index has no other file that tells its columns
    texts = spark.read.schema(known.schema).parquet(f"{folder}/values").select("vid", text).dropDuplicates(["vid"])
    placed = texts.select("vid", text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at"))
    runs = placed.select("vid", F.pmod("vid", F.lit(splits)).cast("int").alias("split"), "at", F.explode(F.array(*(F.substring(F.col(text), F.col("at"), F.lit(k)) for k in range(1, GRAM + 1)))).alias("gram")).withColumn("bucket", _folder("gram", "split", buckets))
    # A shorter run at the end of a text comes twice or more; places are kept for whole ones only.
    whole = F.when(F.length("gram") == GRAM, F.col("at"))
    posted = runs.repartition(buckets, "bucket").groupBy("bucket", "gram", "split", "vid").agg(F.array_distinct(F.collect_list(whole)).alias("positions"))
    posted.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    counts = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").groupBy("gram").agg(F.count("*").alias("texts"))
    counts.withColumns({"text": F.lit(text), "splits": F.lit(splits), "buckets": F.lit(buckets)}).write.parquet(f"{folder}/grams")


def read_index(spark: SparkSession, folder: str) -> GramIndex:
    values = spark.read.schema(spark.read.parquet(f"{folder}/shape").schema).parquet(f"{folder}/values")
    postings, grams = spark.read.schema(POSTINGS).parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/grams")
    about = grams.first()
    return GramIndex(values, postings, grams.select("gram", "texts"), *((about["text"], about["splits"], about["buckets"]) if about else (values.columns[0], SPLITS, 1)))


def matches(index: GramIndex, needles: DataFrame, needle: str) -> DataFrame:
    """(needle, vid): which texts hold which of the distinct needles (not empty), from postings alone."""
    asked = needles.where(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    last = F.length("needle") - GRAM
    offsets = F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last))))
    runs = asked.select("needle", F.explode(offsets).alias("offset")).withColumn("gram", F.substring("needle", F.col("offset") + 1, F.lit(GRAM)))
    counted = runs.join(index.grams, "gram", "left").groupBy("needle").agg(F.min(F.coalesce("texts", F.lit(0))).alias("least"), F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "offset", "gram")).alias("first"), F.collect_list(F.struct("offset", "gram")).alias("runs"))
    possible = counted.where("least > 0")
    # Each split of the rarest gram is a key of its own.
    opened = possible.select("needle", "runs", F.col("first.gram").alias("gram"), F.col("first.offset").alias("offset"), F.explode(F.sequence(F.lit(0), F.lit(index.splits - 1))).alias("split")).withColumn("bucket", _folder("gram", "split", index.buckets))
    starts = F.transform("positions", lambda p: p - F.col("offset"))
    first = opened.join(index.postings, ["bucket", "gram", "split"]).select("needle", "vid", starts.alias("starts"), F.filter("runs", lambda r: r["offset"] != F.col("offset")).alias("others"))
    alone = first.where(F.size("others") == 0).select("needle", "vid")
    more = first.where(F.size("others") > 0).select("needle", "vid", "starts", F.size("others").alias("due"), F.explode("others").alias("o")).select("needle", "vid", F.col("starts").alias("before"), "due", "o.offset", "o.gram")
    split = more.withColumn("split", F.pmod("vid", F.lit(index.splits)).cast("int")).withColumn("bucket", _folder("gram", "split", index.buckets))
    met = split.join(index.postings, ["bucket", "gram", "split", "vid"]).select("needle", "vid", "due", F.array_intersect("before", starts).alias("common")).where(F.size("common") > 0)
    held = met.groupBy("needle", "vid").agg(F.count("*").alias("n"), F.max("due").alias("due"), F.collect_list("common").alias("sets")).where("n = due")
    both = F.aggregate("sets", F.col("sets")[0], F.array_intersect)
    return alone.unionByName(held.where(F.size(both) > 0).select("needle", "vid"))


def contained(index: GramIndex, needles: DataFrame, needle: str) -> DataFrame:
    """All pairs of an indexed row and a row of ``needles`` whose ``needle`` its text holds literally. Rows are fetched by the hashes found; the
    comparison behind it only guards against equal hashes of different texts."""
    found = matches(index, needles, needle).withColumn("vid_bucket", F.pmod("vid", F.lit(index.buckets)).cast("int"))
    rows = index.values.join(found, ["vid_bucket", "vid"]).drop("vid_bucket", "vid")
    return rows.where(F.col(index.text).contains(F.col("needle"))).join(needles.withColumn("needle", F.col(needle)), "needle").drop("needle")
