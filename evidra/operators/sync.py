"""Snapshots of a folder over time: differences, versions, stamps of sources, new columns, and append-only history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.ranges import numbered, running_sum
from evidra.functions.unicode import casefold

STAMP = 12
MOST_CANDIDATE_FILES = 5


def paired_moves(differing: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, change, path, moved_to) of paths with two hashes (``old``, ``now``; null: not there): added, deleted, modified, and moved, where a gone
    and a new path of one hash pair up one to one in path order, within ``by``. Equal hashes give nothing."""
    by = by or []
    change = F.when(F.col("old").isNull() & F.col("now").isNotNull(), "added").when(F.col("now").isNull() & F.col("old").isNotNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("now")), "modified")
    named = differing.withColumn("change", change).where("change is not null").withColumn("sha", F.coalesce("now", "old"))
    number = F.row_number().over(Window.partitionBy(*by, "change", "sha").orderBy("path"))
    loose = named.where("change <> 'modified'").withColumn("n", number)
    gone, fresh = loose.where("change = 'deleted'"), loose.where("change = 'added'").select(*by, "sha", "n", F.col("path").alias("moved_to"))
    pairs = gone.join(fresh, [*by, "sha", "n"]).select(*by, "path", "moved_to")
    rest = named.join(pairs.select(*by, "path"), [*by, "path"], "left_anti").join(pairs.select(*by, F.col("moved_to").alias("path")), [*by, "path"], "left_anti")
    return pairs.select(*by, F.lit("moved").alias("change"), "path", "moved_to").unionByName(rest.select(*by, "change", "path", F.lit(None).cast("string").alias("moved_to")))


def diff_snapshots(prev: DataFrame, new: DataFrame) -> DataFrame:
    """(change, path, moved_to) between snapshots (path, sha256); see ``paired_moves``."""
    return paired_moves(prev.select("path", F.col("sha256").alias("old")).join(new.select("path", F.col("sha256").alias("now")), "path", "full_outer"))


def scan_versions(scans: DataFrame) -> DataFrame:
    """Per scan (scan_id, path, sha256), against the scan before: added, modified and deleted paths, and the version, which rises only
    with a change and starts at 1. One window a path; scans are numbered and summed by ranges of ids."""
    order = numbered(scans.select("scan_id").distinct(), [], "scan_id").withColumnRenamed("number", "k")
    rows = scans.join(order, "scan_id")
    by_path = Window.partitionBy("path").orderBy("k")
    seen = rows.withColumn("last_k", F.lag("k").over(by_path)).withColumn("last_sha", F.lag("sha256").over(by_path)).withColumn("next_k", F.lead("k").over(by_path))
    there = F.coalesce(F.col("last_k") == F.col("k") - 1, F.lit(False))
    came = seen.groupBy("k").agg(F.count_if(~there).alias("added"), F.count_if(there & (F.col("last_sha") != F.col("sha256"))).alias("modified"))
    left = seen.where("next_k is null or next_k > k + 1").groupBy((F.col("k") + 1).alias("k")).agg(F.count("*").alias("deleted"))
    each = order.join(came, "k").join(left, "k", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    changed = (F.col("added") + F.col("modified") + F.col("deleted") > 0).cast("long")
    return running_sum(each.withColumn("_changed", changed), "k", "_changed").withColumn("version", F.greatest(F.lit(1), "so_far")).select("scan_id", "added", "modified", "deleted", "version")


def changed_listing(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Whether two listings (path, size, mtime) differ, and in how many paths."""
    a, b = prev.select("path", F.struct("size", "mtime").alias("a")), new.select("path", F.struct("size", "mtime").alias("b"))
    return a.join(b, "path", "full_outer").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different")).select("different", (F.col("different") > 0).alias("changed"))


def source_stamps(files: DataFrame, used: DataFrame) -> DataFrame:
    """First hex digits of the hash of each path that an answer used."""
    return files.join(used, "path", "left_semi").select("path", F.left("sha256", F.lit(STAMP)).alias("stamp"))


def check_stamps(stamps: DataFrame, files: DataFrame) -> DataFrame:
    """ok, changed, moved (the stamp is elsewhere) or deleted, for each stored (path, stamp)."""
    now = files.select("path", F.left("sha256", F.lit(STAMP)).alias("now"))
    elsewhere = now.groupBy(F.col("now").alias("stamp")).agg(F.min("path").alias("other"))
    joined = stamps.join(now, "path", "left").join(elsewhere, "stamp", "left")
    state = F.when(F.col("now") == F.col("stamp"), "ok").when(F.col("now").isNotNull(), "changed").when(F.col("other").isNotNull(), "moved").otherwise("deleted")
    return joined.select("path", state.alias("state"))


def suggestable(name: Column) -> Column:
    """Whether a column's name may become a term: 2 to 30 characters, no leading underscore, no bare number or period."""
    c = F.trim(name)
    return F.length(c).between(2, 30) & ~c.startswith("_") & ~c.rlike(r"^[\d\W_&&[^가-힣]]+$|^\d+\s*(월|분기|주|일|년)$")


def new_columns(current: DataFrame, known: DataFrame, by: str = "company") -> DataFrame:
    """(by, name): names of a company's columns (by, name) never seen before that may become terms. A company of which nothing is known is
    scanned for the first time: nothing of it is new."""
    scanned = current.join(known.select(by).distinct(), by, "left_semi").select(by, "name").distinct()
    return scanned.join(known, [by, "name"], "left_anti").where(suggestable(F.col("name")))


def glossary_candidates(fresh: DataFrame, dismissed: DataFrame, covered: DataFrame, present: DataFrame, by: str = "company") -> DataFrame:
    """(by, name, files, place): new names (by, name, first_seen) less those dismissed (by, name), covered by the glossary (by, name; cases folded), or in no
    file any more (present: by, name, path); with up to five files that have them. ``place`` counts from the newest, per company."""
    words = covered.select(by, casefold(F.col("name")).alias("_word")).distinct()
    left = fresh.join(dismissed.select(by, "name"), [by, "name"], "left_anti").withColumn("_word", casefold(F.col("name"))).join(words, [by, "_word"], "left_anti")
    some = present.select(by, "name", "path").distinct().withColumn("k", F.row_number().over(Window.partitionBy(by, "name").orderBy("path"))).where(F.col("k") <= MOST_CANDIDATE_FILES)
    files = some.groupBy(by, "name").agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("files"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("first_seen"), "name")).cast("long")
    return left.join(files, [by, "name"]).withColumn("place", place).select(by, "name", "files", "place")


def upsert_latest(rows: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Latest values of each key, and when it was first seen."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *values)).alias("v"), F.min(at).alias("created_at")).select(key, "v.*", "created_at")


def delete_by_id(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def recent(rows: DataFrame, by: str, at: str, key: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each ``by``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(key)))
    return rows.withColumn("n", n).where(F.col("n") <= most).drop("n")
