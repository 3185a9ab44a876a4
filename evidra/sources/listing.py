"""Files of a shared folder: what is read and why not, and who has them open."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions.unicode import nfc

# Extensions and limits.
MOST_BYTES, MOST_FILES = 100 * 1024 * 1024, 5000


def skip_reason(name: Column, size: Column, link: Column | None = None, readable: Column | None = None) -> Column:
    """Why a workbook isn't read, else null: lock file, old format, unreadable, link, too large."""
    linked, open_ = (F.lit(v) if c is None else c for c, v in ((link, False), (readable, True)))
    return F.when(name.startswith("~$") | name.startswith(".~lock."), "lock").when(F.lower(name).endswith(".xls"), "legacy").when(~open_, "unreadable").when(linked, "symlink").when(size > MOST_BYTES, "too_large")


def _looked_at(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        local = [p.removeprefix("file://").removeprefix("file:") if p.startswith(("file:", "/")) else None for p in batch.column("path").to_pylist()]
        link = [p is not None and os.path.islink(p) for p in local]
        readable = [p is None or os.access(p, os.R_OK) for p in local]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(link), pa.array(readable)], [*batch.schema.names, "link", "readable"])


def looked_at(files: DataFrame) -> DataFrame:
    """``link`` and ``readable`` of files (path, size, mtime), told in the tasks that have them. Files of other stores than local and mounted
    folders are no links, and readable as far as can be told before they are read."""
    return files.mapInArrow(_looked_at, "path string, size long, mtime timestamp, link boolean, readable boolean")


def list_files(spark: SparkSession, root: str, most: int = MOST_FILES) -> DataFrame:
    """path, name, folder, rel (the path below ``root``), size, mtime, skip_reason of the workbooks below ``root``; contents aren't read. Name, folder and
    rel are composed (NFC), as some desktops write syllables taken apart; path opens the file. Beyond the first ``most`` readable ones, by
    path, files are listed as ``too_many``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    named = F.element_at(F.split("path", "/"), -1)
    kept = looked_at(found.where(~named.startswith("._") & F.lower(named).rlike(r"\.(xlsx|xlsm|xls)#?$")))
    top = root.rstrip("/").removeprefix("file://").removeprefix("file:").replace("\\E", "\\E\\\\E\\Q")
    rel = F.regexp_replace("path", rf"^.*?\Q{top}\E/*", "")
    written = kept.withColumns({"name": nfc(named), "folder": nfc(F.regexp_replace("path", "/[^/]*$", "")), "rel": nfc(rel)})
    judged = written.withColumn("skip_reason", skip_reason(F.col("name"), F.col("size"), F.col("link"), F.col("readable"))).drop("link", "readable")
    last = judged.where("skip_reason is null").orderBy("path").limit(most).agg(F.count("*").alias("n"), F.max("path").alias("last"))
    beyond = F.col("skip_reason").isNull() & (F.col("n") >= most) & (F.col("path") > F.col("last"))
    return judged.crossJoin(F.broadcast(last)).withColumn("skip_reason", F.when(beyond, "too_many").otherwise(F.col("skip_reason"))).drop("n", "last")  # one row


def fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """path and sha256 of the bytes that are parsed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.sha2("content", 256).alias("sha256"))


def mark_locked(files: DataFrame, locks: DataFrame) -> DataFrame:
    """``owner`` and ``since`` of files (path, folder, name) that a lock file of their folder covers: ``~$`` and the name, or the name
    less its first one or two characters; ``.~lock.name#`` exactly."""
    covered = F.when(F.col("name").startswith("~$"), F.expr("substr(name, 3)")).otherwise(F.regexp_extract("name", r"^\.~lock\.(.*)#$", 1))
    keys = locks.select("folder", covered.alias("key"), F.col("name").startswith("~$").alias("short"), "owner", "since")
    names = files.select("path", "folder", F.explode(F.expr("array(struct(name as key, 0 as cut), struct(substr(name, 2) as key, 1 as cut), struct(substr(name, 3) as key, 2 as cut))")).alias("k")).select("path", "folder", "k.*")
    hits = names.join(keys, ["folder", "key"]).where("cut = 0 or short").groupBy("path").agg(F.min_by(F.struct("owner", "since"), "cut").alias("l"))
    return files.join(hits, "path", "left").select(*files.columns, "l.owner", "l.since")
