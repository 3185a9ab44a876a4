"""Sinks: a company's tables as numbered snapshots. A commit is one small file that is created or not, so writers can't take the same number, and
readers keep the snapshot that they opened until retention ends it.

Data go to a folder of their own first. The commit file of a number (``_log/0000000007``) names it; it is created only if it isn't there,
which stores do atomically, and a writer that comes second takes the next number. Snapshots that were replaced longer than
``retention`` ago are deleted by ``expire``, which a commit runs, and so are folders of writers that never came to commit.
"""

from __future__ import annotations

import json
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours that replaced snapshots, and folders without a commit, are kept.
RETENTION = 24.0


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _top(root: str, company_key: str) -> str:
    return f"{root}/_versions/{company_key}"


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Create a file with this text; False if there is one already. Where a store links names (as local ones do), a whole file is linked, so none is
    ever seen half written or taken twice; others create it if absent."""
    files, path = _files(spark, name)
    local = name.removeprefix("file:") if name.startswith(("/", "file:/")) and "://" not in name.replace("file:///", "") else None
    if local is not None:
        import os

        own = f"{local}.{uuid4().hex}"
        with open(own, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(own, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(own)
    try:
        out = files.create(path(name), False)
    except Exception as taken:
        if files.exists(path(name)):
            return False
        raise taken
    out.write(bytearray(text.encode()))
    out.close()
    return True


def snapshots(spark: SparkSession, root: str, company_key: str) -> list[tuple[int, float, str]]:
    """Number, time of commit (seconds) and folder of a company's snapshots, in order."""
    top = f"{_top(root, company_key)}/_log"
    files, path = _files(spark, top)
    if not files.exists(path(top)):
        return []
    found = [(x.getPath().getName(), x.getPath().toString()) for x in files.listStatus(path(top))]
    numbered = sorted((int(name), place) for name, place in found if name.isdigit())
    said = {r[0]: json.loads(r[1]) for r in spark.read.text([p for _, p in numbered], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), "value").collect()} if numbered else {}
    return [(n, said[f"{n:010d}"]["at"], said[f"{n:010d}"]["folder"]) for n, _ in numbered if f"{n:010d}" in said]


def write_tables(tables: dict[str, DataFrame], root: str, company_key: str, retention: float = RETENTION) -> int:
    """Write all tables of one company as its next snapshot and give its number. Until its commit nobody sees any of it; a failure before leaves
    the snapshot before in place, for all tables."""
    spark = next(iter(tables.values())).sparkSession
    top, folder = _top(root, company_key), f"data-{uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{top}/{folder}/{name}")
    files, path = _files(spark, top)
    files.mkdirs(path(f"{top}/_log"))
    number = max((n for n, *_ in snapshots(spark, root, company_key)), default=0) + 1
    while not _create(spark, f"{top}/_log/{number:010d}", json.dumps({"at": time.time(), "folder": folder})):
        number += 1  # another writer was first
    expire(spark, root, company_key, retention)
    return number


def expire(spark: SparkSession, root: str, company_key: str, retention: float = RETENTION) -> None:
    """Delete what was replaced, or written and never committed, more than ``retention`` hours ago."""
    top, until = _top(root, company_key), time.time() - retention * 3600
    files, path = _files(spark, top)
    known = snapshots(spark, root, company_key)
    replaced = [(n, folder) for (n, _, folder), (_, at, _) in zip(known, known[1:]) if at <= until]
    live = {folder for _, _, folder in known} - {folder for _, folder in replaced}
    for x in files.listStatus(path(top)):
        name = x.getPath().getName()
        if name.startswith("data-") and name not in live and (name in dict((f, n) for n, f in replaced) or x.getModificationTime() / 1000 <= until):
            files.delete(x.getPath(), True)
    for n, _ in replaced:
        files.delete(path(f"{top}/_log/{n:010d}"), False)


def read_table(spark: SparkSession, root: str, name: str, company_key: str, number: int | None = None) -> DataFrame:
    """A table of a company: of its latest snapshot, or of the one with this number, or else its history (see ``append_rows``). What is read
    stays as it was opened."""
    known = {n: folder for n, _, folder in snapshots(spark, root, company_key)}
    if number is not None and number not in known:
        raise ValueError(f"no snapshot {number} of {company_key}")
    if known:
        folder = f"{_top(root, company_key)}/{known[number if number is not None else max(known)]}/{name}"
        files, path = _files(spark, folder)
        if files.exists(path(folder)):
            return spark.read.parquet(folder)
    return spark.read.parquet(f"{root}/{name}").where(F.col("company_key") == company_key).drop("company_key")


def append_rows(df: DataFrame, root: str, name: str, company_key: str) -> None:
    """Append to a history table of a company."""
    df.withColumn("company_key", F.lit(company_key)).write.mode("append").partitionBy("company_key").parquet(f"{root}/{name}")


def company_key(name: str) -> str:
    """A folder name for a company: the beginning of the SHA-1 of its name."""
    import hashlib

    return hashlib.sha1(name.encode()).hexdigest()[:16]
