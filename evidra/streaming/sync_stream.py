"""Snapshots that arrive as a stream, in any pieces and any order, and alerts on answers whose sources changed.

A scan is a set of rows (scan_id, path, sha256) and one end mark, a row without a path. Its rows may come in several batches, and a scan may end
after later ones. Paths are dealt to a fixed number of buckets; each bucket keeps in the state store which hash each path had in
the scans that still count, and which scans have ended. End marks go to all buckets. When a scan ends, each bucket writes how its paths
differ from the scan before, and, if the scan came late, how the scan after differs from it; that replaces what was written before.

The log of changes has one folder a batch, written anew if the batch runs again, so a restart between the state and the log loses and
repeats nothing. ``read_changes`` gives the changes that hold now, as the batch operator ``diff_snapshots`` gives them for each two scans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evidra.operators.sync import STAMP, paired_moves

#: Buckets of paths (fixed for a checkpoint), and ended scans in which a late scan still finds its place.
BUCKETS, KEPT = 64, 8
LOG = "scan_id string, since string, path string, old string, now string"
LATE = "late"


class _Scans(StatefulProcessor):
    """State of one bucket: by path the hash in each scan that counts, and the ended scans in order."""

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "path string", "hashes string")
        self.ended = handle.getValueState("ended", "scans string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh, marks = {}, set()
        for r in rows:
            if r["path"] is None:
                marks.add(r["scan_id"])
            else:
                fresh.setdefault(r["path"], {})[r["scan_id"]] = r["sha256"]
        ended = json.loads(self.ended.get()[0]) if self.ended.exists() else []
        marks -= set(ended)
        past = {s for s in marks if len(ended) >= self.kept and s < ended[0]}
        order = sorted(set(ended) | (marks - past))
        before = dict(zip(order, ["", *order[:-1]]))
        if len(ended) >= self.kept:  # what came before the first one isn't held any more
            before.pop(ended[0], None)
        new = {(a, b) for b, a in before.items() if b in marks or a in marks}
        held = order[-self.kept :]
        for path, hashes in fresh.items():
            known = json.loads(self.seen.getValue((path,))[0]) if self.seen.containsKey((path,)) else {}
            # Rows behind their scan's end mark correct what was written for that scan.
            amended = {(a, b) for b, a in before.items() if (b in hashes or a in hashes) and (a, b) not in new and b in ended}
            known |= hashes
            for a, b in amended:
                yield Row(scan_id=b, since=a, path=path, old=known.get(a), now=known.get(b))
            self.seen.updateValue((path,), (json.dumps({s: h for s, h in known.items() if s >= order[0]} if order else known),))
        if new:
            gone = []
            for (path,), (hashes,) in self.seen.iterator():
                known = json.loads(hashes)
                for a, b in new:
                    if known.get(a) != known.get(b):
                        yield Row(scan_id=b, since=a, path=path, old=known.get(a), now=known.get(b))
                if max(known, default="") < held[0]:
                    gone.append(path)
            for path in gone:
                self.seen.removeKey((path,))
        if marks:
            self.ended.update((json.dumps(held),))
        if key[0] == 0:  # heads, once: which scan was compared with which, also where nothing differs
            for a, b in new:
                yield Row(scan_id=b, since=a, path=None, old=None, now=None)
            for s in past:
                yield Row(scan_id=s, since=None, path=None, old=LATE, now=None)

    def close(self) -> None:
        pass


def _stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def scan_changes(scans: DataFrame, buckets: int = BUCKETS, kept: int = KEPT) -> DataFrame:
    """A stream of log rows (scan_id, since, path, old, now) for a stream of scans (scan_id, path, sha256; an end mark has no path). Rows without
    a path are heads; ``old`` is ``late`` in the head of a scan that ended after ``kept`` later ones and can't be placed any more."""
    bucket = F.when(F.col("path").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    dealt = scans.where("scan_id is not null").select("scan_id", "path", F.coalesce("sha256", F.lit("")).alias("sha256"), F.explode(bucket).alias("bucket"))
    return dealt.groupBy("bucket").transformWithState(_Scans(kept), LOG, outputMode="append", timeMode="none")


def sync_stream(scans: DataFrame, changes: str, checkpoint: str, buckets: int = BUCKETS, kept: int = KEPT) -> StreamingQuery:
    """Run over what has arrived of a stream of scans and write the log of changes, one folder a batch."""
    _stateful(scans.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return scan_changes(scans, buckets, kept).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, changes: str) -> DataFrame:
    """(scan_id, since, change, path, moved_to) of every scan against the one before it, as far as is known now; ``since`` is empty for the first.
    A late scan replaces what the scan after it was compared with; later batches correct earlier ones path by path."""
    log = spark.read.schema(f"{LOG}, batch long").parquet(changes)
    heads = log.where("path is null and since is not null").groupBy("scan_id").agg(F.max("since").alias("since"))
    last = log.where("path is not null").join(heads, ["scan_id", "since"]).groupBy("scan_id", "since", "path").agg(F.max_by(F.struct("old", "now"), "batch").alias("v"))
    return paired_moves(last.select("scan_id", "since", "path", "v.old", "v.now"), ["scan_id", "since"])


def late_scans(spark: SparkSession, changes: str) -> DataFrame:
    """Scans that ended too late to be placed."""
    return spark.read.schema(f"{LOG}, batch long").parquet(changes).where(f"path is null and old = '{LATE}'").select("scan_id").distinct()


class _Alerts(StatefulProcessor):
    """State of one source of one answer: the stamp of which was told last; none while the source is as the answer saw it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "stamp string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["scan_id"]):
            told = self.told.get()[0] if self.told.exists() else None
            if r["now"] == r["stamp"]:
                self.told.clear()
                if told is not None:
                    yield Row(answer_id=key[0], path=key[1], scan_id=r["scan_id"], change="restored")
            elif r["now"] != told:
                self.told.update((r["now"],))
                yield Row(answer_id=key[0], path=key[1], scan_id=r["scan_id"], change="modified" if r["now"] else "deleted")

    def close(self) -> None:
        pass


def lineage_alerts(changes: DataFrame, stamps: DataFrame) -> DataFrame:
    """A stream of alerts (answer_id, path, scan_id, change) for a stream of changes (scan_id, path, now: the hash, null if gone; e.g. the log of
    ``sync_stream``) and the stored sources of answers (answer_id, path, stamp). A source is told once for each state in which it
    differs from its stamp: a change that is sent again is silent, a change back tells ``restored``, and a new change is told anew."""
    _stateful(changes.sparkSession)
    now = F.coalesce(F.left("now", F.lit(STAMP)), F.lit(""))
    met = changes.where("path is not null").select("scan_id", "path", now.alias("now")).join(stamps.select(F.col("answer_id").cast("string").alias("answer_id"), "path", "stamp"), "path")
    return met.groupBy("answer_id", "path").transformWithState(_Alerts(), "answer_id string, path string, scan_id string, change string", outputMode="append", timeMode="none")
