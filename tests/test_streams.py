"""Snapshots that arrive in pieces, late and over restarts, against the batch operator; alerts on changed sources."""

import pytest
from pyspark.sql import functions as F

from evidra.operators.sync import diff_snapshots
from evidra.streaming import sync_stream as S

SCHEMA = "scan_id string, path string, sha256 string"
SCANS = {
    "d1": {"a": "1", "b": "2", "x": "7", "y": "7"},
    "d2": {"a": "9", "c": "2", "x": "7", "z": "7"},
    "d3": {"a": "9", "c": "2", "e": "5", "w/1": "7", "w/2": "7"},
    "d4": {"a": "1", "c": "2"},
    "d5": {},
}


class Source:
    """A folder that files are put in, read one file a batch."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, {x: str(root / x) for x in ("in", "changes", "point")}
        self.n = 0

    def put(self, scan, paths=(), end=False):
        rows = [(scan, p, SCANS[scan][p]) for p in paths] + [(scan, None, None)] * end
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.root["in"])

    def whole(self, scan):
        self.put(scan, SCANS[scan], end=True)

    def stream(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.root["in"])

    def run(self, **options):
        S.sync_stream(self.stream(), self.root["changes"], self.root["point"], buckets=3, **options).awaitTermination()

    def changes(self):
        return {(r["scan_id"], r["since"], r["change"], r["path"], r["moved_to"]) for r in S.read_changes(self.spark, self.root["changes"]).collect()}


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def batch(spark, order):
    """Changes of consecutive scans by the batch operator."""
    frame = lambda s: spark.createDataFrame([*SCANS.get(s, {}).items()], "path string, sha256 string")
    return {(b, a, *r) for a, b in zip(["", *order], order) for r in map(tuple, diff_snapshots(frame(a), frame(b)).collect())}


def test_scans_in_several_batches(spark, source):
    source.put("d1", ["a"])
    source.put("d1", ["b", "x"])
    source.run()
    assert source.changes() == set()  # the scan hasn't ended
    source.put("d1", ["y"], end=True)
    source.put("d2", ["a", "x"])
    source.put("d2", ["c", "z"])
    source.put("d2", end=True)
    source.put("d2", end=True)  # sent twice
    for scan in ("d3", "d4", "d5"):
        source.whole(scan)
    source.run()
    assert source.changes() == batch(spark, ["d1", "d2", "d3", "d4", "d5"])


def test_late_scans_are_placed(spark, source):
    source.whole("d1")
    source.whole("d4")
    source.run()
    assert source.changes() == batch(spark, ["d1", "d4"])
    source.whole("d3")
    source.run()
    assert source.changes() == batch(spark, ["d1", "d3", "d4"])
    source.put("d2", ["a", "c"])
    source.whole("d5")
    source.put("d2", ["x", "z"], end=True)
    source.run()
    assert source.changes() == batch(spark, ["d1", "d2", "d3", "d4", "d5"])


def test_rows_behind_the_mark_correct(spark, source):
    source.put("d1", ["a", "x"], end=True)
    source.whole("d2")
    source.put("d1", ["b"])
    source.run()
    source.put("d1", ["y"])
    source.run()
    assert source.changes() == batch(spark, ["d1", "d2"])


def test_too_late(spark, source):
    for scan in ("d2", "d3", "d4", "d1", "d5"):
        source.whole(scan)
    source.run(kept=2)
    assert {r["scan_id"] for r in S.late_scans(spark, source.root["changes"]).collect()} == {"d1"}
    assert source.changes() == batch(spark, ["d2", "d3", "d4", "d5"])


def test_restart_between_state_and_log(spark, source, monkeypatch):
    """The state has moved on and the log hasn't: the batch runs again from the state before."""
    source.whole("d1")
    source.put("d2", ["a", "x"])
    source.run()
    source.put("d2", ["c", "z"], end=True)
    source.whole("d3")
    stream = S.scan_changes(source.stream(), 3)

    def broken(rows, number):
        rows.collect()  # the state's new version is written
        raise RuntimeError("lost before the log")

    with pytest.raises(Exception, match="lost before the log"):
        stream.writeStream.foreachBatch(broken).option("checkpointLocation", source.root["point"]).trigger(availableNow=True).start().awaitTermination()
    assert source.changes() == batch(spark, ["d1"])
    source.run()
    assert source.changes() == batch(spark, ["d1", "d2", "d3"])


def test_alerts(spark, tmp_path):
    changes, point = str(tmp_path / "changes"), str(tmp_path / "point")
    stamps = spark.createDataFrame([(1, "a", "one"), (2, "a", "two"), (2, "b", "b0"), (3, "c", "c0")], "answer_id int, path string, stamp string")
    told = []

    def arrive(*rows):
        spark.createDataFrame(rows, "scan_id string, path string, now string").coalesce(1).write.mode("append").parquet(changes)
        stream = spark.readStream.schema("scan_id string, path string, now string").parquet(changes)
        q = S.lineage_alerts(stream, F.broadcast(stamps)).writeStream.foreachBatch(lambda b, _: told.extend(map(tuple, b.collect()))).option("checkpointLocation", point).trigger(availableNow=True).start()
        q.awaitTermination()
        out = sorted(told)
        told.clear()
        return out

    assert arrive(("d1", "a", "one"), ("d1", "b", "b0"), ("d1", "d", "x")) == [("2", "a", "d1", "modified")]
    assert arrive(("d2", "a", "two"), ("d2", "b", None)) == [("1", "a", "d2", "modified"), ("2", "a", "d2", "restored"), ("2", "b", "d2", "deleted")]
    assert arrive(("d2", "a", "two"), ("d2", "b", None)) == []  # sent again
    assert arrive(("d3", "a", "one"), ("d4", "a", "two"), ("d3", "b", "b0")) == [("1", "a", "d3", "restored"), ("1", "a", "d4", "modified"), ("2", "a", "d3", "modified"), ("2", "a", "d4", "restored"), ("2", "b", "d3", "restored")]


def test_alerts_follow_the_log(spark, source, tmp_path):
    for scan in ("d1", "d2", "d4"):
        source.whole(scan)
    source.run()
    stamps = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "answer_id int, path string, stamp string")
    log = spark.readStream.schema(f"{S.LOG}, batch long").parquet(source.root["changes"])
    q = S.lineage_alerts(log, stamps).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "p2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("alerts").collect()} == {("1", "a", "d2", "modified"), ("1", "a", "d4", "restored"), ("2", "b", "d2", "deleted")}
