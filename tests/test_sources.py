"""Workbooks, listings and sinks on files."""

import unicodedata
import zipfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evidra.operators import ingest as I
from evidra.sources import listing, tables, workbooks

HEAD = '<?xml version="1.0"?>'
SHEET = "".join(
    f'<row r="{r}">' + "".join(cells) + "</row>"
    for r, cells in {
        1: ['<c r="A1" t="inlineStr"><is><t>실적</t></is></c>'],
        2: ['<c r="A2" t="s"><v>0</v></c>', '<c r="B2" t="s"><v>1</v></c>', '<c r="C2" t="inlineStr"><is><t>day</t></is></c>'],
        3: ['<c r="A3" t="inlineStr"><is><t>a</t></is></c>', '<c r="B3"><v>10</v></c>', '<c r="C3" s="1"><v>45352</v></c>'],
        4: ['<c r="A4" t="inlineStr"><is><t>b</t></is></c>', '<c r="B4" t="e"><v>#REF!</v></c>', '<c r="C4"><f>A1</f></c>'],
    }.items()
)


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", HEAD + '<workbook xmlns:r="r"><sheets><sheet name="one" r:id="rId1"/><sheet name="two" state="hidden" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", HEAD + '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", HEAD + "<sst><si><t>team</t></si><si><r><t>am</t></r><r><t>ount</t></r></si></sst>")
        z.writestr("xl/styles.xml", HEAD + '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", HEAD + f"<worksheet><sheetData>{SHEET}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", HEAD + '<worksheet><sheetData><row r="1"><c r="A1" t="b"><v>1</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    cells, files = workbooks.read_cells(spark, str(tmp_path))
    got = {(r["sheet"], r["row_no"], r["col_no"]): (r["kind"], r["v_text"], r["v_num"]) for r in cells.collect()}
    assert got[("one", 2, 2)] == ("s", "amount", None) and got[("one", 3, 2)] == ("n", None, 10.0)
    assert got[("one", 3, 3)] == ("d", "2024-03-01 00:00:00", None) and got[("one", 4, 2)][0] == "e" and got[("two", 1, 1)] == ("b", "TRUE", None)
    facts = {r["path"].rsplit("/", 1)[-1]: r for r in files.collect()}
    assert facts["a.xlsx"]["uncached"] == 1 and facts["broken.xlsx"]["error"] and set(facts) == {"a.xlsx", "broken.xlsx"}
    one = cells.where("sheet = 'one'").select(*I.CELL, "kind", "v_text", "v_num")
    assert I.detect_header(one).collect()[0]["header_row"] == 2


def large(path, rows=3000, note=""):
    """Two sheets with shared strings, gaps, a phonetic hint, odd numbers and something behind the rows."""
    row = lambda k: f'<x:row r="{k}"><x:c r="A{k}" t="s"><x:v>{k % 7}</x:v></x:c><x:c r="C{k}"><x:v>{k}.5</x:v></x:c><x:c r="D{k}" s="1"><x:v>{k}</x:v></x:c><x:c r="AB{k}" t="str"><x:f>A1</x:f><x:v>t&lt;row {k}</x:v></x:c></x:row>'
    sheet = lambda n: HEAD + f'<x:worksheet xmlns:x="m"><x:cols><x:col a="1>0"/></x:cols><x:sheetData>{note}' + "".join(map(row, range(1, n + 1))) + "</x:sheetData><x:tail>" + "<x:t/>" * 5000 + "</x:tail></x:worksheet>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", HEAD + '<workbook xmlns:r="r"><sheets><sheet name="big" sheetId="1" r:id="rId1"/><sheet name="small" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", HEAD + '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", HEAD + "<sst>" + "".join(f"<si><t>word{k}</t><rPh><t>hint</t></rPh></si>" for k in range(7)) + "</sst>")
        z.writestr("xl/styles.xml", HEAD + '<styleSheet><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet(rows))
        z.writestr("xl/worksheets/sheet2.xml", sheet(5))


@pytest.mark.parametrize("note", ["", "<!-- <row r='1'> -->"])
def test_parts_of_large_sheets(spark, tmp_path, note, monkeypatch):
    monkeypatch.setattr(workbooks, "READ", 1000)  # many edges of chunks, where this process decodes
    large(tmp_path / "a.xlsx", note=note)
    path = str(tmp_path / "a.xlsx")
    taken = lambda parts: [[r for b in workbooks.decode(path, "p", k, parts, workbooks.NAMES[:9], facts=False) for r in b.to_pylist()] for k in range(parts)]
    whole = taken(1)[0]
    assert len(whole) == 4 * 3005 and whole[3]["v_text"] == "t<row 1" and whole[0]["v_text"] == "word1" and whole[2]["kind"] == "d"
    for parts in (2, 3, 16):
        got = taken(parts)
        key = lambda r: (r["sheet_index"], r["row_no"], r["col_no"])
        assert sorted((r for p in got for r in p), key=key) == whole
        assert note or min(map(len, got)) >= 0 and sum(map(bool, got)) > parts // 2
    cells, files = workbooks.read_cells(spark, str(tmp_path), part_bytes=2000)
    assert cells.count() == 4 * 3005 and cells.rdd.getNumPartitions() > 4
    assert [(r["uncached"], r["error"]) for r in files.collect()] == [(0, None)]


def test_each_file_is_decoded_once(spark, tmp_path, monkeypatch):
    for name in ("a", "b", "c"):
        workbook(tmp_path / f"{name}.xlsx")
    cells, files = workbooks.read_cells(spark, str(tmp_path))
    for df in (cells, files):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RelationV2") == 1
    seen, real = [], workbooks.decode
    monkeypatch.setattr(workbooks, "decode", lambda source, path, *rest: seen.append(path) or real(source, path, *rest))
    reader = workbooks._Reader(str(tmp_path), workbooks.NAMES, 1 << 20, 1)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(seen) == len(set(seen)) == 3 and len(reader.partitions()) == 3 and sum(r["kind"] == "file" for r in rows) == 3


def test_filters_and_columns_reach_the_source(spark, tmp_path):
    for name in ("a", "b"):
        workbook(tmp_path / f"{name}.xlsx")
    (tmp_path / "z.xlsx").write_bytes(b"no zip")
    rows = workbooks.workbook_rows(spark, str(tmp_path))
    one = rows.where("sheet = 'two' and path like 'file:%a.xlsx'")
    assert [(r["path"].rsplit("/", 1)[-1], r["v_text"]) for r in one.collect()] == [("a.xlsx", "TRUE")]
    exact = rows.where(F.col("path") == f"file:{tmp_path}/b.xlsx")
    assert exact.where("kind <> 'file'").count() == 10 and exact.where("kind = 'file'").count() == 1
    reader = workbooks._Reader(str(tmp_path), workbooks.NAMES, 1 << 20, 1)
    from pyspark.sql.datasource import EqualTo, In

    assert list(reader.pushFilters([EqualTo(("path",), f"file:{tmp_path}/b.xlsx"), In(("sheet",), ("two",)), EqualTo(("row_no",), 1)])) == [EqualTo(("row_no",), 1)]
    assert [p.files for p in reader.partitions()] == [[(f"{tmp_path}/b.xlsx", 0, 1)]] and not reader.facts
    numbers = workbooks.workbook_rows(spark, str(tmp_path), ["path", "row_no", "v_num"])
    assert numbers.columns == ["path", "row_no", "v_num"] and numbers.where("v_num = 10").count() == 2
    assert spark.read.format("workbook").load(str(tmp_path / "a.xlsx")).where("kind <> 'file'").count() == 10


def test_damaged_workbooks_give_no_cells(spark, tmp_path):
    large(tmp_path / "bad.xlsx")
    raw = bytearray((tmp_path / "bad.xlsx").read_bytes())
    at = raw.index(b"xl/worksheets/sheet2.xml") + 200
    raw[at : at + 4] = b"\0\0\0\0"
    (tmp_path / "bad.xlsx").write_bytes(raw)
    workbook(tmp_path / "odd.xlsx")
    with zipfile.ZipFile(tmp_path / "odd.xlsx", "a") as z:
        z.writestr("xl/comments1.xml", "<open>")
    cells, files = workbooks.read_cells(spark, str(tmp_path), part_bytes=2000)
    assert cells.collect() == [] and all(r["error"] for r in files.collect()) and files.count() == 2


def test_odd_cells(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    cells = '<row><c><v>1</v></c><c t="s"><v>99</v></c><c><v>x1</v></c><c s="1"><v>1e300</v></c></row><row><c t="inlineStr"><is><t>p</t><r><t>q</t></r><rPh><t>h</t></rPh></is></c><c t="str"><v></v></c></row>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z, zipfile.ZipFile(tmp_path / "a.xlsx") as y:
        for n in y.namelist():
            z.writestr(n, HEAD + f"<worksheet><sheetData>{cells}</sheetData></worksheet>" if n.endswith("sheet2.xml") else y.read(n))
    got, _ = workbooks.read_cells(spark, str(tmp_path))
    rows = sorted(tuple(r[c] for c in ("row_no", "col_no", "kind", "v_text", "v_num")) for r in got.where("sheet = 'two' and path like '%b.xlsx'").collect())
    assert rows == [(1, 1, "n", None, 1.0), (1, 2, "e", "99", None), (1, 3, "e", "x1", None), (1, 4, "n", None, 1e300), (2, 1, "s", "pq", None), (2, 2, "s", "", None)]


def test_listing(spark, tmp_path):
    for name in ("a.xlsx", "~$a.xlsx", "old.xls", "._x.xlsx", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = {r["name"]: r["skip_reason"] for r in listing.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.xlsx": None, "~$a.xlsx": "lock", "old.xls": "legacy"}
    assert len({r["sha256"] for r in listing.fingerprint(spark, str(tmp_path)).collect()}) == 1


def test_links_and_many_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.xlsx").write_bytes(b"x")
    (tmp_path / "link.xlsx").symlink_to(tmp_path / "f0.xlsx")
    got = {r["name"]: r["skip_reason"] for r in listing.list_files(spark, str(tmp_path), 3).collect()}
    assert got == {"f0.xlsx": None, "f1.xlsx": None, "f2.xlsx": None, "f3.xlsx": "too_many", "f4.xlsx": "too_many", "link.xlsx": "symlink"}


def test_names_are_composed_and_unreadable_files_told(spark, tmp_path):
    folder = tmp_path / unicodedata.normalize("NFD", "영업팀")
    folder.mkdir()
    (folder / unicodedata.normalize("NFD", "실적 보고.xlsx")).write_bytes(b"x")
    row = listing.list_files(spark, str(tmp_path)).first()
    assert (row["name"], row["rel"], row["folder"].rsplit("/", 1)[1]) == ("실적 보고.xlsx", "영업팀/실적 보고.xlsx", "영업팀")
    assert spark.read.format("binaryFile").load(row["path"]).count() == 1
    gone = spark.createDataFrame([(f"file:{tmp_path}/gone.xlsx", 5, None), ("s3://store/a.xlsx", 5, None)], "path string, size long, mtime timestamp")
    told = listing.looked_at(gone).withColumn("reason", listing.skip_reason(F.lit("a.xlsx"), F.col("size"), F.col("link"), F.col("readable")))
    assert [r["reason"] for r in told.collect()] == ["unreadable", None]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "db")
    one, two = (spark.createDataFrame([(x,)], "a int") for x in (1, 2))
    tables.write_tables({"files": one, "sheets": one}, root, "k")
    broken = two.select(F.raise_error(F.lit("stop")).cast("int").alias("a"))
    try:
        tables.write_tables({"files": two, "sheets": broken}, root, "k")
        raise AssertionError
    except Exception as problem:
        assert not isinstance(problem, AssertionError)
    assert [tables.read_table(spark, root, n, "k").first()["a"] for n in ("files", "sheets")] == [1, 1]
    tables.write_tables({"files": two, "sheets": two}, root, "k")
    assert tables.read_table(spark, root, "sheets", "k").first()["a"] == 2 and [n for n, *_ in tables.snapshots(spark, root, "k")] == [1, 2]


def test_readers_keep_what_they_opened(spark, tmp_path):
    root = str(tmp_path / "db")
    one = lambda x: {"files": spark.createDataFrame([(x,)], "a int")}
    assert tables.write_tables(one(1), root, "k") == 1
    opened = tables.read_table(spark, root, "files", "k")
    assert tables.write_tables(one(2), root, "k") == 2
    assert [r["a"] for r in opened.collect()] == [1]
    assert [tables.read_table(spark, root, "files", "k", n).first()["a"] for n in (None, 1, 2)] == [2, 1, 2]
    assert tables.write_tables(one(3), root, "k", retention=0) == 3  # what was replaced goes at once
    assert [n for n, *_ in tables.snapshots(spark, root, "k")] == [3] and len(list((tmp_path / "db/_versions/k").glob("data-*"))) == 1
    with pytest.raises(ValueError, match="no snapshot 1"):
        tables.read_table(spark, root, "files", "k", 1)


def test_two_writers(spark, tmp_path):
    """All commit, under numbers of their own, and none is lost."""
    root = str(tmp_path / "db")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda x: tables.write_tables({"files": spark.createDataFrame([(x,)], "a int")}, root, "k"), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert [tables.read_table(spark, root, "files", "k", n).first()["a"] for n in numbers] == list(range(6))
    assert tables._create(spark, f"{root}/_versions/k/_log/0000000003", "{}") is False


def test_folders_of_lost_writers_go(spark, tmp_path):
    root = str(tmp_path / "db")
    df = {"files": spark.createDataFrame([(1,)], "a int")}
    tables.write_tables(df, root, "k")
    (tmp_path / "db/_versions/k/data-lost/files").mkdir(parents=True)
    tables.write_tables(df, root, "k")
    assert (tmp_path / "db/_versions/k/data-lost").exists()  # it may still be written
    tables.expire(spark, root, "k", 0)
    assert not (tmp_path / "db/_versions/k/data-lost").exists() and tables.read_table(spark, root, "files", "k").count() == 1


def test_sinks(spark, tmp_path):
    root = str(tmp_path / "db")
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    tables.write_tables({"files": df}, root, "one")
    tables.write_tables({"files": df.withColumn("a", F.lit(2))}, root, "two")
    tables.write_tables({"files": df.withColumn("a", F.lit(3))}, root, "one")
    assert [r["a"] for r in tables.read_table(spark, root, "files", "one").collect()] == [3]
    assert [r["a"] for r in tables.read_table(spark, root, "files", "two").collect()] == [2]
    for _ in range(2):
        tables.append_rows(df, root, "log", tables.company_key("acme"))
    assert tables.read_table(spark, root, "log", tables.company_key("acme")).count() == 2
