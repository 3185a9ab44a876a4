"""Workbooks as a Spark data source: ``spark.read.format("workbook").load(folder)`` gives cells and facts of all workbooks below a folder.

A workbook is a zip of XML parts, decoded with the standard library only. A task reads several small workbooks or one part of a large
one: part r of k decodes the rows whose text begins in the r-th of k equal stretches of each sheet, so one large sheet is read by many
tasks. Filters on ``path``, ``sheet``, ``sheet_index`` and ``kind`` are used before anything is decoded, and a schema with fewer columns
(``.schema(...)``) decodes no more than it needs. Sheets and shared strings are parsed as streams; no tree is built.

Cached values are read; formulas without one are counted. Rows of kind ``file`` are facts: unpacked size, uncached formulas and error of what one task
saw of a file. A file that is no workbook, is damaged (checksums and XML are verified before its first cell) or unpacks to more than
``MOST_UNPACKED`` bytes gives an error and no cells. A number that can't be read is an error cell with its text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path
from xml.parsers import expat

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringStartsWith
from pyspark.sql.types import StructType

MOST_UNPACKED, CELLS_A_BATCH = 600 * 1024 * 1024, 50_000
#: Packed bytes from which a workbook is read in parts, parts at most (each verifies the whole file), and packed bytes of a task.
PART_BYTES, MOST_PARTS, TASK_BYTES = 1 << 20, 16, 32 << 20
READ = 1 << 20
CELLS = "path string, sheet string, sheet_index int, hidden boolean, row_no long, col_no long, kind string, v_text string, v_num double, unpacked long, uncached long, error string"
NAMES = [x.split()[0] for x in CELLS.split(", ")]
TYPES = dict(zip(NAMES, [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]))
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # fixed value: built-in number formats of days and times
ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])")


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _parse(chunks: Iterator[bytes], start=None, end=None, text=None) -> None:
    """Feed chunks to a parser with handlers of local names."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    if start:
        parser.StartElementHandler = lambda name, attributes: start(_local(name), {_local(k): v for k, v in attributes.items()})
    if end:
        parser.EndElementHandler = lambda name: end(_local(name))
    parser.CharacterDataHandler = text
    for chunk in chunks:
        parser.Parse(chunk, False)
    parser.Parse(b"", True)


def _chunks(book: zipfile.ZipFile, name: str) -> Iterator[bytes]:
    with book.open(name) as part:
        while chunk := part.read(READ):
            yield chunk


def _elements(book: zipfile.ZipFile, name: str, *wanted: str) -> list[tuple[str, dict[str, str]]]:
    """(name, attributes) of elements of a small part; none if it isn't there."""
    found: list[tuple[str, dict[str, str]]] = []
    if name in book.NameToInfo:
        _parse(_chunks(book, name), lambda tag, attributes: found.append((tag, attributes)) if tag in wanted else None)
    return found


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    """Shared strings in order; phonetic hints aren't part of them."""
    out, now, state = [], [], {"t": False, "rPh": 0}

    def start(tag, _):
        if tag == "si":
            now.clear()
        elif tag == "rPh":
            state["rPh"] += 1
        state["t"] = tag == "t" and not state["rPh"]

    def end(tag):
        state["t"] = False
        if tag == "si":
            out.append("".join(now))
        elif tag == "rPh":
            state["rPh"] -= 1

    if "xl/sharedStrings.xml" in book.NameToInfo:
        _parse(_chunks(book, "xl/sharedStrings.xml"), start, end, lambda s: now.append(s) if state["t"] else None)
    return out


@dataclass
class _Book:
    """What all sheets of a workbook share."""

    zip: zipfile.ZipFile
    strings: list[str]
    dated: list[bool] = field(default_factory=list)
    epoch: datetime = datetime(1899, 12, 30)

    def __post_init__(self) -> None:
        own = {int(a["numFmtId"]) for _, a in _elements(self.zip, "xl/styles.xml", "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", a.get("formatCode", "")), re.I)}
        inside = False
        for tag, a in _elements(self.zip, "xl/styles.xml", "cellStyleXfs", "cellXfs", "cellStyles", "xf"):
            if tag == "xf" and inside:
                number = int(a.get("numFmtId", 0))
                self.dated.append(number in DATE_FORMATS or number in own)
            inside = tag == "cellXfs" or (tag == "xf" and inside)
        if any(a.get("date1904") in ("1", "true") for _, a in _elements(self.zip, "xl/workbook.xml", "workbookPr")):
            self.epoch = datetime(1904, 1, 1)

    def sheets(self) -> list[tuple[str, int, bool, str]]:
        """Name, index, whether hidden, and part of each sheet."""
        parts = {a.get("Id"): a.get("Target", "").lstrip("/").removeprefix("xl/") for _, a in _elements(self.zip, "xl/_rels/workbook.xml.rels", "Relationship")}
        listed = [a for _, a in _elements(self.zip, "xl/workbook.xml", "sheet")]
        # The relation's attribute is r:id; by local names it is "id" beside "sheetId".
        return [(a.get("name"), i, a.get("state", "visible") != "visible", f"xl/{parts.get(a.get('id'))}") for i, a in enumerate(listed)]


def _open_tags(xml: bytes) -> list[str]:
    """Names of the elements that are open at the end of a beginning of a document."""
    stack: list[str] = []
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = lambda name, _: stack.append(name), lambda _: stack.pop()
    parser.Parse(xml, False)
    return stack


def _cuttable(book: zipfile.ZipFile, name: str) -> tuple[bytes, int] | None:
    """What stands before the first row of a sheet, if its rows have numbers and no comment or marked section could hold the look of a row."""
    with book.open(name) as part:
        start = part.read(READ)
    first, before = ROW.search(start), b""
    if first is None or not re.match(rb"<[^<>]*?\sr\s*=", start[first.start() :]):
        return None
    for chunk in _chunks(book, name):
        if b"<!" in before[-1:] + chunk:
            return None
        before = chunk
    return start[: first.start()], first.start()


def _stretch(book: zipfile.ZipFile, name: str, part: int, parts: int) -> Iterator[bytes]:
    """XML of the rows of a sheet that begin in one of ``parts`` equal stretches, as a document of its own. Sheets that can't be cut fall to the
    first part whole."""
    if parts == 1 or (head := _cuttable(book, name)) is None:
        if part == 0:
            yield from _chunks(book, name)
        return
    opened, first = head
    size = book.getinfo(name).file_size
    low, high = max(size * part // parts, first) if part else first, size * (part + 1) // parts
    yield opened
    held, at, begun, edge = b"", 0, False, 256  # a tag may lie across chunks
    for chunk in _chunks(book, name):
        at += len(chunk)
        held += chunk
        if not begun:
            found = next((m.start() for m in ROW.finditer(held) if at - len(held) + m.start() >= low), None)
            begun, held = (True, held[found:]) if found is not None else (False, held[-edge:])
        if begun and part < parts - 1 and at >= high:
            if (stop := next((m.start() for m in ROW.finditer(held) if at - len(held) + m.start() >= high), None)) is not None:
                yield held[:stop]
                break
        if begun:
            yield held[:-edge]
            held = held[-edge:]
    else:
        if begun:  # to the sheet's own end
            yield held
            return
    yield "".join(f"</{t}>" for t in reversed(_open_tags(opened))).encode()


@dataclass
class _Sheet:
    """Handlers that turn the events of a sheet into cells (row, column, kind, text, number)."""

    book: _Book
    cells: list[tuple] = field(default_factory=list)
    uncached: int = 0
    row: int = 0
    column: int = 0

    def start(self, tag: str, a: dict[str, str]) -> None:
        if tag == "c":
            self.kind, self.style, self.formula, self.value, self.text, self.hint = a.get("t", "n"), a.get("s"), False, None, None, 0
            if place := a.get("r"):
                letters = place.rstrip("0123456789")
                self.column = 0
                for x in letters:
                    self.column = self.column * 26 + ord(x) - 64
            else:
                self.column += 1
        elif tag == "v":
            self.value = self.part = []
        elif tag == "t":
            self.text = self.text if self.text is not None else []
            self.part = None if self.hint else self.text
        elif tag == "f":
            self.formula = True
        elif tag == "rPh":
            self.hint += 1
        elif tag == "row":
            self.row, self.column = int(a["r"]) if "r" in a else self.row + 1, 0

    part = None

    def characters(self, s: str) -> None:
        if self.part is not None:
            self.part.append(s)

    def end(self, tag: str) -> None:
        if tag in ("v", "t"):
            self.part = None
        elif tag == "rPh":
            self.hint -= 1
        elif tag == "c":
            if (cell := self.cell()) is not None:
                self.cells.append((self.row, self.column, *cell))

    def cell(self) -> tuple[str, str | None, float | None] | None:
        if self.kind == "inlineStr":
            return ("s", "".join(self.text), None) if self.text is not None else None
        value = "".join(self.value) if self.value is not None else ""
        if value == "" and self.kind != "str":
            self.uncached += self.formula
            return None
        if self.kind == "s":
            k = int(value) if value.isdigit() else -1
            return ("s", self.book.strings[k], None) if 0 <= k < len(self.book.strings) else ("e", value, None)
        if self.kind == "str":
            return "s", value, None
        if self.kind == "b":
            return "b", "TRUE" if value == "1" else "FALSE", None
        if self.kind == "e":
            return "e", value, None
        if self.kind == "d":
            return "d", value.replace("T", " "), None
        try:
            number = float(value)
            style = int(self.style or 0)
            if style < len(self.book.dated) and self.book.dated[style]:
                return "d", str(self.book.epoch + timedelta(seconds=round(number * 86400))), None
        except OverflowError:
            return "n", None, number  # no day so far off
        except ValueError:
            return "e", value, None
        return "n", None, number


def decode(source, path: str, part: int, parts: int, columns: Sequence[str], keep=lambda name, index: True, cells: bool = True, facts: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of ``columns`` of one part of a workbook (a file object): cells of sheets that ``keep`` lets through, then the facts."""

    def batch(n: int, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, TYPES[c]) if isinstance(v := values.get(c), list) else pa.array([v] * n, TYPES[c]) for c in columns], list(columns))

    unpacked = uncached = error = None
    try:
        with zipfile.ZipFile(source) as file:
            unpacked = sum(i.file_size for i in file.infolist())
            if unpacked > MOST_UNPACKED:
                raise ValueError("too large")
            text = "v_text" in columns and cells
            for name in file.namelist():  # reading to the end compares checksums
                if name.startswith("xl/") and name.endswith(".xml"):
                    _parse(_chunks(file, name))
            book = _Book(file, _shared_strings(file) if text else [])
            uncached = 0
            for name, index, hidden, place in book.sheets():
                if place not in file.NameToInfo or not keep(name, index):
                    continue
                sheet = _Sheet(book)
                if not text:
                    sheet.book.strings = _Any()
                for chunk in _sheet_batches(sheet, _stretch(file, place, part, parts)):
                    if cells and chunk:
                        row, column, kind, v_text, v_num = map(list, zip(*chunk))
                        yield batch(len(chunk), path=path, sheet=name, sheet_index=index, hidden=hidden, row_no=row, col_no=column, kind=kind, v_text=v_text, v_num=v_num)
                uncached += sheet.uncached
    except (zipfile.BadZipFile, expat.ExpatError, ValueError, KeyError, EOFError, OSError, RuntimeError, NotImplementedError, zipfile.zlib.error) as problem:  # a broken file is a fact about that file
        unpacked = uncached = None
        error = f"{type(problem).__name__}: {problem}"
    if facts:
        yield batch(1, path=path, kind="file", unpacked=unpacked, uncached=uncached, error=error)


class _Any(list):
    """Stands for strings that nobody asked for."""

    def __len__(self) -> int:
        return 1 << 62

    def __getitem__(self, _):
        return ""


def _sheet_batches(sheet: _Sheet, chunks: Iterator[bytes]) -> Iterator[list[tuple]]:
    """Cells of a sheet, some at a time."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    local: dict[str, str] = {}

    def start(name: str, attributes: dict[str, str]) -> None:
        sheet.start(local.get(name) or local.setdefault(name, _local(name)), attributes)

    parser.StartElementHandler, parser.CharacterDataHandler = start, sheet.characters
    parser.EndElementHandler = lambda name: sheet.end(local[name])
    began = False
    for chunk in chunks:
        parser.Parse(chunk, False)
        began = True
        while len(sheet.cells) >= CELLS_A_BATCH:
            yield sheet.cells[:CELLS_A_BATCH]
            del sheet.cells[:CELLS_A_BATCH]
    if began:
        parser.Parse(b"", True)
    yield sheet.cells
    sheet.cells = []


def _store(root: str) -> tuple[fs.FileSystem, str, str]:
    """File system, folder there, and what stands before paths in Spark's names."""
    if "://" not in root:
        return fs.LocalFileSystem(), str(Path(root.removeprefix("file:")).resolve()), "file:"
    system, folder = fs.FileSystem.from_uri(root)
    return system, folder, "file:" if root.startswith("file:") else root.partition(folder.split("/")[0] + "/" if not folder.startswith("/") else folder)[0]


@dataclass
class _Piece(InputPartition):
    """Parts of workbooks that one task reads: (file, part, parts)."""

    files: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, root: str, columns: list[str], part_bytes: int, task_bytes: int) -> None:
        self.root, self.columns, self.part_bytes, self.task_bytes = root, columns, part_bytes, task_bytes
        self.tests: dict[str, list] = {}
        self.cells = self.facts = True

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, lists and beginnings of path, sheet and its index decide what is opened; ``kind = 'file'`` and its opposite what is given."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if isinstance(f, (EqualTo, In, StringStartsWith)) and name in ("path", "sheet", "sheet_index"):
                self.tests.setdefault(name, []).append(f)
                self.facts &= name == "path"  # facts are of no sheet
            elif isinstance(f, EqualTo) and name == "kind" and f.value == "file":
                self.cells = False
            elif isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute[0] == "kind" and f.child.value == "file":
                self.facts = False
            else:
                yield f

    def _passes(self, name: str, value) -> bool:
        def one(f: Filter) -> bool:
            if isinstance(f, EqualTo):
                return value == f.value
            return value in f.value if isinstance(f, In) else value is not None and value.startswith(f.value)

        return all(map(one, self.tests.get(name, [])))

    def partitions(self) -> list[_Piece]:
        system, folder, front = _store(self.root)
        listed = system.get_file_info(fs.FileSelector(folder, recursive=True)) if system.get_file_info(folder).type == fs.FileType.Directory else [system.get_file_info(folder)]
        out, now, size = [], [], 0
        for info in sorted(listed, key=lambda i: i.path):
            if info.type != fs.FileType.File or not re.search(r"\.xls[xm]$", info.base_name) or info.base_name.startswith(("~$", "._")) or not self._passes("path", front + info.path):
                continue
            parts = min(MOST_PARTS, -(-max(info.size, 1) // self.part_bytes))
            if parts > 1:
                out += [_Piece([(info.path, k, parts)]) for k in range(parts)]
            else:
                now.append((info.path, 0, 1))
                size += info.size
                if size >= self.task_bytes:
                    out.append(_Piece(now))
                    now, size = [], 0
        return out + [_Piece(now)] * bool(now) or [_Piece([])]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        system, _, front = _store(self.root)
        for path, part, parts in partition.files:
            with system.open_input_file(path) as source:
                yield from decode(source, front + path, part, parts, self.columns, lambda name, index: self._passes("sheet", name) and self._passes("sheet_index", index), self.cells, self.facts)


class WorkbookSource(DataSource):
    """Format ``workbook``. Options: ``path``; ``part_bytes`` and ``task_bytes`` for sizes of parts and tasks."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> _Reader:
        columns = [f.name for f in schema.fields]
        if unknown := set(columns) - set(NAMES):
            raise ValueError(f"no such columns of workbooks: {sorted(unknown)}")
        return _Reader(self.options["path"], columns, int(self.options.get("part_bytes", PART_BYTES)), int(self.options.get("task_bytes", TASK_BYTES)))


def workbook_rows(spark: SparkSession, root: str, columns: Sequence[str] = NAMES, **options: int) -> DataFrame:
    """Cells and facts of the workbooks below ``root`` (see the module), only these columns. Where pyarrow doesn't know the store, Spark reads the
    files and each is decoded whole where it was read."""
    schema = ", ".join(x for x in CELLS.split(", ") if x.split()[0] in columns)
    try:
        _store(root)
    except (pa.ArrowException, OSError):
        names = [x.split()[0] for x in schema.split(", ")]
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xls[xm]").load(root).where(~F.col("path").rlike(r"/(~\$|\._)[^/]*$"))

        def run(batches):
            for b in batches:
                for path, content in zip(b.column("path").to_pylist(), b.column("content")):
                    yield from decode(io.BytesIO(content.as_py()), path, 0, 1, names)

        return raw.select("path", "content").mapInArrow(run, schema)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").schema(schema).options(**options).load(root)


def read_cells(spark: SparkSession, root: str, **options: int) -> tuple[DataFrame, DataFrame]:
    """(cells, files): cells of all sheets of the workbooks below ``root``, and per file its size unpacked, number of formulas without a stored value,
    and error. Each of the two decodes a file once when it is used."""
    cells = workbook_rows(spark, root, NAMES[:9], **options).where("kind <> 'file'")
    facts = workbook_rows(spark, root, ["path", "kind", "unpacked", "uncached", "error"], **options).where("kind = 'file'")
    return cells, facts.groupBy("path").agg(F.max("unpacked").alias("unpacked"), F.sum("uncached").alias("uncached"), F.max("error").alias("error"))
