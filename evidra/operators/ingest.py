"""From cell grids to typed tables, for all sheets at once.

Cells are rows (sheet, row_no, col_no, kind, v_text, v_num), one per cell that isn't empty; kinds are s text, n number, b boolean,
d date, e error. Everything is set-wise: no sheet is collected, and only heads of sheets are looked at for headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.ranges import running_sum

# Words of subtotals, totals and note labels, reserved names, limits of heads, preambles and sheets.
SUBTOTAL = r"(?i)(소\s*계|sub\s*-?\s*total)(\s*[\(（\[].*[\)）\]])?\s*$"
TOTAL = r"(?i)((?:^|\s)[월일대연]\s*계|합\s*계|총\s*계|누\s*계|총\s*합|grand\s*total|total)(\s*[\(（\[].*[\)）\]])?\s*$"
BARE_TOTAL = r"^계\s*$"
NOTE = r"(작성자|작성일|기준일|담당자|부서|작성|문서|단위|마감일|출력일)\s*[:：]?\s*$|[:：]"
LABEL_EDGE = r"^[ \t\[\]【】:：]+|[ \t\[\]【】:：]+$"
RESERVED = ("_row", "_row_kind", "_label")
HEAD_ROWS, WIDTH_ROWS, PREAMBLE_LINES, PREAMBLE_CHARS, MOST_ROWS, WHOLE_BELOW = 30, 50, 12, 200, 300_000, 9e18
CELL = ("sheet", "row_no", "col_no")


def cells_from_table(df: DataFrame, sheet: Column, row_no: Column) -> DataFrame:
    """Any table as cells: numbers keep their value, all else is text; nulls have no cell."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float") or f.dataType.typeName().startswith("decimal")}
    cells = F.array(*(F.struct(F.lit(i + 1).cast("long").alias("col_no"), F.lit("n" if c in numeric else "s").alias("kind"), (F.lit(None) if c in numeric else F.col(c)).cast("string").alias("v_text"), (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("v_num")) for i, c in enumerate(df.columns)))
    return df.select(sheet.alias("sheet"), row_no.cast("long").alias("row_no"), F.explode(cells).alias("c")).select("sheet", "row_no", "c.*").where("v_text is not null or v_num is not null")


def clean_cells(cells: DataFrame) -> DataFrame:
    """Texts trimmed; cells of empty text go."""
    text = F.nullif(F.trim("v_text"), F.lit(""))
    return cells.withColumn("v_text", F.when(F.col("kind") == "s", text).otherwise(F.col("v_text"))).where("kind <> 's' or v_text is not null")


def error_cells(cells: DataFrame) -> DataFrame:
    """How many error cells a sheet has."""
    return cells.groupBy("sheet").agg(F.count_if(F.col("kind") == "e").alias("error_cells"))


def row_cap(cells: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Sheets with their number of rows that aren't empty, those kept, and whether they are cut."""
    rows = cells.where("kind <> 'e'").groupBy("sheet").agg(F.count_distinct("row_no").alias("n_rows"))
    return rows.select("sheet", "n_rows", F.least("n_rows", F.lit(most)).cast("long").alias("kept"), (F.col("n_rows") > most).alias("truncated"))


def _as_rows(cells: DataFrame, most: int) -> DataFrame:
    """The first rows of each sheet that aren't empty, each with its cells in order; ``n`` is the place among such rows."""
    place = F.dense_rank().over(Window.partitionBy("sheet").orderBy("row_no"))
    kept = clean_cells(cells).where("kind <> 'e'").withColumn("n", place).where(F.col("n") <= most)
    grouped = kept.groupBy("sheet", "row_no", "n")
    return grouped.agg(F.array_sort(F.collect_list(F.struct("col_no", "kind", "v_text", "v_num"))).alias("cells"), F.count("*").alias("filled"), F.min("col_no").alias("left"), F.max("col_no").alias("right"))


def header_like(cells: Column) -> Column:
    """All text; or text first and else dates only, years 1900 to 2100 only, or three or more consecutive numbers of 1 to 31."""
    numbers = F.filter(cells, lambda c: c["kind"] != "s")
    values = F.transform(numbers, lambda c: c["v_num"])
    whole = F.forall(numbers, lambda c: (c["kind"] == "n") & (c["v_num"] == F.floor(c["v_num"])))
    steps = F.forall(F.arrays_zip(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))).alias("a"), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))).alias("b")), lambda p: p["b"] - p["a"] == 1)
    labels = F.forall(numbers, lambda c: c["kind"] == "d") | (whole & (F.forall(values, lambda v: v.between(1900, 2100)) | ((F.size(values) >= 3) & F.forall(values, lambda v: v.between(1, 31)) & steps)))
    return F.coalesce((F.size(numbers) == 0) | ((cells[0]["kind"] == "s") & labels), F.lit(False))


def note_like(cells: Column) -> Column:
    """A date, or a text that is a label or holds a colon."""
    return F.coalesce(F.exists(cells, lambda c: (c["kind"] == "d") | ((c["kind"] == "s") & F.trim(c["v_text"]).rlike(NOTE))), F.lit(False))


def detect_header(cells: DataFrame) -> DataFrame:
    """``header_row`` of each sheet: of the first thirty rows the first that fills enough of the sheet's width, reads like labels,
    is no note above a row of labels, and (in narrow sheets) is soon followed by a row of two cells or more."""
    rows = _as_rows(cells, WIDTH_ROWS)
    spans = rows.where("filled >= 2").groupBy("sheet").agg((F.max("right") - F.min("left") + 1).alias("width")).where("width >= 2")
    order = Window.partitionBy("sheet").orderBy("n")
    all_text = F.forall("cells", lambda c: c["kind"] == "s")
    ahead = (
        rows.withColumn("like", header_like(F.col("cells"))).withColumn("note", note_like(F.col("cells"))).withColumn("texts", all_text)
        .withColumn("next_filled", F.lead("filled").over(order)).withColumn("next_texts", F.lead("texts").over(order)).withColumn("next_most", F.max("filled").over(order.rowsBetween(1, 5)))
    )
    need = F.greatest(F.lit(2), F.ceil(F.col("width") * 0.6))
    above = F.col("note") & F.coalesce((F.col("next_filled") >= need) & F.col("next_texts"), F.lit(False))
    good = (F.col("n") <= HEAD_ROWS) & (F.col("filled") >= need) & F.col("like") & ~above & ((F.col("width") > 3) | (F.coalesce("next_most", F.lit(0)) >= 2))
    return ahead.join(spans, "sheet").where(good).groupBy("sheet").agg(F.min("row_no").alias("header_row"))


def preamble(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Lines above the header: cells joined by bars, 200 characters each, the first twelve."""
    rows = _as_rows(cells, PREAMBLE_LINES).join(headers, "sheet").where("row_no < header_row")
    line = F.left(F.array_join(F.transform("cells", lambda c: F.coalesce(c["v_text"], c["v_num"].cast("string"))), " | "), F.lit(PREAMBLE_CHARS))
    return rows.groupBy("sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("preamble"))


def body(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells below the header, without errors."""
    return clean_cells(cells).where("kind <> 'e'").join(headers, "sheet").where("row_no > header_row").drop("header_row")


def kept_columns(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Columns with a header or a cell below it; ``header`` is its text."""
    at = clean_cells(cells).where("kind <> 'e'").join(headers, "sheet").where("row_no >= header_row")
    text = F.coalesce("v_text", F.when(F.col("v_num") == F.floor("v_num"), F.col("v_num").cast("long").cast("string")).otherwise(F.col("v_num").cast("string")))
    return at.groupBy("sheet", "col_no").agg(F.max(F.when(F.col("row_no") == F.col("header_row"), text)).alias("header"))


def unique_names(headers: Column, numbers: Column) -> Column:
    """Clean and unique names of ordered headers (null: ``열n``): a fold, each name taking the first free suffix."""
    clean = lambda h, n: F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(h, r"[\x00-\x1f\x7f]+", " "), r"(?U)\s+", " ")), F.lit("")), F.concat(F.lit("열"), n.cast("string")))
    named = F.transform(F.zip_with(headers, numbers, clean), lambda b: F.when(F.lower(b).isin(*RESERVED), F.concat(F.lit("col_"), b)).otherwise(b))

    def take(done: Column, base: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(1), F.size(done) + 2), lambda k: F.when(k == 1, base).otherwise(F.concat_ws("_", base, k.cast("string")))), lambda x: ~F.exists(done, lambda d: F.lower(d) == F.lower(x)) & ~F.lower(x).isin(*RESERVED))
        return F.concat(done, F.slice(free, 1, 1))

    return F.aggregate(named, F.array().cast("array<string>"), take)


def column_names(columns: DataFrame) -> DataFrame:
    """(sheet, col_no, name) of kept columns; a sheet's headers are one array, bounded by its width."""
    ordered = columns.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col_no", "header"))).alias("h"))
    names = ordered.select("sheet", F.transform("h", lambda x: x["col_no"]).alias("n"), unique_names(F.transform("h", lambda x: x["header"]), F.transform("h", lambda x: x["col_no"])).alias("names"))
    return names.select("sheet", F.explode(F.arrays_zip(F.col("n").alias("col_no"), F.col("names").alias("name"))).alias("x")).select("sheet", "x.col_no", "x.name")


def kind_of(first: Column) -> Column:
    """Subtotal, total or data, from the texts (null for other cells) of a row's first three cells."""
    bare = lambda t: F.regexp_replace(t, LABEL_EDGE, "")
    sub, total = lambda t: F.coalesce(bare(t).rlike(SUBTOTAL), F.lit(False)), lambda t: F.coalesce(bare(t).rlike(TOTAL), F.lit(False))
    marked = F.transform(F.slice(first, 1, 3), lambda t, i: F.when(sub(t), "subtotal").when(total(t) | ((i < 2) & F.coalesce(bare(t).rlike(BARE_TOTAL), F.lit(False))), "total"))
    return F.coalesce(F.try_element_at(F.filter(marked, lambda k: k.isNotNull()), F.lit(1)), F.lit("data"))


def row_kinds(body_cells: DataFrame) -> DataFrame:
    """(sheet, row_no, row_kind, label): only each row's three leftmost cells are gathered."""
    first = body_cells.withColumn("k", F.row_number().over(Window.partitionBy("sheet", "row_no").orderBy("col_no"))).where("k <= 3")
    rows = first.groupBy("sheet", "row_no").agg(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("kind") == "s", F.col("v_text")).alias("t")))).alias("c"))
    kind = kind_of(F.transform("c", lambda x: x["t"]))
    label = F.try_element_at(F.filter(F.transform("c", lambda x: x["t"]), lambda t: t.isNotNull() & (kind_of(F.array(t)) != "data")), F.lit(1))
    return rows.select("sheet", "row_no", kind.alias("row_kind"), F.when(kind != "data", label).alias("label"))


def infer_types(body_cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """(sheet, col_no, dtype, mixed) from data rows, or all rows where a column has none there; a whole-number column is DOUBLE if a
    total of it has decimals. One aggregation a column."""
    rows = body_cells.join(kinds.select("sheet", "row_no", "row_kind"), ["sheet", "row_no"])
    data = F.col("row_kind") == "data"
    kind = lambda k, only: F.count_if((F.col("kind") == k) & only)
    whole = (F.col("v_num") == F.floor("v_num")) & (F.abs("v_num") < WHOLE_BELOW)
    finite = ~F.isnan("v_num") & (F.abs("v_num") != float("inf"))
    g = rows.groupBy("sheet", "col_no").agg(
        F.count_if(data).alias("n"), *(kind(k, data).alias(f"d_{k}") for k in "snbd"), *(kind(k, F.lit(True)).alias(f"a_{k}") for k in "snbd"),
        F.bool_and(F.when((F.col("kind") == "n") & data, whole)).alias("d_whole"), F.bool_and(F.when(F.col("kind") == "n", whole)).alias("a_whole"), F.bool_and(F.when(F.col("kind") == "n", finite)).alias("finite"),
        F.bool_and(F.when(F.col("kind") == "d", F.col("v_text").rlike("^.{10}$|00:00:00"))).alias("midnight"),
    )
    n = lambda k: F.when(F.col("n") > 0, F.col(f"d_{k}")).otherwise(F.col(f"a_{k}"))
    s, num, b, d = n("s"), n("n"), n("b"), n("d")
    numbers = (num > 0) & (s + b + d == 0)
    dtype = (
        F.when((b > 0) & (s + num + d == 0), "BOOLEAN").when(numbers & ~F.col("finite"), "VARCHAR").when(numbers & F.when(F.col("n") > 0, F.col("d_whole") & F.coalesce("a_whole", F.lit(True))).otherwise(F.col("a_whole")), "BIGINT").when(numbers, "DOUBLE")
        .when((d > 0) & (s + num + b == 0) & F.col("midnight"), "DATE").when((d > 0) & (s + num + b == 0), "TIMESTAMP").otherwise("VARCHAR")
    )
    used = sum((F.when(x > 0, 1).otherwise(0) for x in (s, num, b, d)), F.lit(0))
    return g.select("sheet", "col_no", dtype.alias("dtype"), ((used > 1) | (numbers & ~F.col("finite"))).alias("mixed"))


def cell_text(kind: Column, text: Column, number: Column) -> Column:
    """Stable text of a cell: whole numbers without decimals, booleans in capitals, midnight as a date."""
    plain = F.when((number == F.floor(number)) & (F.abs(number) < WHOLE_BELOW), number.cast("long").cast("string")).otherwise(number.cast("string"))
    return F.when(kind == "n", plain).when(kind == "b", F.upper(text)).when(kind == "d", F.regexp_replace(text, "[ T]00:00:00.*$", "")).otherwise(text)


def coerce(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells as values of their column's type: ``v_str``, ``v_dbl``, ``v_int``, ``v_day``; null where impossible."""
    at = cells.join(types.select("sheet", "col_no", "dtype"), ["sheet", "col_no"])
    number, whole = F.col("kind") == "n", F.col("v_num") == F.floor("v_num")
    return at.select(
        *CELL, "dtype",
        F.when(F.col("dtype") == "VARCHAR", cell_text(F.col("kind"), F.col("v_text"), F.col("v_num"))).alias("v_str"),
        F.when((F.col("dtype") == "BIGINT") & number & whole, F.col("v_num").cast("long")).alias("v_int"),
        F.when((F.col("dtype") == "DOUBLE") & number, F.col("v_num")).alias("v_dbl"),
        F.when(F.col("dtype").isin("DATE", "TIMESTAMP") & (F.col("kind") == "d"), F.try_to_timestamp("v_text")).alias("v_day"),
    )


def materialize_layout(typed: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """All sheets of one layout as one wide table: (sheet, row_no) and the named columns as text."""
    value = F.coalesce("v_str", F.col("v_int").cast("string"), F.col("v_dbl").cast("string"), F.col("v_day").cast("string"))
    return typed.join(names, ["sheet", "col_no"]).withColumn("value", value).groupBy("sheet", "row_no").pivot("name", columns).agg(F.first("value"))


def scan_summary(files: DataFrame, most_rows: int = 3_000_000) -> DataFrame:
    """Files by status: skipped for a reason, failed, beyond the row limit of a scan (in path order), partial or ok; with rows.

    The running total goes by ranges of paths: sums per range first, so no single task orders all files."""
    status = F.when(F.col("skip_reason").isNotNull(), F.concat(F.lit("skipped: "), "skip_reason")).when(F.col("so_far") - F.col("n_rows") >= most_rows, "error").when(F.col("truncated"), "partial").otherwise("ok")
    return running_sum(files, "path", "n_rows").withColumn("status", status).groupBy("status").agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"))
