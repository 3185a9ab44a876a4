"""The catalog of files: departments, families of versions, copies, freshness, layouts and time axes."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.joins import contains_join

# Departments and the label of the rest, suffixes of versions, marks of copies, labels of base dates.
DEPARTMENTS = ("영업팀", "경영지원팀", "회계팀", "물류팀", "구매팀", "공용")
UNCLASSIFIED = "미분류"
SUFFIXES = r"(?i)(?:\(\d+\)|\s*-\s*(?:복사본|copy)|[_\s-]*(?:old|수정|최종|천원|final|copy|복사본)|[_\s-]*v\d+|\s)+$"
COPY_MARK = r"(?i)\(\d+\)|복사본|[\s_-]copy"
BASE_DATE = r"(?:기준일|최종\s*수정일|업데이트|작성일|마감일)\s*[:：|]?\s*(\d{4})\s*[-./년]\s*(\d{1,2})\s*[-./월]\s*(\d{1,2})"
SAME_DATA = 0.005
MOST_EXCLUDED, MOST_FOUND, MOST_CLOSEST, MOST_COLUMNS = 10, 12, 5, 50


def classify_department(path: Column, labels: tuple[str, ...] = DEPARTMENTS) -> Column:
    """First known label among the folders, else the first label (in list order) within the file name; paths may be written composed or with syllables
    taken apart (labels are looked for in both forms)."""
    forms = {form: d for d in labels for form in (d, unicodedata.normalize("NFD", d))}
    named = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    known = F.array(*(F.struct(F.lit(d).alias("label"), F.lit(unicodedata.normalize("NFD", d)).alias("apart")) for d in labels))
    parts = F.split(path, "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    by_folder = F.try_element_at(named, F.try_element_at(F.filter(folders, lambda p: p.isin(*forms)), F.lit(1)))
    by_name = F.try_element_at(F.filter(known, lambda d: name.contains(d["label"]) | name.contains(d["apart"])), F.lit(1))["label"]
    return F.coalesce(by_folder, by_name, F.lit(UNCLASSIFIED))


def top_folder(path: Column) -> Column:
    """First folder of a composed path (as ``list_files`` gives them in ``rel``), or empty."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def family_stem(name: Column) -> Column:
    """File name without extension and version marks; a day after a year tag goes too."""
    stem = F.regexp_replace(F.trim(F.regexp_replace(name, r"\.[^.]+$", "")), SUFFIXES, "")
    stem = F.regexp_replace(stem, r"(_\d{4})_\d{4}$", "$1")
    return F.trim(F.regexp_replace(stem, SUFFIXES, ""))


def data_date(preamble: Column, modified: Column) -> Column:
    """First labelled valid date not after the file's own (preamble: lines), else the file's own."""
    found = F.transform(preamble, lambda line: F.try_to_date(F.concat_ws("-", *(F.lpad(F.regexp_extract(line, BASE_DATE, k), 4 if k == 1 else 2, "0") for k in (1, 2, 3))), "yyyy-MM-dd"))
    return F.coalesce(F.try_element_at(F.filter(found, lambda d: d.isNotNull() & (d <= modified.cast("date"))), F.lit(1)), modified.cast("date"))


def detect_copies(files: DataFrame) -> DataFrame:
    """``copy_of``: the original among files of one hash (in a department first, then oldest, unmarked, short, by path)."""
    order = F.struct((~top_folder(F.col("path")).isin(*DEPARTMENTS)).alias("a"), F.col("mtime").alias("b"), F.col("name").rlike(COPY_MARK).alias("c"), F.length("name").alias("d"), F.col("path").alias("e"))
    first = files.groupBy("sha256").agg(F.min(order).alias("_o"))
    return files.join(first, "sha256", "left").withColumn("copy_of", F.when(F.col("_o.e") != F.col("path"), F.col("_o.e"))).drop("_o")


def assign_families(files: DataFrame) -> DataFrame:
    """``family`` of each file (path, stem, dept, folder): in a department its (stem, dept, folder); an outside file joins the
    only family of its stem and department, else stands for itself."""
    key = lambda *c: F.concat_ws("|", *c)
    inside = top_folder(F.col("path")).isin(*DEPARTMENTS)
    families = files.where(inside).select("stem", "dept", key("stem", "dept", "folder").alias("f")).distinct().groupBy("stem", "dept").agg(F.count("*").alias("n"), F.min("f").alias("only"))
    return files.join(families, ["stem", "dept"], "left").withColumn("family", F.when(inside, key("stem", "dept", "folder")).when(F.col("n") == 1, F.col("only")).otherwise(key("stem", "dept", F.lit("")))).drop("n", "only")


def assign_freshness(files: DataFrame) -> DataFrame:
    """``fresh``, ``newer`` and ``tie_with`` of each file (path, family, sha256, data_date, copy_of)."""
    own = files.where("copy_of is null")
    newest = own.groupBy("family").agg(F.max("data_date").alias("newest"), F.min_by("path", F.struct(-F.unix_date("data_date"), F.col("path"))).alias("first"))
    marked = files.join(newest, "family", "left")
    top = own.join(newest, "family").where("data_date = newest").select("family", F.col("path").alias("other"), F.col("sha256").alias("other_sha"))
    ties = marked.where("copy_of is null and data_date = newest").join(top, "family").where("other_sha <> sha256").groupBy("path").agg(F.array_sort(F.collect_set("other")).alias("tie_with"))
    fresh = F.when(F.col("copy_of").isNotNull(), "copy").when(F.col("data_date") == F.col("newest"), "ok").otherwise("stale")
    out = marked.withColumn("fresh", fresh).withColumn("newer", F.when(fresh == "stale", F.col("first"))).drop("newest", "first")
    return out.join(ties, "path", "left")


def numeric_totals(cells: DataFrame, multiplier: Column) -> DataFrame:
    """Sum of data rows per path, sheet and numeric column on one unit; ratio columns stay."""
    ratio = F.col("column").contains("%") | F.col("column").contains("률")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return cells.groupBy("path", "sheet", "column").agg(total.alias("t"), F.max(multiplier).alias("m")).select("path", "sheet", "column", F.when(ratio, F.col("t")).otherwise(F.col("t") * F.col("m")).alias("total"))


def same_data(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Pairs (a, b) of paths whose shared totals all agree within 0.5 %, at least one being shared."""
    x, y = totals.select(F.col("path").alias("a"), "sheet", "column", F.col("total").alias("ta")), totals.select(F.col("path").alias("b"), "sheet", "column", F.col("total").alias("tb"))
    near = F.abs(F.col("ta") - F.col("tb")) <= SAME_DATA * F.greatest(F.abs("ta"), F.abs("tb"), F.lit(1.0))
    return pairs.join(x, "a").join(y, ["b", "sheet", "column"]).groupBy("a", "b").agg(F.bool_and(near).alias("same_data"), F.count("*").alias("compared"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tie_primary(files: DataFrame, same: DataFrame) -> DataFrame:
    """For tied files (path, tie_with): the ``primary`` of the group, which has the shortest name, then the first path; and whether the
    file is a ``format_copy``: not the primary, and its data the same (pairs a, b, same_data) as those of the first file it is tied with."""
    group = F.array_union(F.array("path"), F.col("tie_with"))
    primary = F.array_min(F.transform(group, lambda p: F.struct(F.length(file_name(p)).alias("n"), p.alias("path"))))["path"]
    tied = files.where(F.size("tie_with") > 0).select("path", primary.alias("primary"), F.col("tie_with")[0].alias("_first"))
    known = same.select(F.col("a").alias("path"), F.col("b").alias("_first"), "same_data")
    return tied.join(known, ["path", "_first"], "left").select("path", "primary", ((F.col("path") != F.col("primary")) & F.coalesce("same_data", F.lit(False))).alias("format_copy"))


def catalog_search(columns: DataFrame, requests: DataFrame, tables: DataFrame) -> DataFrame:
    """(request_id, table_id) where the table has every wanted column: columns (table_id, name); requests (request_id, wants, and year, dept,
    file or null), a want ``A|B`` meaning either. A want is met by an equal name or one that contains it. Tables (table_id, path, dept,
    title) of another department, with a path that lacks the file's name, or that name another year first, are left out."""
    each = requests.select("request_id", F.size("wants").alias("n"), F.posexplode("wants").alias("k", "want")).select("request_id", "n", "k", F.explode(F.split("want", r"\|")).alias("alternative"))
    met = contains_join(columns, "name", each.withColumn("alternative", F.trim("alternative")), "alternative")
    found = met.groupBy("request_id", "table_id").agg(F.count_distinct("k").alias("met"), F.max("n").alias("n")).where("met = n").select("request_id", "table_id")
    year = F.nullif(F.regexp_extract(F.concat_ws("", "title", file_name(F.col("path")), "path"), r"(20\d{2})", 1), F.lit(""))
    fits = lambda asked, test: F.col(asked).isNull() | test
    of = found.join(requests.select("request_id", "year", F.col("dept").alias("_dept"), "file"), "request_id").join(tables.select("table_id", "path", "dept", year.alias("_year")), "table_id")
    return of.where(fits("_dept", F.col("dept") == F.col("_dept")) & fits("file", F.col("path").contains(F.trim("file"))) & fits("year", F.coalesce(F.col("_year").cast("int") == F.col("year"), F.lit(True)))).select("request_id", "table_id")


def catalog_excluded(found: DataFrame) -> DataFrame:
    """Stale files, copies and copies in another format (``format_of``: the one that is kept) of each request's hits with the reason, at
    most ten."""
    reason = F.when(F.col("fresh") == "stale", F.concat(F.lit("newer: "), F.coalesce("newer", F.lit("")))).when(F.col("fresh") == "copy", F.concat(F.lit("copy of "), "copy_of")).when(F.col("format_of").isNotNull(), F.concat(F.lit("same data in another format: "), file_name(F.col("format_of"))))
    ranked = found.withColumn("reason", reason).where("reason is not null").withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("path")))
    return ranked.where(F.col("n") <= MOST_EXCLUDED).select("request_id", "path", "reason")


def catalog_order(found: DataFrame) -> DataFrame:
    """Each request's hits: excerpts last, newest base date first, at most twelve."""
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("excerpt", F.desc_nulls_last("data_date"), "path"))
    return found.withColumn("place", n.cast("long")).where(F.col("place") <= MOST_FOUND)


def closest_tables(columns: DataFrame, tables: DataFrame, wants: list[str]) -> DataFrame:
    """The five fresh tables (tables: table_id, fresh) that meet most wants, with what they have and miss. A want ``A|B`` is met by a column whose
    name holds either; tables that meet none are left out."""
    met = lambda want: F.bool_or(reduce(Column.__or__, (F.col("name").contains(a.strip()) for a in want.split("|"))))
    fresh = columns.join(tables.where("fresh = 'ok'").select("table_id"), "table_id", "left_semi")
    held = fresh.groupBy("table_id").agg(*(met(w).alias(f"_{i}") for i, w in enumerate(wants)))
    named = lambda there: F.filter(F.array(*(F.when(F.col(f"_{i}") == there, w) for i, w in enumerate(wants))), lambda x: x.isNotNull())
    top = held.select("table_id", named(True).alias("h"), named(False).alias("m")).where(F.size("h") > 0).orderBy(F.desc(F.size("h")), "table_id").limit(MOST_CLOSEST)
    return top.select("table_id", F.array_join("h", ",").alias("has"), F.array_join("m", ",").alias("missing"))


def known_columns(columns: DataFrame) -> DataFrame:
    """The fifty names that most tables have."""
    return columns.groupBy("name").agg(F.count_distinct("table_id").alias("tables")).orderBy(F.desc("tables"), "name").limit(MOST_COLUMNS)


def latest_year(files: DataFrame) -> DataFrame:
    return files.where("fresh = 'ok'").agg(F.coalesce(F.year(F.max("data_date")), F.year(F.current_date())).cast("long").alias("year"))


def catalog_listing(files: DataFrame, sheets: DataFrame) -> DataFrame:
    """Files with how many sheets and rows they have, and the sheets' names."""
    counts = sheets.groupBy("path").agg(F.count("*").alias("sheets"), F.sum("n_rows").alias("n_rows"), F.array_join(F.array_sort(F.collect_list("sheet")), ",").alias("names"))
    return files.join(counts, "path", "left").select("path", F.coalesce("sheets", F.lit(0)).alias("sheets"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "names")


def catalog_tree(files: DataFrame) -> DataFrame:
    """Files and stale ones by department, by its first subfolder, and in all."""
    return files.rollup("dept", "sub").agg(F.count("*").alias("files"), F.count_if(F.col("fresh") != "ok").alias("not_fresh"))
