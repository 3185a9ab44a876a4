"""Searching values, names and columns; the value index is a table (value, value_norm, table_id, row_no, column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.grams import GramIndex, contained
from evidra.functions.joins import contains_join
from evidra.functions.ranges import numbered
from evidra.functions.unicode import casefold, nfc, squeezed
from evidra.operators.audits import cell_address
from evidra.operators.catalog import DEPARTMENTS
from evidra.operators.terms import GLOSSARY

# Lengths of indexed texts, entity columns and their kinds, words that name no file.
SHORTEST, LONGEST = 2, 120
ENTITY_COLUMNS = {"팀명": "팀", "담당팀": "팀", "거래처명": "거래처", "업체명": "거래처", "고객사": "거래처", "거래처": "거래처", "공급처": "거래처", "담당자": "담당자"}
GENERIC = ("xlsx", "xlsm", "copy", "final", "최종", "사본", "백업", "new", "old")
MOST_LOCATIONS, MOST_ROWS, MOST_SIMILAR, MOST_COLUMNS = 15, 3, 8, 5


def normalize_value(x: Column) -> Column:
    """Trimmed, any white space as one space, cases folded."""
    return casefold(squeezed(x))


def build_value_index(rows: DataFrame, table: str, row: str, columns: list[str]) -> DataFrame:
    """Texts of 2 to 120 characters in the given columns of data rows."""
    long = rows.where("row_kind = 'data'").unpivot([table, row], columns, "column", "value")
    return long.where(F.length("value").between(SHORTEST, LONGEST)).select("value", normalize_value(F.col("value")).alias("value_norm"), F.col(table).alias("table_id"), F.col(row).alias("row_no"), "column")


def search_value(index: DataFrame | GramIndex, terms: DataFrame, exact: bool, most: int) -> DataFrame:
    """Up to ``most`` hits of each term (term_id, term), in order of table and row: equal normal forms by an equi-join, else literal
    substrings, by postings where the index is stored (``functions.grams``)."""
    asked = terms.withColumn("t", normalize_value(F.col("term")))
    stored = isinstance(index, GramIndex)
    rows = index.values.drop("vid", "vid_bucket") if stored else index
    if exact:
        hits = rows.join(asked, F.col("value_norm") == F.col("t"))
    else:
        hits = contained(index, asked, "t") if stored else contains_join(rows, "value_norm", asked, "t")
    n = F.row_number().over(Window.partitionBy("term_id").orderBy("table_id", "row_no", "column"))
    return hits.withColumn("n", n).where(F.col("n") <= most).drop("n", "t")


def search_locations(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """Hits by term, table and column: how many, and their first three rows. Tables (table_id, fresh) that are fresh come first, then those with
    most hits, at most fifteen a term."""
    ordered = F.row_number().over(Window.partitionBy("term_id", "table_id", "column").orderBy("row_no"))
    first = hits.select("term_id", "table_id", "column", "row_no").distinct().withColumn("k", ordered).where(F.col("k") <= MOST_ROWS)
    rows = first.groupBy("term_id", "table_id", "column").agg(F.array_sort(F.collect_list("row_no")).alias("rows"))  # three at most
    counts = hits.groupBy("term_id", "table_id", "column").agg(F.count("*").alias("hits")).join(tables.select("table_id", "fresh"), "table_id", "left")
    n = F.row_number().over(Window.partitionBy("term_id").orderBy(F.desc(F.coalesce(F.col("fresh") == "ok", F.lit(False))), F.desc("hits"), "table_id", "column"))
    best = counts.withColumn("place", n.cast("long")).where(F.col("place") <= MOST_LOCATIONS)
    return best.join(rows, ["term_id", "table_id", "column"]).select("term_id", "table_id", "column", "fresh", "hits", "rows", "place")


def similar_names(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """For a term that lies within an earlier one that found nothing: what it hit, as similar names and not as evidence."""
    missed = terms.join(hits.select("term_id").distinct(), "term_id", "left_anti").select(F.col("term_id").alias("missed_id"), F.col("term").alias("missed"))
    inner = contains_join(missed, "missed", terms, "term").where((F.col("missed_id") < F.col("term_id")) & (F.col("missed") != F.col("term")))
    names = inner.select("missed", "term_id").join(hits, "term_id").groupBy("missed").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return names.select("missed", F.array_join(F.slice("v", 1, MOST_SIMILAR), ";").alias("similar"))


def search_relevance(fresh: Column, exact: Column) -> Column:
    return F.when((fresh == "ok") & exact, "높음").otherwise("보통")


def hit_cell(column_no: Column, rows: Column) -> Column:
    """Address of the first hit."""
    return cell_address(column_no, rows[0])


def hit_rows(rows: Column, hits: Column) -> Column:
    """The rows that are listed, and how many more places there are."""
    more = hits - F.size(rows)
    listed = F.array_join(F.transform(rows, lambda r: F.concat(r.cast("string"), F.lit("행"))), ", ")
    return F.concat(listed, F.when(more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("곳"))).otherwise(""))


def row_snippet(names: list[str], most: int = 160) -> Column:
    """``name value`` of the columns that aren't null."""
    return F.left(F.concat_ws(", ", *(F.when(F.col(n).isNotNull(), F.concat_ws(" ", F.lit(n), F.col(n).cast("string"))) for n in names)), F.lit(most))


def value_columns(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Columns in which a term is a value, at most five."""
    asked = terms.select("term_id", normalize_value(F.col("term")).alias("value_norm"))
    found = index.join(asked, "value_norm").groupBy("term_id").agg(F.array_sort(F.collect_set("column")).alias("c"))
    return found.select("term_id", F.array_join(F.slice("c", 1, MOST_COLUMNS), ",").alias("columns"))


def entity_dictionary(index: DataFrame, kinds: dict[str, str] = ENTITY_COLUMNS) -> DataFrame:
    """(value, kind, placeholder): distinct values of entity columns numbered in value order within their kind; a value of several
    kinds has the first one. Ranks go by ranges of values: counts of each range are added up first."""
    pairs = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    own = index.withColumn("kind", pairs[F.col("column")]).where(F.col("kind").isNotNull() & (F.length("value") >= 2)).groupBy("value").agg(F.min("kind").alias("kind"))
    return numbered(own, ["kind"], "value").select("value", "kind", F.concat(F.lit("{"), "kind", F.lit("_"), F.col("number").cast("string"), F.lit("}")).alias("placeholder"))


def vocabulary(names: list[tuple[DataFrame, Column]], paths: list[tuple[DataFrame, Column]], own: list[tuple[DataFrame, Column]] | None = None) -> DataFrame:
    """(word, origin): what questions may speak of, composed and with cases folded, two letters or more. ``data``: departments, whole names (of columns and
    sheets), and parts of paths that are neither digits nor generic; ``glossary``: glossary words and a company's ``own`` entries."""
    spark = names[0][0].sparkSession
    parts = [df.select(F.explode(F.split(x, r"[/\\._\-\s()]+")).alias("word")).where(~F.col("word").rlike(r"^\d+$") & ~casefold(F.col("word")).isin(*GENERIC)) for df, x in paths]
    known = [spark.createDataFrame([(d,) for d in DEPARTMENTS], "word string"), *(df.select(x.alias("word")) for df, x in names), *parts]
    terms = [spark.createDataFrame([(w,) for w in dict.fromkeys(w for term, columns, words in GLOSSARY for w in (term, *columns, *words))], "word string"), *(df.select(x.alias("word")) for df, x in own or [])]
    out = None
    for origin, some in (("data", known), ("glossary", terms)):
        for df in some:
            one = df.where(F.length(F.trim("word")) >= 2).select(casefold(nfc(F.col("word"))).alias("word"), F.lit(origin).alias("origin"))
            out = one if out is None else out.unionByName(one)
    return out.distinct()


def search_coverage(terms: DataFrame, hits: DataFrame, files: DataFrame) -> DataFrame:
    """Of a batch of searches: how many terms were tried and found, files covered, and files left out by reason."""
    found = terms.join(hits.select("term_id").distinct().withColumn("hit", F.lit(1)), "term_id", "left").agg(F.count("*").alias("tried"), F.count("hit").alias("found"))
    reasons = files.groupBy(F.coalesce("skip_reason", F.lit("read")).alias("reason")).agg(F.count("*").alias("files"))
    return reasons.crossJoin(F.broadcast(found))  # one row
