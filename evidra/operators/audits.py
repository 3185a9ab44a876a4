"""Data-quality audits of tables and files. Each gives rows, or columns, that name a rule where it fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.functions.storage import stored
from evidra.operators.aggregate import exact_sum

# Thresholds in days and shares, and words that mark folders and names.
BIG_GAP, EDGE_GAP, LATE_EDIT = 31, 7, 14
MANY_NULLS, MANY_DOUBLES, TOTAL_OFF, DRIFT_SECONDS = 0.05, 0.01, 0.01, 2
INFORMAL_FOLDER = r"(?i)백업|개인|새 폴더|임시|정리중|받은자료|보관|archive|backup|\bold\b|\btemp\b|\btmp\b"
INFORMAL_NAME = r"(?i)임시|초안|발췌|테스트|샘플|작업중|참고용|(?<![a-z])(draft|temp|sample|test)(?![a-z])"
INJECTION = (
    r"(?i)(ignore (all |any )?(previous|prior|above) (instructions|prompts?)|disregard .{0,30}instructions"
    r"|이전\s*(지시|명령|지침)(사항)?\s*(을|를)?\s*(모두\s*)?(무시|잊)|시스템\s*프롬프트|system prompt|api[\s_-]*key|apikey|비밀\s*키|위\s*지시를?\s*무시"
    r"|\[?\s*(AI|LLM|인공지능)\s*(에이전트|어시스턴트|비서)?(에게|야|님)?\s*\]|(AI|LLM|에이전트|어시스턴트)(에게|한테)\s*(전달|지시|명령|알림|안내)|시스템\s*안내\s*[:：]"
    r"|교차\s*검증을?\s*(생략|건너뛰|하지\s*마|무시)|신뢰도[를은]?\s*(항상\s*)?['\"“‘]?(높음|낮음|보통)['\"”’]?\s*(으로|로)\s*(표시|보고|답|출력)|(0원|전부|모든\s*매출)\S*\s*(으로\s*)?보고(할|하라|해))"
)
ROW_RANGES = 6


def compress_rows(rows: DataFrame, by: list[str], row: str = "row_no") -> DataFrame:
    """Row numbers of each group as ranges, ``6-8, 30-31``; beyond six ranges only their number. Ranges end where a
    neighbour is missing, so no task orders a group's rows."""
    some = stored(rows.select(*by, F.col(row).alias("_r")).distinct())  # read four times

    def ends(step: int) -> DataFrame:
        """Rows whose neighbour on that side is missing."""
        return some.join(some.select(*by, (F.col("_r") - step).alias("_r")), [*by, "_r"], "left_anti")

    # The k-th first row of a range and the k-th last one belong together; only the first few are ordered, which is pushed below shuffles.
    few = lambda df, name: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_r"))).where(F.col("_n") <= ROW_RANGES).withColumnRenamed("_r", name)
    first = ends(-1)
    shown = few(first, "_a").join(few(ends(1), "_b"), [*by, "_n"])
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", F.col("_a").cast("string"), F.col("_b").cast("string")))
    listed = shown.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("text")))), lambda x: x["text"]).alias("_t"))
    more = F.col("_count") - ROW_RANGES
    counted = listed.join(first.groupBy(*by).agg(F.count("*").alias("_count")), by)
    return counted.select(*by, F.concat(F.array_join("_t", ", "), F.when(more > 0, F.concat(F.lit(" 외 "), more.cast("string"), F.lit("곳"))).otherwise("")).alias("row_text"))


def null_audit(df: DataFrame, by: list[str], used: list[str]) -> DataFrame:
    """Rows with a null in any used column: D1, from 5 % on D1H."""
    bad = F.exists(F.array(*(F.col(c).isNull() for c in used)), lambda x: x)
    counted = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(bad).alias("nulls")).where("nulls > 0")
    return counted.withColumn("rule", F.when(F.col("nulls") / F.col("n") >= MANY_NULLS, "D1H").otherwise("D1"))


def duplicate_audit(df: DataFrame, by: list[str], columns: list[str], amount: str) -> DataFrame:
    """Identical rows: extra ones and their share of the sum; D2, from 1 % on D2H. Equal rows meet after partial counts."""
    same = df.groupBy(*by, *(c for c in columns if c not in by)).agg(F.count("*").alias("_n"))
    x = F.coalesce(F.col(amount), F.lit(0.0))
    out = same.groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("extra_rows"), exact_sum(x * (F.col("_n") - 1)).alias("extra_sum"), exact_sum(x * F.col("_n")).alias("total")).where("extra_rows > 0")
    return out.withColumn("rule", F.when(F.abs("extra_sum") >= MANY_DOUBLES * F.abs("total"), "D2H").otherwise("D2"))


def total_row_audit(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Sheets of which no total row is within 1 % of the sum of their data rows: D3."""
    of = lambda kind: F.when(F.col("row_kind") == kind, F.col(amount))
    both = df.groupBy(*by).agg(exact_sum(of("data")).alias("data_sum"), F.max(of("total")).alias("total_row"))
    return both.where(F.col("total_row").isNotNull() & (F.abs(F.col("total_row") - F.col("data_sum")) > TOTAL_OFF * F.greatest(F.abs("data_sum"), F.lit(1.0)))).withColumn("rule", F.lit("D3"))


def mixed_column_audit(mixed: Column, used: Column) -> Column:
    """D4 where a used column is of mixed type."""
    return F.when(F.size(F.array_intersect(mixed, used)) > 0, "D4")


def sheet_flag_audit(hidden: Column, errors: Column, uncached: Column, truncated: Column) -> Column:
    """Rules of a sheet's flags, as an array."""
    return F.filter(F.array(F.when(hidden, "V11"), F.when(errors > 0, "D5"), F.when(uncached > 0, "D6"), F.when(truncated, "D7")), lambda r: r.isNotNull())


def vat_audit(used: Column, columns: Column, gross: str = "합계", net: str = "공급가액") -> Column:
    """D8 where the gross column is summed although the net one exists."""
    return F.when(F.array_contains(used, gross) & F.array_contains(columns, net), "D8")


def injection_scan(text: Column) -> Column:
    """D9 where a text of more than 8 characters reads like instructions."""
    return F.when((F.length(text) > 8) & text.rlike(INJECTION), "D9")


def column_letters(number: Column) -> Column:
    """1 is A, 27 is AA; up to three letters."""
    letter = lambda n: F.char(F.lit(65) + n)
    n = number.cast("long") - 1
    one, two = letter(n % 26), F.when(n >= 26, letter((F.floor(n / 26) - 1) % 26)).otherwise("")
    return F.concat(F.when(n >= 702, letter(F.floor(F.floor(n / 26 - 1) / 26) - 1)).otherwise(""), two, one)


def cell_address(column: Column, row: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def period_coverage(start: Column, end: Column, want_start: Column, want_end: Column) -> Column:
    """P1 or P1M where dates miss more than 31 or 7 days at either end of the wanted period."""
    gap = F.greatest(F.datediff(want_end, end), F.datediff(start, want_start))
    return F.when(gap > BIG_GAP, "P1").when(gap > EDGE_GAP, "P1M")


def month_coverage(months: Column, wanted: Column, base_date: Column, want_end: Column) -> Column:
    """P1 where months are missing, P2 where all are there but the base date is before the period's end."""
    return F.when(F.size(F.array_except(wanted, months)) > 0, "P1").when(base_date < want_end, "P2")


def version_audit(fresh: Column, tied: Column, same_data: Column) -> Column:
    """V1 stale, V2 copy, V3F tied with the same data, V3 tied with other data."""
    return F.when(fresh == "stale", "V1").when(fresh == "copy", "V2").when(tied & same_data, "V3F").when(tied, "V3")


def late_edit_audit(modified: Column, base_date: Column) -> Column:
    return F.when(F.datediff(modified, base_date) > LATE_EDIT, "V4")


def informal_location_audit(path: Column, title: Column) -> Column:
    """V5 for a folder, V6 for a mark in name or title, as an array."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.filter(F.array(F.when(F.exists(folders, lambda p: p.rlike(INFORMAL_FOLDER)), "V5"), F.when(F.concat_ws(" ", name, title).rlike(INFORMAL_NAME), "V6")), lambda r: r.isNotNull())


def lock_audit(files: DataFrame, locks: DataFrame) -> DataFrame:
    """V7 for files that someone has open (locks: path, owner, since)."""
    return files.join(locks, "path").withColumn("rule", F.lit("V7"))


def drift_audit(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """V9 for indexed files that are gone, V8 for those whose size, or time by over two seconds, changed."""
    now = current.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    apart = F.abs(F.unix_timestamp(F.col("mtime").cast("timestamp")) - F.unix_timestamp(F.col("_mtime").cast("timestamp")))
    rule = F.when(F.col("_size").isNull(), "V9").when((F.col("size") != F.col("_size")) | (apart > DRIFT_SECONDS), "V8")
    return indexed.join(now, "path", "left").select("path", rule.alias("rule")).where("rule is not null")


def years_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1)))


def year_mismatch_audit(text: Column, year: Column) -> Column:
    """V10 where a text names years but not the asked one."""
    years = years_in(text)
    return F.when((F.size(years) > 0) & ~F.array_contains(years, year.cast("string")), "V10")


def quality_summary(df: DataFrame, by: list[str], texts: list[str], columns: list[str], notes: tuple[str, ...] = ("비고",)) -> DataFrame:
    """Per table: empty texts of each text column but notes, and duplicate rows."""
    blank = [F.count_if(F.col(c).isNull() | (F.trim(c) == "")).alias(f"blank_{c}") for c in texts if c not in notes]
    doubles = df.groupBy(*by, *(c for c in columns if c not in by)).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *blank).join(doubles, by)
