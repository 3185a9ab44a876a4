"""Rules about an answer's trustworthiness, and grades from the rules that fired.

Findings are rows (answer_id, rule, ...); a rule has a signal and a severity. A signal's grade is its worst severity, an answer's the
worst signal. Information is shown but not graded. ``RULES`` is a small fixed table, so it is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIGNALS = ("MAP", "CROSS", "QUAL", "EXEC", "NUM", "EVID")
SHOWN_ALWAYS = SIGNALS[:4]
# Rule ids, their signals and severities (L low, M medium, I information), and the three grades.
RULES = (
    ("M1", "MAP", "L", "Terms are in no dictionary: {terms}", "Check which columns the terms mean and register them."),
    ("M2", "MAP", "M", "A default was applied: {defaults}", "Check that the default period is the one meant."),
    ("M3", "MAP", "M", "Computed without looking up any term", "Check that the columns used fit the question."),
    ("M4", "MAP", "M", "No period was asked; the whole range {span} was used", "Ask again with a period."),
    ("X1", "CROSS", "L", "Computed but never compared", "Compare with a second file."),
    ("X2", "CROSS", "M", "A second source differs by up to {max_rel}; ranks agree", "Check the items that differ."),
    ("X3", "CROSS", "L", "A second source differs by up to {max_rel}", "Find out which file is authoritative."),
    ("X4", "CROSS", "L", "Ranks differ between the sources", "Decide on a source and open the rows that differ."),
    ("X5", "CROSS", "M", "Keys on one side only: {keys}", "Align the spelling of names."),
    ("X6", "CROSS", "L", "Totals differ by a unit factor", "Check the units of both files."),
    ("X7", "CROSS", "I", "Base dates differ: {dates}", "Mind the different dates."),
    ("X8", "CROSS", "M", "A difference was left unexplained", "Trace the rows that differ."),
    ("X9", "CROSS", "M", "Nothing was computed", "Ask for a figure."),
    ("X10", "CROSS", "M", "No second source: {reason}", "Look for an independent file."),
    ("X11", "CROSS", "I", "Related but different metrics were compared", "Mind the different definitions."),
    ("X12", "CROSS", "M", "A ranking had fewer than three common keys", "Compare more items."),
    ("V1", "QUAL", "L", "A stale version was used: {file}", "Use the newer file."),
    ("V2", "QUAL", "M", "A copy was used: {file}", "Use the original."),
    ("V3", "QUAL", "L", "Same family and date, other content: {others}", "Find out which one holds."),
    ("V3F", "QUAL", "M", "Same data in another format: {others}", "Use one of them."),
    ("V4", "QUAL", "M", "Edited {gap} days after its base date", "Check what was changed."),
    ("V5", "QUAL", "M", "In an informal folder: {folder}", "Look for the official file."),
    ("V6", "QUAL", "M", "Marked as draft or excerpt: {marker}", "Look for the final file."),
    ("V7", "QUAL", "M", "Someone has the file open", "Wait until it is saved."),
    ("V8", "QUAL", "L", "Changed since it was indexed", "Scan again."),
    ("V9", "QUAL", "L", "The file is gone", "Scan again."),
    ("V10", "QUAL", "L", "Other years than asked: {years}", "Use the asked year's file."),
    ("V11", "QUAL", "M", "A hidden sheet was used", "Check why it is hidden."),
    ("P1", "QUAL", "L", "Data cover {have} of {want}", "Look for the missing period."),
    ("P1M", "QUAL", "M", "Data miss {gap} days of the period", "Check the period's ends."),
    ("P2", "QUAL", "M", "The base date is before the period's end", "Look for a later file."),
    ("P3", "QUAL", "L", "The named period doesn't hold the computed range", "Name the computed range."),
    ("D1", "QUAL", "M", "Empty cells in used columns", "Fill or explain them."),
    ("D1H", "QUAL", "L", "Many empty cells in used columns", "Fill or explain them."),
    ("D2", "QUAL", "M", "Identical rows", "Check for double entries."),
    ("D2H", "QUAL", "L", "Identical rows hold much of the sum", "Remove double entries."),
    ("D3", "QUAL", "L", "The total row doesn't fit the data", "Check the total row."),
    ("D4", "QUAL", "L", "A used column mixes types", "Clean the column."),
    ("D5", "QUAL", "M", "Error cells", "Repair the formulas."),
    ("D6", "QUAL", "M", "Formulas without a stored value", "Open and save the file."),
    ("D7", "QUAL", "L", "Cut at the row limit", "Split the file."),
    ("D8", "QUAL", "M", "The gross column was summed", "Use the net column."),
    ("D9", "QUAL", "M", "A cell reads like instructions", "Check the cell."),
    ("E1", "EXEC", "L", "A query failed after retries", "Ask again."),
    ("E2", "EXEC", "M", "A query took a retry", "Check the figures."),
    ("E3", "EXEC", "M", "An empty result", "Loosen the filters."),
    ("E4", "EXEC", "M", "A negative sum", "Check for returns."),
    ("E5", "EXEC", "M", "The call budget was reached", "Ask in parts."),
    ("E6", "EXEC", "L", "The answer lacks the required form", "Ask again."),
    ("N1", "NUM", "L", "A figure in the answer is in no result", "Check the figure."),
    ("S1", "EVID", "L", "No source and no search", "Ask for sources."),
    ("S2", "EVID", "M", "Nothing relevant was found", "Check that the data were uploaded."),
)
HIGH, MEDIUM, LOW = "높음", "보통", "낮음"
MOST_REASONS, MOST_ACTIONS = 3, 4


def rule_registry(spark: SparkSession) -> DataFrame:
    """rule, signal, severity, title, action, and the ranks that order severities and signals."""
    rows = [(*r, "LMI".index(r[2]), SIGNALS.index(r[1])) for r in RULES]
    return spark.createDataFrame(rows, "rule string, signal string, severity string, title string, action string, severity_rank int, signal_rank int")


def _fact(facts: DataFrame, name: str, default: bool | float = False) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in facts.columns else F.lit(default)


def fact_rules(facts: DataFrame) -> DataFrame:
    """(answer_id, rule) of each rule that the answer's facts fire; answers without any keep one row with a null rule.
    Facts that a frame lacks count as their harmless default."""
    f = lambda n, d=False: _fact(facts, n, d)
    relative = f("max_rel", 0.0)
    matched = f("matched") if "matched" in facts.columns else relative <= 0.01
    computed, compared = f("computed", True), f("compared", True)
    differs = compared & ~matched
    fired = {
        "M1": f("unregistered"), "M2": f("defaulted"), "M3": f("no_lookup"), "M4": f("long_span"),
        "X1": computed & ~compared & ~f("no_second_source"), "X9": ~computed & ~compared, "X10": computed & ~compared & f("no_second_source"),
        "X4": compared & f("rank_changed"), "X3": differs & ~f("rank_changed") & (relative > 0.05), "X2": differs & ~f("rank_changed") & (relative <= 0.05), "X8": differs & ~f("traced"), "X7": f("date_gap"),
        "E1": f("retry_failed"), "E2": f("retry_ok"), "E3": f("empty_result"), "E4": f("negative_sum"), "E5": f("budget_hit"), "E6": f("unstructured"),
        "N1": f("bad_number"), "S1": ~f("has_source", True) & ~f("unstructured"),
    }
    return facts.select("answer_id", F.explode_outer(F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in fired.items())), lambda x: x.isNotNull())).alias("rule"))


def graded(findings: DataFrame) -> DataFrame:
    """Findings with their rule's columns."""
    return findings.join(F.broadcast(rule_registry(findings.sparkSession)), "rule", "left")


def _grade(rank: Column) -> Column:
    return F.when(rank == 0, LOW).when(rank == 1, MEDIUM).otherwise(HIGH)


def signal_grades(findings: DataFrame) -> DataFrame:
    """(answer_id, signal, grade): four signals always, the other two when raised."""
    worst = lambda s: F.coalesce(F.min(F.when((F.col("signal") == s) & (F.col("severity") != "I"), F.col("severity_rank"))), F.lit(2))
    each = graded(findings).groupBy("answer_id").agg(*(worst(s).alias(s) for s in SIGNALS))
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("rank")) for s in SIGNALS))
    rows = each.select("answer_id", F.explode(pairs).alias("x")).select("answer_id", "x.signal", "x.rank")
    return rows.where(F.col("signal").isin(*SHOWN_ALWAYS) | (F.col("rank") < 2)).select("answer_id", "signal", _grade(F.col("rank")).alias("grade"))


def grade_confidence(findings: DataFrame) -> DataFrame:
    """(answer_id, grade): the worst graded finding decides."""
    worst = F.coalesce(F.min(F.when(F.col("severity") != "I", F.col("severity_rank"))), F.lit(2))
    return graded(findings).groupBy("answer_id").agg(_grade(worst).alias("grade"))


def _first(texts: Column, most: int) -> Column:
    more = F.size(texts) - most
    return F.concat(F.array_join(F.slice(texts, 1, most), "; "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def _distinct_in_order(order: list[str], text: str) -> Column:
    """Distinct texts of a group, each at its first place."""
    ordered = F.array_sort(F.collect_set(F.struct(*order, text)))
    return F.array_distinct(F.transform(ordered, lambda x: x[text]))


def grade_reason(findings: DataFrame) -> DataFrame:
    """(answer_id, reason): up to three distinct titles of the worst findings in the order of signals."""
    g = graded(findings).where("severity <> 'I'")
    worst = g.withColumn("worst", F.min("severity_rank").over(Window.partitionBy("answer_id"))).where("severity_rank = worst")
    return worst.groupBy("answer_id").agg(_first(_distinct_in_order(["signal_rank", "rule"], "title"), MOST_REASONS).alias("reason"))


def check_message(findings: DataFrame) -> DataFrame:
    """(answer_id, message): the first four distinct actions by severity and signal; the rest counted."""
    return graded(findings).where("severity <> 'I'").groupBy("answer_id").agg(_first(_distinct_in_order(["severity_rank", "signal_rank", "rule"], "action"), MOST_ACTIONS).alias("message"))


def render_findings(findings: DataFrame, detail: str) -> DataFrame:
    """Titles with ``{placeholders}`` filled from a map column; missing ones become ``?``."""
    filled = F.aggregate(F.map_entries(F.coalesce(F.col(detail), F.create_map().cast("map<string,string>"))), F.col("title"), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("?"))))
    return graded(findings).withColumn("shown", F.regexp_replace(filled, r"\{\w+\}", "?"))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["rule", "path", "sheet", "row_text", "shown"])


def group_warnings(findings: DataFrame) -> DataFrame:
    """One row per rule and title with the places it was found."""
    places = F.array_sort(F.collect_set(F.concat_ws("!", "path", "sheet")))
    return findings.groupBy("rule", "shown").agg(F.array_join(places, ";").alias("places"), F.count("*").alias("n"))


def no_data_grade(found: Column) -> tuple[Column, Column]:
    """Grade and rule where nothing relevant was found."""
    return F.when(~found, MEDIUM), F.when(~found, "S2")


def answer_type(searched: Column, computed: Column, found: Column, claim: Column) -> Column:
    """What kind of answer the facts allow."""
    return F.when(~found, "no_data").when(searched & ~computed, "find").when(computed & claim, "verify").otherwise("compute")


def dedupe_sources(parts: list[DataFrame]) -> DataFrame:
    """One evidence row per path, sheet, rows and role."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["path", "sheet", "row_text", "role"])
