"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, with DataFrame functions alone.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at twice its source's
size, and the excess is shared anew by weight until none is above. Whole numbers decide, so targets are exact before the last division.

Documents of a source are shuffled by a digest of id and text and laid end to end, pass after pass; every ``block`` words of that
stream are one block. Slot i of the mix has the golden-ratio point frac(i * 0.618...), in exact arithmetic modulo 2**40. The source
whose stretch of cumulated targets holds the point owns the slot, and its r-th slot takes its r-th block, the last cut to the target.
Slots beyond a target stay unused. What the points' discrepancy (a few slots a source) leaves short follows in slots behind the last.
So each source gives its target, rounded down, and each document at most ``most`` times its words.

At scale. Words are counted once, to a checkpointed table of numbers and digests. Texts aren't moved. Positions come from sums by
(source, first digits of the digest), ranks of slots from counts by (stretch of slots, source): no window holds a source. Keys that hold
many documents are broadcast (``join_uneven``); blocks meet slots on (source, rank), which is one to one. Only sums reach the driver,
once for each time the excess is shared anew.

Cases. Null or empty texts have 0 words and are listed with nothing taken; a null source is one of its own, null ids count as empty
text. Equal rows are taken each for itself, in any order among them. Other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.ranges import numbered, running_sum
from evidra.llm.common import checkpointed, join_uneven, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by order of sources; what all targets add up to (3/2 of all words); passes over a source at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), (3, 2), 2
#: Words of a block; slots of a stretch in which ranks are counted; documents for which shuffles get one more digit.
BLOCK, STRETCH, A_DIGIT = 256, 1 << 14, 3_000
#: Points are multiples of 2**-POINT_BITS; the step is odd, so all of them occur before one comes again.
POINT_BITS = 40
STEP = int((5**0.5 - 1) / 2 * 2**POINT_BITS) | 1
#: Stretches of sources up to which they are broadcast to the slots (24 bytes each); more meet on the points' first bits.
FEW_STRETCHES = 100_000


def digest(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Of id and text; null counts as empty."""
    return F.md5(F.concat(F.coalesce(docs[id_col].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")))))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, key (orders sources, null last), digest (of id and text) and size (words) of each document."""
    text, name = F.coalesce(docs[text_col].cast("string"), F.lit("")), docs[source_col].cast("string")
    key = F.coalesce(F.concat(F.lit("0"), name), F.lit("1"))
    return docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), key.alias("key"), digest(docs, id_col, text_col).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def _whole(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(38,0)")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: key, number (from 1), weight, source_size, documents, target (double) and quota (the target, rounded down)."""
    grouped = checkpointed(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")))
    place = F.pmod(F.col("number") - 1, F.lit(len(weights))).cast("int") + 1
    known = checkpointed(numbered(grouped, [], "key").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long")).withColumn("most", F.col("source_size") * most))
    words, spread = known.agg(F.sum("source_size"), F.sum("weight")).first()
    # A level of words a weight, as a fraction: what full sources leave, by the weights of the others.
    level, full = (share[0] * int(words or 0), share[1] * int(spread or 1)), None
    above = lambda: F.col("weight") * _whole(level[0]) > F.col("most") * _whole(level[1])
    while (now := known.where(above()).agg(F.sum("most"), F.sum("weight"), F.count("*")).first()) != full:
        full = now
        level = (share[0] * int(words or 0) - share[1] * int(full[0] or 0), share[1] * (int(spread or 1) - int(full[1] or 0)))
    asked = F.col("weight") * _whole(level[0])
    target = F.when(above(), F.col("most").cast("double")).otherwise(asked.cast("double") / F.lit(float(level[1] or 1)))
    quota = F.when(above(), F.col("most")).otherwise(F.expr(f"CAST(weight * {level[0]}BD AS DECIMAL(38, 0)) div {level[1] or 1}BD"))
    return known.select("key", "number", "weight", "source_size", "documents", target.alias("target"), quota.cast("long").alias("quota"))


def point(i: Column) -> Column:
    """Golden-ratio points as whole numbers below 2**POINT_BITS: i * STEP modulo that, in two halves that fit into 64 bits."""
    half = POINT_BITS // 2
    i = i.bitwiseAND((1 << POINT_BITS) - 1)
    high = (F.shiftright(i, half) * STEP).bitwiseAND((1 << half) - 1)
    return (F.shiftleft(high, half) + i.bitwiseAND((1 << half) - 1) * STEP).bitwiseAND((1 << POINT_BITS) - 1)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, number (of a source), rank (of the slot in it, from 0) for a checkpointed table of ``targets``: as many slots as each quota needs."""
    spark = sources.sparkSession
    need = F.ceil(F.col("quota") / block).cast("long")
    total, n = (int(v or 0) for v in sources.agg(F.sum("quota"), F.count("*")).first())
    slots, bits = -(-total // block), min(POINT_BITS // 2, max(n - 1, 0).bit_length())
    edge = lambda c: F.expr(f"CAST(CAST({c} AS DECIMAL(38, 0)) * {1 << POINT_BITS}BD AS DECIMAL(38, 0)) div {max(total, 1)}BD")
    held = checkpointed(running_sum(sources, "number", "quota").select("number", need.alias("need"), edge("so_far - quota").alias("low"), edge("so_far").alias("high")))
    cells = held.where("high > low").select("number", "low", "high", F.explode(F.sequence(F.shiftright("low", POINT_BITS - bits), F.shiftright(F.col("high") - 1, POINT_BITS - bits))).alias("cell"))
    cells = F.broadcast(cells) if n + (1 << bits) <= FEW_STRETCHES else cells  # a source has one row and one more for each cell it enters
    points = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.shiftright("point", POINT_BITS - bits))
    owned = points.join(cells, "cell").where("point >= low AND point < high").select("slot", "number", F.expr(f"slot div {STRETCH}").alias("stretch"))
    counts = checkpointed(owned.groupBy("number", "stretch").agg(F.count("*").alias("n")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("number").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("slot")) - 1 + F.col("before")
    ranked = owned.join(counts.withColumn("before", before).drop("n"), ["number", "stretch"]).select("slot", "number", rank.alias("rank"))
    used = ranked.join(F.broadcast(held.select("number", "need")) if n <= FEW_STRETCHES else held.select("number", "need"), "number").where("rank < need").drop("need")
    got = held.join(counts.groupBy("number").agg(F.sum("n").alias("got")), "number", "left").select("number", "need", F.coalesce("got", F.lit(0)).alias("got"))
    short = checkpointed(got.where("got < need").withColumn("missing", F.col("need") - F.col("got")))
    late = running_sum(short, "number", "missing").select("number", "got", (F.col("so_far") - F.col("missing") - F.col("got") + slots).alias("first"), F.explode(F.sequence("got", F.col("need") - 1)).alias("rank"))
    return used.unionByName(late.select((F.col("first") + F.col("rank")).alias("slot"), "number", "rank"))


def laid(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents (checkpointed ``sizes``) with their source's numbers, ``ordinal`` (from 1) and ``start`` (words before) in its shuffled order."""
    total = sized.count()
    digits, many = 0, total // A_DIGIT
    while many:
        digits, many = digits + 1, many // 16
    of = join_uneven(sized, sources, ["key"], "documents", total).withColumn("part", F.substring("digest", 1, digits))
    parts = of.groupBy("number", "part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    back = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select("number", "part", *(F.coalesce(F.sum(c).over(back), F.lit(0)).alias(f"{c}_before") for c in ("words", "rows")))
    inner = Window.partitionBy("number", "part").orderBy("digest", "size")
    start = F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") + F.col("words_before")
    return of.join(placed, ["number", "part"]).withColumn("start", start).withColumn("ordinal", F.row_number().over(inner) + F.col("rows_before")).drop("part", "words_before", "rows_before", "key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The mix, piece by piece: slot, and the words [from_word, to_word) of a document (id, source, digest, size) that stand in it, with the
    document's ``ordinal`` in its source's order (``number``), ``pass`` (from 0), ``source_size`` and ``target``. A document that the mix takes
    nothing of has one row with null in slot, pass and words."""
    sized = checkpointed(sizes(docs, id_col, text_col, source_col))
    sources = checkpointed(targets(sized, weights, share, most))
    begin = F.col("start") + F.col("source_size") * F.col("pass")
    end = F.least(begin + F.col("size"), F.col("quota"))
    passes = laid(sized, sources).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    spans = passes.withColumn("begin", begin).withColumn("end", end).where((F.col("pass") == 0) | (F.col("end") > F.col("begin")))
    taken = (F.col("size") > 0) & (F.col("end") > F.col("begin"))
    none = -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40))  # spreads rows that meet no slot
    blocks = F.when(taken, F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))).otherwise(F.array(none))
    pieces = spans.withColumn("rank", F.explode(blocks))
    met = pieces.join(schedule(sources, block), ["number", "rank"], "left")
    there = F.col("slot").isNotNull()
    first, last = F.greatest(F.col("begin"), F.col("rank") * block), F.least(F.col("end"), (F.col("rank") + 1) * block)
    return met.select("slot", "id", "source", "digest", "number", "ordinal", F.when(there, F.col("pass")).alias("pass"), F.when(there, first - F.col("begin")).alias("from_word"), F.when(there, last - F.col("begin")).alias("to_word"), "size", "source_size", "target")


def mixed_texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """slot, place (order in the slot), id, source and text (words joined by one space) of every piece of a ``mix`` of ``docs``. A text's words are
    found once for all its pieces."""
    at = docs.select(digest(docs, id_col, text_col).alias("digest"), docs[text_col].cast("string").alias("text")).dropDuplicates(["digest"])
    each = mixed.where("slot is not null").groupBy("digest", "number", "ordinal").agg(F.first("id").alias("id"), F.first("source").alias("source"), F.collect_list(F.struct("slot", "pass", "from_word", "to_word")).alias("pieces"))
    cut = F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), lambda words: F.transform("pieces", lambda p: F.struct(p["slot"].alias("slot"), p["pass"].alias("pass"), F.array_join(F.slice(words, (p["from_word"] + 1).cast("int"), (p["to_word"] - p["from_word"]).cast("int")), " ").alias("text"))))[0]
    rows = each.join(at, "digest").select("id", "source", "number", "ordinal", F.explode(cut).alias("p")).select("p.*", "id", "source", "number", "ordinal")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("slot").orderBy("pass", "ordinal"))).select("slot", "place", "id", "source", "text")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: how many words the mix takes of every document."""
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = mixed.groupBy("number", "ordinal", "id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The same numbers without slots: targets by the order in which sources fill up, and each document's stretch of its source's stream.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM d GROUP BY source) g
), o AS (
  SELECT *, CAST(source_size * 6 / weight AS HUGEINT) AS ratio, sum(source_size) OVER () AS words,
    coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 6 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(weight) OVER (ORDER BY source_size * 6 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM s
), l AS (
  SELECT CAST(3 * words - 2 * full_before AS HUGEINT) AS num, CAST(2 * weight_left AS HUGEINT) AS den FROM o
  WHERE 3 * (3 * words - 2 * full_before) <= 2 * weight_left * ratio ORDER BY full_before, weight_left DESC LIMIT 1
), q AS (
  SELECT source, source_size, CASE WHEN weight * num > 2 * source_size * den THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target,
    CASE WHEN weight * num > 2 * source_size * den THEN 2 * source_size ELSE weight * num // den END AS quota
  FROM o CROSS JOIN l
), p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY digest, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(greatest(0, least(start + size, quota) - start) + greatest(0, least(start + size + source_size, quota) - start - source_size) AS BIGINT) AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
"""
