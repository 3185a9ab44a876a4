"""Terms of questions, periods, and which questions are in scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.functions.joins import contains_join, small
from evidra.functions.storage import stored
from evidra.functions.suffixes import common_beginnings
from evidra.functions.unicode import casefold, squeezed

# The glossary (term, its columns, its synonyms), and words that decide on scope.
GLOSSARY = (
    ("매출실적", ("매출실적", "공급가액", "매출액", "금액"), ("실적", "매출", "매상", "판매액", "매출액")),
    ("목표", ("목표",), ("목표액", "타겟")),
    ("팀", ("팀명", "담당팀", "부서"), ("팀명", "담당팀", "부서")),
    ("거래처", ("거래처명", "업체명", "고객사", "거래처", "공급처"), ("고객", "업체", "고객사", "거래처명", "공급처")),
    ("수량", ("수량", "발주수량", "입고수량"), ("물량",)),
    ("재고", ("기말재고", "기초재고", "안전재고"), ("재고수량", "기말재고", "현재고")),
    ("미수금", ("당월잔액", "전월잔액"), ("미수", "외상", "채권")),
    ("계약금액", ("계약금액",), ("계약액",)),
    ("품목", ("품목명", "품목", "품목코드"), ("제품", "상품", "아이템", "자재")),
    ("창고", ("창고",), ("보관창고", "물류창고")),
    ("입고", ("입고", "입고수량", "반품입고"), ("입고량",)),
    ("출고", ("출고",), ("출고량",)),
    ("수주일", ("수주일",), ("주문일", "오더일")),
    ("결제조건", ("결제조건",), ("결제", "지급조건")),
    ("납품실적", ("1분기 납품실적", "2분기 납품실적", "3분기 납품실적", "4분기 납품실적"), ("납품",)),
)
OFF_TOPIC = ("날씨", "점심", "저녁", "아침식사", "맛집", "메뉴 추천", "메뉴추천", "농담", "노래", "영화", "드라마", "게임", "번역", "코딩", "프로그래밍", "로또", "주식", "비트코인", "코인", "운세", "연애", "사랑", "여행", "레시피", "요리", "축구", "야구", "대통령", "뉴스", "시 써", "소설", "너 누구", "안녕", "고마워", "심심", "별자리")
INTENT = ("합계", "총", "평균", "순위", "등", "위", "몇", "얼마", "최근", "최신", "찾", "목록", "현황", "비교", "증가", "감소", "차이", "맞아", "맞나", "보고서", "파일", "엑셀", "시트", "자료", "데이터", "실적", "매출", "재고", "금액", "수량", "분기", "상반기", "하반기", "월별", "누적", "건수", "누가", "어느", "어디", "언제", "가장", "제일", "높", "낮", "많", "적", "알려", "보여", "액", "량", "율")
FOLLOW_UP = ("그럼", "그러면", "그건", "그것", "그중", "그 중", "거기", "아까", "방금", "위에", "다시", "또")
PERIOD_PHRASE = r"(?:\d{4}\s*년\s*)?(?:[1-4]\s*분기|상반기|하반기|\d{1,2}\s*월)|\d{4}\s*년"
SHORT_QUESTION, MOST_GUESSES = 14, 6
SHORTEST_NAMED, NAMES_A_WORD, MOST_MENTIONED = 3, 3, 5


def glossary(spark: SparkSession) -> DataFrame:
    """(word, standard, grade, priority): names and columns of a term match exactly, synonyms less so."""
    rows = [(w, term, "정확", i) for i, (term, columns, _) in enumerate(GLOSSARY) for w in dict.fromkeys((term, *columns))]
    rows += [(w, term, "동의어", 100 + i) for i, (term, _, words) in enumerate(GLOSSARY) for w in words]
    return spark.createDataFrame(rows, "word string, standard string, grade string, priority int")


def match_terms(terms: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Grade and standard term of each term (term_id, term): a company's own entries (word, standard, grade, priority below 0)
    first, then exact words, then synonyms, else unregistered."""
    words = glossary(terms.sparkSession)
    words = words if extra is None else words.unionByName(extra)
    hit = terms.join(F.broadcast(words), F.trim("term") == F.col("word"), "left").groupBy("term_id", "term").agg(F.min_by(F.struct("standard", "grade"), "priority").alias("h"))
    return hit.select("term_id", "term", F.coalesce("h.grade", F.lit("미등록")).alias("grade"), F.col("h.standard").alias("standard"))


def guess_columns(terms: DataFrame, columns: DataFrame) -> DataFrame:
    """Up to six columns (name) that hold a term or lie within it."""
    names, distinct = columns.select("name").distinct(), terms.select("term").distinct()
    both = contains_join(names, "name", distinct, "term").select("term", "name").unionByName(contains_join(distinct, "term", names, "name").select("term", "name"))
    found = terms.join(both.distinct(), "term").groupBy("term_id").agg(F.array_sort(F.collect_set("name")).alias("c"))
    return found.select("term_id", F.array_join(F.slice("c", 1, MOST_GUESSES), ",").alias("guesses"))


def term_fallback(unmatched: DataFrame, index: DataFrame, names: DataFrame) -> DataFrame:
    """What an unregistered term is: a value of the data, part of a department's, file's or sheet's name (names: name), or unknown. Each
    distinct term is looked for once, however many rows ask for it."""
    terms = unmatched.select("term").distinct()
    value = terms.join(index.select(F.col("value_norm").alias("v")).distinct(), casefold(squeezed(F.col("term"))) == F.col("v"), "left_semi").withColumn("_as", F.lit("value"))
    part = _held(names.select("name").distinct(), stored(terms.join(value, "term", "left_anti"))).withColumn("_as", F.lit("file"))
    found = value.unionByName(part)
    return unmatched.join(found, "term", "left").select("term_id", "term", F.coalesce("_as", F.lit("unknown")).alias("found_as"))


def _held(names: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms (term; distinct, not empty) that any name holds. Many terms are looked up among the names' suffixes in order: a name holds a term
    that one of its suffixes begins with. So no pairs of names and terms are made."""
    if small(terms):
        return names.join(F.broadcast(terms.where(F.length("term") > 0)), F.col("name").contains(F.col("term"))).select("term").distinct()
    suffixes = names.where(F.length("name") > 0).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.expr("name").substr(i, F.length("name")))).alias("text")).distinct()
    words = terms.where(F.length("term") > 0).select(F.col("term").alias("w"))
    return common_beginnings(stored(words), "w", stored(suffixes), "text").where(F.col("n") == F.length("w")).select(F.col("w").alias("term"))


def parse_period(text: Column, latest_year: Column) -> Column:
    """Year, first and last day, months and label of the period words in a text; null without any. The year defaults to the latest."""
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    year, quarter, half, month = part(r"(20\d{2})\s*년"), part(r"([1-4])\s*분기").cast("int"), part(r"(상반기|하반기)"), part(r"(?<!\d)(1[0-2]|[1-9])\s*월").cast("int")
    y = F.coalesce(year.cast("int"), latest_year.cast("int"))
    first = F.when(quarter.isNotNull(), quarter * 3 - 2).when(half.isNotNull(), F.when(half == "상반기", 1).otherwise(7)).when(month.isNotNull(), month).when(year.isNotNull(), 1)
    last = F.when(quarter.isNotNull(), quarter * 3).when(half.isNotNull(), F.when(half == "상반기", 6).otherwise(12)).when(month.isNotNull(), month).when(year.isNotNull(), 12)
    label = F.when(quarter.isNotNull(), F.concat(quarter.cast("string"), F.lit("분기"))).when(half.isNotNull(), half).when(month.isNotNull(), F.concat(month.cast("string"), F.lit("월"))).otherwise("연간")
    months = F.transform(F.sequence(first, last), lambda m: F.concat(m.cast("string"), F.lit("월")))
    return F.when(first.isNotNull(), F.struct(label.alias("text"), y.cast("long").alias("year"), F.make_date(y, first, F.lit(1)).alias("start"), F.last_day(F.make_date(y, last, F.lit(1))).alias("end"), months.alias("months"), year.isNull().alias("year_defaulted")))


def pre_lookup(questions: DataFrame, names: DataFrame) -> DataFrame:
    """What each question (id, text) says by itself; questions that say nothing are left out.

    ``words``: glossary words (two letters or more) that lie in no longer one found there, in order, six at most. ``periods``: its first
    two period phrases. ``files``: names (name) that hold a word of three letters or more, or the longest beginning of it that any name
    holds; three names a word, five in all. Words and names meet in an equi-join of beginnings with the names' runs of letters."""
    words = glossary(questions.sparkSession).where(F.length("word") >= 2).groupBy("word").agg(F.min_by("standard", "priority").alias("standard"))
    hits = questions.join(F.broadcast(words), F.col("text").contains(F.col("word"))).groupBy("id").agg(F.collect_set("word").alias("w"))
    alone = F.filter("w", lambda a: ~F.exists("w", lambda b: (b != a) & b.contains(a)))
    found = hits.select("id", F.array_join(F.slice(F.array_sort(alone), 1, 6), ",").alias("words"))
    periods = questions.select("id", F.array_join(F.array_distinct(F.slice(F.regexp_extract_all("text", F.lit(PERIOD_PHRASE), F.lit(0)), 1, 2)), ",").alias("periods")).where("periods <> ''")
    joined = found.join(periods, "id", "full_outer").join(mentioned_files(questions, names), "id", "full_outer")
    return joined.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("words", "periods", "files")))


def mentioned_files(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(id, files) of questions that name files; see ``pre_lookup``.

    Names are laid out by their suffixes, in order: a name holds a word's beginning where one of its suffixes begins with it, and these suffixes stand
    together. Each word looks at its two neighbours in that order, which have the longest beginning in common with it, and then at
    the suffixes that begin with what is found. Letters of names give one row each; the order is cut into ranges (``functions.ranges``)."""
    suffixes = names.select("name").distinct().where(F.length("name") >= SHORTEST_NAMED).select("name", F.explode(F.sequence(F.lit(1), F.length("name") - (SHORTEST_NAMED - 1))).alias("i")).select("name", F.expr("substr(name, i)").alias("text"))
    words = questions.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[가-힣A-Za-z0-9_]{%d,}" % SHORTEST_NAMED), F.lit(0))).alias("pos", "w"))
    begins = stored(common_beginnings(stored(words.select("w").distinct()), "w", stored(suffixes.select("text").distinct()), "text").where(F.col("n") >= SHORTEST_NAMED).withColumn("run", F.expr("left(w, n)")))
    # Suffixes that begin with what was found: by an equi-join on as many letters as the shortest word has, then compared.
    head = lambda c: F.left(c, F.lit(SHORTEST_NAMED))
    met = begins.select("run").distinct().withColumn("head", head(F.col("run"))).join(suffixes.withColumn("head", head(F.col("text"))), "head").where(F.col("text").startswith(F.col("run"))).select("run", "name").distinct()
    few = met.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("name"))).where(F.col("k") <= NAMES_A_WORD)
    hits = words.join(begins.select("w", "run"), "w").join(few, "run")
    each = hits.groupBy("id", "name").agg(F.min(F.struct("pos", "k")).alias("o"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("k") <= MOST_MENTIONED, F.struct("o", "name"))))
    ranked = each.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("o")))
    return ranked.groupBy("id").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("files"))


def standard_terms(columns: DataFrame) -> DataFrame:
    """``columns`` (name and others) that are a term's, with the ``standard`` term; a column of two terms comes twice."""
    own = columns.sparkSession.createDataFrame([(c, term) for term, cs, _ in GLOSSARY for c in cs], "name string, standard string")
    return columns.join(F.broadcast(own), "name")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def scope_gate(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Verdict on each question (id, text, in_session): nonsense, pass or offtopic. ``vocabulary`` (word) is joined on the
    questions' own words and their beginnings, so neither side is compared with all of the other."""
    q = questions.withColumn("q", F.lower(F.coalesce("text", F.lit(""))))
    words = q.select("id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"[0-9a-z가-힣]+"), F.lit(0)))).alias("w")).where(F.length("w") >= 2)
    forms = words.select("id", F.explode(F.array_distinct(F.array("w", F.expr("left(w, length(w) - 1)"), F.expr("left(w, length(w) - 2)")))).alias("word")).where(F.length("word") >= 2)
    known = forms.join(vocabulary.select("word").distinct(), "word", "left_semi").select("id").distinct().withColumn("known", F.lit(True))
    off = _any(F.col("q"), OFF_TOPIC)
    verdict = (
        F.when(~F.col("q").rlike("[0-9a-z가-힣]"), "nonsense").when(F.col("known"), "pass").when(F.col("in_session") & (F.length("q") <= SHORT_QUESTION) & ~off, "pass")
        .when(_any(F.col("q"), FOLLOW_UP) & ~off, "pass").when(off, "offtopic").when(_any(F.col("q"), INTENT), "pass").otherwise("offtopic")
    )
    return q.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False))).select("id", verdict.alias("verdict"))


def scope_suggestions(columns: DataFrame, most: int = 12) -> DataFrame:
    """The names that most tables have, as hints of what can be asked."""
    return columns.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
