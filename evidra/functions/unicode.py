"""Canonical composition (NFC) and full case folding as Spark expressions.

The tables follow from Python's ``unicodedata`` by rule, so both sides use one version of Unicode; Hangul syllables are composed by
arithmetic. Texts that need nothing (no marks, plain ASCII) are told by one pattern and pass unchanged.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEP = "\0"
L0, V0, T0, S0, LN, VN, TN = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28  # fixed values: where Hangul letters and syllables begin, and how many there are


def _all() -> list[str]:
    return [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]


def _syllable(c: str) -> bool:
    return S0 <= ord(c) < S0 + LN * VN * TN


def _class(chars: list[str]) -> str:
    """A character class of a pattern, as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


@cache
def _composition() -> dict[str, object]:
    """What composition needs: decompositions, classes of marks, pairs, and patterns of the characters in question."""
    chars = _all()
    apart = {c: d for c in chars if not _syllable(c) and (d := unicodedata.normalize("NFD", c)) != c}
    marks = {c: unicodedata.combining(c) for c in chars if unicodedata.combining(c)}
    pairs = {}
    for c in apart:
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and unicodedata.normalize("NFC", c) == c:  # the others are never composed
            pairs[chr(int(parts[0], 16)) + chr(int(parts[1], 16))] = c
    second = {p[1] for p in pairs} | {chr(V0 + k) for k in range(VN)} | {chr(T0 + k) for k in range(1, TN)}
    joins = [c for c in chars if (d := apart.get(c, c)[0]) in marks or d in second]
    changed = [c for c in chars if unicodedata.normalize("NFC", c) != c]
    return {
        "apart": _SEP + _SEP.join(c + d for c, d in apart.items()) + _SEP, "apart_class": _class(list(apart)), "marks": _SEP + _SEP.join(c + f"{k:03d}" for c, k in marks.items()) + _SEP, "marks_class": _class(list(marks)),
        "pairs": _SEP + _SEP.join(p + c for p, c in pairs.items()) + _SEP, "second_class": _class([p[1] for p in pairs]), "joins": _class(joins), "in_question": _class(joins + changed),
    }


def _found(entries: str, key: Column, length: int) -> Column:
    """What follows ``key`` (of ``length`` characters) in separated entries; null if it isn't there."""
    at = F.instr(F.lit(entries), F.concat(F.lit(_SEP), key))
    return F.when(at > 0, F.substring_index(F.substring(F.lit(entries), at + 1 + length, F.lit(8)), _SEP, 1))


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _composed(a: Column, b: Column, tables: dict) -> Column:
    """The one character that stands for the pair, or null."""
    first, second = F.ascii(a), F.ascii(b)
    syllable = F.when(first.between(L0, L0 + LN - 1) & second.between(V0, V0 + VN - 1), S0 + ((first - L0) * VN + second - V0) * TN).when(
        first.between(S0, S0 + LN * VN * TN - 1) & ((first - S0) % TN == 0) & second.between(T0 + 1, T0 + TN - 1), first + second - T0
    )
    return F.when(syllable.isNotNull(), _character(syllable)).when(b.rlike(tables["second_class"]), _found(tables["pairs"], F.concat(a, b), 2))


def nfc(x: Column) -> Column:
    """Canonical composition. Each starter and what may join it is taken apart, its marks are put in order, and it is put together."""
    t = _composition()
    apart = lambda c: F.when(c.rlike(t["apart_class"]), F.coalesce(_found(t["apart"], c, 1), c)).otherwise(c)
    rank = lambda c: F.when(c.rlike(t["marks_class"]), _found(t["marks"], c, 1).cast("int")).otherwise(0)

    def composed(cluster: Column) -> Column:
        chars = F.flatten(F.transform(F.split(cluster, ""), lambda c: F.split(apart(c), "")))
        ranked = F.transform(chars, lambda c, i: F.struct(rank(c).alias("rank"), i.alias("at"), c.alias("c")))
        # A starter is a barrier: marks are ordered among those behind the same starter.
        starters = F.transform(F.filter(ranked, lambda r: r["rank"] == 0), lambda r: r["at"])
        ordered = F.array_sort(F.transform(ranked, lambda r: F.struct(F.size(F.filter(starters, lambda s: s <= r["at"])).alias("group"), r["rank"].alias("rank"), r["at"].alias("at"), r["c"].alias("c"))))

        def step(s: Column, i: Column) -> Column:
            free = (F.length(s["starter"]) > 0) & ((F.length(s["tail"]) == 0) | (s["last"] < i["rank"]))
            one = F.when(free, _composed(s["starter"], i["c"], t))
            new = i["rank"] == 0
            return F.when(one.isNotNull(), F.struct(s["done"].alias("done"), one.alias("starter"), s["tail"].alias("tail"), s["last"].alias("last"))).when(
                new, F.struct(F.concat(s["done"], s["starter"], s["tail"]).alias("done"), i["c"].alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))
            ).otherwise(F.struct(s["done"].alias("done"), s["starter"].alias("starter"), F.concat(s["tail"], i["c"]).alias("tail"), i["rank"].alias("last")))

        empty = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("tail"), F.lit(0).alias("last"))
        return F.aggregate(ordered, empty, step, lambda s: F.concat(s["done"], s["starter"], s["tail"]))

    clusters = F.regexp_extract_all(x, F.lit(f"(?s).{t['joins']}*"), F.lit(0))
    return F.when(x.rlike(t["in_question"]), F.array_join(F.transform(clusters, lambda c: F.when(c.rlike(t["in_question"]), composed(c)).otherwise(c)), "")).otherwise(x)


@cache
def _folds() -> tuple[str, str, str, str]:
    """Characters that fold to one other, what they fold to, and a pattern and entries of those that fold to several."""
    folds = {c: f for c in _all() if (f := c.casefold()) != c}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    several = {c: f for c, f in folds.items() if len(f) > 1}
    return "".join(one), "".join(one.values()), _class(list(several)), _SEP + _SEP.join(c + f for c, f in several.items()) + _SEP


def casefold(x: Column) -> Column:
    """Full case folding: what compares texts without regard to case (``Straße`` is ``STRASSE``). Runs of plain ASCII are only lowered; tables are
    for what lies between them. ``x`` is worked out once."""
    before, after, several, entries = _folds()

    def folded(run: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(run, ""), lambda c: F.when(c.rlike(several), _found(entries, c, 1)).otherwise(c)), "")
        return F.translate(F.when(run.rlike(several), spelled).otherwise(run), before, after)

    runs = lambda y: F.regexp_extract_all(y, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    whole = lambda y: F.array_join(F.transform(runs(y), lambda r: F.when(F.length(r) == F.octet_length(r), F.lower(r)).otherwise(folded(r))), "")
    return F.element_at(F.transform(F.array(x), lambda y: F.when(F.length(y) == F.octet_length(y), F.lower(y)).otherwise(whole(y))), 1)


def white_space() -> str:
    """A character class of what ``str.split`` parts words at."""
    return _class([c for c in _all() if c.isspace()])


def squeezed(x: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, f"{white_space()}+", " "))


