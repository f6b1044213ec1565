"""Spans of patterns in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushspan.functions.entities import let, no_spans, span
from hushspan.functions.rules import Rule


def places(text: Column, pattern: str, inside: str = "") -> Column:
    """array<struct<start int, value string>> of all matches of a Java pattern that never matches the empty text; of each
    match only what `inside` finds at its start, if that is given, and no match where it finds nothing.

    What the pattern splits off and what it extracts alternate, so their lengths add up to the offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.length(g)).alias("gap"), F.transform(found, lambda v: F.length(v)).alias("size"))
    # plain numbers are collected, and joined to the values after: copying them is what an array of many matches costs
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + p["gap"] + p["size"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + p["gap"])).alias("out"))
    out = F.arrays_zip(F.aggregate(pairs, start, step)["out"].alias("start"), found.alias("value"))
    if inside:
        cut = F.transform(out, lambda m: F.struct(m["start"].alias("start"), F.regexp_extract(m["value"], inside, 0).alias("value")))
        out = F.filter(cut, lambda m: m["value"] != "")
    none = F.array().cast("array<struct<start:int,value:string>>")
    return F.when(F.size(found) == 0, none).otherwise(out)


def rule_spans(text: Column, rule: Rule, source: str = "regex", detector: int = 0, ord: int = 0, low: Column | None = None) -> Column:
    """SPANS of one rule; the costly part runs only for texts that pass the rule's cheap tests and match at all. low: the
    text in lower case, where several rules share it."""
    one = F.transform(places(text, rule.java, rule.flags + rule.inside if rule.inside else ""), lambda m, i: span(m["start"], m["value"], rule.type, rule.confidence, source, rule.disposition, detector, F.lit(ord * 100_000) + i))
    test = text.rlike(rule.java)
    if rule.hint:
        test = text.rlike(rule.hint) & test
    if rule.needs:
        low = F.lower(text) if low is None else low
        any_of = low.contains(rule.needs[0])
        for word in rule.needs[1:]:
            any_of = any_of | low.contains(word)
        test = any_of & test
    return F.when(test, one).otherwise(no_spans())


def rules_spans(text: Column, rules: list[Rule], source: str = "regex", detector: int = 0) -> Column:
    if not rules:
        return no_spans()
    return let(F.lower(text), lambda low: F.concat(*[rule_spans(text, r, source, detector, i, low) for i, r in enumerate(rules)]))


def ordered(spans: Column) -> Column:
    """By start, then the longer, then the surer, then detector and match: as resolution takes them."""
    key = lambda s: F.struct(s["start"], -s["end"], -s["confidence"], s["detector_ord"], s["match_ord"])
    keyed = F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.struct(key(s).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def overlap(spans: Column) -> Column:
    """Whether any span of an ordered array starts before an earlier one ends."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(False).alias("hit"))
    return F.aggregate(spans, start, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["hit"] | (s["start"] < a["end"])).alias("hit")))["hit"]


def grapheme_offset(text: Column, start: Column) -> Column:
    """A code point offset as a count of characters as readers see them (CRLF, emoji and accents are one each)."""
    return F.regexp_count(F.left(text, start), F.lit(r"\X"))
