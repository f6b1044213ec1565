"""Tokens, redacted texts, reports and counts, inside each row: no shuffle, fit for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushspan.functions.entities import let, token_prefix
from hushspan.functions.spans import overlap


def hmac_sha256(key: bytes, value: Column) -> Column:
    """HMAC-SHA256 in hex. The padded key is a literal of the plan: keep plans of pseudonymising jobs as secret as it."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def pseudonym(prefix: Column, value: Column, key: bytes, width: int = 8) -> Column:
    return F.concat(prefix, F.lit("_"), F.upper(F.left(hmac_sha256(key, value), F.lit(max(2, width)))))


def active(spans: Column) -> Column:
    """Spans to redact, those in the way of one already taken left out (spans are in order; resolved ones never are)."""
    enabled = F.filter(spans, lambda s: s["enabled"] & (s["end"] > s["start"]))
    return let(enabled, lambda e: F.when(~overlap(e), e).otherwise(F.filter(e, lambda s, i: (i == 0) | (s["start"] >= F.coalesce(F.array_max(F.transform(F.slice(e, F.lit(1), i), lambda p: p["end"])), F.lit(0))))))


def tokens(spans: Column, mode: str = "redact", key: bytes | None = None, width: int = 8) -> Column:
    """Spans as structs with token. In mode redact a token counts the distinct values of its prefix in reading order; in
    mode pseudonymise it is derived from value and key, and without a key falls back to counting."""

    def all_tokens(taken: Column) -> Column:
        kinds = F.array_distinct(F.transform(taken, lambda s: s["type"]))
        of = lambda k: F.array_distinct(F.transform(F.filter(taken, lambda o: o["type"] == k), lambda o: o["value"]))
        return let(F.map_from_arrays(kinds, F.transform(kinds, of)), lambda values: stamped(taken, values))

    def stamped(taken: Column, values: Column) -> Column:
        def one(s: Column) -> Column:
            prefix = token_prefix(s["type"])
            if mode == "pseudonymise" and key is not None:
                token = pseudonym(prefix, s["value"], key, width)
            else:
                token = F.concat(F.lit("["), prefix, F.lit("_"), F.array_position(F.element_at(values, s["type"]), s["value"]).cast("string"), F.lit("]"))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["type"].alias("type"), token.alias("token"))

        return F.transform(taken, one)

    if mode not in ("redact", "pseudonymise"):
        raise ValueError(f"unknown mode: {mode}")
    return let(active(spans), all_tokens)


def splice(text: Column, stamped: Column) -> Column:
    """The text with each stamped span replaced by its token."""

    def whole(t: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(t, i - 1)["end"])
        pieces = F.transform(t, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), s["token"]))
        tail = F.substring(text, F.coalesce(F.get(t, F.size(t) - 1)["end"], F.lit(0)) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return let(stamped, whole)


def redacted(df: DataFrame, mode: str = "redact", key: bytes | None = None, width: int = 8) -> DataFrame:
    """Adds to df (text, spans resolved) tokens and redacted_text. A null text stays null."""
    own = df.withColumn("tokens", tokens(F.col("spans"), mode, key, width))
    return own.withColumn("redacted_text", splice(F.col("text"), F.col("tokens")))


def flagged(spans: Column) -> Column:
    """What is found, reported and left in."""
    return F.filter(spans, lambda s: (s["disposition"] == "flag") & ~s["enabled"])


def counts(spans: Column) -> Column:
    """map<type, bigint>, keys in order."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["type"])))
    return F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter(spans, lambda s: s["type"] == k)).cast("long"))))


def left_in(spans: Column) -> Column:
    """`type n, type n` of the flagged spans, by type."""
    return F.array_join(F.transform(F.map_entries(counts(flagged(spans))), lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"))), ", ")


def report(df: DataFrame, id: str = "doc_id") -> DataFrame:
    """One row a span, without its value: what may leave the house."""
    one = df.select(id, F.explode("spans").alias("s"))
    status = F.when(F.col("s.enabled"), "redacted").otherwise(F.when(F.col("s.disposition") == "flag", "flagged").otherwise("off"))
    return one.select(id, F.col("s.type").alias("type"), F.col("s.confidence").alias("confidence"), F.col("s.source").alias("source"), F.col("s.start").alias("start"), (F.col("s.end") - F.col("s.start")).alias("length"), status.alias("status"))


def report_json(df: DataFrame) -> DataFrame:
    """Sorted JSON of the counts of what is removed, and what is left in."""
    return df.withColumn("removed", F.to_json(counts(active(F.col("spans"))))).withColumn("left_in", left_in(F.col("spans")))
