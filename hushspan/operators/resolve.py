"""From overlapping candidates to disjoint spans. Texts without an overlap never leave the JVM."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.functions.entities import SPANS, let
from hushspan.functions.spans import ordered, overlap


def settle(spans: list[dict], text: str) -> list[dict]:
    """The rules for overlaps, for spans in order (start, longer, surer).

    A span inside the last one kept goes. Of two that overlap in part the surer wins, of equals the longer. If the later
    one wins, the earlier keeps what lies before it; if it loses, what lies behind the earlier one waits its turn.
    Remainders lose white space at their ends and vanish if nothing is left.
    """
    waiting, kept = list(reversed(spans)), []
    while waiting:
        new = waiting.pop()
        if not kept or new["start"] >= kept[-1]["end"]:
            kept.append(new)
            continue
        old = kept[-1]
        if new["end"] <= old["end"]:
            continue
        sizes = new["end"] - new["start"], old["end"] - old["start"]
        if (new["confidence"], sizes[0]) > (old["confidence"], sizes[1]):
            rest = part(old, old["start"], new["start"], text)
            kept[-1:] = [new] if rest is None else [rest, new]
        elif (rest := part(new, old["end"], new["end"], text)) is not None:
            at = next((i for i in range(len(waiting), 0, -1) if waiting[i - 1]["start"] > rest["start"]), 0)
            waiting.insert(at, rest)
    return kept


def part(span: dict, start: int, end: int, text: str) -> dict | None:
    """What is left of a span between start and end."""
    piece = text[start:end]
    start, end = start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())
    if start >= end:
        return None
    return span | {"start": start, "end": end, "value": text[start:end], "enabled": span["disposition"] == "redact"}


def resolve(df: DataFrame, found: str, out: str = "spans") -> DataFrame:
    """df (text) with column `found` replaced by `out`: disjoint spans, ascending. Only documents whose spans overlap are
    handed to Python; the others arrive there as nulls, without their text."""

    @F.pandas_udf(SPANS)
    def settled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for some, texts in batches:
            yield pd.Series([None if s is None else settle([dict(x) for x in s], t) for s, t in zip(some, texts, strict=True)], dtype=object)

    own = df.withColumn("_sorted", ordered(F.col(found))).drop(found)
    own = own.withColumn("_hit", let(F.col("_sorted"), overlap))
    own = own.withColumn("_settled", settled.asNondeterministic()(F.when(F.col("_hit"), F.col("_sorted")), F.when(F.col("_hit"), F.col("text"))))
    return own.withColumn(out, F.coalesce("_settled", "_sorted")).drop("_sorted", "_hit", "_settled")
