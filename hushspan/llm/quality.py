"""Quality classifier trained without labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of
vote patterns (all documents; a bounded table) estimates the labellers' accuracies. The posterior labels of a bounded
sample then train a linear scorer on hashed features, and the scorer decides on every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import durable, small_batches, trim

#: Distinct texts that the linear scorer is fitted on, about; hashed features; rounds of EM and of gradient descent.
SAMPLE, FEATURES, ROUNDS, STEPS = 6000, 1 << 14, 200, 300
#: A document is kept if its score is at least this.
KEEP = 0.5
LABELLERS = ("symbols", "shouting", "repetition", "cells", "alphabet", "sentences", "variety", "stutter")


@lru_cache(1 << 14)
def traits(word: str) -> tuple[int, int, int, int]:
    """(letters, upper-case letters, 1 marked 2 bare 3 closed, slot of the shape) of a word."""
    letters = sum(map(str.isalpha, word))
    upper = 0 if word.islower() else sum(map(str.isupper, word))
    if not letters and not any(map(str.isdigit, word)):
        ending = 2
    elif len(word) > 2 and not word[-1].isalnum() and not word[-2].isalnum():
        ending = 1
    else:
        ending = 3 if word[-1] in ".?!:;," else 0
    return letters, upper, ending, shape(word)


#: Marks that words end in; what else a word may hold is looked at character by character.
TAIL = ".,;:!?$%&#*|\"')]}"
#: Longer words are read whole too, but not remembered.
LONG = 64
_slots: dict[tuple[str, str], int] = {}


def plain_slot(kind: str, tail: str) -> int:
    """Slot of the shape of a word of letters (a, A, Aa) and closing marks."""
    if (slot := _slots.get((kind, tail))) is None:
        if len(_slots) > 1 << 16:
            _slots.clear()
        slot = _slots[kind, tail] = shape(kind + tail)
    return slot


def statistics(text: str, shaped: bool = True) -> tuple[dict[str, float], Counter[int]]:
    """What the labellers and the scorer look at, for a whole text, and, if asked for, how often each word shape occurs."""
    words = text.split()
    count = Counter(words)
    n = max(1, len(words))
    letters = upper = 0
    endings = [0, 0, 0, 0]
    shapes: Counter[int] = Counter()
    for w, k in count.items():
        core = w.rstrip(TAIL)
        if core.isalpha():
            size = len(core)
            letters += size * k
            if core.islower():
                kind = "a"
            elif core.isupper():
                kind = "A"
                upper += size * k
            elif core[1:].islower():
                kind = "Aa"
                upper += k
            else:
                kind = core
                upper += sum(map(str.isupper, core)) * k
            tail = w[size:]
            if tail:
                endings[1 if len(tail) > 1 else 3 if tail in ".?!:;," else 0] += k
            if shaped:
                shapes[plain_slot(kind, tail) if kind is not core and len(tail) <= LONG else shape(w)] += k
        else:
            a, u, e, slot = traits(w) if len(w) <= LONG else traits.__wrapped__(w)
            letters += a * k
            upper += u * k
            endings[e] += k
            shapes[slot] += k
    return {
        "n": len(words),
        "marked": endings[1] / n,
        "bare": endings[2] / n,
        "upper": upper / max(1, letters),
        "distinct": len(count) / n,
        "top": max(count.values(), default=0) / n,
        "letters": letters / max(1, len(text)),
        "closed": endings[3] / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "blank": float(not words),
    }, shapes


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """A vote of each labeller: 1 good, 0 bad, -1 none."""
    long = s["n"] >= 30
    spread = s["distinct"] * min(1.0, (s["n"] / 60) ** 0.4)  # long texts repeat words anyway
    return (
        0 if s["marked"] > 0.3 or s["blank"] else 1 if s["marked"] < 0.05 else -1,
        0 if s["upper"] > 0.5 and s["n"] > 3 else 1 if s["upper"] < 0.2 else -1,
        0 if long and (spread < 0.22 or s["top"] > 0.3) else 1 if long and spread > 0.35 else -1,
        0 if s["bare"] > 0.25 and s["n"] > 4 else 1 if s["bare"] < 0.08 else -1,
        0 if s["letters"] < 0.3 or s["blank"] else 1 if s["letters"] > 0.6 else -1,
        -1 if not long else 0 if s["closed"] == 0 else 1 if s["closed"] > 0.05 else -1,
        -1 if not long else 1 if s["distinct"] > 0.3 and s["marked"] < 0.1 and s["bare"] < 0.1 else 0 if s["marked"] > 0.5 or s["bare"] > 0.4 else -1,
        -1 if s["n"] < 4 else 0 if s["stutter"] > 0.3 else 1 if s["stutter"] < 0.1 else -1,
    )


def shape(word: str) -> int:
    """Slot of a word's shape: classes of its characters, runs shortened; the letters themselves don't count."""
    s = re.sub(r"\d+", "9", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word))
    s = re.sub(r"a+", "a", re.sub(r"A+", "A", s))
    return hash_slot("shape " + re.sub(r"(\W)\1+", r"\1\1", s))


def hash_slot(name: str) -> int:
    h = 0xCBF29CE484222325
    for b in name.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 31) % FEATURES


@lru_cache(4096)
def level(name: str, at: int) -> int:
    return hash_slot(f"{name} {at}")


def features(s: dict[str, float], shapes: Counter[int]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights): shares of word shapes, and the statistics in steps."""
    slots = np.fromiter(shapes, np.int64, len(shapes))
    shares = np.sqrt(np.fromiter(shapes.values(), float, len(shapes)) / max(1, s["n"]))
    spread = s["distinct"] * min(1.0, (s["n"] / 60) ** 0.4)
    steps = [level(k, int(10 * min(1.0, v))) for k, v in (*s.items(), ("spread", spread)) if k != "n"]
    return np.append(slots, steps), np.append(shares, np.full(len(steps), 0.5))


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """EM for independent labellers: (share of good, accuracy[labeller, class, vote], posterior of good by pattern).

    A labeller that doesn't vote tells nothing. It starts from whether anyone votes bad, and smooths by one vote of each kind.
    """
    rows = list(patterns)
    v = np.array(rows, int).reshape(len(rows), -1)
    n = np.array([patterns[r] for r in rows], float)
    good = np.where((v == 0).sum(1) >= 1, 0.1, 0.95)
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        table = np.empty((v.shape[1], 2, 2))
        for j in range(v.shape[1]):
            for c, p in ((1, good), (0, 1 - good)):
                w = np.array([(n * p)[v[:, j] == x].sum() for x in (0, 1)]) + 1
                table[j, c] = w / w.sum()
        ll = [np.log(q) + sum(np.where(v[:, j] < 0, 0.0, np.log(table[j, c, v[:, j]])) for j in range(v.shape[1])) for c, q in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return float(prior), table, dict(zip(rows, good.tolist(), strict=True))


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, seen: tuple[dict[str, float], Counter[int]]) -> float:
        slots, values = features(*seen)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[slots] @ values, -60, 60))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float, float]], steps: int = STEPS) -> Scorer:
    """Logistic regression on posterior labels, (slots, values, label, weight) a row; the classes weigh alike."""
    w, b = np.zeros(FEATURES), 0.0
    if not rows:
        return Scorer(w, 1.0)
    slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    n = np.array([r[3] for r in rows])
    weight = n * y / max(1.0, n @ y) + n * (1 - y) / max(1.0, n @ (1 - y))
    weight /= weight.sum()
    if min(y.sum(), (1 - y).sum()) < 1:  # one class only: keep or reject all
        return Scorer(w, 4.0 if y.sum() >= 1 else -4.0)
    square, square_b = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(owner, w[slots] * values, len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        grad = np.bincount(slots, g[owner] * values, FEATURES) + 1e-5 * w
        square, square_b = square + grad**2, square_b + g.sum() ** 2
        w -= 0.5 * grad / np.sqrt(square)
        b -= 0.5 * g.sum() / np.sqrt(square_b)
    return Scorer(w, float(b))


def observed(docs: DataFrame, name: str = "pattern") -> DataFrame:
    @F.pandas_udf("array<int>")
    def vote(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([list(votes(statistics(x or "", shaped=False)[0])) for x in texts], dtype=object)

    return docs.withColumn(name, vote("text"))


def train(docs: DataFrame) -> tuple[Scorer, dict[tuple[int, ...], float]]:
    """The scorer and the posteriors. Votes are counted over all of docs; the scorer is fitted on about SAMPLE distinct
    texts, those of least hash, half of them from each side where there are enough; null is one text, the empty one. A
    text that n rows have weighs 1 + ln(n): counted fully, one text that much of a table repeats would be all that its
    side learns from. No given label is read."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    place = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    seen = durable(observed(docs).groupBy("hash", "pattern").agg(F.count("*").alias("n")))
    counted = {tuple(r["pattern"]): (r["n"], r["texts"]) for r in seen.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()}
    if not counted:
        return Scorer(np.zeros(FEATURES), 1.0), {}
    _, _, posterior = estimate({p: n for p, (n, _) in counted.items()})
    sides = {side: sum(n for p, (_, n) in counted.items() if (posterior[p] >= 0.5) == side) for side in (True, False)}
    limit = {side: min(1.0, SAMPLE / 2 / max(1, n)) for side, n in sides.items()}
    good = F.array(*[F.array(*map(F.lit, p)) for p, q in posterior.items() if q >= 0.5]) if any(q >= 0.5 for q in posterior.values()) else F.array().cast("array<array<int>>")
    chosen = seen.where(place < F.when(F.array_contains(good, F.col("pattern")), limit[True]).otherwise(limit[False])).select(F.col("hash").alias("own"), "n")
    likely = docs.sparkSession.sparkContext.broadcast(posterior)

    def sample(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, n in zip(part["text"], part["n"], strict=True):
                seen = statistics(text)
                slots, values = features(*seen)
                out.append((slots, values, likely.value[votes(seen[0])], 1 + np.log(n)))
            yield pd.DataFrame(out, columns=["slots", "weights", "label", "count"])

    texts = docs.join(F.broadcast(chosen), F.col("hash") == F.col("own")).groupBy("hash").agg(F.min("text").alias("text"), F.min("n").alias("n"))
    rows = texts.select("text", "n").mapInPandas(sample, "slots array<long>, weights array<double>, label double, count double").toPandas()
    rows = sorted(((np.asarray(a), np.asarray(b), c, d) for a, b, c, d in rows.itertuples(index=False)), key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes(), r[3]))
    return fit(rows), posterior


def classify(docs: DataFrame, model: tuple[Scorer, dict[tuple[int, ...], float]] | None = None) -> DataFrame:
    """Adds to docs: weak_label double (posterior of good from the votes alone), quality_score double (0 to 1), keep boolean.

    Null and empty texts and texts of white space are judged as empty ones: their votes are bad, so they go wherever bad
    documents were seen. Columns of docs with these names are replaced; an empty table stays empty. Repeated rows get
    equal results.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("struct<weak_label:double, quality_score:double>")
    def judge(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer, posterior = model.value
        for texts in column:
            found = [(posterior.get(votes(seen[0]), 0.5), scorer.score(seen)) for seen in (statistics(x or "") for x in texts)]
            yield pd.DataFrame(found, columns=["weak_label", "quality_score"]).astype(float)
        trim()

    own = docs.drop("weak_label", "quality_score", "keep").withColumn("_judged", judge("text"))
    return own.select(*[c for c in own.columns if c != "_judged"], "_judged.*").withColumn("keep", F.col("quality_score") >= KEEP)
