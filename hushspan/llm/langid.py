"""Language identification by Bloom filters of n-grams, bit-sliced by language.

Slot i of the filter holds a mask with one bit for each language. The masks at an n-gram's slots, combined by AND, are
the set of all languages that contain the n-gram: one lookup asks every language at once. The counts of the bits over a
text's n-grams, corrected for what a filter answers falsely, decide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import durable, small_batches

#: Rows learned from in each language, about, and in all: the bound of the sample, shared evenly by very many languages.
SAMPLE, TOTAL = 3000, 300_000
#: Lengths of n-grams, hash functions, slots for each entry, least count and least share of the most frequent language's rate.
SIZES, HASHES, SLOTS, LEAST, SHARE = (2, 3, 4), 3, 24, 4, 0.25
#: Languages whose shares are broadcast at most; n-grams of a language's sample for each time that one must be met, up to
#: LEAST: a language of few texts keeps all of its n-grams.
MANY, RICH = 10_000, 20_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SPACE = 32


@lru_cache(1)
def letters() -> np.ndarray:
    """The code point of each letter or mark, SPACE of everything else."""
    table = np.full(0x110000, SPACE, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] in "LM":
            table[i] = i
    return table


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams of the lower-cased texts, text that each belongs to). Words are framed by one blank."""
    points = np.frombuffer((" " + "  ".join(texts).lower() + " ").encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x.lower()) + 2 for x in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    points = letters()[points[: len(owner)]].astype(np.uint64)
    blank = points == SPACE
    keep = ~(blank & np.append(False, blank[:-1] & (owner[1:] == owner[:-1])))
    points, owner, blank = points[keep], owner[keep], blank[keep]
    hashes, owners = [], []
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        whole = owner[:m] == owner[n - 1 :]
        for i in range(n):
            h = (h ^ points[i : i + m]) * np.uint64(0x100000001B3)
            if 0 < i < n - 1:
                whole &= ~blank[i : i + m]
        hashes.append((h ^ (h >> np.uint64(29)))[whole])
        owners.append(owner[:m][whole])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def slots(hashes: np.ndarray, log2: int) -> list[np.ndarray]:
    return [((hashes * odd) >> np.uint64(64 - log2)).astype(np.int64) for odd in ODD[:HASHES]]


@dataclass
class Model:
    """masks: (slots, words of 64 languages); false: for each language the rate of false hits."""

    langs: list[str]
    log2: int
    masks: np.ndarray
    false: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """`und` with score 0 for null texts, texts without a letter, and where nothing was learned."""
        found = ["" if x is None else x for x in texts]
        hashes, owner = grams(found)
        both = self.masks[slots(hashes, self.log2)[0]]
        for at in slots(hashes, self.log2)[1:]:
            both &= self.masks[at]
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        hits = np.stack([np.bincount(owner, (both[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), len(texts)) for i in range(len(self.langs))] or [np.zeros(len(texts))], 1)
        false = self.false if self.langs else np.zeros(1)
        true = np.clip((hits - total[:, None] * false) / np.maximum(1e-9, 1 - false), 0, None)
        best = true.argmax(1)
        out, score = [], []
        for i, x in enumerate(found):
            if not self.langs or not any(map(str.isalpha, x)):
                out.append("und")
                score.append(0.0)
            else:
                out.append(self.langs[best[i]])
                # the share of the winner among the languages' squared hits: 1 if no other language has any
                square = true[i] ** 2
                score.append(float(square[best[i]] / s) if (s := square.sum()) > 0 else 0.0)
        return out, score


def build(counts: pd.DataFrame) -> Model:
    """counts: (lang, gram, n), the n-grams of the sample."""
    langs = sorted(counts["lang"].unique())
    size = counts.groupby("lang")["n"].transform("sum")
    counts = counts.assign(rate=counts["n"] / size)
    counts = counts[counts["rate"] >= SHARE * counts.groupby("gram")["rate"].transform("max")]
    log2 = max(10, int(np.ceil(np.log2(max(1, SLOTS * counts["gram"].nunique())))))
    masks = np.zeros((1 << log2, max(1, -(-len(langs) // 64))), np.uint64)
    false = []
    for i, lang in enumerate(langs):
        own = counts.loc[counts["lang"] == lang, "gram"].to_numpy().view(np.uint64)
        filled = np.unique(np.concatenate(slots(own, log2)))
        masks[filled, i // 64] |= np.uint64(1 << i % 64)
        false.append((len(filled) / len(masks)) ** HASHES)
    return Model(langs, log2, masks, np.array(false))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learns from rows with text, doc_id and lang that are not held out: of each language about SAMPLE rows, those of
    least hash of doc_id; all if there are fewer; less of each if there are more than TOTAL / SAMPLE languages. N-grams are
    counted where the rows lie. The driver gets those met LEAST times or more, of languages with small samples those met
    less often too, down to once: each language learned from has n-grams. The sample bounds their number."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = durable(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("rows")))
    most = min(SAMPLE, TOTAL / max(1, counts.count()))
    share = counts.select((F.lit(float(most)) / F.col("rows")).alias("share"), "of")
    if counts.count() <= MANY:  # the usual case: texts stay where they are; with more languages the join deals them out
        share = F.broadcast(share)
    least = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    sample = known.join(share, known["lang"] == share["of"]).where(least < F.col("share")).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lang, own in part.groupby("lang"):
                gram, n = np.unique(grams(own["text"].tolist())[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    total = durable(sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    size = total.groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("size"))
    need = F.greatest(F.lit(1), F.least(F.lit(LEAST), F.floor(F.col("size") / RICH)))
    return build(total.join(size, total["lang"] == size["of"]).where(F.col("n") >= need).select("lang", "gram", "n").toPandas())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text; lang where no model is given).

    A null text, or one without a letter, is `und` with score 0, and so is every text if nothing could be learned. A
    null doc_id is not held out and not learned from. An empty table gives an empty one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("struct<lang_pred:string, score:double>")
    def predict(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            langs, score, at = [], [], 0
            rows = texts.tolist()
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(rows[end] or "") <= 1_000_000):
                    size += len(rows[end] or "")
                    end += 1
                a, b = model.value.predict(rows[at:end])
                langs += a
                score += b
                at = end
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object), "score": pd.Series(score, dtype=float)})

    return docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
