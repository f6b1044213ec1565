"""Personal data by a semi-Markov conditional random field over whole spans.

Base spans follow fixed patterns. Around digits and at-signs a text is cut into short islands; there every segment of
bounded length is scored as a whole, for every kind, by features of the full span (its digits, checksum, shape, label to
the left, how it is bounded), and dynamic programming chooses boundaries and kinds together. Spans of the model that
touch no base span are added. Weights are learned from generated islands by maximum likelihood, once on the driver.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
BASE = KINDS[:4]
#: Atoms of an entity at most; atoms of an island at most (a longer one is cut, with an entity's length of overlap).
MOST, ISLAND = 16, 400

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    back = [ord(c) - 48 for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind in the order of KINDS. Linear in the text."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            free = m.end()
            found.append((start, free, "email"))
            at = text.find("@", free)
        else:
            # what lies before this sign can't open a match any more
            free = at + 1
            at = text.find("@", at + 1)
    if re.search("[0-9]", text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if small_parts(m[0])]
        for pattern, kind, low, high in ((CARD, "card", 14, 19), (PHONE, "phone", 10, 15)):
            for m in pattern.finditer(text):
                if m.end() - m.start() >= low and low <= len(d := digits_of(m[0])) <= high and (kind == "phone" or luhn(d)):
                    found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


ATOM = re.compile(r"\w+|\s+|[^\w\s]")
WORD = re.compile(r"\S+")
TRIGGER = re.compile(r"[0-9@]")
LABEL = re.compile(r"([A-Za-z]+)[\W_]*$")
FULL_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
FULL_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
FULL_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
FULL_PHONE = re.compile(r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}")
LABELS = (("token", "secret", "key", "apikey", "password", "passwd", "bearer"), ("phone", "tel", "telephone", "call", "fax", "mobile", "cell"), ("ssn", "social", "security"), ("card", "visa", "mastercard", "credit", "cc"), ("mail", "email", "contact"))


def features(span: str, before: str, after: str, atoms: int) -> list[float]:
    """Of a whole span; before and after: what is next to it, a few characters."""
    d = digits_of(span)
    n, letters = len(d), any(map(str.isalpha, span))
    label = m[1].lower() if (m := LABEL.search(before)) else ""
    alone = span.isalnum() and span.isascii()
    ip = FULL_IP.fullmatch(span) is not None and small_parts(span)
    return [
        1,
        span[0] == "+",
        span[0] == "(",
        "@" in span,
        FULL_EMAIL.fullmatch(span) is not None,
        ip,
        10 <= n <= 15 and not letters,
        14 <= n <= 19 and not letters,
        14 <= n <= 19 and not letters and luhn(d),
        FULL_SSN.fullmatch(span) is not None,
        FULL_PHONE.fullmatch(span) is not None,
        alone and len(span) >= 32 and n > 2 and letters and all(c in "0123456789abcdefABCDEF" for c in span),
        alone and len(span) >= 20 and n > 2 and letters,
        *(label in x for x in LABELS),
        before[-1:].isalnum() or before[-1:] in ("_", "@"),
        after[:1].isalnum() or after[:1] in ("_", "@"),
        not (span[-1].isalnum()),
        not (span[0].isalnum() or span[0] in "+("),
        atoms > 10,
        n == len(span),
        any(map(str.isspace, span)),
        n < 5,
        letters,
        bool(re.search(r"\.$", before)) or bool(re.match(r"\.[0-9]", after)),
    ]


WIDTH = len(features("x", "", "", 1))


class Island:
    """Atoms of a stretch of text with all segments that may be entities: those whose ends are no white space."""

    def __init__(self, text: str, start: int, end: int):
        self.ends = [m.end() for m in ATOM.finditer(text, start, end)]
        self.starts = [start, *self.ends[:-1]]
        self.n = len(self.ends)
        blank = [text[a].isspace() for a in self.starts]
        self.segments = []
        for i in range(self.n):
            if blank[i]:
                continue
            for j in range(i, min(self.n, i + MOST)):
                # a segment without a digit or an at-sign is never an entity
                if not blank[j] and TRIGGER.search(text, self.starts[i], self.ends[j]):
                    self.segments.append((i, j + 1))
        rows = [features(text[self.starts[i] : self.ends[j - 1]], text[max(0, self.starts[i] - 24) : self.starts[i]], text[self.ends[j - 1] : self.ends[j - 1] + 2], j - i) for i, j in self.segments]
        self.x = np.array(rows, float).reshape(-1, WIDTH)

    def best(self, weights: np.ndarray) -> list[tuple[int, int, str]]:
        """The segmentation of highest score; atoms outside of entities score 0."""
        score = self.x @ weights.T
        kind = score.argmax(1) if len(score) else np.empty(0, int)
        top = score.max(1, initial=-np.inf) if len(score) else score
        by_end: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            if top[k] > 0:
                by_end[j].append(k)
        total, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            total[j] = total[j - 1]
            for k in by_end[j]:
                if (s := total[self.segments[k][0]] + top[k]) > total[j]:
                    total[j], back[j] = s, k
        out, j = [], self.n
        while j > 0:
            if (k := back[j]) < 0:
                j -= 1
            else:
                i = self.segments[k][0]
                out.append((self.starts[i], self.ends[j - 1], KINDS[kind[k]]))
                j = i
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log likelihood of the gold segmentation (segments as atoms and kind), by the forward-backward sums."""
        score = self.x @ weights.T
        ahead, behind = np.full(self.n + 1, -np.inf), np.full(self.n + 1, -np.inf)
        ahead[0] = behind[self.n] = 0
        whole = np.logaddexp.reduce(score, axis=1) if len(score) else np.empty(0)
        ends: list[list[int]] = [[] for _ in range(self.n + 1)]
        starts: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (i, j) in enumerate(self.segments):
            ends[j].append(k)
            starts[i].append(k)
        for j in range(1, self.n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[self.segments[k][0]] + whole[k] for k in ends[j])])
        for i in range(self.n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[self.segments[k][1]] + whole[k] for k in starts[i])])
        if not len(score):
            return np.zeros_like(weights)
        i, j = np.array(self.segments).T
        p = -np.exp(ahead[i][:, None] + score + behind[j][:, None] - ahead[self.n])
        for k, (a, b) in enumerate(self.segments):
            for kind in range(len(KINDS)):
                if (a, b, kind) in gold:
                    p[k, kind] += 1
        return p.T @ self.x


def generated(count: int, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with known entities among words, numbers, dates, versions, prices and near misses."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        d = num(rng.choice([13, 14, 15, 15, 15, 18]))
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if rng.random() < 0.6 else rng.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} {a} {b} {c}"])

    make = {
        "email": lambda: f"{word()}{rng.choice(['', '.', '_', '+'])}{rng.choice([word(), num(2)])}@{word()}{rng.choice(['', num(1)])}.{rng.choice(['com', 'example.com', 'org', 'co.uk'])}",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": phone,
        "ssn": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "secret": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))) if rng.random() < 0.7 else num(3) + "".join(rng.choice("0123456789abcdefghijkXYZABC") for _ in range(rng.randint(20, 40))),
    }
    labels = {"email": ["mail:", "contact"], "ip": ["from", "host"], "card": ["card", "visa:"], "phone": ["phone", "tel:", "call"], "ssn": ["SSN", "social security"], "secret": ["token =", "api_key:", "secret"]}
    noise = [lambda: f"{rng.randint(1, 12)}.{rng.randint(0, 20)}", lambda: str(rng.randint(1900, 2030)), lambda: num(rng.randint(1, 9)), lambda: num(16), lambda: f"{rng.randint(2, 9)}.0.", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: f"20{num(2)}-{num(2)}-{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{word()}@{word()}", lambda: f"{num(3)}.{num(3)}.{num(3)}.{rng.randint(300, 999)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{word()}{num(2)}", lambda: f"{num(3)},{num(3)}", lambda: f"{num(22)}"]
    for _ in range(count):
        text, gold = "", []
        for _ in range(rng.randint(3, 7)):
            text += rng.choice([" ", " ", " ", ", "]) if text else ""
            r = rng.random()
            if r < 0.35:
                kind = rng.choice(KINDS)
                if rng.random() < 0.5:
                    text += rng.choice(labels[kind]) + " "
                quote = '"' if rng.random() < 0.2 else ""
                text += quote
                value = make[kind]()
                gold.append((len(text), len(text) + len(value), kind))
                text += value + quote + rng.choice(["", "", ".", ",", "!!", "###"])
            else:
                text += word() if r < 0.65 else rng.choice(noise)()
                while re.fullmatch(r"[0-9]{14,19}", text.rpartition(" ")[2]) and luhn(text.rpartition(" ")[2]):
                    text = text[:-1] + num(1)
        yield text, gold


@lru_cache(1)
def trained(count: int = 500, rounds: int = 6) -> np.ndarray:
    """Weights (kinds, features); the same each time."""
    cases = []
    for text, gold in generated(count):
        island = Island(text, 0, len(text))
        at = {s: i for i, s in enumerate(island.starts)}
        end = {e: i + 1 for i, e in enumerate(island.ends)}
        cases.append((island, {(at[a], end[b], KINDS.index(k)) for a, b, k in gold if a in at and b in end}))
    weights, square = np.zeros((len(KINDS), WIDTH)), np.full((len(KINDS), WIDTH), 1e-3)
    for _ in range(rounds):
        for island, gold in cases:
            g = island.gradient(weights, gold) - 2e-4 * weights
            square += g * g
            weights += 0.4 * g / np.sqrt(square)
    return weights


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words that hold a digit or an at-sign, with one word more on the left for its label."""
    if not TRIGGER.search(text):
        return
    begin = end = -1
    for m in WORD.finditer(text):
        if TRIGGER.search(m[0]):
            if begin >= 0 and m.start() - end <= 2:
                end = m.end()
                continue
            if begin >= 0:
                yield begin, end
            begin, end = m.start(), m.end()
    yield begin, end


def added(text: str, base: list[tuple[int, int, str]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """The model's spans that touch no base span."""
    out: list[tuple[int, int, str]] = []
    for start, end in islands(text):
        at = start
        while at < end:
            # an island of very many atoms is taken in pieces that overlap by an entity's length
            cut, places = end, []
            for m in ATOM.finditer(text, at, end):
                places.append(m.end())
                if len(places) > ISLAND:
                    cut = places[-1]
                    break
            found = Island(text, at, cut).best(weights)
            if cut < end:
                back = places[-1 - MOST]
                found = [s for s in found if s[1] <= back]
                at = max(back, found[-1][1] if found else back)
            else:
                at = end
            out += found
    if not base:
        return out
    begins = np.array([s[0] for s in base])
    reach = np.maximum.accumulate([s[1] for s in base])
    return [s for s in out if (k := int(np.searchsorted(begins, s[1]))) == 0 or reach[k - 1] <= s[0]]


def spans_of(text: str | None, weights: np.ndarray) -> list[tuple[str, int, int, bool]]:
    text = text or ""
    base = base_spans(text)
    both = [(a, b, k, True) for a, b, k in base] + [(a, b, k, False) for a, b, k in added(text, base, weights)]
    return [(k, a, b, x) for a, b, k, x in sorted(both, key=lambda s: (s[0], KINDS.index(s[2])))]


def find(docs: DataFrame) -> DataFrame:
    """Adds to docs (with a column text) spans: array<struct<kind, start, end, base>>, ends exclusive, in code points, by
    start, then kind in the order of KINDS; base tells the fixed patterns from what the model adds.

    A null or empty text has none. Base spans of different kinds may overlap; spans of the model overlap nothing. A column
    named spans is replaced; repeated rows get equal spans; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("array<struct<kind:string, start:int, end:int, base:boolean>>")
    def detect(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans_of(x, model.value)] for x in texts], dtype=object)

    return docs.withColumn("spans", detect("text"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; of overlapping spans the first, then the longer one
    counts, and what is left of the others goes with it. Null texts stay null; columns stay as they are."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in column:
            yield pd.Series([None if x is None else blanked(x, spans_of(x, model.value)) for x in texts], dtype=object)

    return docs.withColumn("text", clean("text"))


def blanked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
