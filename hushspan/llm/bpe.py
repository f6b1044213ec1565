"""Byte-level BPE encoding and decoding.

Boundaries of the pre-tokens come from a finite automaton over classes of code points, run for a whole batch of texts at
once: every class is a transition function, the functions form a small finite monoid, and composition is one table
lookup. The batch is cut into equal blocks; composed functions are scanned inside all blocks together, then across
blocks (an associative scan), and applied to the start state. No regular expression takes part.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import small_batches, trim

# Classes. An apostrophe that opens a contraction is told by the number of letters that follow; white space by whether
# the next character is white space (or the text's end) too.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, INNER, LAST_BLANK, LAST_SPACE, BREAK = range(9)
# States: what the token that holds the last character may go on with.
NEW, IN_LETTERS, IN_NUMBERS, IN_OTHERS, BLANK, IN_SPACE, LEFT1, LEFT2 = range(8)
#: Code points with the White_Space property.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces remembered by a worker, in all.
CACHE = 150_000
#: Longer pieces are merged by a heap and not remembered.
LONG = 64


def step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a token starts with this character."""
    if kind == BREAK:
        return NEW, True
    if state in (LEFT1, LEFT2):
        return (NEW if state == LEFT1 else LEFT1), False
    for what, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        if kind == what:
            return inside, state not in (inside, BLANK)
    if kind in (QUOTE1, QUOTE2):
        if state in (IN_OTHERS, BLANK):
            return IN_OTHERS, False
        return (LEFT1 if kind == QUOTE1 else LEFT2), True
    if kind == INNER:
        return IN_SPACE, state != IN_SPACE
    return (BLANK if kind == LAST_BLANK else NEW), True


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, products, state reached from NEW, start flag by state and class)."""
    base = [tuple(step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = list(dict.fromkeys([tuple(range(8)), *base]))
    known = {e: i for i, e in enumerate(elements)}
    for e in elements:  # grows while it is read, until it is closed
        for b in base:
            if (p := tuple(b[x] for x in e)) not in known:
                known[p] = len(elements)
                elements.append(p)
    product = np.array([[known[tuple(b[x] for x in a)] for b in elements] for a in elements], np.uint16)
    starts = np.array([[step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([known[b] for b in base], np.uint16), product, np.array([e[NEW] for e in elements], np.uint8), starts


def class_table() -> bytes:
    """The class of every code point, without regard to what follows. Letters and numbers are those of the tiktoken
    library's Unicode version, asked of it once on the driver: a one-class pattern drops all that it does not match."""
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000], np.uint32)
    every = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        plain = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        table[np.frombuffer(plain.decode(plain.encode_ordinary(every)).encode("utf-32-le"), np.uint32)] = kind
    table[SPACES] = INNER
    return table.tobytes()


def token_starts(points: np.ndarray, breaks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each code point, whether a pre-token starts there. breaks: places of separators between texts."""
    n = len(points)
    kind = classes[points]
    kind[breaks] = BREAK
    nxt = np.append(kind[1:], BREAK)
    ends = (kind == INNER) & (nxt != INNER) & (nxt != BREAK)
    quote = np.flatnonzero((points == 39) & (kind == OTHER))
    if len(quote):
        padded = np.append(points, [0, 0])
        one, two = padded[quote + 1], padded[quote + 2]
        kind[quote[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pairs = one.astype(np.int64) << 32 | two
        kind[quote[np.isin(pairs, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])]] = QUOTE2
    kind[ends] = np.where(points[ends] == 32, LAST_BLANK, LAST_SPACE)
    element, product, reached, starts = monoid()
    size = len(product)
    flat = product.ravel().astype(np.intp)
    rows = flat * size
    length = max(1, int(n**0.5))
    blocks = -(-n // length)
    f = np.full(blocks * length, element[BREAK], np.uint16)
    f[:n] = element[kind]
    f = f.reshape(blocks, length).T.astype(np.intp, order="C")
    f[0] *= size
    for i in range(1, length):
        np.add(f[i - 1], f[i], out=f[i])
        f[i] = rows[f[i]]
    f //= size
    whole, gap = f[-1].copy(), 1
    while gap < blocks:
        whole[gap:] = flat[whole[:-gap] * size + whole[gap:]]
        gap *= 2
    carry = np.concatenate([[0], whole[:-1]])
    f += carry * size
    after = reached[flat][f].T.ravel()[:n]
    before = np.concatenate([[NEW], after[:-1]])
    return starts[before, kind]


def pieces(texts: list[str], classes: np.ndarray) -> tuple[bytes, list[int], list[int], np.ndarray]:
    """(bytes of all texts, start and end of each pre-token in them, number of pre-tokens of each text)."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    breaks = np.cumsum([len(x) + 1 for x in texts]) - 1
    start = token_starts(points, breaks, classes)
    data = joined.encode()
    places = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    marks = np.flatnonzero(start)
    at = places[marks]
    ends = np.append(at[1:], len(data))
    own = np.ones(len(marks), bool)
    own[np.searchsorted(marks, breaks)] = False
    count = np.diff(np.searchsorted(marks, breaks), prepend=-1) - 1
    return data, at[own].tolist(), ends[own].tolist(), count


class Coder:
    """Merges pieces by a table of ranks, and turns ids into bytes."""

    def __init__(self, ranks: dict[bytes, int], classes: bytes):
        self.ranks = ranks
        self.classes = np.frombuffer(classes, np.uint8)
        self.tokens = {i: t for t, i in ranks.items()}
        self.words = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Joins the adjacent pair of lowest rank, the leftmost first, until no pair has a rank; the packed ids."""
        if (whole := self.words.get(piece)) is not None:
            return whole
        if len(piece) > LONG:
            return self.merge_long(piece)
        get, none = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        order = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while order and (low := min(order)) != none:
            i = order.index(low)
            one = parts[i] = parts[i] + parts.pop(i + 1)
            del order[i]
            if i < len(order):
                order[i] = get(one + parts[i + 1], none)
            if i:
                order[i - 1] = get(parts[i - 1] + one, none)
        return b"".join([self.words[p] for p in parts])

    def merge_long(self, piece: bytes) -> bytes:
        """The same for a long piece: a linked list and a heap instead of repeated search."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if end[i] else n
            if not end[i] or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if left[i] >= 0 and (r := get(piece[left[i] : stop])) is not None:
                heapq.heappush(heap, (r, left[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(self.words[piece[i : end[i]]])
            i = right[i]
        return b"".join(ids)

    def packed(self, piece: bytes) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        if (known := self.cache.get(piece)) is None:
            known = self.merge(piece)
            if len(piece) <= LONG:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = known
        return known

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
        """For each text its packed ids, and for each pre-token its first byte's offset in the text."""
        data, starts, ends, count = pieces(texts, self.classes)
        get, packed = self.cache.get, self.packed
        ids = [get(p) or packed(p) for p in [data[a:b] for a, b in zip(starts, ends, strict=True)]]
        out, at = [], 0
        places = np.array(starts, np.int64)
        base = np.cumsum([0, *(len(x.encode()) + 1 for x in texts)])
        offsets = []
        for i, k in enumerate(count.tolist()):
            out.append(b"".join(ids[at : at + k]))
            offsets.append(places[at : at + k] - base[i])
            at += k
        return out, offsets

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, blank, rank) as bytes; its size is that of one vocabulary."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(4)
def coder(content: bytes, classes: bytes) -> Coder:
    return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}, classes)


def shared(spark, vocabulary: str):
    """The vocabulary and the classes, broadcast: about 2 MB, whatever the input."""
    small_batches(spark)
    return spark.sparkContext.broadcast((read_ranks(vocabulary), class_table()))


def batches(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters; a longer text makes a run of its own."""
    run, size = [], 0
    for x in texts:
        if run and size + len(x) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x)
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Adds to docs (with a column text): ids binary (little-endian unsigned 32-bit integers), offsets binary (likewise,
    the first byte of each pre-token in the text's UTF-8), n_tokens long.

    A null text is encoded as an empty one: no ids. Texts of any length are taken whole. Columns of docs with these
    names are replaced; an empty table stays empty.
    """
    common = shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("struct<ids:binary, offsets:binary, n_tokens:bigint>")
    def coded(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(*common.value)
        for series in column:
            ids, offsets = [], []
            for run in batches(["" if x is None else x for x in series]):
                some, places = own.encode(run)
                ids += some
                offsets += [x.astype("<u4").tobytes() for x in places]
            yield pd.DataFrame({"ids": ids, "offsets": offsets, "n_tokens": [len(x) // 4 for x in ids]})
        trim()

    own = docs.drop("ids", "offsets", "n_tokens").withColumn("_coded", coded("text"))
    return own.select(*[c for c in own.columns if c != "_coded"], "_coded.*")


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Adds to docs (with a column text) n_tokens long, as encode() would, without the ids."""
    common = shared(docs.sparkSession, vocabulary)

    @F.pandas_udf("bigint")
    def counted(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(*common.value)
        for series in column:
            yield pd.Series([len(x) // 4 for run in batches(["" if x is None else x for x in series]) for x in own.encode(run)[0]], dtype="int64")

    return docs.withColumn("n_tokens", counted("text"))


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds to coded (with a column ids binary, as encode() gives it) the column decoded binary. Null ids give null; an
    id that the vocabulary lacks is an error."""
    common = shared(coded.sparkSession, vocabulary)

    @F.pandas_udf("binary")
    def plain(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(*common.value)
        for series in column:
            yield pd.Series([None if x is None else own.decode(x) for x in series], dtype=object)
        trim()

    return coded.withColumn("decoded", plain("ids"))
