"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint emits every variant within half the radius. Two fingerprints within the radius share a variant, and two
that share a variant are within the radius. Variants are shuffled by their leading bits, and a fingerprint travels only
once to each group of variants that it reaches; the group's worker expands the variants there. So the shuffle holds some
dozens of rows for a fingerprint instead of thousands, and each variant still meets all its owners in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.llm.common import components, durable, small_batches, trim

#: Variants that a worker holds at once, and those that a group should have on average.
CHUNK = 1_000_000


def shingle_hashes(text: str | None, words: int, seeds: tuple[int, ...] = (42,)) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased (A-Z) text, a row for each seed."""
    joined = b" ".join((text or "").encode("utf-8", "replace").lower().split())
    if not joined:
        return np.empty((len(seeds), 0), np.uint64)
    white = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(white + 1).tolist()], [*white.tolist(), len(joined)]
    slices = [joined] if len(starts) < words else [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)]
    h = xxhash.xxh64_intdigest
    return np.array([[h(x, s) for x in slices] for s in seeds], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint, as a signed integer: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 4, blocks: int = 1) -> DataFrame:
    """(doc_id, fp array of `blocks` longs): block i uses seed 42 + i."""
    seeds = tuple(range(42, 42 + blocks))
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<bigint>")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[majority(h) for h in shingle_hashes(x, words, seeds)] for x in batch])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint("text").alias("fp"))


def masks(bits: int, most: int, low: int = 0) -> np.ndarray:
    """All words with at most `most` of the bits low..bits-1 set."""
    return np.array([sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(low, bits), k)], np.uint64)


def forest(values: np.ndarray, lead: int, prefix: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link all of the values which share a variant under this prefix of `lead` bits.

    A run of equal variants gives a star round its first value: all its members are within the radius of each other.
    """
    rest = bits - lead
    far = np.bitwise_count((values >> np.uint64(rest)) ^ np.uint64(prefix)).astype(np.int64)
    part = (np.uint64(prefix) << np.uint64(rest)) if lead else np.uint64(0)
    tail = values & np.uint64((1 << rest) - 1)
    flips = [masks(rest, half - d) for d in range(half + 1)]
    sets = [np.flatnonzero(far == d) for d in range(half + 1)]
    total = sum(len(i) * len(m) for i, m in zip(sets, flips, strict=True))
    passes = max(1, -(-total // CHUNK))
    label = np.arange(len(values))
    for k in range(passes):
        found: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        for i, m in zip(sets, flips, strict=True):
            rows = max(1, CHUNK // len(m))
            for at in range(0, len(i), rows):
                own = i[at : at + rows]
                v = (tail[own][:, None] ^ m[None, :]).ravel()
                o = np.repeat(own, len(m))
                if passes > 1:
                    keep = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(passes) == k
                    v, o = v[keep], o[keep]
                found.append(v)
                owner.append(o)
        v, o = np.concatenate(found), np.concatenate(owner)
        s = np.sort(v)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if not len(twice):
            continue
        sieve = np.zeros(1 << 20, bool)
        spread = lambda x: ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64)
        sieve[spread(twice)] = True
        near = sieve[spread(v)]
        v, o = v[near], o[near]
        at = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
        hit = twice[at] == v
        at, o = at[hit], o[hit]
        first = np.full(len(twice), len(values))
        np.minimum.at(first, at, o)
        link = np.unique(np.stack([first[at], o]), axis=1)
        a, b = link[:, link[0] != link[1]]
        if len(a):
            assert (np.bitwise_count(values[a] ^ values[b]) <= 2 * half).all()
            label = joined(label, a, b)
    other = np.flatnonzero(label != np.arange(len(label)))
    return label[other], other


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each the smallest index of its class) after linking a with b."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, up := new[new]):
            new = up
        if np.array_equal(new[a], new[b]):
            return new
        label = new


def ball_links(values: DataFrame, count: int, bits: int = 64, radius: int = 4) -> DataFrame:
    """Links (a, b) between values (v: long holding `bits` bits) whose closure is that of all pairs within the radius.

    Values of the same leading bits travel as one row, about CHUNK / 2 / variants of them, to each group that their
    variants reach, so that a value costs eight bytes a group and no row of its own.
    """
    half = radius // 2
    variants = len(masks(bits, half))
    lead = min(bits - 1, max(4, int(np.ceil(np.log2(max(1, count * variants / (CHUNK / 2)))))))
    flips = [int(x) for x in masks(lead, half)]
    prefix = F.shiftrightunsigned("v", bits - lead) if bits == 64 else F.shiftright("v", bits - lead)
    together = values.groupBy(prefix.alias("lead")).agg(F.collect_list("v").alias("v"))
    routed = together.select("v", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: m.cast("long").bitwiseXOR(F.col("lead")))).alias("part"))

    def links(key, group: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(np.concatenate(group["v"].tolist()).view(np.uint64))
        a, b = forest(own, lead, int(key[0]), bits, half)
        return pd.DataFrame({"a": own[a].view(np.int64), "b": own[b].view(np.int64)})

    return routed.groupBy("part").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Null and empty texts, and texts of white space only, have fingerprint zero and link like any other. Rows with the
    same doc_id stay apart rows of one id. A null doc_id stays null; its row links, but names no component unless the
    component has nothing else (then null). Other columns of docs are ignored. An empty table gives an empty table.
    """
    own = durable(fingerprints(docs, words).select("doc_id", F.element_at("fp", 1).alias("v")))
    nodes = durable(own.groupBy("v").agg(F.min("doc_id").alias("least")))
    roots = components(ball_links(nodes.select("v"), nodes.count(), 64, radius))
    linked = nodes.join(roots, nodes["v"] == roots["node"]).select("v", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("best")).withColumnRenamed("root", "top")
    named = linked.join(best, linked["root"] == best["top"]).select(F.col("v").alias("w"), "best")
    named = durable(nodes.join(named, nodes["v"] == named["w"], "left").select(F.col("v").alias("w"), F.coalesce("best", "least").alias("component_id")))
    return own.join(named, own["v"] == named["w"]).select("doc_id", F.lower(F.lpad(F.hex("v"), 16, "0")).alias("fingerprint"), "component_id")



#: Of similar(): keys of a text and minima that make one; blocks of 64 bits of the prefilter, standard deviations that it
#: leaves as margin, shingles from which on it is used; rounds of stars at most; nodes of a key that are compared with each
#: other as they are, and nodes of a row's key, on average, up to which no round of stars comes first.
KEYS, MINIMA, BLOCKS, MARGIN, MANY, STARS, SPLIT, CHEAP = 24, 4, 12, 6, 64, 3, 16, 8
_rng = np.random.default_rng(42)
_XOR, _ODD = (_rng.integers(0, 1 << 64, (KEYS * MINIMA, 1), np.uint64) for _ in range(2))
_ODD = _ODD | np.uint64(1)
_MIX = _rng.integers(0, 1 << 64, (1, MINIMA), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words)[0])


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """BLOCKS fingerprints of 64 bits from as many mixtures of the hashes of a set."""
    out = []
    for k in range(BLOCKS):
        x = h ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def meeting_keys(h: np.ndarray) -> list[int]:
    """KEYS keys of a set, each of MINIMA minima of its hashes: two sets share one with the power MINIMA of their similarity.
    At 0.8 a pair shares none of 24 with a probability of 3e-6. An empty set has none."""
    if not len(h):
        return []
    least = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(least, ((h[None, i : i + 512] ^ _XOR) * _ODD).min(1), out=least)
    x = (least.reshape(KEYS, MINIMA) * _MIX).sum(1, dtype=np.uint64) + np.arange(KEYS, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64).tolist()


def far_at(similarity: float) -> int:
    """Differing bits, of all blocks, that two sets of this similarity stay under but for MARGIN standard deviations."""
    bits, p = 64 * BLOCKS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * p + MARGIN * np.sqrt(bits * p * (1 - p)))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted) have this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose sets of shingles have the similarity. The bits only spare pairs the texts."""
    one, two = (texts.select(F.col("node").alias(f"n{i}"), F.col("wide").alias(f"fp{i}"), F.col("size").alias(f"s{i}")) for i in (1, 2))
    held = pairs.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2"))
    apart = F.aggregate(F.zip_with("fp1", "fp2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    least, most = F.least("s1", "s2"), F.greatest("s1", "s2")
    held = held.where(least >= most * similarity - 1e-9).select("a", "b", apart.alias("apart"), least.alias("least"))
    held = held.where((F.col("least") < MANY) | (F.col("apart") <= far_at(similarity)))
    held = durable(held.select("a", "b"))
    one, two = (texts.select(F.col("node").alias(f"n{i}"), F.col("text").alias(f"t{i}")) for i in (1, 2))

    @F.pandas_udf("boolean")
    def same(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([alike(shingle_set(s, words), shingle_set(t, words), similarity) for s, t in zip(x, y, strict=True)], dtype=bool)
        trim()

    return durable(held.join(one, F.col("a") == F.col("n1")).join(two, F.col("b") == F.col("n2")).where(same("t1", "t2")).select("a", "b"))


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that the ball hashing of their 64-bit fingerprints links: a forest over each class."""
    prints = durable(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.max("node").alias("most")))
    equal = nodes.join(prints.where("least < most").select(F.col("fp").alias("f"), "least"), F.col("fp") == F.col("f")).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = ball_links(prints.select(F.col("fp").alias("v")), prints.count())
    one, two = (prints.select(F.col("fp").alias(f"f{i}"), F.col("least").alias(f"n{i}")) for i in (1, 2))
    near = links.join(one, F.col("a") == F.col("f1")).join(two, F.col("b") == F.col("f2")).select(F.col("n1").alias("a"), F.col("n2").alias("b"))
    return durable(equal.unionByName(near))


def linked(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, row, twin, rows, component_id) of docs (doc_id, text, row, twin), one row for each row and twin (two hashes
    that tell rows apart), with the number of rows that have them; see similar()."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("struct<node:bigint, size:int, fp:bigint, keys:array<bigint>>")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(x, words) for x in batch]
            yield pd.DataFrame({
                "node": np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64),
                "size": pd.Series([len(h) for h in sets], dtype="int32"),
                "fp": pd.Series([majority(h) for h in sets], dtype="int64"),
                "keys": pd.Series([meeting_keys(h) for h in sets], dtype=object),
            })
        trim()

    @F.pandas_udf("array<bigint>")
    def wide(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([wide_fingerprint(shingle_set(x, words)) for x in batch], dtype=object)
        trim()

    own = durable(docs.withColumn("k", known("text")).select("doc_id", "row", "twin", "k.*"))
    nodes = durable(own.groupBy("node").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct("row", "twin")).alias("of")))
    ball = ball_pairs(nodes)
    # dealt out by key once, for both the counting and the join
    keyed = nodes.select("node", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    keyed = durable(keyed.join(shared, F.col("key") == F.col("k")).select("key", "node"))
    met = keyed.select("node").unionByName(ball.select(F.col("a").alias("node"))).unionByName(ball.select(F.col("b").alias("node"))).distinct()
    used = durable(nodes.join(met.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left_semi").select("node", "size", "of.row", "of.twin"))
    # the small side is hashed, so that texts need no sort
    texts = docs.select("text", F.col("row").alias("r"), F.col("twin").alias("t")).join(used.hint("shuffle_hash"), (F.col("row") == F.col("r")) & (F.col("twin") == F.col("t")))
    texts = durable(texts.groupBy("node").agg(F.first("size").alias("size"), F.min("text").alias("text")).withColumn("wide", wide("text")))

    links = verified(ball, texts, words, similarity)
    roots, whole = components(links), False
    for turn in range(STARS + 1):
        # rows of the keys that still join different components
        at = keyed.join(roots.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        ends = at.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
        at = durable(at.join(ends, F.col("key") == F.col("k")).select("key", "node", "root", "n"))
        pairs, rows = at.agg(F.sum("n"), F.count("*")).first()
        if not rows:
            break
        whole = whole or turn == STARS or pairs <= CHEAP * rows
        if whole:
            long = at.where(F.col("n") > SPLIT).select("node", "root").distinct()
            pairs = rivals(at.where(F.col("n") <= SPLIT).select("key", "node", "root"))
            if long.head(1):
                pairs = pairs.unionByName(rivals(rare(long, texts, words, similarity), similarity)).distinct()
        else:
            pairs = stars(at)
        new = verified(pairs, texts, words, similarity)
        gained = new.count()
        if gained:
            links = links.unionByName(new)
            roots = components(links)
        if whole:
            break
        whole = gained < rows / 10  # what is left shares passages rather than texts
    found = own.groupBy("doc_id", "row", "twin", "node").agg(F.count("*").alias("rows"))
    found = found.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    return found.select("doc_id", "row", "twin", "rows", F.coalesce("root", "node").alias("component_id"))


def stars(at: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the hubs of its keys in other components, two hubs at most. The hub of a key is the
    node whose keys are shared most: in a family of copies that is the text which they all come from."""
    weight = at.groupBy(F.col("node").alias("w")).agg(F.sum("n").alias("weight"))
    own = at.join(weight, F.col("node") == F.col("w")).select("key", "node", "root", "weight")
    hubs = own.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("weight", "node", "root")).alias("hub"))
    met = own.join(hubs, F.col("key") == F.col("k")).where("root <> hub.root").groupBy("hub.node", own["node"].alias("b")).agg(F.count("*").alias("n"), F.first("hub.weight").alias("weight"))
    met = met.groupBy("b").agg(F.max_by("node", F.struct("n", "node")).alias("near"), F.max_by("node", F.struct("weight", "node")).alias("great"))
    return met.select(F.explode(F.array_distinct(F.array("near", "great"))).alias("a"), "b")


def rare(nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, node, root, size, at): of each of the nodes (node, root) the rarest shingles among these nodes with their
    places in that order, so many that two sets of the similarity share one for certain; shingles that only one node has
    are counted but not listed. A passage that many texts share is common, so texts which have little else in common
    don't meet."""

    @F.pandas_udf("array<bigint>")
    def shingles(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in column:
            yield pd.Series([shingle_set(x, words).view(np.int64) for x in batch], dtype=object)
        trim()

    own = texts.select(F.col("node").alias("o"), "size", "text").join(nodes, F.col("node") == F.col("o"))
    each = durable(own.select("node", shingles("text").alias("keys"))).select("node", F.explode("keys").alias("key"))
    common = each.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    listed = each.join(common, F.col("key") == F.col("k")).groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("l"))
    listed = listed.join(own.select("node", "root", "size"), F.col("of") == F.col("node"))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1
    alone = F.col("size") - F.size("l")
    most = F.greatest(F.lit(0), first - alone).cast("int")
    keyed = listed.select("node", "root", "size", alone.alias("alone"), F.posexplode(F.slice("l", F.lit(1), most)).alias("i", "x")).select("x.key", "node", "root", "size", (F.col("alone") + F.col("i") + 1).alias("at"))
    ends = keyed.groupBy(F.col("key").alias("k")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("k")
    return durable(keyed.join(ends, F.col("key") == F.col("k")).select("key", "node", "root", "size", "at"))


def rivals(at: DataFrame, similarity: float | None = None) -> DataFrame:
    """Pairs (a, b) of nodes of a key that lie in different components. With a similarity, at is of rare(), and a pair is
    left out where even all that comes after the shared shingle would not make the sets alike: that holds for each shingle
    of an alike pair that is its first in both orders."""
    own = at if similarity is not None else at.withColumns({"size": F.lit(1), "at": F.lit(1)})
    other = own.select(F.col("key").alias("k"), F.col("node").alias("a"), F.col("root").alias("r"), F.col("size").alias("s"), F.col("at").alias("p"))
    fits = F.lit(True)
    if similarity is not None:
        common = similarity / (1 + similarity) * (F.col("size") + F.col("s")) - 1e-9
        fits = F.least(F.col("size") - F.col("at"), F.col("s") - F.col("p")) + 1 >= common
    return own.join(other, (F.col("key") == F.col("k")) & (F.col("r") < F.col("root")) & fits).select("a", F.col("node").alias("b")).distinct()


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component_id), one row for each id and text: texts whose sets of shingles of `words` words have
    this Jaccard similarity or more are linked. No pair is linked that has less.

    Equal sets are one node. First ball hashing links nodes whose 64-bit fingerprints differ in four bits or fewer; the
    forest that it gives is verified on the sets themselves. At this similarity a fingerprint differs in about ten bits,
    out of reach of any ball that can be emitted, so nodes meet by keys of minima too (see meeting_keys). What meets passes
    a loose filter of 64 * BLOCKS SimHash bits before the sets are compared. Where keys hold many pairs, rounds of stars
    (see stars()) link most near copies before. At the end the pairs of a key of up to SPLIT nodes that are not yet in one
    component are compared; nodes of longer keys meet by their rarest shingles instead, which loses no pair (see rare()). Null and empty texts are alike. A
    component is named by one of its nodes, whatever the ids are. An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"), F.lit(0).cast("long").alias("twin"))
    return linked(rows, words, similarity).select("doc_id", F.col("row").alias("text_hash"), "component_id")


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar(), that of the smallest doc_id; among rows of that id the one of least
    hash. Rows whose ids are null or repeated are told apart by all of their columns: they form groups like others, and
    one with a null id stays only if its group has no id. Of rows alike in all columns one stays."""
    every = [F.col(c) for c in docs.columns]
    own = docs.select(F.struct(*every).alias("whole"), F.xxhash64(*every).alias("row"), F.xxhash64(F.lit(7), *every).alias("twin"))
    rows = own.select(F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").alias("text"), "row", "twin")
    found = linked(rows, words, similarity)
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "twin", "rows")).alias("best"))
    best = durable(best.select(F.col("best.row").alias("r"), F.col("best.twin").alias("t"), F.col("best.rows").alias("rows")))
    joined = own.join(best.hint("shuffle_hash"), (F.col("row") == F.col("r")) & (F.col("twin") == F.col("t")))
    kept = joined.where("rows = 1").select("whole")
    if best.where("rows > 1").head(1):
        kept = kept.unionByName(joined.where("rows > 1").groupBy("row", "twin").agg(F.first("whole").alias("whole")).select("whole"))
    return kept.select(*[F.col(f"whole.{c}").alias(c) for c in docs.columns])
