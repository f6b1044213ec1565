"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Every shingle is hashed once; the top bits of the hash name a bin, and the least hash of each bin is kept. An empty bin
copies a full one, taken by its own fixed random order of the bins (optimal densification), so that two texts which share
their full bins copy alike. Of each bin only the low bits are stored; likeness counts equal bins, less those that b bits
let agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import WHITE, durable, let, repeated

#: log2 of the bins; low bits stored of each, one hexadecimal digit; words of a shingle.
LOG2, BITS, WORDS = 7, 4, 5
BINS = 1 << LOG2
#: Closes the order of a bin.
END = "\u00ff"
#: (full bins at least, bins of an order that are tried first): the shorter, the cheaper; all are tried where these fail.
TRIES = ((90, 9), (40, 25))
#: Rows of a range of ids, about; ranges at most (beyond, ranges grow).
BUCKET, RANGES = 500, 16384


def orders(tries: int) -> str:
    """For each bin itself and then the first of a random order of the others, fixed by the seed, `tries` in all: bin j as
    character j, each bin's order closed by END."""
    rng, out = random.Random(7), []
    for i in range(BINS):
        others = rng.sample([j for j in range(BINS) if j != i], BINS - 1)
        out.append("".join(map(chr, [i, *others][:tries])) + END)
    return "".join(out)


def fingerprint(text: Column) -> Column:
    """BINS hexadecimal digits. Words are lower-cased; a text of fewer than WORDS words is one shingle; a text without
    words has a fingerprint of BINS blanks, which is like another of its kind only."""
    words = F.filter(F.split(F.lower(text), WHITE), lambda w: w != "")

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(h) - (WORDS - 1), F.lit(1)))
        some = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(WORDS)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < WORDS, F.array(F.xxhash64(h))).otherwise(some)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - LOG2).cast("int")

    # hashes are sorted as signed numbers, which keeps those of one bin together
    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))

    def digit(x: Column) -> Column:
        return x.bitwiseAND((1 << BITS) - 1)

    def packed(full: Column) -> Column:
        """Of all orders, empty bins are struck out and full ones turned into digits, by one translation; the first digit
        left of each bin is its own or the one it borrows."""
        bins = F.transform(full, bin_of)
        empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), bins)
        marks = F.array_join(F.transform(F.concat(bins, empty), lambda i: F.char(i)), "")
        digits = F.array_join(F.transform(full, lambda x: F.substring(F.lit("0123456789abcdef"), digit(x).cast("int") + 1, F.lit(1))), "")

        def translated(both: Column) -> Column:
            def result(tries: int) -> Column:
                left = F.call_function("translate", F.lit(orders(tries)), both["marks"], both["digits"])
                return F.regexp_replace(left, f"([0-9a-f])[0-9a-f]*{END}", "$1")

            quick = F.lit("")
            for least_full, tries in reversed(TRIES):
                quick = F.when(F.length(both["digits"]) >= least_full, result(tries)).otherwise(quick)
            return let(quick, lambda q: F.when((F.length(q) == BINS) & ~F.contains(q, F.lit(END)), q).otherwise(result(BINS)))

        return let(F.struct(marks.alias("marks"), digits.alias("digits")), translated)

    full = let(let(F.transform(words, lambda w: F.xxhash64(w)), shingles), lambda s: let(F.sort_array(s), least))
    return let(full, lambda f: F.when(F.size(f) == 0, F.lit(" " * BINS)).otherwise(packed(f)))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles, 0 to 1: equal digits, corrected for chance agreement of BITS bits."""
    chance = 2.0**-BITS
    share = (equal_digits(a, b).cast("double") / BINS - chance) / (1 - chance)
    empty = F.lit(" " * BINS)
    return F.when((a == empty) | (b == empty), (a == b).cast("double")).otherwise(F.greatest(F.lit(0.0), share))


def equal_digits(a: Column, b: Column) -> Column:
    """Number of places where two fingerprints have the same digit: 16 digits at a time as longs, whose XOR is folded so
    that one bit is left of each differing digit."""
    total = F.lit(BINS)
    for at in range(1, BINS + 1, 8):
        x = F.conv(F.substring(a, at, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, at, 8), 16, 10).cast("long"))
        y = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        total = total - F.bit_count(y.bitwiseAND(F.lit(0x11111111)))
    return total


def ranges(groups: DataFrame) -> tuple[Column, Column]:
    """(range, part) of the columns doc_id and h (a hash of the text): ranges fall with doc_id, null ids last, about BUCKET
    groups each; an id that many groups have is cut into parts by the hash, each as large as a range."""
    count, without = groups.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    parts = max(1, min(RANGES, count // BUCKET))
    size = max(1, count // parts)
    found = groups.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("c")).first()["c"] or [0]
    cuts = sorted(set(found))
    inner = max(1, round(len(cuts) ** 0.5))
    heads = cuts[::inner]
    array = lambda xs: "array(" + ",".join(f"{x}L" if x > -(2**63) else f"CAST({x} AS BIGINT)" for x in xs) + ")"
    table = F.expr("array(" + ",".join(array(cuts[i : i + inner]) for i in range(0, len(cuts), inner)) + ")")

    def place(i: Column) -> Column:
        return i * inner + F.when(i == 0, 0).otherwise(F.size(F.filter(F.get(table, i - 1), lambda x: x <= F.col("doc_id"))))

    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(let(F.size(F.filter(F.expr(array(heads)), lambda x: x <= F.col("doc_id"))), place))
    many = {c: found.count(c) for c in cuts if found.count(c) > 1}
    wide = F.when(F.col("doc_id").isNull(), F.lit(max(1, without // size)))
    if many:
        wide = wide.otherwise(F.element_at(F.map_from_arrays(F.expr(array(many)), F.expr(array(many.values()))), F.col("doc_id")))
    part = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * wide)
    return bucket.cast("int"), F.coalesce(part + 1, F.lit(0)).cast("long")


def edited(text: Column, following: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def judged(own: DataFrame, following: str) -> DataFrame:
    """own with the edited text's hash and fingerprint, null where `following` is."""
    changed = edited(F.col("text"), F.col(following))
    return own.withColumn("edited", changed).withColumns({"edited_sha256": F.sha2(F.col("edited").cast("binary"), 256), "edited_fingerprint": fingerprint(F.col("edited"))}).drop("edited")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fingerprint string; a null text counts as empty. Other columns stay as they are."""
    return docs.withColumn("fingerprint", fingerprint(F.coalesce("text", F.lit(""))))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next text (all of it if
    it is shorter). Next is the row after this by descending doc_id, null ids last, rows of one id in order of two hashes
    of the text; after the last comes the first; a single row is its own next. Null texts are empty. Other columns are
    ignored; an empty table gives an empty table.

    Rows are dealt out into ranges of this order once, with their fingerprints, and look ahead inside them. The last row of
    each range then meets the first of the next one, in a join of at most one row a range. A text that one id has more
    often than a range has rows is ordered once: all but one of its rows have it as their next.
    """
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(5), "text")})
    groups = durable(rows.groupBy("doc_id", "h", "g").agg(F.count("*").alias("n")))
    bucket, part = ranges(groups)
    rows = fingerprints(rows)
    total = groups.agg(F.sum("n")).first()[0] or 0
    often = groups.where(F.col("n") > max(BUCKET, total // RANGES))
    hot = bool(often.head(1))
    if hot:  # at most RANGES groups have so many rows each: a table of that bound may be sent out
        far = F.broadcast(often.select(F.col("doc_id").alias("i"), F.col("h").alias("i1"), F.col("g").alias("i2"), "n"))
        flagged = rows.join(far, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("i1")) & (F.col("g") == F.col("i2")), "left").drop("i", "i1", "i2")
        one = flagged.where("n is not null").groupBy("doc_id", "h", "g").agg(F.first("text").alias("text"), F.first("fingerprint").alias("fingerprint"), F.first("n").alias("n"))
        rows = flagged.where("n is null").unionByName(one)
    rows = rows.withColumns({"bucket": bucket, "part": part})
    over = Window.partitionBy("bucket", "part").orderBy(F.desc_nulls_last("doc_id"), "h", "g")
    rows = rows.withColumns({"following": F.lead("text").over(over), "next_fingerprint": F.lead("fingerprint").over(over), "place": F.row_number().over(over)})
    rows = judged(rows.withColumn("n_chars", F.length("text").cast("long")), "following")
    end = F.col("following").isNull()
    kept = [*out, "bucket", "part", "h", "g", (F.col("place") == 1).alias("first"), end.alias("last"), F.when((F.col("place") == 1) | end, F.col("text")).alias("text")]
    if hot:
        own = judged(rows.where("n is not null").drop("edited_sha256", "edited_fingerprint").withColumn("again", F.col("text")), "again").withColumn("next_fingerprint", F.col("fingerprint"))
        copies = durable(own.select(*out, (F.col("n") - 1).alias("n"), "h", "g"))
        copies = repeated(copies, "n", "k", ["h", "g"]).select(*out)
    rows = durable(rows.select(*kept))
    # ids of ranges only, one row each
    ring = Window.orderBy(F.desc("bucket"), "part")
    begin = F.first(F.struct("bucket", "part")).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = rows.where("first").select("bucket", "part").withColumn("to", F.coalesce(F.lead(F.struct("bucket", "part")).over(ring), begin))
    heads = rows.where("first").select(F.col("bucket").alias("b"), F.col("part").alias("p"), F.col("text").alias("following"), F.col("fingerprint").alias("f"))
    links = after.select(F.col("bucket").alias("b0"), F.col("part").alias("p0"), F.col("to.bucket").alias("b1"), F.col("to.part").alias("p1"))
    ends = rows.where("last").drop("edited_sha256", "edited_fingerprint").join(links, (F.col("bucket") == F.col("b0")) & (F.col("part") == F.col("p0"))).join(heads, (F.col("b1") == F.col("b")) & (F.col("p1") == F.col("p")))
    ends = judged(ends.withColumn("next_fingerprint", F.col("f")), "following")
    every = rows.where("not last").select(*out).unionByName(ends.select(*out))
    if hot:
        every = every.unionByName(copies)
    near = lambda c: likeness(F.col("fingerprint"), F.col(c))
    return every.select(*out[:5], near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
