"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate, the mean number of its copies. Of all rates that meet every source's token constraint, those
of least relative entropy to one copy each are an exponential tilt, min(2, exp(lambda * size / scale)), with one lambda
for each source; the lambdas maximise a concave dual, by Newton steps over aggregates of the data. Rates are then rounded
into 0, 1 or 2 copies: a document's place in a fixed random order decides, shifted by source until the words taken are
as near to the target as whole documents allow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.llm.common import WORD, durable, repeated

#: Relative error of a source's words at which Newton stops, its steps at most, those of one job, and levels of the search
#: for the shift with the bins of each.
EXACT, STEPS, CHAIN, LEVELS, BINS = 1e-7, 60, 3, 2, 1 << 16
#: Sizes of which documents are added singly to a source, at most, to fill what is left, and documents of each.
FILLS, EACH = 5, 64
CAP = 2.0


def keys(apart: Sequence[str]) -> list[Column]:
    """Two hashes of the columns that tell rows apart."""
    own = [F.col(c) for c in apart]
    return [F.xxhash64(*own).alias("key1"), F.xxhash64(F.lit(11), *own).alias("key2")]


def sizes(docs: DataFrame, apart: Sequence[str]) -> DataFrame:
    """(doc_id, source, size, key1, key2, u): words of each document, and its place in a fixed random order, 0 to 1. Rows
    that are alike in all columns of `apart` are counted before they are shuffled and numbered after, so that each has a
    place of its own."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), *keys(apart))
    same = rows.groupBy("key1", "key2", "doc_id", "source", "size").agg(F.count("*").alias("rows"))
    u = F.pmod(F.xxhash64("key1", "key2", "turn"), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return repeated(same, "rows", "turn", ["key1", "key2"]).select("doc_id", "source", "size", "key1", "key2", u.alias("u"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """sources (source, source_size) with weight and target. One row a source, so windows over all of them are small.

    Sources in order of code points, null last, weigh as given, repeating, and share `share` of all words; none gets
    over twice its own, and what is over is dealt among the others by weight. The sources that reach their limit are the
    first in order of limit by weight: those whose limit is at most the level that the rest would have.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    pick = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    rows = sources.withColumn("weight", pick).withColumn("cap", F.lit(CAP) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    # once a source is not full none after it is: their level is that of the first
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return rows.select("source", "source_size", "weight", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * final).alias("target"))


def exact(x: Column) -> Column:
    """Sums of these are the same in any order."""
    return x.cast("decimal(38,10)")


def tilts(counts: DataFrame, goal: DataFrame) -> DataFrame:
    """goal (source, source_size, target) with scale and lambda; counts: (source, size, n), sizes above 0.

    Newton steps on the dual, held in a bracket that each step narrows; a source whose target is twice its words has all
    rates at their limit.
    """
    state = goal.where("source_size > 0").withColumn("scale", F.col("source_size") / F.col("docs"))
    state = durable(state.selectExpr("source AS s", "target", "scale", "CAST(0 AS double) AS lam", "CAST(-1e6 AS double) AS lo", "ln(2D) * scale AS hi", "CAST(1 AS double) AS err"))
    for turn in range(STEPS):
        z = F.col("size") / F.col("scale")
        e = F.exp(F.least(F.col("lam") * z, F.lit(1.0)))
        rate, words = F.least(F.lit(CAP), e), F.col("n") * F.col("size")
        sums = counts.join(state, counts["source"].eqNullSafe(state["s"])).groupBy("s").agg(F.sum(exact(words * rate)).cast("double").alias("got"), F.sum(exact(F.when(e < CAP, words * z * e).otherwise(0.0))).cast("double").alias("slope"))
        new = state.join(sums.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")))
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        done = F.abs(F.col("got") - F.col("target")) <= EXACT * F.col("target")
        inside = (step > lo) & (step < hi)
        # outside of the bracket: halve it, or double away from zero while it is open below
        other = F.when(lo <= -1e6, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((lo + hi) / 2)
        lam = F.when(done, F.col("lam")).when(inside, step).otherwise(other)
        state = new.select("s", "target", "scale", lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), F.when(done | (hi - lo < 1e-12), 0.0).otherwise(1.0).alias("err"))
        if turn % CHAIN < CHAIN - 1 and turn < STEPS - 1:
            continue
        state = durable(state)
        if not state.where("err > 0").head(1):
            break
    return state.select("s", "target", "scale", "lam")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, apart: Sequence[str] = ("doc_id", "source", "text")) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, key1, key2) for every row of docs (doc_id, source, text).

    size: words of the text, 0 if it is null; taken = copies * size, at most 2 * size. A null source is a source, last in
    order. Documents of size 0 have rate 1 and one copy, which adds no word. A source without words has target 0. Null and
    repeated ids are rows like others: each row has its own place in the random order, rows alike in all columns of `apart`
    too. key1, key2: hashes of these columns (see keys()). Reruns agree: sums that decide are decimal, places are hashes. An
    empty table gives an empty table; other columns are ignored.

    The rows are written once, without texts; what is decided is one row a source, joined to them.
    """
    own = durable(sizes(docs, apart))
    counts = durable(own.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs"))
    goal = durable(targets(sources, weights, share).join(sources.select(F.col("source").alias("k"), "docs"), F.col("source").eqNullSafe(F.col("k"))).drop("k"))
    tilt = tilts(counts.where("size > 0"), goal)
    # one row a source: the dual's solution by source
    plan = durable(goal.join(tilt.select("s", "scale", "lam"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("src"), "source_size", "target", "scale", "lam"))
    rated = own.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn("rate", rate())
    # copies = floor(rate + u + shift) within 0..2: c copies are reached where the shift is at least c - rate - u
    at = rated.where("size > 0").select("source", "size", F.explode(F.array(F.lit(1.0) - F.col("rate") - F.col("u"), F.lit(2.0) - F.col("rate") - F.col("u"))).alias("place"))
    shift = shifts(at, plan.where("source_size > 0"))
    plan = durable(plan.join(shift, F.col("src").eqNullSafe(F.col("k")), "left").drop("k"))
    rated = own.join(plan, F.col("source").eqNullSafe(F.col("src"))).withColumn("rate", rate()).withColumn("copies", reached())
    extra = filled(rated, goal)
    out = rated.join(extra, F.col("source").eqNullSafe(F.col("k")), "left")
    chosen = F.exists("picks", lambda p: (p["size"] == F.col("size")) & (p["u"] == F.col("u")) & (p["key1"] == F.col("key1")))
    out = out.withColumn("copies", F.col("copies") + F.coalesce(chosen, F.lit(False)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"), "key1", "key2")


def rate() -> Column:
    return F.when(F.col("size") == 0, 1.0).otherwise(F.least(F.lit(CAP), F.exp(F.least(F.round(F.col("lam"), 9) * F.col("size") / F.col("scale"), F.lit(1.0)))))


def reached() -> Column:
    """Copies at the source's shift."""
    fit = F.coalesce("shift", F.lit(0.0))
    once, twice = (F.lit(c) - F.col("rate") - F.col("u") < fit for c in (1.0, 2.0))
    return F.when(F.col("size") == 0, 1).otherwise(once.cast("int") + twice.cast("int")).cast("long")


def shifts(at: DataFrame, plan: DataFrame) -> DataFrame:
    """(k, shift): for each source the greatest shift, to within its finest bin, at which the words of places below it do
    not exceed the target. Each level counts words in BINS bins of the interval that the level before has left."""
    state = plan.selectExpr("src AS k", "target", "CAST(-3 AS double) AS lo", "CAST(5 AS double) AS width", "CAST(0 AS decimal(38,10)) AS below")
    for _ in range(LEVELS):
        own = at.join(state, F.col("source").eqNullSafe(F.col("k"))).where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + F.col("width")))
        bins = own.groupBy("k", F.floor((F.col("place") - F.col("lo")) / F.col("width") * BINS).alias("bin")).agg(F.sum("size").cast("decimal(38,10)").alias("words"))
        bins = state.select(F.col("k").alias("of"), "target", "lo", "width", "below").join(bins, F.col("k").eqNullSafe(F.col("of")), "left")
        run = F.col("below") + F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("bin")), F.lit(0).cast("decimal(38,10)"))
        bins = bins.withColumn("run", run)
        # the last bin that still fits; the next occupied one holds the place where the target is passed
        over = F.col("run").cast("double") > F.col("target")
        cut = bins.groupBy("of").agg(F.first("target").alias("target"), F.first("lo").alias("lo"), F.first("width").alias("width"), F.first("below").alias("below"), F.min(F.when(over, F.col("bin"))).alias("bin"), F.max(F.when(~over, F.col("run"))).alias("fits"))
        step = F.col("width") / BINS
        state = durable(cut.select(F.col("of").alias("k"), "target", F.when(F.col("bin").isNull(), F.col("lo") + F.col("width")).otherwise(F.col("lo") + F.col("bin") * step).alias("lo"), step.alias("width"), F.coalesce("fits", "below").cast("decimal(38,10)").alias("below")))
    return state.select("k", F.col("lo").alias("shift"))


def filled(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """(k, picks): for each source that lacks words the documents that get one more copy: of the largest size that still
    fits as many as fit (EACH at most), then of the largest smaller one, for FILLS sizes; of documents of one size the
    first in the random order."""
    spare = F.sum((F.col("copies") < 2).cast("long"))
    sums = durable(rows.where("size > 0").groupBy("source", "size").agg(F.sum("copies").alias("copies"), spare.alias("spare")))
    got = sums.groupBy(F.col("source").alias("k")).agg(F.sum(F.col("copies") * F.col("size")).alias("got"))
    lack = goal.join(got, F.col("source").eqNullSafe(F.col("k"))).select("k", (F.col("target") - F.col("got")).alias("lack"), F.lit(1 << 62).alias("under"))
    spare = sums.where("spare > 0").select("source", "size", "spare")
    picked = None
    for _ in range(FILLS):
        fits = spare.join(lack, F.col("source").eqNullSafe(F.col("k"))).where((F.col("size") <= F.col("lack")) & (F.col("size") < F.col("under")))
        best = fits.groupBy("k").agg(F.max(F.struct("size", "spare")).alias("b"), F.first("lack").alias("lack"))
        number = F.least(F.col("b.spare"), F.floor(F.col("lack") / F.col("b.size")), F.lit(EACH))
        best = durable(best.select("k", F.col("b.size").alias("size"), number.alias("number"), "lack"))
        if not best.head(1):
            break
        picked = best if picked is None else picked.unionByName(best)
        lack = best.select("k", (F.col("lack") - F.col("size") * F.col("number")).alias("lack"), F.col("size").alias("under"))
    if picked is None:
        return lack.where("false").select("k", F.lit(None).cast("array<struct<size:bigint,u:double,key1:bigint>>").alias("picks"))
    wanted = picked.select(F.col("k").alias("of"), F.col("size").alias("wanted"), "number")
    some = rows.where("copies < 2").join(wanted, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("wanted"))).select("of", "size", "u", "key1", "number")
    place = F.row_number().over(Window.partitionBy("of", "size").orderBy("u", "key1"))
    some = some.withColumn("place", place).where(F.col("place") <= EACH).where("place <= number")
    return durable(some.groupBy(F.col("of").alias("k")).agg(F.collect_list(F.struct("size", "u", "key1")).alias("picks")))
