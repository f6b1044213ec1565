"""Regions of a clip over time. samples: (clip_id, t, regions array<REGION>); frames to look up: (clip_id, t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushspan.operators.regions import REGION, overlap_ratio


def as_of(samples: DataFrame, frames: DataFrame, fallback: bool = True) -> DataFrame:
    """frames with sample_t and regions: the last sample at or before each, or, with fallback, the first one for frames
    before it. One sort by clip and time; no pair of frame and sample is formed."""
    both = samples.select("clip_id", "t", F.lit(0).alias("ask"), F.struct(F.col("t").alias("sample_t"), "regions").alias("s")).unionByName(frames.select("clip_id", "t", F.lit(1).alias("ask"), F.lit(None).cast(f"struct<sample_t:double,regions:array<{REGION}>>").alias("s")))
    past = Window.partitionBy("clip_id").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("clip_id").orderBy("t", "ask").rowsBetween(0, Window.unboundedFollowing)
    found = F.last("s", ignorenulls=True).over(past)
    if fallback:
        found = F.coalesce(found, F.first("s", ignorenulls=True).over(later))
    return both.withColumn("f", found).where("ask = 1").select("clip_id", "t", F.col("f.sample_t").alias("sample_t"), F.col("f.regions").alias("regions"))


def verified(samples: DataFrame, frames: DataFrame, frame_duration: float | None = None) -> DataFrame:
    """frames with the first sample closer than a fifth of a frame (or 4 ms). Times are cut into cells of the slack, and a
    frame looks into its own and the neighbouring ones: an equi-join."""
    slack = frame_duration / 5 if frame_duration else 0.004
    cell = lambda t: F.floor(t / slack)
    s = samples.select(F.col("clip_id").alias("c"), F.col("t").alias("sample_t"), "regions", cell(F.col("t")).alias("cell"))
    f = frames.distinct().select("clip_id", "t", F.explode(F.array(*[cell(F.col("t")) + d for d in (-1, 0, 1)])).alias("near"))
    hit = f.join(s, (f["clip_id"] == s["c"]) & (f["near"] == s["cell"])).where(F.abs(F.col("sample_t") - F.col("t")) < slack)
    best = hit.groupBy("clip_id", "t").agg(F.min(F.struct("sample_t", "regions")).alias("b"))
    return frames.join(best, ["clip_id", "t"], "left").select("clip_id", "t", F.col("b.sample_t").alias("sample_t"), F.col("b.regions").alias("regions"))


def distinct_regions(samples: DataFrame) -> DataFrame:
    """(clip_id, type, x, y, w, h, t): the first sight of each type and rounded box."""
    one = samples.select("clip_id", "t", F.posexplode("regions").alias("pos", "r"))
    key = [F.col("r.type").alias("type"), *[F.round(f"r.box.{c}").cast("long").alias(c) for c in "xywh"]]
    return one.select("clip_id", "t", *key).groupBy("clip_id", "type", "x", "y", "w", "h").agg(F.min("t").alias("t"))


def with_manual(samples: DataFrame, manual: DataFrame) -> DataFrame:
    """samples with the manual boxes of their clip (clip_id, regions) put onto every one."""
    m = manual.select("clip_id", F.col("regions").alias("more"))
    return samples.join(m, "clip_id", "left").select("clip_id", "t", F.concat("regions", F.coalesce("more", F.array().cast(f"array<{REGION}>"))).alias("regions"))


def same_box(a: Column, b: Column) -> Column:
    return (a["type"] == b["type"]) & (overlap_ratio(a["box"], b["box"]) >= 0.6)


def _union(a: Column, b: Column) -> Column:
    x, y = F.least(a["box"]["x"], b["box"]["x"]), F.least(a["box"]["y"], b["box"]["y"])
    x2 = F.greatest(a["box"]["x"] + a["box"]["w"], b["box"]["x"] + b["box"]["w"])
    y2 = F.greatest(a["box"]["y"] + a["box"]["h"], b["box"]["y"] + b["box"]["h"])
    box = F.struct(x.alias("x"), y.alias("y"), (x2 - x).alias("w"), (y2 - y).alias("h"))
    surer = F.when(a["confidence"] >= b["confidence"], a).otherwise(b)
    return F.struct(a["type"].alias("type"), box.alias("box"), surer["confidence"].alias("confidence"))


def fill_gaps(samples: DataFrame, window: float, confirmed: DataFrame | None = None) -> DataFrame:
    """samples with boxes put back that a read between two others missed, if the same box stands before and after within
    the window and, where given, confirmed (clip_id, t, before_t, after_t) says that the picture stayed.

    A sample only looks at its clip's samples within the window: a range frame collects them, so the state is bounded by
    what a window holds, and clips are dealt by their id.
    """
    if window <= 0:
        return samples
    own = F.struct(F.col("t").alias("t"), F.col("regions").alias("regions"))
    micros = F.round(F.col("t") * 1_000_000).cast("long")
    width = round(window * 1_000_000)
    by = Window.partitionBy("clip_id").orderBy("m")
    rows = samples.withColumn("m", micros)
    rows = rows.withColumn("before", F.collect_list(own).over(by.rangeBetween(-width, -1))).withColumn("after", F.collect_list(own).over(by.rangeBetween(1, width)))
    if confirmed is not None:
        seen = confirmed.groupBy("clip_id", "t").agg(F.collect_set(F.struct("before_t", "after_t")).alias("seen"))
        rows = rows.join(seen, ["clip_id", "t"], "left")
    empty = F.array().cast(f"array<{REGION}>")

    def candidate(added: Column, b: Column, c: Column) -> Column:
        """added with c of the earlier sample b, if it may be put back."""
        return_at = F.filter("after", lambda a: F.exists(a["regions"], lambda r: same_box(r, c)))
        first = F.get(return_at, 0)
        match = F.get(F.filter(first["regions"], lambda r: same_box(r, c)), 0)
        covered = F.exists("regions", lambda r: same_box(r, c)) | F.exists(added, lambda r: same_box(r, c))
        ok = ~covered & first.isNotNull() & (first["t"] - b["t"] <= window)
        if confirmed is not None:
            ok = ok & F.coalesce(F.exists("seen", lambda s: (s["before_t"] == b["t"]) & (s["after_t"] == first["t"])), F.lit(False))
        return F.when(F.coalesce(ok, F.lit(False)), F.concat(added, F.array(_union(c, match)))).otherwise(added)

    nearest = F.reverse(F.array_sort("before"))
    additions = F.aggregate(nearest, empty, lambda acc, b: F.aggregate(b["regions"], acc, lambda inner, c: candidate(inner, b, c)))
    filled = F.when((F.size("after") > 0) & (F.size("before") > 0), F.concat("regions", additions)).otherwise(F.col("regions"))
    return rows.select("clip_id", "t", filled.alias("regions"))
