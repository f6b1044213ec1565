"""Boxes on images: layout of recognised lines, spans to boxes, tiles, and repeats between tiles.

A box is struct<x,y,w,h: double>. Recognition itself is outside: its lines are an input table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
REGION = f"struct<type:string,box:{BOX},confidence:double>"
WORDS = f"array<struct<start:int,end:int,box:{BOX}>>"
LINE = f"struct<text:string,box:{BOX},words:{WORDS}>"

# Sides and overlaps of strips and of squares, the longest shape of a strip, the least side.
STRIP, STRIP_OVERLAP, SQUARE, SQUARE_OVERLAP, ASPECT, LEAST = 2048, 384, 640, 160, 4, 512


def layout(lines: DataFrame) -> DataFrame:
    """lines (image_id, idx, text, …) with start and end in the image's text, whose lines are joined by newlines."""
    before = Window.partitionBy("image_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return lines.withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def joined_text(lines: DataFrame) -> DataFrame:
    """(image_id, text): one image's lines make one document."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return lines.groupBy("image_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def span_boxes(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(image_id, start, end, type, x, y, w, h): for each span the union of the word boxes it touches, in lines without
    word boxes of the whole line's box. spans: (image_id, start, end, type); lines as layout() gives them, with x, y, w,
    h and words. The join's key is the image; the ranges only filter."""
    s = spans.select("image_id", F.col("start").alias("s"), F.col("end").alias("e"), "type")
    hit = lines.join(s, "image_id").where((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    own = F.filter(F.coalesce("words", F.array().cast(WORDS)), lambda w: (F.col("start") + w["start"] < F.col("e")) & (F.col("s") < F.col("start") + w["end"]))
    line = F.struct("x", "y", "w", "h").cast(BOX)
    boxes = F.when(F.size(own) > 0, F.transform(own, lambda w: w["box"])).otherwise(F.array(line))
    b = hit.withColumn("b", F.explode(boxes))
    edges = b.groupBy("image_id", "s", "e", "type").agg(F.min("b.x").alias("x"), F.min("b.y").alias("y"), F.max(F.col("b.x") + F.col("b.w")).alias("x2"), F.max(F.col("b.y") + F.col("b.h")).alias("y2"))
    return edges.select("image_id", F.col("s").alias("start"), F.col("e").alias("end"), "type", "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))


def starts(total: Column, size: Column, overlap: Column) -> Column:
    """Evenly spaced starts of tiles, the last one flush with the end; the overlap counts for half a tile at most."""
    step = F.greatest(F.lit(1), size - F.least(F.greatest(F.lit(0), overlap), F.floor(size / 2).cast("int")))
    gaps = F.greatest(F.ceil((total - size) / step), F.lit(1)).cast("int")
    spaced = F.transform(F.sequence(F.lit(0), gaps), lambda i: F.round(i * ((total - size) / gaps)).cast("int"))
    return F.when((total > size) & (size > 0), spaced).otherwise(F.array(F.lit(0)))


def _tiles(images: DataFrame, width: Column, height: Column, overlap: int) -> DataFrame:
    """(image_id, tile_id, left, top, width, height), row by row."""
    rows = images.select("image_id", F.col("width").alias("iw"), F.col("height").alias("ih"), width.cast("int").alias("tw"), height.cast("int").alias("th"))
    tops = rows.select("*", F.posexplode(starts(F.col("ih"), F.col("th"), F.lit(overlap))).alias("row", "top"))
    # an array of one array: it is computed once, then unfolded with its size
    across = tops.select("*", F.explode(F.array(starts(F.col("iw"), F.col("tw"), F.lit(overlap)))).alias("lefts"))
    lefts = across.select("*", F.posexplode("lefts").alias("col", "left"), F.size("lefts").alias("cols"))
    return lefts.select("image_id", (F.col("row") * F.col("cols") + F.col("col")).cast("int").alias("tile_id"), "left", "top", F.least(F.col("tw"), F.col("iw") - F.col("left")).alias("width"), F.least(F.col("th"), F.col("ih") - F.col("top")).alias("height"))


def grid(images: DataFrame, side: int = SQUARE, overlap: int = SQUARE_OVERLAP) -> DataFrame:
    """Overlapping squares over images (image_id, width, height)."""
    return _tiles(images, F.lit(side), F.lit(side), overlap)


def strips(images: DataFrame, length: int = STRIP, overlap: int = STRIP_OVERLAP) -> DataFrame:
    """Pieces that no side of an image runs too long across the other: at most ASPECT to 1, and LEAST at the least."""
    fitted = lambda side, other: F.least(side, F.greatest(F.lit(LEAST), F.least(F.lit(length), other * ASPECT)))
    width, height = F.col("width"), F.col("height")
    return _tiles(images, fitted(width, height), fitted(height, width), overlap)


def shared(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area by that of the smaller box; 0 where a box is empty."""
    small = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when(small > 0, shared(a, b) / small).otherwise(0.0)


def ratio(a: dict, b: dict) -> float:
    w = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    h = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    small = min(a["w"] * a["h"], b["w"] * b["h"])
    return w * h / small if w > 0 and h > 0 and small > 0 else 0.0


def union(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return {"x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y}


def merge_regions(regions: list[dict]) -> list[dict]:
    """From the largest down, a region that repeats one of its type makes that one's box grow over it."""
    kept: list[dict] = []
    for r in sorted(regions, key=lambda r: -r["box"]["w"] * r["box"]["h"]):
        same = next((k for k in kept if k["type"] == r["type"] and ratio(k["box"], r["box"]) >= 0.5), None)
        if same is None:
            kept.append(dict(r))
        else:
            same["box"] = union(same["box"], r["box"])
    return kept


def merge_lines(lines: list[dict]) -> list[dict]:
    """Lines read twice, where one reading holds the other: the longer text, a box over both, and the words' boxes only
    if they reach as far as the reading that is dropped."""
    kept: list[dict] = []
    for line in lines:
        at = next((i for i, k in enumerate(kept) if ratio(k["box"], line["box"]) >= 0.5 and (line["text"] in k["text"] or k["text"] in line["text"])), None)
        if at is None:
            kept.append(dict(line))
            continue
        long, short = (line, kept[at]) if len(line["text"]) > len(kept[at]["text"]) else (kept[at], line)
        box = union(kept[at]["box"], line["box"])
        words = []
        if own := list(long["words"] if long["words"] is not None else []):
            left, right = min(w["box"]["x"] for w in own), max(w["box"]["x"] + w["box"]["w"] for w in own)
            if abs(short["box"]["x"] - left) <= 1 and abs(short["box"]["x"] + short["box"]["w"] - right) <= 1:
                tall = union(long["box"], short["box"])
                words = [{"start": w["start"], "end": w["end"], "box": w["box"] | {"y": tall["y"], "h": tall["h"]}} for w in own]
        kept[at] = {"text": long["text"], "box": box, "words": words}
    return kept


def _folded(function, schema: str):
    @F.pandas_udf(f"array<{schema}>")
    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in column:
            yield pd.Series([None if r is None else function([dict(x) for x in r]) for r in rows], dtype=object)

    return run


def dedup_regions(regions: Column) -> Column:
    """The fold needs an order, so it runs over one image's array; arrays of one region or none stay in the JVM."""
    return F.coalesce(_folded(merge_regions, REGION)(F.when(F.size(regions) > 1, regions)), regions)


def dedup_lines(lines: Column) -> Column:
    return F.coalesce(_folded(merge_lines, LINE)(F.when(F.size(lines) > 1, lines)), lines)


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """A box in parts of the image, counted from below, as pixels counted from above."""
    return F.struct((box["x"] * width).alias("x"), ((1 - box["y"] - box["h"]) * height).alias("y"), (box["w"] * width).alias("w"), (box["h"] * height).alias("h"))
