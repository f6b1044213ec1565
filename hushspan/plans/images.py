"""Images from recognised lines to painted pixels: an image's lines make one document, its spans become boxes, boxes are
painted. Recognition itself, of text, faces and barcodes, is an input table."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushspan.operators.images import painted_png
from hushspan.operators.regions import BOX, WORDS, dedup_regions, union
from hushspan.plans.pipeline import Pipeline

FIELDS = {"type": "string", "confidence": "double", "source": "string", "disposition": "string", "enabled": "boolean", "start": "int", "end": "int", "token": "string", "x": "double", "y": "double", "w": "double", "h": "double"}
REGIONS = f"array<struct<{','.join(f'{name}:{kind}' for name, kind in FIELDS.items())}>>"
ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}


def region_rows(spans: Sequence[dict], tokens: dict[int, str], lines: Sequence[dict]) -> list[dict]:
    """A region for each span, over the boxes of the words that it touches, in lines where it touches none over the line's.
    Spans are disjoint and ascending, so each line is looked up once a span that touches it."""
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line["text"]) + 1
    out = []
    for s in spans:
        box = None
        for i in range(max(0, bisect_right(starts, s["start"]) - 1), len(lines)):
            start, line = starts[i], lines[i]
            if start >= s["end"]:
                break
            if s["start"] >= start + len(line["text"]):
                continue
            touched = [w["box"] for w in line["words"] if start + w["start"] < s["end"] and s["start"] < start + w["end"]]
            for b in touched or [{k: line[k] for k in "xywh"}]:
                box = b if box is None else union(box, b)
        if box is not None:
            own = {k: s[k] for k in ("type", "confidence", "source", "disposition", "enabled", "start", "end")}
            out.append(own | {"token": tokens.get(s["start"])} | {k: float(box[k]) for k in "xywh"})
    return out


def with_regions(df: DataFrame) -> DataFrame:
    """(image_id, regions) of df (image_id, spans, tokens, lines), null where spans are. Lines of images without a span stay
    in the JVM. The step takes rows, not columns: tokens are an expression with lambdas, which no Python column can take in."""
    some = F.size("spans") > 0
    own = df.select("image_id", "spans", F.when(some, F.col("tokens")).alias("tokens"), F.when(some, F.col("lines")).alias("lines"))

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(name, ARROW[of]) for name, of in FIELDS.items()]))
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("spans", "tokens", "lines")], strict=True)
            found = [None if s is None else region_rows(s, {t["start"]: t["token"] for t in ts or ()}, ls or ()) for s, ts, ls in rows]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(found, kind)], ["image_id", "regions"])

    return own.mapInArrow(boxed, f"image_id {df.schema['image_id'].dataType.simpleString()}, regions {REGIONS}")


class ImagePipeline:
    """A text pipeline over images.

    lines: (image_id, idx, text, x, y, w, h, words), one row a recognised line, boxes in pixels from above; a null text
    counts as empty, words may be null, lines of one idx follow the order of their texts. An image that was read and holds
    no text needs a line with an empty text: one without any line counts as unread, has no regions (null) and is not
    painted. seen: (image_id, type, confidence, x, y, w, h) of faces and barcodes, repeats between tiles merged; it may be
    missing. Other columns are ignored. An image's lines are one row: they are as many as one image holds.
    """

    def __init__(self, text: Pipeline | None = None):
        self.text = text or Pipeline()

    def recognised(self, lines: DataFrame) -> DataFrame:
        """(image_id, lines, text): one row an image, its lines in order and joined by newlines."""
        line = F.struct("idx", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).cast("double").alias(c) for c in "xywh"], F.coalesce("words", F.array().cast(WORDS)).alias("words"))
        own = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
        return own.withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))

    def regions(self, lines: DataFrame, seen: DataFrame | None = None, mode: str = "redact", key: bytes | None = None, width: int = 8) -> DataFrame:
        """(image_id, regions) of every image that has lines. A region carries its span's type, confidence, source,
        disposition, place and token, never its value; those of seen have neither place nor token."""
        own = with_regions(self.text.run(self.recognised(lines), mode, key, width))
        if seen is None:
            return own
        box = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"]).cast(BOX)
        some = seen.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("type", box.alias("box"), F.col("confidence").cast("double").alias("confidence")))).alias("seen"))
        flat = lambda r: F.struct(r["type"], r["confidence"], F.when(r["type"] == "face", "face").otherwise("barcode"), F.lit("redact"), F.lit(True), F.lit(None), F.lit(None), F.lit(None), *[r["box"][c] for c in "xywh"])
        some = some.select("image_id", F.transform(dedup_regions(F.col("seen")), flat).cast(REGIONS).alias("seen"))
        both = F.concat("regions", F.coalesce("seen", F.array().cast(REGIONS)))
        return own.join(some, "image_id", "left").select("image_id", both.alias("regions"))

    def redact(self, images: DataFrame, lines: DataFrame, seen: DataFrame | None = None, style: str = "solid", mode: str = "redact", key: bytes | None = None, width: int = 8) -> DataFrame:
        """images (image_id, width, height, rgba) with regions and png. png is null where the image is unread, its id is
        null, a user's rule ran over its time or the pixels don't fit the size. In mode pseudonymise with a key, tokens
        are written on boxes of the opaque styles."""
        self.text._free(images, ["regions", "png"])
        own = images.join(self.regions(lines, seen, mode, key, width), "image_id", "left")
        stamped = mode == "pseudonymise" and key is not None
        return own.withColumn("png", painted_png(F.col("width"), F.col("height"), F.when(F.col("regions").isNotNull(), F.col("rgba")), F.col("regions"), style, stamped))
