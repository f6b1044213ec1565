"""Files in: listing, sorting out what can be read, decoding to text, and routing of dropped paths."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions by kind.
RICH = "rtf rtfd doc docx html htm odt webarchive".split()
PLAIN = "txt text md markdown json ndjson xml csv tsv hl7 yaml yml".split()
IMAGES = "png jpg jpeg heic tiff tif gif bmp webp".split()
PACKAGES = "app bundle framework rtfd pages numbers key".split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]*)$", 1))


def kind(path: Column) -> Column:
    """pdf, rich, image, text, or null for what isn't read."""
    ext = extension(path)
    return F.when(ext == "pdf", "pdf").when(ext.isin(RICH), "rich").when(ext.isin(IMAGES), "image").when(ext.isin(PLAIN), "text")


def supported(path: Column) -> Column:
    return kind(path).isNotNull()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files; a file of other bytes is an error, not a guess."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "UTF-8")
    valid = F.encode(text, "UTF-8") == F.col("content")
    return files.select("path", F.when(valid, text).otherwise(F.raise_error(F.lit("not UTF-8 text"))).alias("text"))


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags go, block ends break lines, five entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|title)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.btrim(out)


def rich_text(name: str, data: bytes) -> str | None:
    """Text of a DOCX, ODT or RTF file; None if it can't be read or has none."""
    ext = name.rpartition(".")[2].lower()
    try:
        if ext in ("docx", "odt"):
            part, paragraph = ("word/document.xml", "}p") if ext == "docx" else ("content.xml", "}p")
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read(part))
            return "\n".join("".join(e.itertext()) for e in root.iter() if e.tag.endswith(paragraph)) or None
        if ext == "rtf":
            text = data.decode("latin-1")
            text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
            text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), text)
            text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
            text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
            return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip() or None
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    return None


def decoded(files: DataFrame) -> DataFrame:
    """files (path, content) with kind and text; images and PDF pages have no text here and go to recognition."""

    @F.pandas_udf("string")
    def rich(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, blobs in batches:
            yield pd.Series([None if b is None else rich_text(n, bytes(b)) for n, b in zip(names, blobs, strict=True)], dtype=object)

    own = files.withColumn("kind", kind(F.col("path")))
    html = extension(F.col("path")).isin("html", "htm")
    office = (F.col("kind") == "rich") & ~html
    text = F.when(F.col("kind") == "text", F.decode("content", "UTF-8")).when(html, html_text(F.decode("content", "UTF-8"))).otherwise(rich(F.when(office, F.col("path")), F.when(office, F.col("content"))))
    return own.withColumn("text", text)


def pages(batch: DataFrame) -> DataFrame:
    """(name, page) for each page of multipage files (path, pages array): `<name> N` where there are several."""
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    one = batch.select(stem.alias("stem"), F.size("pages").alias("n"), F.posexplode("pages").alias("at", "page"))
    return one.select(F.when(F.col("n") > 1, F.concat_ws(" ", "stem", (F.col("at") + 1).cast("string"))).otherwise(F.col("stem")).alias("name"), "page")


def reason(path: Column) -> Column:
    """Why a file isn't taken; null if it is."""
    ext = extension(path)
    return (
        F.when(ext.isin(RICH), "rich text keeps its formatting only on its own route")
        .when(ext == "", "no file extension, so what it holds is unknown")
        .when(~supported(path), F.concat(F.lit("."), ext, F.lit(" files are not read")))
    )


def sort_out(files: DataFrame, excluded: str | None = None, root: str | None = None) -> DataFrame:
    """(path, accepted, reason) of files (path; target of links where known), by path. Hidden files and what lies in
    packages leave no row; files under the excluded folder are summed up in one."""
    path = F.col("path")
    visible = ~path.rlike(r"/\.[^/]") & ~path.rlike(rf"(?i)\.(?:{'|'.join(PACKAGES)})/")
    rows = files.where(visible)
    inside = path.startswith(excluded.rstrip("/") + "/") if excluded else F.lit(False)
    why = reason(path)
    if root and "target" in files.columns:
        why = F.when(F.col("target").isNotNull() & ~F.col("target").startswith(root.rstrip("/") + "/"), "a shortcut to a file outside of this folder").otherwise(why)
    out = rows.where(~inside).select("path", why.isNull().alias("accepted"), why.alias("reason"))
    if excluded:
        n = rows.where(inside).agg(F.count("*").alias("n")).where("n > 0")
        text = F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " file").otherwise(" files"), F.lit(" already in this folder were not looked at"))
        out = out.unionByName(n.select(F.lit(excluded).alias("path"), F.lit(False).alias("accepted"), text.alias("reason")))
    return out.orderBy("path")


def scan(spark: SparkSession, root: str, excluded: str | None = None) -> DataFrame:
    """sort_out() over a local folder. A root that can't be read is an error."""
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    found = []
    for folder, _, names in os.walk(root, onerror=None):
        for name in names:
            full = os.path.join(folder, name)
            found.append((full, os.path.realpath(full) if os.path.islink(full) else None))
    return sort_out(spark.createDataFrame(found, "path string, target string"), excluded, os.path.realpath(root))


def route(urls: DataFrame, limit: int) -> DataFrame:
    """urls (ord, url, is_video, is_folder) with route: videos go their way; if there is a folder, loose files are left
    out; else the first `limit` files are taken and the rest is over the limit."""
    folders = urls.agg(F.coalesce(F.bool_or(F.col("is_folder") & ~F.col("is_video")), F.lit(False)).alias("any_folder"))
    firsts = urls.where("NOT is_video AND NOT is_folder").orderBy("ord").limit(limit).select(F.col("ord").alias("first"))
    rows = urls.crossJoin(F.broadcast(folders)).join(F.broadcast(firsts), urls["ord"] == firsts["first"], "left")
    label = F.when(F.col("is_video"), "video").when(F.col("is_folder"), "folder").when(F.col("any_folder"), "suppressed").when(F.col("first").isNotNull(), "file").otherwise("over_limit")
    return rows.select("ord", "url", label.alias("route"))
