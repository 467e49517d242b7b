"""Readers: form-feed text, word tables, ALTO files, page images, manifests and JSON-lines relations.

Files are read by Spark's own sources (``binaryFile``, ``json``, ``csv``), so
that listing, splitting and pruning are Spark's; Arrow functions decode only
what has no built-in decoder.

Defined results
* text: a byte-order mark is dropped; a last form feed followed by blanks only
  opens no page; bytes that aren't UTF-8 give an ``error`` and no page.
* an image header that can't be read gives an ``error`` and null sizes.
* files of no bytes have no rows: Spark's file sources skip them.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions.text import natural_key

MOST_WORDS = 20_000


def split_pages(text: Column, mark: str = "\f") -> Column:
    """Pages of a text: split at form feeds, no page for blanks after the last one."""
    parts = F.split(F.regexp_replace(text, "^﻿", ""), mark)
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) > 1) & ~last.rlike(r"\S"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``sha256``, ``page_number`` (from 1), ``content``, ``error``."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.try_validate_utf8(F.col("content").cast("string")).alias("t"))
    good = raw.filter("t IS NOT NULL").select("path", "sha256", F.posexplode(split_pages(F.col("t"))).alias("i", "content")).select("path", "sha256", (F.col("i") + 1).alias("page_number"), "content", F.lit(None).cast("string").alias("error"))
    bad = raw.filter("t IS NULL").select("path", "sha256", F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("content"), F.lit("unreadable_text").alias("error"))
    return good.unionByName(bad)


def source_kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("jpg", "jpeg", "png"), "page_images").when(suffix.isin("txt", "text", "md"), "text").otherwise("refused")


def tsv_confidence(tsv: Column) -> Column:
    """Struct of word_count, mean, min, below_60_count, below_60_ratio of a recogniser's word table (level 5, confidence from 0, words that aren't blank)."""
    rows = F.transform(F.split(tsv, "\n"), lambda x: F.split(x, "\t"))
    conf = F.transform(
        F.filter(rows, lambda r: (F.size(r) >= 12) & (F.try_element_at(r, F.lit(1)) == "5") & (F.coalesce(F.try_element_at(r, F.lit(11)).try_cast("double"), F.lit(-1.0)) >= 0) & (F.trim(F.try_element_at(r, F.lit(12))) != "")),
        lambda r: F.try_element_at(r, F.lit(11)).try_cast("double"),
    )
    n = F.size(conf)
    low = F.size(F.filter(conf, lambda c: c < 60))
    return F.struct(
        n.cast("bigint").alias("word_count"), F.when(n > 0, F.round(F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / n / 100, 4)).alias("mean"), F.array_min(conf).alias("min"),
        low.cast("bigint").alias("below_60_count"), F.when(n > 0, F.round(low.cast("double") / n, 4)).alias("below_60_ratio"),
    )


def parse_alto(data: bytes | None) -> tuple[list[dict], str | None]:
    """(words with box, confidence and line, error) of one page file."""
    if not data:
        return [], "empty_file"
    if b"<!DOCTYPE" in data[:4096]:
        return [], "doctype_refused"
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError:
        return [], "malformed_xml"
    local = lambda e: e.tag.rpartition("}")[2]
    if sum(local(e) == "Page" for e in root.iter()) != 1:
        return [], "not_one_page"
    words, line = [], 0
    for e in root.iter():
        if local(e) == "TextLine":
            line += 1
        elif local(e) == "String" and e.get("CONTENT"):
            try:
                x, y, w, h = (round(float(e.get(k, "0"))) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT"))
            except ValueError:
                return [], "bad_box"
            if e.get("WC") is not None:
                conf: float | None = float(e.get("WC", "0"))
            elif e.get("CC"):
                digits = [int(c) for c in re.findall(r"\d", e.get("CC", ""))]
                conf = 1 - sum(digits) / len(digits) / 9 if digits else None
            else:
                conf = None
            words.append({"line": line, "item": len(words), "x0": x, "y0": y, "x1": x + w, "y1": y + h, "confidence": conf, "text": e.get("CONTENT")})
    return ([], "too_many_words") if len(words) > MOST_WORDS else (words, None)


_WORD = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("item", T.IntegerType()), *[T.StructField(k, T.IntegerType()) for k in ("x0", "y0", "x1", "y1")], T.StructField("confidence", T.DoubleType()), T.StructField("text", T.StringType())])
_ALTO = T.StructType([T.StructField("words", T.ArrayType(_WORD)), T.StructField("error", T.StringType())])


@F.arrow_udf(_ALTO)
def alto(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    word = pa.struct([("line", pa.int32()), ("item", pa.int32()), *[(k, pa.int32()) for k in ("x0", "y0", "x1", "y1")], ("confidence", pa.float64()), ("text", pa.string())])
    for files in it:
        yield pa.array([dict(zip(("words", "error"), parse_alto(f if isinstance(f, bytes | None) else f.encode()), strict=True)) for f in files.to_pylist()], pa.struct([("words", pa.list_(word)), ("error", pa.string())]))


def alto_words(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and its words; files with an error have one row with it and no word."""
    f = spark.read.format("binaryFile").load(path).select("path", alto("content").alias("a"))
    return f.select("path", F.col("a.error").alias("error"), F.inline_outer("a.words"))


def png_header(data: bytes) -> dict:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return {"error": "not_png"}
    at, out = 8, {"kind": "png", "width": None, "height": None, "dpi": None, "error": None}
    while at + 12 <= len(data):
        (n,), name = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or len(data) < at + 12 + n:
            break
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            return {"error": "bad_crc"}
        if name == b"IHDR":
            out["width"], out["height"] = struct.unpack(">II", body[:8])
        elif name == b"pHYs" and body[8] == 1:
            out["dpi"] = round(struct.unpack(">I", body[:4])[0] * 0.0254)
        elif name in (b"IDAT", b"IEND"):
            break
        at += 12 + n
    return out if out["width"] else {"error": "no_header"}


def jpeg_header(data: bytes) -> dict:
    if data[:2] != b"\xff\xd8":
        return {"error": "not_jpeg"}
    at, out = 2, {"kind": "jpeg", "width": None, "height": None, "dpi": None, "error": None}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return {"error": "bad_marker"}
        mark, (n,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + n]
        if mark == 0xE0 and body[:5] == b"JFIF\0" and body[7] in (1, 2):
            dpi = struct.unpack(">H", body[8:10])[0]
            out["dpi"] = dpi if body[7] == 1 else round(dpi * 2.54)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            return out
        elif mark in (0xD9, 0xDA):
            break
        at += 2 + n
    return {"error": "no_frame"}


_IMAGE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("dpi", T.IntegerType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_IMAGE)
def image_header(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("kind", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("dpi", pa.int32()), ("error", pa.string())])

    def one(b: bytes | None) -> dict:
        try:
            return (png_header(b) if b[:1] == b"\x89" else jpeg_header(b)) if b else {"error": "empty_file"}
        except (struct.error, IndexError):
            return {"error": "truncated"}

    for files in it:
        yield pa.array([one(b) for b in files.to_pylist()], kind)


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page images of folders, each numbered in natural order of its names: folder, page number, name, hash, size, density."""
    f = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), image_header("content").alias("h"))
    from pyspark.sql import Window as W

    # a folder is a document
    return f.select("folder", F.row_number().over(W.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")).alias("page_number"), "name", "length", "sha256", "h.*")


def manifest_changes(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``name``, ``change`` (missing, added, changed, reordered) between two manifests of name, position, sha256."""
    a = recorded.select("name", F.col("position").alias("pa"), F.col("sha256").alias("ha"))
    b = current.select("name", F.col("position").alias("pb"), F.col("sha256").alias("hb"))
    change = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "added").when(F.col("ha") != F.col("hb"), "changed").when(F.col("pa") != F.col("pb"), "reordered")
    return a.join(b, "name", "full").select("name", change.alias("change")).filter("change IS NOT NULL")


def iiif_canvases(manifest: Column) -> Column:
    """Array of struct(canvas, label, service) of a Presentation 2 or 3 manifest, in order."""
    v3 = F.from_json(manifest, "items array<struct<id:string,items:array<struct<items:array<struct<body:struct<id:string,service:array<struct<id:string,`@id`:string>>>>>>>>>")
    v2 = F.from_json(manifest, "sequences array<struct<canvases:array<struct<`@id`:string,label:string,images:array<struct<resource:struct<`@id`:string,service:struct<`@id`:string>>>>>>>>")

    def three(c: Column) -> Column:
        body = F.get(F.get(c["items"], F.lit(0))["items"], F.lit(0))["body"]
        service = F.get(body["service"], F.lit(0))
        return F.struct(c["id"].alias("canvas"), F.coalesce(service["id"], service["@id"], body["id"]).alias("service"))

    def two(c: Column) -> Column:
        res = F.get(c["images"], F.lit(0))["resource"]
        return F.struct(c["@id"].alias("canvas"), F.coalesce(res["service"]["@id"], res["@id"]).alias("service"))

    return F.coalesce(F.transform(v3["items"], three), F.transform(F.get(v2["sequences"], F.lit(0))["canvases"], two))


def relation(spark: SparkSession, path: str, schema: str | T.StructType, key: str) -> DataFrame:
    """A JSON-lines relation with a declared schema; damaged lines fail the read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.filter(F.assert_true(F.col(key).isNotNull(), F.lit(f"{key} is missing")).isNull())


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
