"""Queries of the llm operators for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import encoding, language, mixing, repetition, residue, scans, tokenize, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: repetition.found(_t(s, d, "readings")),
    "p2_found": lambda s, d: language.found(_t(s, d, "readings")),
    "p4_found": lambda s, d: truncation.found(_t(s, d, "readings")),
    "p4_by_source": lambda s, d: truncation.by_source(_t(s, d, "readings")),
    "p7_found": lambda s, d: scans.found(_t(s, d, "readings")),
    "p7_paragraphs": lambda s, d: scans.paragraphs(_t(s, d, "readings").select("reading_id", "job_id", "page_number", "result_format", "content")).select("reading_id", "clean_text"),
    "p7_pages": lambda s, d: scans.page_texts(_t(s, d, "page_results")),
    "p8_ids": lambda s, d: tokenize.encode(_t(s, d, "documents").select("doc_id", "text")).select("doc_id", "ids"),
    "p9_mix": lambda s, d: mixing.mix(_t(s, d, "documents"), _t(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mixing.shares(_t(s, d, "documents"), _t(s, d, "mix_targets")),
    "p10_found": lambda s, d: residue.found(_t(s, d, "documents")),
    "p10_kept": lambda s, d: residue.without_residue(_t(s, d, "documents").select("doc_id", "text")).select("doc_id"),
    "p1_bands": lambda s, d: repetition.perplexity_bands(_t(s, d, "readings").filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "lang", "content")).select("reading_id", F.round("repetition.repeated_share", 6).alias("repeated_share"), "band").distinct(),
    "p2_segments": lambda s, d: language.identify_languages(_t(s, d, "readings").filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "lang", "content")).select("reading_id", F.posexplode("language.segments").alias("segment", "x")).select("reading_id", "segment", "x.lang", "x.words", "x.confidence"),
    "p5_repaired": lambda s, d: encoding.repair_encoding(_t(s, d, "readings").select("reading_id", "content")).select("reading_id", "encoding_status", "encoding_text").distinct(),
    "p5_found": lambda s, d: encoding.found(_t(s, d, "readings")),
}
ORACLES: dict[str, str] = {}
