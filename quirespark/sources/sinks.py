"""Writers: JSON lines, spreadsheet-safe CSV, transcripts, TEI. Spark's committer publishes; nothing passes the driver but one document's transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirespark.functions.text import spreadsheet_safe


def json_line(row: Column) -> Column:
    """JSON of a struct with the line separators escaped that some readers split at."""
    out = F.to_json(row)
    for c, esc in ((0x2028, "\\\\u2028"), (0x2029, "\\\\u2029"), (0x85, "\\\\u0085")):
        out = F.regexp_replace(out, chr(c), esc)
    return out


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(json_line(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet takes for formulas."""
    safe = [spreadsheet_safe(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def xml_text(text: Column) -> Column:
    """Text as XML 1.0 can hold it."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "�")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def tei_pages(df: DataFrame, doc: str = "job_id", number: str = "page_number", text: str = "text") -> DataFrame:
    """A TEI body for each document: page breaks and their texts in order. A document's pages are one array."""
    page = F.concat(F.lit('<pb n="'), F.col(number).cast("string"), F.lit('"/><ab>'), xml_text(F.col(text)), F.lit("</ab>"))
    held = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), page.alias("x")))).alias("p"))
    head = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), xml_text(F.col(doc)), F.lit("</title></titleStmt></fileDesc></teiHeader><text><body>"))
    return held.select(doc, F.concat(head, F.array_join("p.x", ""), F.lit("</body></text></TEI>")).alias("tei"))


def transcripts(df: DataFrame, doc: str = "job_id", number: str = "page_number", text: str = "text") -> DataFrame:
    """The texts of each document's pages in order, form feeds between; pages without text stay as empty pages."""
    held = df.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("p"))
    return held.select(doc, F.array_join("p.t", "\f").alias("transcript"), F.size("p").cast("bigint").alias("n_pages"))


def inventory(df: DataFrame, key: str, content: str) -> DataFrame:
    """Size and hash of each item, for bundles and their check."""
    return df.select(key, F.octet_length(content).cast("bigint").alias("size"), F.sha2(content, 256).alias("sha256"))
