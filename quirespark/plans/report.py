"""Report derivations: notes, selections, coverage, rows and columns of boxes, further checks. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.operators import compare as C
from quirespark.operators import ordered as O
from quirespark.plans.geometry import BOXES, _pairs, boxes
from quirespark.plans.ledger import _CMP, BASE, PAGES, base, compare_runs, pages

# Reasons in the order in which the first present one decides.
HOLDS = ("source_defect", "numeric_column_conflict", "numeric_disagreement", "engine_disagreement", "unconfirmed_model_output", "contested", "coverage_defect", "low_confidence", "handwriting", "unreadable", "illustration", "blank_candidate")
STAGE_ORDER = ("local_text", "local_ocr", "second_ocr", "local_image", "image", "second_opinion")
TERMS = ("salt office", "archivist", "bureau du sel", "соляной конторы")


def warning_notes(s: SparkSession, d: str) -> DataFrame:
    """Each warning with its readings, jobs and pages."""
    w = base(s, d, "job_id", "page_number", "warnings").select("job_id", "page_number", F.explode("warnings").alias("code")).filter("code IS NOT NULL")
    return w.groupBy("code").agg(F.count("*").alias("n_readings"), F.count_distinct("job_id").alias("n_jobs"), F.count_distinct("job_id", "page_number").alias("n_pages"))


def warning_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of each warning of a job as run strings."""
    w = base(s, d, "job_id", "page_number", "warnings").select("job_id", F.explode("warnings").alias("code"), "page_number").filter("code IS NOT NULL")
    return O.run_strings(w, ["job_id", "code"], "page_number")


def first_words(s: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.regexp_replace("selected_output.text", r"\s+", " "))
    return pages(s, d).filter("selected_output.text IS NOT NULL").select("job_id", "page_id", F.array_join(F.slice(F.split(t, " "), 1, 12), " ").alias("words"), F.length("selected_output.text").cast("bigint").alias("n_chars"))


def _term(t: str) -> str:
    return r"(?i)(^|[^\p{L}])" + t.replace(" ", r"\s+") + r"($|[^\p{L}])"


def term_filter(s: SparkSession, d: str) -> DataFrame:
    """Readings that hold each term as whole words, case and blanks aside."""
    t = F.coalesce("content", F.lit(""))
    r = base(s, d, *[t.rlike(_term(x)).alias(f"term_{i}") for i, x in enumerate(TERMS)])
    return r.agg(*[F.count_if(f"term_{i}").alias(f"term_{i}") for i in range(len(TERMS))])


def dispositions(s: SparkSession, d: str) -> DataFrame:
    """The first hold in order among a page's reasons, beside what is recorded."""
    order = F.create_map(*[F.lit(x) for i, h in enumerate(HOLDS) for x in (h, i)])
    first = F.array_min(F.filter(F.transform(F.split("review_reasons", ";"), lambda r: F.try_element_at(order, r)), lambda i: i.isNotNull()))
    p = pages(s, d).select("job_id", "page_id", "disposition", F.try_element_at(F.array(*map(F.lit, HOLDS)), (first + 1).cast("int")).alias("derived"))
    return p.groupBy("disposition", "derived").agg(F.count("*").alias("n"))


def select_reading(s: SparkSession, d: str) -> DataFrame:
    """A page's reading: the first without warnings in the order of stages, else fewest warnings, then most sure; readings without text aside."""
    at = F.create_map(*[F.lit(x) for i, n in enumerate(STAGE_ORDER) for x in (n, i)])
    full = F.coalesce(F.col("content"), F.lit("")).rlike(r"\S").alias("full")
    n = F.greatest(F.coalesce(F.size("warnings"), F.lit(0)), F.lit(0))
    r = base(s, d, "job_id", "page_id", "stage", "confidence", full, n.alias("n")).filter("full").withColumn("o", F.try_element_at(at, F.col("stage")))
    return O.latest(r, ["job_id", "page_id"], [F.asc("n"), F.when(F.col("n") == 0, F.col("o")).otherwise(0).asc(), F.desc_nulls_last("confidence"), F.asc("o"), F.asc("reading_id")]).select("job_id", "page_id", "reading_id", "stage")


def missing_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages between a source's first and last that have no reading."""
    have = base(s, d, "source_key", "page_number").filter("page_number IS NOT NULL").select("source_key", "page_number").distinct()
    span = have.groupBy("source_key").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b"))
    want = span.select("source_key", F.explode(F.sequence("a", "b")).alias("page_number"))
    return want.join(have, ["source_key", "page_number"], "left_anti")


def changed_pages_top(s: SparkSession, d: str) -> DataFrame:
    return compare_runs(s, d).filter("status = 'different'").select("job_id", "page_id", "length_delta").orderBy("job_id", "page_id").limit(50)


def verify_readings(s: SparkSession, d: str) -> DataFrame:
    """Faults of readings: one id with two contents, numbers that don't match the id, values out of range, ingested before extracted, unknown sources."""
    raw = s.read.parquet(f"{d}/readings.parquet")
    b = base(s, d, "page_id", "page_number", "confidence", "usage", "extracted_at", "source_key", F.col("ingested_at").alias("first_ingested"))
    src = s.read.parquet(f"{d}/sources.parquet").select("source_key")
    bad = lambda df, code: df.select(F.lit(code).alias("code"), "reading_id")
    return (
        bad(raw.groupBy("reading_id").agg(F.count_distinct(F.md5("content")).alias("n")).filter("n > 1"), "content_conflict")
        .unionByName(bad(b.filter(F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") != F.col("page_number")), "page_number_mismatch"))
        .unionByName(bad(b.filter("confidence < 0 OR confidence > 1"), "confidence_out_of_range"))
        .unionByName(bad(b.filter("usage.tokens < 0 OR usage.compute_seconds < 0 OR usage.cost_usd < 0"), "usage_negative"))
        .unionByName(bad(b.filter("first_ingested < extracted_at"), "time_order"))
        .unionByName(bad(b.join(src, "source_key", "left_anti"), "unknown_source"))
    )


def column_starts(s: SparkSession, d: str) -> DataFrame:
    """Clusters of the boxes' left edges: edges within the gap of the one before chain together."""
    w = W.partitionBy("page_id").orderBy("x0", "item")
    t = boxes(s, d).withColumn("new", F.when(F.col("x0") - F.lag("x0").over(w) <= 30_000, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return t.groupBy("page_id", "cluster").agg(F.min("x0").alias("start"), F.count("*").alias("n"))


def row_groups(s: SparkSession, d: str) -> DataFrame:
    """Boxes in visual rows: each against the first box of the current row, a fold over the boxes in order of height."""
    held = boxes(s, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), "item"))).alias("b"))

    def add(acc, b):
        last = F.try_element_at(acc, F.lit(-1))
        same = last.isNotNull() & (F.abs(b["cy"] - last["head"]) <= 15_000)
        row = F.struct(F.when(same, last["row"]).otherwise(F.coalesce(last["row"], F.lit(0)) + 1).alias("row"), F.when(same, last["head"]).otherwise(b["cy"]).alias("head"), b["item"].alias("item"))
        return F.concat(acc, F.array(row))

    rows = F.aggregate("b", F.array().cast("array<struct<row:int,head:double,item:int>>"), add)
    return held.select("page_id", F.inline(rows)).groupBy("page_id", "row").agg(F.count("*").alias("n"))


def packets(s: SparkSession, d: str) -> DataFrame:
    """Open spans as blind packets: the two candidates in alphabetical order with 80 characters of context."""
    p = _pairs(s, d).select("job_id", "page_id", "ref", F.inline(C.contest("ref", "content"))).filter("settled IS NULL")
    around = lambda a, n: F.substring(F.col("ref"), a, n)
    return p.select("job_id", "page_id", "span_id", F.array_join(F.array_sort(F.array_distinct(F.array("base", "witness"))), " | ").alias("candidates"), around(F.greatest(F.col("start") - 79, F.lit(1)), F.least(F.col("start"), F.lit(80))).alias("before"), around(F.col("end") + 1, F.lit(80)).alias("after"))


QUERIES = {f.__name__: f for f in (warning_notes, warning_pages, first_words, term_filter, dispositions, select_reading, missing_pages, changed_pages_top, verify_readings, column_starts, row_groups, packets)}
_W = f"(SELECT reading_id, job_id, page_number, unnest(warnings) AS code FROM {BASE} b)"
_ORD = "CASE stage " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(STAGE_ORDER)) + " END"
ORACLES = {
    "warning_notes": f"SELECT code, count(*) AS n_readings, count(DISTINCT job_id) AS n_jobs, count(DISTINCT (job_id, page_number)) AS n_pages FROM {_W} w WHERE code IS NOT NULL GROUP BY 1",
    "warning_pages": f"SELECT job_id, code, string_agg(CASE WHEN f = l THEN f::VARCHAR ELSE f::VARCHAR || '-' || l::VARCHAR END, ', ' ORDER BY f) AS runs, sum(n)::BIGINT AS n FROM (SELECT job_id, code, min(page_number) AS f, max(page_number) AS l, count(*) AS n FROM (SELECT *, page_number - row_number() OVER (PARTITION BY job_id, code ORDER BY page_number) AS g FROM (SELECT DISTINCT job_id, code, page_number FROM {_W} w WHERE code IS NOT NULL AND page_number IS NOT NULL) q) q1 GROUP BY job_id, code, g) q2 GROUP BY 1, 2",
    "first_words": rf"SELECT job_id, page_id, array_to_string((string_split(trim(regexp_replace(selected_output.text, '\s+', ' ', 'g'), ' '), ' '))[1:12], ' ') AS words, length(selected_output.text) AS n_chars FROM {PAGES} p WHERE selected_output.text IS NOT NULL",
    "term_filter": "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(coalesce(content, ''), '{_term(t)}')) AS term_{i}" for i, t in enumerate(TERMS)) + f" FROM {BASE} b",
    "dispositions": "SELECT disposition, CASE " + " ".join(f"WHEN list_contains(r, '{h}') THEN '{h}'" for h in HOLDS) + f" END AS derived, count(*) AS n FROM (SELECT disposition, string_split(review_reasons, ';') AS r FROM {PAGES} p) q GROUP BY 1, 2",
    "select_reading": rf"SELECT job_id, page_id, reading_id, stage FROM (SELECT *, coalesce(len(warnings), 0) AS n, {_ORD} AS o FROM {BASE} b WHERE regexp_matches(coalesce(content, ''), '\S')) q QUALIFY row_number() OVER (PARTITION BY job_id, page_id ORDER BY n, CASE WHEN n = 0 THEN o ELSE 0 END, confidence DESC NULLS LAST, o, reading_id) = 1",
    "missing_pages": f"SELECT w.source_key, w.page_number FROM (SELECT source_key, unnest(generate_series(min(page_number), max(page_number)))::INTEGER AS page_number FROM {BASE} b WHERE page_number IS NOT NULL GROUP BY 1) w ANTI JOIN readings r ON r.source_key = w.source_key AND r.page_number = w.page_number",
    "changed_pages_top": f"SELECT job_id, page_id, length_delta FROM {_CMP} c WHERE status = 'different' ORDER BY job_id, page_id LIMIT 50",
    "verify_readings": rf"""SELECT 'content_conflict' AS code, reading_id FROM readings GROUP BY reading_id HAVING count(DISTINCT content) > 1
 UNION ALL SELECT 'page_number_mismatch', reading_id FROM {BASE} b WHERE try_cast(regexp_extract(page_id, '(\d+)$', 1) AS INTEGER) <> page_number UNION ALL SELECT 'confidence_out_of_range', reading_id FROM {BASE} b WHERE confidence < 0 OR confidence > 1
 UNION ALL SELECT 'usage_negative', reading_id FROM {BASE} b WHERE usage.tokens < 0 OR usage.compute_seconds < 0 OR usage.cost_usd < 0 UNION ALL SELECT 'time_order', reading_id FROM {BASE} b WHERE ingested_at < extracted_at
 UNION ALL SELECT 'unknown_source', reading_id FROM {BASE} b WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_key = b.source_key)""",
    "column_starts": f"SELECT page_id, cluster::BIGINT AS cluster, min(x0) AS start, count(*) AS n FROM (SELECT page_id, x0, sum(new) OVER (PARTITION BY page_id ORDER BY x0, item ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0, item) <= 30000 THEN 0 ELSE 1 END AS new FROM {BOXES} b) q) q1 GROUP BY 1, 2",
}
