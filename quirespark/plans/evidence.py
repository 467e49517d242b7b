"""Queues, line matching, declared languages, histories and lineage. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.functions import align as A
from quirespark.functions import text as X
from quirespark.operators import nested
from quirespark.operators import ordered as O
from quirespark.plans.ledger import _L, BASE, PAGES, base, pages
from quirespark.plans.quality import READS, SQL_QUALITY, quality, reads

STAGES = ("local_text", "local_ocr", "second_ocr", "local_image", "image", "second_opinion")


def review_queue(s: SparkSession, d: str) -> DataFrame:
    """One row a reading and reason, in the order of the reasons."""
    q = quality(reads(s, d))
    reasons = F.array_compact(F.array(F.when(F.col("type_confidence").isNull(), "unsure_type"), F.when(F.size("quality_warnings") > 0, "quality_warning"), F.when(F.col("grade") > "C", "grade_below_threshold")))
    return q.select("reading_id", F.posexplode(reasons).alias("i", "reason")).select("reading_id", (F.col("i") + 1).cast("bigint").alias("position"), "reason")


def rerun_plan(s: SparkSession, d: str) -> DataFrame:
    """Pages with a queued reading, less those with one of the best grade; reasons merged."""
    q = quality(reads(s, d)).select("reading_id", "job_id", "page_id", "grade")
    queued = review_queue(s, d).join(q, "reading_id")
    good = q.filter("grade = 'A'").select("job_id", "page_id").distinct()
    return queued.join(good, ["job_id", "page_id"], "left_anti").groupBy("job_id", "page_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), "+").alias("reasons"), F.max("grade").alias("worst"))


def stage_accounting(s: SparkSession, d: str) -> DataFrame:
    """Every configured stage with its readings and pages, and why there are none."""
    stages = s.createDataFrame([(i, x) for i, x in enumerate(STAGES)], "position bigint, stage string")
    n = base(s, d, "stage", "job_id", "page_id").groupBy("stage").agg(F.count("*").alias("readings"), F.count_distinct("job_id", "page_id").alias("n_pages"))
    return stages.join(n, "stage", "left").fillna(0, ["readings", "n_pages"]).withColumn("reason", F.when(F.col("readings") == 0, "not_run").otherwise(""))


def declared_language(s: SparkSession, d: str) -> DataFrame:
    """Readings of 200 letters or more of which under half are of the declared language's script."""
    lang, t = F.lower("lang"), F.coalesce("content", F.lit(""))
    cyrillic = lang.isin("rus", "ru", "russian", "orus", "ukr", "uk", "ukrainian")
    own = F.when(cyrillic, X.count(t, r"\p{IsCyrillic}")).otherwise(X.count(t, r"\p{IsLatin}"))
    r = base(s, d, lang.alias("lang"), X.count(t, r"\p{L}").alias("letters"), own.alias("own"))
    out = r.filter("lang IS NOT NULL AND lang NOT IN ('', ' ', 'und', 'osd', 'unknown') AND NOT contains(lang, '+')")
    return out.filter((F.col("letters") >= 200) & (F.col("own") < 0.5 * F.col("letters")))


def heading_carry(s: SparkSession, d: str) -> DataFrame:
    """Lines under each document's last heading before them: number of lines by heading position."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    head = docs.withColumn("h", F.when(F.col("line").startswith("#"), F.col("i")))
    carried = head.withColumn("heading", F.last("h", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return carried.groupBy("doc_id", "heading").agg(F.count("*").alias("n_lines"))


def limit_history(s: SparkSession, d: str) -> DataFrame:
    """Raises of each record's limit replayed in order: whether each starts from where the last ended, and the limit that holds."""
    rows = nested.table(nested.shred(s.read.parquet(f"{d}/job_records.parquet").select("record_id", "record_json")), "limits.history", ("previous", "raised_to"))
    t = rows.select("record_id", "ordinal", F.col("previous").cast("bigint").alias("previous"), F.col("raised_to").cast("bigint").alias("raised_to"))
    t = t.withColumn("before", F.lag("raised_to").over(W.partitionBy("record_id").orderBy("ordinal")))
    return t.groupBy("record_id").agg(F.count("*").alias("n_raises"), F.bool_and(F.coalesce(F.col("before") == F.col("previous"), F.lit(True))).alias("consistent"), F.max_by("raised_to", "ordinal").alias("effective"))


def lineage_depth(s: SparkSession, d: str) -> DataFrame:
    """Depth of each part in the tree in which part n descends from part n // 2: its binary digits less one, at any number of parts and with any missing."""
    parts = s.read.parquet(f"{d}/part.parquet").filter("p_partkey >= 1")
    return parts.select("p_partkey", (F.length(F.bin("p_partkey")) - 1).cast("bigint").alias("depth"))


def _line_pairs(s: SparkSession, d: str, raw: bool = False) -> DataFrame:
    """A page's lines of its selected text beside those of its latest scan reading: a row a page, so that texts are shuffled and not their trigrams."""
    keys = ["job_id", "page_id"]
    page = s.read.parquet(f"{d}/page_results.parquet").select(*keys, "page_number", F.col("selected_output.text").alias("ref"))
    ref = O.latest(page, keys, [F.asc_nulls_last("page_number")]).filter("ref IS NOT NULL")
    scan = base(s, d, *keys, "stage", "extracted_at", F.when(F.col("stage") == "local_ocr", F.col("content")).alias("got")).filter("stage = 'local_ocr'")
    last = O.latest(scan, keys, [F.desc("extracted_at"), F.desc("reading_id")]).filter("got IS NOT NULL")
    return ref.select(*keys, "ref").join(last.select(*keys, "got"), keys).select(*keys, A.lines(F.col("ref"), raw).alias("ref"), A.lines(F.col("got"), raw).alias("got"))


def trigram_candidates(s: SparkSession, d: str, k: int = 3) -> DataFrame:
    """For each line of a page's selected text, the lines of its latest scan reading that share most trigrams."""
    best = _line_pairs(s, d).select("job_id", "page_id", A.nearest_lines(k)("ref", "got").alias("m"))
    return best.select("job_id", "page_id", F.inline("m"))


def matched_lines(s: SparkSession, d: str) -> DataFrame:
    """The best candidate of each line, aligned: edits of the nearest stretch, and whether the line is missing (over half)."""
    best = _line_pairs(s, d, raw=True).select("job_id", "page_id", A.nearest_edits("ref", "got").alias("m"))
    return best.select("job_id", "page_id", F.inline("m")).select("job_id", "page_id", "ref_no", "edits", (F.col("edits") * 2 > F.col("n")).alias("missing"))


def numbers_found(s: SparkSession, d: str) -> DataFrame:
    """Of a page's numbers in its selected text, how many its latest scan reading holds too."""
    last = O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at", "content").filter("stage = 'local_ocr'"), ["job_id", "page_id"], [F.desc("extracted_at"), F.desc("reading_id")]).select("job_id", "page_id", F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"([0-9]+)"), 1)).alias("g"))
    ref = pages(s, d).select("job_id", "page_id", F.array_distinct(F.regexp_extract_all(F.coalesce("selected_output.text", F.lit("")), F.lit(r"([0-9]+)"), 1)).alias("r"))
    return ref.join(last, ["job_id", "page_id"]).select("job_id", "page_id", F.size("r").cast("bigint").alias("n_numbers"), F.size(F.array_intersect("r", "g")).cast("bigint").alias("n_found"))


def line_pieces(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").filter("text != ''")
    return docs.select("doc_id", F.posexplode(A.pieces(F.col("text"))).alias("i", "p")).select("doc_id", F.col("i").cast("bigint").alias("i"), F.length("p").cast("bigint").alias("n"))


def source_status(s: SparkSession, d: str) -> DataFrame:
    """Whether each page's source is the same, changed or unknown."""
    src = s.read.parquet(f"{d}/sources.parquet").select("source_key", F.col("source_sha256").alias("want"))
    j = pages(s, d).join(src, "source_key", "left")
    status = F.when(F.col("want").isNull() | F.col("source_sha256").isNull(), "unknown").when(F.col("want") == F.col("source_sha256"), "same").otherwise("changed")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def right_to_left(s: SparkSession, d: str) -> DataFrame:
    """Documents with right-to-left letters, and how many."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", X.count(F.coalesce("text", F.lit("")), r"[\p{IsHebrew}\p{IsArabic}]").alias("n")).filter("n > 0")


QUERIES = {f.__name__: f for f in (review_queue, rerun_plan, stage_accounting, declared_language, heading_carry, limit_history, lineage_depth, trigram_candidates, matched_lines, numbers_found, line_pieces, source_status, right_to_left)}
_QUEUE = f"(SELECT reading_id, unnest(list_filter([CASE WHEN type_confidence IS NULL THEN 'unsure_type' END, CASE WHEN len(ws) > 0 THEN 'quality_warning' END, CASE WHEN grade > 'C' THEN 'grade_below_threshold' END], lambda x: x IS NOT NULL)) AS reason, generate_subscripts(list_filter([CASE WHEN type_confidence IS NULL THEN 1 END, CASE WHEN len(ws) > 0 THEN 1 END, CASE WHEN grade > 'C' THEN 1 END], lambda x: x IS NOT NULL), 1) AS position FROM ({SQL_QUALITY}) z)"
_GRADES = f"(SELECT z.reading_id, r.job_id, r.page_id, grade FROM ({SQL_QUALITY}) z JOIN {READS} r USING (reading_id))"
_LN = lambda src, name: f"(SELECT job_id, page_id, i - 1 AS {name}_no, l[i] AS line FROM (SELECT job_id, page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT job_id, page_id, string_split(t, chr(10)) AS l FROM {src} s0) q) q1 WHERE length(trim(l[i], ' ')) >= 3)"
_TG = lambda src, name: rf"(SELECT DISTINCT job_id, page_id, {name}_no, CASE WHEN length(t) < 3 THEN t ELSE substring(t, k, 3) END AS g FROM (SELECT job_id, page_id, {name}_no, t, unnest(generate_series(1, greatest(length(t) - 2, 1))) AS k FROM (SELECT job_id, page_id, {name}_no, regexp_replace(lower(trim(line, ' ')), '\s+', ' ', 'g') AS t FROM {src} s1) q) q1)"
_REFL = _LN(f"(SELECT job_id, page_id, selected_output.text AS t FROM {PAGES} p)", "ref")
_GOTL = _LN(f"(SELECT job_id, page_id, content AS t FROM (SELECT * FROM {_L()} l WHERE stage = 'local_ocr') l)", "got")
_NUMS = lambda c: f"list_distinct(regexp_extract_all(coalesce({c}, ''), '[0-9]+'))"
ORACLES = {
    "review_queue": f"SELECT reading_id, position, reason FROM {_QUEUE} q",
    "rerun_plan": f"WITH g AS {_GRADES}, q AS {_QUEUE} SELECT job_id, page_id, array_to_string(list_sort(list_distinct(list(reason))), '+') AS reasons, max(grade) AS worst FROM q JOIN g USING (reading_id) WHERE (job_id, page_id) NOT IN (SELECT (job_id, page_id) FROM g WHERE grade = 'A') GROUP BY 1, 2",
    "stage_accounting": f"SELECT v.stage, v.position::BIGINT AS position, count(b.reading_id) AS readings, count(DISTINCT b.job_id || '/' || b.page_id) AS n_pages, CASE WHEN count(b.reading_id) = 0 THEN 'not_run' ELSE '' END AS reason FROM (VALUES {', '.join(f'({i}, {chr(39)}{x}{chr(39)})' for i, x in enumerate(STAGES))}) v(position, stage) LEFT JOIN {BASE} b ON b.stage = v.stage GROUP BY 1, 2",
    "declared_language": rf"SELECT * FROM (SELECT reading_id, lower(lang) AS lang, len(regexp_extract_all(coalesce(content, ''), '\p{{L}}')) AS letters, CASE WHEN lower(lang) IN ('rus', 'ru', 'russian', 'orus', 'ukr', 'uk', 'ukrainian') THEN len(regexp_extract_all(coalesce(content, ''), '\p{{Cyrillic}}')) ELSE len(regexp_extract_all(coalesce(content, ''), '\p{{Latin}}')) END AS own FROM {BASE} b WHERE lang IS NOT NULL AND lower(lang) NOT IN ('', ' ', 'und', 'osd', 'unknown') AND NOT contains(lang, '+')) q WHERE letters >= 200 AND own < 0.5 * letters",
    "heading_carry": "SELECT doc_id, heading, count(*) AS n_lines FROM (SELECT doc_id, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading FROM (SELECT doc_id, i, CASE WHEN starts_with(line, '#') THEN (i - 1)::INTEGER END AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) q) q1) q2 GROUP BY 1, 2",
    "limit_history": "SELECT record_id, count(*) AS n_raises, bool_and(coalesce(before = previous, true)) AS consistent, arg_max(raised_to, i) AS effective FROM (SELECT *, lag(raised_to) OVER (PARTITION BY record_id ORDER BY i) AS before FROM (SELECT record_id, i, (h[i]->>'previous')::BIGINT AS previous, (h[i]->>'raised_to')::BIGINT AS raised_to FROM (SELECT record_id, h, unnest(generate_series(1, len(h))) AS i FROM (SELECT record_id, json_extract(coalesce(record_json::JSON->'payload', record_json::JSON), '$.limits.history')::JSON[] AS h FROM job_records WHERE record_json IS NOT NULL) q WHERE h IS NOT NULL) q1) q2) q3 GROUP BY 1",
    "lineage_depth": "SELECT p_partkey, floor(log2(p_partkey))::BIGINT AS depth FROM part WHERE p_partkey >= 1",
    "trigram_candidates": f"SELECT job_id, page_id, ref_no, got_no, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_id, ref_no ORDER BY shared DESC, got_no) AS rank FROM (SELECT job_id, page_id, ref_no, got_no, count(*) AS shared FROM {_TG(_REFL, 'ref')} a JOIN {_TG(_GOTL, 'got')} b USING (job_id, page_id, g) GROUP BY ALL) q) q1 WHERE rank <= 3",
    "numbers_found": f"SELECT job_id, page_id, len({_NUMS('p.selected_output.text')}) AS n_numbers, len(list_intersect({_NUMS('p.selected_output.text')}, {_NUMS('l.content')})) AS n_found FROM {PAGES} p JOIN (SELECT * FROM {_L()} l0 WHERE stage = 'local_ocr') l USING (job_id, page_id)",
    "line_pieces": "SELECT doc_id, i - 1 AS i, CASE WHEN n <= 400 THEN n ELSE least(400, n - (i - 1) * 200) END AS n FROM (SELECT doc_id, length(text) AS n, unnest(generate_series(1, CASE WHEN length(text) <= 400 THEN 1 ELSE (length(text) - 201) // 200 + 1 END)) AS i FROM documents WHERE text <> '') q",
    "source_status": f"SELECT CASE WHEN s.source_sha256 IS NULL OR p.source_sha256 IS NULL THEN 'unknown' WHEN s.source_sha256 = p.source_sha256 THEN 'same' ELSE 'changed' END AS status, count(*) AS n FROM {PAGES} p LEFT JOIN sources s USING (source_key) GROUP BY 1",
    "right_to_left": r"SELECT doc_id, n FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{Hebrew}\p{Arabic}]')) AS n FROM documents) q WHERE n > 0",
}
