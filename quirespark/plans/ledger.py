"""Roll-ups, order, joins and sets over readings and pages. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.functions.align import edit_distance
from quirespark.operators import ordered as O

BASE = """(SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY reading_id ORDER BY ingested_at) = 1)"""
CAP = 2000


def base(s: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Each reading once, as it came first: ``reading_id`` and ``columns``, computed in the scan, so that only they are read and shuffled."""
    r = s.read.parquet(f"{d}/readings.parquet").select("reading_id", "ingested_at", *columns)
    return r.groupBy("reading_id").agg(F.min_by(F.struct(*r.columns[2:]), "ingested_at").alias("r")).select("reading_id", "r.*")


def pages(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/page_results.parquet").dropDuplicates(["job_id", "page_id"])


PAGES = "(SELECT * FROM page_results QUALIFY row_number() OVER (PARTITION BY job_id, page_id ORDER BY page_number) = 1)"


def cost_rollup(s: SparkSession, d: str) -> DataFrame:
    """Usage by adapter and by stage in one pass: sums, and whether every reading's is known."""
    df = base(s, d, "adapter", "stage", "usage")
    return df.groupingSets([["adapter"], ["stage"]], "adapter", "stage").agg(
        F.count("*").alias("n_pages"), F.sum("usage.tokens").alias("tokens"), F.round(F.sum("usage.compute_seconds"), 3).alias("seconds"), F.round(F.sum("usage.cost_usd"), 8).alias("cost"),
        F.coalesce(F.bool_and(F.col("usage.cost_usd").isNotNull()), F.lit(False)).alias("cost_known"),
    )


def usage_summed(s: SparkSession, d: str) -> DataFrame:
    """A job's tokens, null unless every reading reported them, and the basis of its costs."""
    df = base(s, d, "job_id", "usage")
    t, c = F.col("usage.tokens"), F.col("usage.cost_usd")
    basis = F.when(F.count(c) == 0, "none").when(F.count(c) == F.count("*"), "reported").otherwise("mixed")
    return df.groupBy("job_id").agg(F.when(F.count(t) == F.count("*"), F.sum(t)).alias("tokens"), basis.alias("cost_basis"), F.count("*").alias("n_readings"))


def budget_alerts(s: SparkSession, d: str) -> DataFrame:
    df = base(s, d, "job_id", "extracted_at", F.length("content").alias("size"))
    return O.first_crossing(df, ["job_id"], ["extracted_at", "reading_id"], "size", CAP).select("job_id", "reading_id", F.col("running").cast("bigint").alias("running"))


def budget_stop(s: SparkSession, d: str) -> DataFrame:
    """Readings a job attempts before its running size reaches the cap, and those it doesn't."""
    df = base(s, d, "job_id", "extracted_at", F.coalesce(F.length("content"), F.lit(0)).alias("size"))
    t = O.running(df, ["job_id"], ["extracted_at", "reading_id"], "size").withColumn("before", F.col("running") - F.col("size"))
    return t.groupBy("job_id").agg(F.count_if(F.col("before") < CAP).alias("attempted"), F.count_if(F.col("before") >= CAP).alias("not_attempted"))


def circuit_breaker(s: SparkSession, d: str) -> DataFrame:
    """Three readings without text on end, in the order of a job's extraction."""
    empty = F.coalesce(F.trim(F.regexp_replace("content", r"\s", "")) == "", F.lit(True))
    df = base(s, d, "job_id", "extracted_at", empty.alias("empty"))
    return O.flagged_runs(df, ["job_id"], ["extracted_at", "reading_id"], F.col("empty"), 3)


def page_runs(s: SparkSession, d: str) -> DataFrame:
    return O.run_strings(base(s, d, "job_id", "page_number"), ["job_id"], "page_number")


def page_ranges(s: SparkSession, d: str) -> DataFrame:
    """Run strings read back: number and sum of the pages they name."""
    p = F.col("p")
    return page_runs(s, d).withColumn("p", X.page_range(F.col("runs"))).select("job_id", F.size(p).cast("bigint").alias("n"), F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def latest_attempts(s: SparkSession, d: str) -> DataFrame:
    return O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at"), ["job_id", "page_id", "stage"], [F.desc("extracted_at"), F.desc("reading_id")]).select("job_id", "page_id", "stage", "reading_id")


def _two(s: SparkSession, d: str) -> DataFrame:
    """A page's latest scan reading beside its latest image reading."""
    last = O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at", "content", "warnings", "confidence", "model").filter(F.col("stage").isin("local_ocr", "image")), ["job_id", "page_id", "stage"], [F.desc("extracted_at"), F.desc("reading_id")])
    side = [last.filter(F.col("stage") == st).select("job_id", "page_id", F.col("reading_id").alias(f"{n}_id"), F.col("content").alias(f"{n}_text"), F.coalesce("warnings", F.array().cast("array<string>")).alias(f"{n}_warnings"), F.col("confidence").alias(f"{n}_confidence"), F.col("model").alias(f"{n}_model")) for n, st in (("a", "local_ocr"), ("b", "image"))]
    return side[0].join(side[1], ["job_id", "page_id"], "full")


def compare_runs(s: SparkSession, d: str) -> DataFrame:
    j = _two(s, d)
    status = F.when(F.col("b_id").isNull(), "only_a").when(F.col("a_id").isNull(), "only_b").when(F.col("a_text").eqNullSafe(F.col("b_text")), "equal").otherwise("different")
    diff = lambda x, y: F.when(F.col("a_id").isNotNull() & F.col("b_id").isNotNull(), F.array_join(F.array_sort(F.array_distinct(F.array_except(x, y))), ";"))
    return j.select(
        "job_id", "page_id", status.alias("status"), (F.length("b_text") - F.length("a_text")).cast("bigint").alias("length_delta"), F.round(F.col("b_confidence") - F.col("a_confidence"), 6).alias("confidence_delta"),
        diff("a_warnings", "b_warnings").alias("resolved"), diff("b_warnings", "a_warnings").alias("introduced"),
    )


def compare_totals(s: SparkSession, d: str) -> DataFrame:
    c = compare_runs(s, d)
    n = lambda k: F.coalesce(F.sum(F.when(F.col(k) != "", F.size(F.split(k, ";"))).otherwise(0)), F.lit(0)).cast("bigint")
    return c.groupBy("status").agg(F.count("*").alias("n_pages"), n("resolved").alias("n_resolved"), n("introduced").alias("n_introduced"))


def pages_only_in(s: SparkSession, d: str) -> DataFrame:
    a, b = base(s, d, "job_id", "page_id").select("job_id", "page_id").distinct(), pages(s, d).select("job_id", "page_id")
    return a.exceptAll(b).withColumn("where", F.lit("readings")).unionByName(b.exceptAll(a).withColumn("where", F.lit("page_results"))).unionByName(a.intersect(b).withColumn("where", F.lit("both"))).groupBy("where").agg(F.count("*").alias("n"))


def short_readers(s: SparkSession, d: str) -> DataFrame:
    """Image readings of under half of the words of the page's literal readings, where those have forty or more."""
    words = F.size(F.filter(F.split(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")), " "), lambda x: x != "")).cast("bigint")
    df = base(s, d, "job_id", "page_id", "stage", words.alias("n"))
    df = df.withColumn("literal", F.max(F.when(F.col("stage") != "image", F.col("n"))).over(W.partitionBy("job_id", "page_id")))
    return df.filter((F.col("stage") == "image") & (F.col("literal") >= 40) & (F.col("n") < 0.5 * F.col("literal"))).select("reading_id", "n", "literal")


def reason_counts(s: SparkSession, d: str) -> DataFrame:
    r = pages(s, d).select("disposition", F.explode(F.split("review_reasons", ";")).alias("reason")).filter("reason != ''")
    return r.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == F.col("disposition")).alias("n_deciding")).orderBy(F.desc("n"), "reason")


def merged_reasons(s: SparkSession, d: str) -> DataFrame:
    """Each page's warnings of its last and first attempt merged, first occurrence kept, joined by +."""
    both = F.concat_ws(";", "initial_attempt_warnings", "last_attempt_warnings")
    return pages(s, d).select("job_id", "page_id", F.array_join(F.array_distinct(F.filter(F.split(both, ";"), lambda x: x != "")), "+").alias("reasons"))


def route_map(s: SparkSession, d: str) -> DataFrame:
    """Documents with their pages nested in order."""
    p = pages(s, d).select("source_key", "job_id", "page_number", "page_id", "disposition")
    return p.groupBy("source_key", "job_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "disposition"))).alias("p")).select("source_key", "job_id", F.size("p").cast("bigint").alias("n_pages"), F.array_join("p.page_id", ",").alias("pages"))


def pages_csv(s: SparkSession, d: str) -> DataFrame:
    """Page rows beside their selected reading, text safe for spreadsheets."""
    p = pages(s, d).select("job_id", "page_id", "selected_stage", "selected_characters", "selected_output.text")
    return p.select("job_id", "page_id", "selected_stage", "selected_characters", X.spreadsheet_safe(F.col("text")).alias("text"))


def natural_order(s: SparkSession, d: str) -> DataFrame:
    """Position of each source by name in natural order."""
    names = s.read.parquet(f"{d}/sources.parquet").select("source_key", F.concat(F.lit("page"), F.pmod(F.xxhash64(F.lit(0)), F.lit(7)) * 0 + F.col("page_count"), F.lit(".jpg")).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", X.natural_key(F.col("name")).alias("sort_key"))


def source_coverage(s: SparkSession, d: str) -> DataFrame:
    """Pages of each source that were read, against its page count, by a left join."""
    read = base(s, d, "source_key", "page_number").groupBy("source_key").agg(F.count_distinct("page_number").alias("pages_read"), F.max("page_number").alias("last_page"))
    src = s.read.parquet(f"{d}/sources.parquet").select("source_key", "page_count")
    return src.join(read, "source_key", "left").select("source_key", "page_count", F.coalesce("pages_read", F.lit(0)).cast("bigint").alias("pages_read"), F.coalesce(F.col("last_page") > F.col("page_count"), F.lit(False)).alias("beyond"))


def verify_pages(s: SparkSession, d: str) -> DataFrame:
    """Violations: duplicates, numbers that don't match the id, unknown pages, sources unknown or of another hash, wrong sizes and output hashes."""
    raw = s.read.parquet(f"{d}/page_results.parquet")
    p = pages(s, d)
    known = base(s, d, "job_id", "page_id").select("job_id", "page_id").distinct()
    src = s.read.parquet(f"{d}/sources.parquet").select("source_key", F.col("source_sha256").alias("want"))

    def bad(df: DataFrame, code: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), "job_id", "page_id")

    with_source = p.join(src, "source_key", "left")
    text = F.col("selected_output.text")
    return (
        bad(raw.groupBy("job_id", "page_id").agg(F.count("*").alias("n")).filter("n > 1"), "duplicate_page_id")
        .unionByName(bad(p.filter(F.regexp_extract("page_id", r"(\d+)$", 1).cast("int") != F.col("page_number")), "page_number_mismatch"))
        .unionByName(bad(p.join(known, ["job_id", "page_id"], "left_anti"), "unknown_page_reference"))
        .unionByName(bad(with_source.filter("want IS NULL"), "source_identity_missing"))
        .unionByName(bad(with_source.filter("want != source_sha256"), "source_identity_mismatch"))
        .unionByName(bad(p.filter(F.length(text) != F.col("selected_characters")), "selected_size_mismatch"))
        .unionByName(bad(p.filter(F.sha2(text, 256) != F.col("selected_output.output_sha256")), "output_hash_mismatch"))
    )


def verify_counts(s: SparkSession, d: str) -> DataFrame:
    return verify_pages(s, d).groupBy("code").agg(F.count("*").alias("n"))


def attempt_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a page's latest readings (a page has a few stages): share of common words, and whether their numbers differ."""
    own = base(s, d, "job_id", "page_id", "stage", "extracted_at", "content").filter("content IS NOT NULL")
    last = O.latest(own, ["job_id", "page_id", "stage"], [F.desc("extracted_at"), F.desc("reading_id")])
    r = last.select("job_id", "page_id", "reading_id", F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}+)"), 1)).alias("w"), F.array_sort(F.regexp_extract_all("content", F.lit(r"([0-9]+)"), 1)).alias("d"))
    a, b = r.select("job_id", "page_id", *[F.col(c).alias(f"a_{c}") for c in ("reading_id", "w", "d")]), r.select("job_id", "page_id", *[F.col(c).alias(f"b_{c}") for c in ("reading_id", "w", "d")])
    j = a.join(b, ["job_id", "page_id"]).filter("a_reading_id < b_reading_id")
    common = F.size(F.array_intersect("a_w", "b_w"))
    union = F.size("a_w") + F.size("b_w") - common
    return j.select("a_reading_id", "b_reading_id", F.when(union > 0, F.round(common.cast("double") / union, 4)).alias("agreement"), (F.col("a_d") != F.col("b_d")).alias("numeric_conflict"))


def _cer(s: SparkSession, d: str) -> DataFrame:
    """A page's selected text as reference for its latest readings by other stages, whole texts of every length. Where the latest reading is null or empty there is nothing to score; an older one doesn't stand in for it."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    last = O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at", "content"), ["job_id", "page_id", "stage"], [F.desc("extracted_at"), F.desc("reading_id")]).filter("content != ''").select("job_id", "page_id", "stage", "content")
    ref = pages(s, d).filter("selected_output.text != ''").select("job_id", "page_id", "selected_stage", F.col("selected_output.text").alias("ref"))
    e = last.join(ref, ["job_id", "page_id"]).filter("stage != selected_stage").select("job_id", "page_id", "stage", squeeze("ref").alias("ref"), squeeze("content").alias("got")).filter("ref != ''")
    return e.select("job_id", "page_id", "stage", edit_distance("ref", "got").alias("edits"), F.length("ref").cast("bigint").alias("chars"))


def cer_pages(s: SparkSession, d: str) -> DataFrame:
    return _cer(s, d).select("job_id", "page_id", "stage", "edits", "chars", F.round(F.col("edits").cast("double") / F.col("chars"), 4).alias("cer"))


def cer_summary(s: SparkSession, d: str) -> DataFrame:
    """Micro-averaged character error of each stage and of each job, in one pass."""
    return _cer(s, d).groupingSets([["stage"], ["job_id"]], "stage", "job_id").agg(F.count("*").alias("n_pages"), F.sum("edits").alias("edits"), F.sum("chars").alias("chars"), F.round(F.sum("edits").cast("double") / F.sum("chars"), 4).alias("cer"))


def worst_pages(s: SparkSession, d: str) -> DataFrame:
    return cer_pages(s, d).orderBy(F.desc("cer"), F.desc("edits"), "job_id", "page_id", "stage").limit(5)


def historical_counts(s: SparkSession, d: str) -> DataFrame:
    """Old letters of each source's readings."""
    counts = [X.count(F.coalesce("content", F.lit("")), f"[{c}]").alias(n) for n, c in (("yat", "ѣѢ"), ("dotted_i", "іІ"), ("fita", "ѳѲ"), ("izhitsa", "ѵѴ"))]
    return base(s, d, "source_key", *counts).groupBy("source_key").agg(*[F.sum(n).alias(n) for n in ("yat", "dotted_i", "fita", "izhitsa")])


def word_changes(s: SparkSession, d: str) -> DataFrame:
    """Words of a page's selected text against its latest scan reading as bags: kept, added, removed."""
    last = O.latest(base(s, d, "job_id", "page_id", "stage", "extracted_at", "content").filter("stage = 'local_ocr' AND content IS NOT NULL"), ["job_id", "page_id"], [F.desc("extracted_at"), F.desc("reading_id")])
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), 1)).alias("w")
    a = last.select("job_id", "page_id", words("content")).groupBy("job_id", "page_id", "w").agg(F.count("*").alias("a"))
    b = pages(s, d).filter("selected_output.text IS NOT NULL").select("job_id", "page_id", words("selected_output.text")).groupBy("job_id", "page_id", "w").agg(F.count("*").alias("b"))
    both = last.select("job_id", "page_id").join(pages(s, d).filter("selected_output.text IS NOT NULL").select("job_id", "page_id"), ["job_id", "page_id"])
    j = a.join(b, ["job_id", "page_id", "w"], "full").fillna(0, ["a", "b"]).join(both, ["job_id", "page_id"], "left_semi")
    return j.groupBy("job_id", "page_id").agg(F.sum(F.least("a", "b")).alias("kept"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed"))


QUERIES = {f.__name__: f for f in (
    cost_rollup, usage_summed, budget_alerts, budget_stop, circuit_breaker, page_runs, page_ranges, latest_attempts, compare_runs, compare_totals, pages_only_in, short_readers, reason_counts, merged_reasons,
    route_map, pages_csv, natural_order, source_coverage, verify_pages, verify_counts, attempt_pairs, cer_pages, cer_summary, worst_pages, historical_counts, word_changes,
)}
_LATEST = f"(SELECT * FROM {BASE} q0 {{where}} QUALIFY row_number() OVER (PARTITION BY job_id, page_id, stage ORDER BY extracted_at DESC, reading_id DESC) = 1)"
_L = lambda w="": _LATEST.replace("{where}", w)
_ISL = f"(SELECT job_id, min(page_number) AS f, max(page_number) AS l, count(*) AS n FROM (SELECT job_id, page_number, page_number - row_number() OVER (PARTITION BY job_id ORDER BY page_number) AS g FROM (SELECT DISTINCT job_id, page_number FROM {BASE} b WHERE page_number IS NOT NULL) q1) q2 GROUP BY job_id, g)"
_RUNNING = f"(SELECT job_id, reading_id, extracted_at, coalesce(length(content), 0) AS size, sum(coalesce(length(content), 0)) OVER (PARTITION BY job_id ORDER BY extracted_at, reading_id ROWS UNBOUNDED PRECEDING) AS running FROM {BASE} b)"
_TWO = f"(SELECT job_id, page_id, a.reading_id AS a_id, b.reading_id AS b_id, a.content AS a_text, b.content AS b_text, coalesce(a.warnings, []) AS a_w, coalesce(b.warnings, []) AS b_w, a.confidence AS a_c, b.confidence AS b_c FROM (SELECT * FROM {_L()} l WHERE stage = 'local_ocr') a FULL JOIN (SELECT * FROM {_L()} l WHERE stage = 'image') b USING (job_id, page_id))"
_CMP = f"""(SELECT job_id, page_id, CASE WHEN b_id IS NULL THEN 'only_a' WHEN a_id IS NULL THEN 'only_b' WHEN a_text IS NOT DISTINCT FROM b_text THEN 'equal' ELSE 'different' END AS status, (length(b_text) - length(a_text))::BIGINT AS length_delta, round(b_c - a_c, 6) AS confidence_delta,
 CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(a_w, lambda x: NOT list_contains(b_w, x)))), ';') END AS resolved, CASE WHEN a_id IS NOT NULL AND b_id IS NOT NULL THEN array_to_string(list_sort(list_distinct(list_filter(b_w, lambda x: NOT list_contains(a_w, x)))), ';') END AS introduced FROM {_TWO} t)"""
_PW = "len(list_filter(string_split(trim(regexp_replace(coalesce(content, ''), '\\s+', ' ', 'g'), ' '), ' '), lambda x: x <> ''))"
_VIOL = f"""(SELECT 'duplicate_page_id' AS code, job_id, page_id FROM page_results GROUP BY job_id, page_id HAVING count(*) > 1
 UNION ALL SELECT 'page_number_mismatch', job_id, page_id FROM {PAGES} p WHERE try_cast(regexp_extract(page_id, '(\\d+)$', 1) AS INTEGER) <> page_number
 UNION ALL SELECT 'unknown_page_reference', job_id, page_id FROM {PAGES} p WHERE NOT EXISTS (SELECT 1 FROM readings r WHERE r.job_id = p.job_id AND r.page_id = p.page_id)
 UNION ALL SELECT 'source_identity_missing', job_id, page_id FROM {PAGES} p LEFT JOIN sources s USING (source_key) WHERE s.source_sha256 IS NULL
 UNION ALL SELECT 'source_identity_mismatch', job_id, page_id FROM {PAGES} p JOIN sources s USING (source_key) WHERE s.source_sha256 <> p.source_sha256
 UNION ALL SELECT 'selected_size_mismatch', job_id, page_id FROM {PAGES} p WHERE length(selected_output.text) <> selected_characters
 UNION ALL SELECT 'output_hash_mismatch', job_id, page_id FROM {PAGES} p WHERE sha256(selected_output.text) <> selected_output.output_sha256)"""
ORACLES = {
    "cost_rollup": f"SELECT adapter, stage, count(*) AS n_pages, sum(usage.tokens)::BIGINT AS tokens, round(sum(usage.compute_seconds), 3) AS seconds, round(sum(usage.cost_usd), 8) AS cost, coalesce(bool_and(usage.cost_usd IS NOT NULL), false) AS cost_known FROM {BASE} b GROUP BY GROUPING SETS ((adapter), (stage))",
    "usage_summed": f"SELECT job_id, CASE WHEN count(usage.tokens) = count(*) THEN sum(usage.tokens)::BIGINT END AS tokens, CASE WHEN count(usage.cost_usd) = 0 THEN 'none' WHEN count(usage.cost_usd) = count(*) THEN 'reported' ELSE 'mixed' END AS cost_basis, count(*) AS n_readings FROM {BASE} b GROUP BY 1",
    "budget_alerts": f"SELECT job_id, reading_id, running::BIGINT AS running FROM {_RUNNING} r WHERE running >= {CAP} QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY extracted_at, reading_id) = 1",
    "budget_stop": f"SELECT job_id, count(*) FILTER (running - size < {CAP}) AS attempted, count(*) FILTER (running - size >= {CAP}) AS not_attempted FROM {_RUNNING} r GROUP BY 1",
    "circuit_breaker": rf"SELECT job_id, count(*) AS length, min(reading_id) AS first, max(reading_id) AS last FROM (SELECT job_id, reading_id, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY extracted_at, reading_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT job_id, reading_id, extracted_at, coalesce(regexp_replace(content, '\s', '', 'g') = '', true) AS f FROM {BASE} b) q1) q2 WHERE f GROUP BY job_id, g HAVING count(*) >= 3",
    "page_runs": f"SELECT job_id, string_agg(CASE WHEN f = l THEN f::VARCHAR ELSE f::VARCHAR || '-' || l::VARCHAR END, ', ' ORDER BY f) AS runs, sum(n)::BIGINT AS n FROM {_ISL} i GROUP BY 1",
    "page_ranges": f"SELECT job_id, count(DISTINCT page_number) AS n, sum(DISTINCT page_number)::BIGINT AS total FROM {BASE} b WHERE page_number IS NOT NULL GROUP BY 1",
    "latest_attempts": f"SELECT job_id, page_id, stage, reading_id FROM {_L()} l",
    "compare_runs": f"SELECT * FROM {_CMP} c",
    "compare_totals": f"SELECT status, count(*) AS n_pages, coalesce(sum(CASE WHEN resolved <> '' THEN len(string_split(resolved, ';')) ELSE 0 END), 0)::BIGINT AS n_resolved, coalesce(sum(CASE WHEN introduced <> '' THEN len(string_split(introduced, ';')) ELSE 0 END), 0)::BIGINT AS n_introduced FROM {_CMP} c GROUP BY 1",
    "pages_only_in": "WITH a AS (SELECT DISTINCT job_id, page_id FROM readings), b AS (SELECT DISTINCT job_id, page_id FROM page_results) SELECT \"where\", n FROM (SELECT 'readings' AS \"where\", count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'page_results', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) z WHERE n > 0",
    "short_readers": f"SELECT reading_id, n, literal FROM (SELECT reading_id, stage, n, max(CASE WHEN stage <> 'image' THEN n END) OVER (PARTITION BY job_id, page_id) AS literal FROM (SELECT reading_id, job_id, page_id, stage, {_PW} AS n FROM {BASE} b) q1) q2 WHERE stage = 'image' AND literal >= 40 AND n < 0.5 * literal",
    "reason_counts": f"SELECT reason, count(*) AS n, count(*) FILTER (reason = disposition) AS n_deciding FROM (SELECT disposition, unnest(string_split(review_reasons, ';')) AS reason FROM {PAGES} p) q WHERE reason <> '' GROUP BY 1",
    "merged_reasons": f"SELECT job_id, page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+') AS reasons FROM (SELECT job_id, page_id, list_filter(string_split(concat_ws(';', initial_attempt_warnings, last_attempt_warnings), ';'), lambda x: x <> '') AS l FROM {PAGES} p) q",
    "route_map": f"SELECT source_key, job_id, count(*) AS n_pages, string_agg(page_id, ',' ORDER BY page_number, page_id) AS pages FROM {PAGES} p GROUP BY 1, 2",
    "pages_csv": f"SELECT job_id, page_id, selected_stage, selected_characters, CASE WHEN selected_output.text[1] IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || selected_output.text ELSE selected_output.text END AS text FROM {PAGES} p",
    "natural_order": "SELECT name, count(*) AS n, 'page' || lpad(page_count::VARCHAR, 20, '0') || '.jpg' AS sort_key FROM (SELECT 'page' || page_count || '.jpg' AS name, page_count FROM sources) q GROUP BY name, page_count",
    "source_coverage": f"SELECT s.source_key, s.page_count, coalesce(r.pages_read, 0)::BIGINT AS pages_read, coalesce(r.last_page > s.page_count, false) AS beyond FROM sources s LEFT JOIN (SELECT source_key, count(DISTINCT page_number) AS pages_read, max(page_number) AS last_page FROM {BASE} b GROUP BY 1) r USING (source_key)",
    "verify_pages": f"SELECT * FROM {_VIOL} v",
    "verify_counts": f"SELECT code, count(*) AS n FROM {_VIOL} v GROUP BY 1",
    "attempt_pairs": rf"WITH r AS (SELECT job_id, page_id, reading_id, list_distinct(regexp_extract_all(lower(content), '\p{{L}}+')) AS w, list_sort(regexp_extract_all(content, '[0-9]+')) AS d FROM {_L('WHERE content IS NOT NULL')} l) SELECT a.reading_id AS a_reading_id, b.reading_id AS b_reading_id, CASE WHEN len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) > 0 THEN round(len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 4) END AS agreement, a.d <> b.d AS numeric_conflict FROM r a JOIN r b USING (job_id, page_id) WHERE a.reading_id < b.reading_id",
    "historical_counts": f"SELECT source_key, sum(len(regexp_extract_all(coalesce(content, ''), '[ѣѢ]')))::BIGINT AS yat, sum(len(regexp_extract_all(coalesce(content, ''), '[іІ]')))::BIGINT AS dotted_i, sum(len(regexp_extract_all(coalesce(content, ''), '[ѳѲ]')))::BIGINT AS fita, sum(len(regexp_extract_all(coalesce(content, ''), '[ѵѴ]')))::BIGINT AS izhitsa FROM {BASE} b GROUP BY 1",
    "word_changes": rf"""WITH last AS (SELECT job_id, page_id, content FROM {_L("WHERE stage = 'local_ocr' AND content IS NOT NULL")} l), sel AS (SELECT job_id, page_id, selected_output.text AS t FROM {PAGES} p WHERE selected_output.text IS NOT NULL),
 a AS (SELECT job_id, page_id, w, count(*) AS n FROM (SELECT job_id, page_id, unnest(regexp_extract_all(lower(content), '\p{{L}}+')) AS w FROM last) q GROUP BY ALL), b AS (SELECT job_id, page_id, w, count(*) AS n FROM (SELECT job_id, page_id, unnest(regexp_extract_all(lower(t), '\p{{L}}+')) AS w FROM sel) q GROUP BY ALL)
 SELECT job_id, page_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS kept, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS added, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS removed FROM a FULL JOIN b USING (job_id, page_id, w) WHERE EXISTS (SELECT 1 FROM last x WHERE x.job_id = job_id AND x.page_id = page_id) AND (job_id, page_id) IN (SELECT (job_id, page_id) FROM last) AND (job_id, page_id) IN (SELECT (job_id, page_id) FROM sel) GROUP BY 1, 2""",
}
