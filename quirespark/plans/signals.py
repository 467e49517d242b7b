"""Scripts, loops, remarks, costs, summaries and comparability of readings. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.functions import signals as G
from quirespark.functions import text as X
from quirespark.operators import ordered as O
from quirespark.plans.ledger import BASE, PAGES, base, pages, word_changes
from quirespark.plans.ledger import ORACLES as LEDGER_SQL
from quirespark.plans.quality import READS, SQL_QUALITY, once, quality, raw, reads

PER_PAGE, PER_1K_TOKENS = 0.01, 0.002
#: Unit -> (absolute warning, cap); warnings stand at ``WARN_PERCENT`` of a cap too.
LIMITS = {"pages": (12, 10), "tokens": (None, 20_000), "usd": (0.05, None)}
WARN_PERCENT = 80
SAMPLE = 15


def coverage_signals(s: SparkSession, d: str) -> DataFrame:
    """Mixed-script tokens, private-use and foreign-script characters of each reading, with their warnings."""
    t = F.col("content")
    m = once(raw(s, d).select("reading_id", G.mixed_script_ratio(t).alias("mixed_script_ratio"), G.private_use(t).alias("private_use"), G.foreign_script(t).alias("foreign_script"), F.size(X.tokens(F.coalesce(t, F.lit("")))).alias("n"), X.count(F.coalesce(t, F.lit("")), r"\p{L}").alias("letters")))
    foreign = (F.col("foreign_script") >= G.FOREIGN_MIN) & (F.col("foreign_script") < G.FOREIGN_MAX_SHARE * F.col("letters"))
    rules = G.codes(((F.col("n") >= G.MIXED_MIN_TOKENS) & (F.col("mixed_script_ratio") >= G.MIXED_MIN_RATIO), "mixed_script_tokens"), (F.col("private_use") >= G.PRIVATE_MIN, "private_use_characters"), (foreign, "foreign_script_characters"))
    return m.select("reading_id", "mixed_script_ratio", "private_use", "foreign_script", rules.alias("warnings"))


def loop_signals(s: SparkSession, d: str) -> DataFrame:
    """Longest run of a letter and whether the ending repeats, for each reading."""
    t = F.col("content")
    return once(raw(s, d).select("reading_id", G.letter_run(t).alias("letter_run"), (G.repeated_tail(t) > 0).alias("tail_repeats")))


def misread_signals(s: SparkSession, d: str) -> DataFrame:
    """Impossible capitals, and leaders without values, of each reading."""
    t = F.col("content")
    m = once(raw(s, d).select("reading_id", G.capital_signs(t).alias("capital_signs"), G.unfinished_leaders(t).alias("unfinished"), G.numeric_lines(t).alias("numeric_lines")))
    lost = (F.col("unfinished") >= G.LEADERS_MIN) & (F.col("numeric_lines") < F.col("unfinished") / 2)
    return m.withColumn("labels_without_values", lost)


def split_words(s: SparkSession, d: str) -> DataFrame:
    """Cyrillic tokens and stray letters of each reading that has any, and whether its words are broken."""
    t = F.col("content")
    m = once(raw(s, d).select("reading_id", G.cyrillic_tokens(t).alias("tokens"), G.stray_letters(t).alias("stray"))).filter("tokens > 0")
    return m.withColumn("split_words", (F.col("tokens") >= G.SPLIT_MIN_TOKENS) & (F.col("stray") >= G.SPLIT_MIN_SHARE * F.col("tokens")))


def model_remarks(s: SparkSession, d: str) -> DataFrame:
    """Documents in which a model speaks about its own reading."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", G.partial_transcription(F.col("text")).alias("partial_transcription"), G.model_commentary(F.col("text")).alias("model_commentary"))


def old_letters_lost(s: SparkSession, d: str) -> DataFrame:
    """Readings declared as old Russian print with and without the old spelling, by source."""
    own = raw(s, d, "lang").filter(F.lower("lang") == "orus")
    m = once(own.select("reading_id", "source_key", G.historical_letters_lost(F.col("content")).alias("lost")))
    return m.groupBy("source_key").agg(F.count("*").alias("n_readings"), F.count_if("lost").alias("n_lost"))


def derived_costs(s: SparkSession, d: str) -> DataFrame:
    """Cost of each adapter's readings: what it reported, else the rates by page and by thousand tokens; unknown where tokens are."""
    u = F.col("usage")
    rated = F.when(u["tokens"].isNotNull(), PER_PAGE * F.coalesce(u["pages"], F.lit(0)) + PER_1K_TOKENS * (u["tokens"] / 1000))
    r = base(s, d, "adapter", F.coalesce(u["cost_usd"], rated).alias("cost"), F.when(u["cost_usd"].isNotNull(), "adapter_reported").when(rated.isNotNull(), "configured_rate").alias("basis"))
    one = r.groupBy("adapter").agg(F.round(F.sum("cost"), 8).alias("cost"), F.count("*").alias("n_readings"), F.count("basis").alias("n_known"), F.array_sort(F.collect_set("basis")).alias("b"))
    return one.select("adapter", "cost", "n_readings", "n_known", F.when(F.size("b") == 0, "none").when(F.size("b") > 1, "mixed").otherwise(F.try_element_at("b", F.lit(1))).alias("basis"))


def warning_thresholds(s: SparkSession, d: str) -> DataFrame:
    """Effective warning threshold of each unit, the lesser of the absolute one and the percentage of the cap, against each job's usage."""
    now = base(s, d, "job_id", "usage").groupBy("job_id").agg(F.coalesce(F.sum("usage.pages"), F.lit(0)).cast("double").alias("pages"), F.coalesce(F.sum("usage.tokens"), F.lit(0)).cast("double").alias("tokens"), F.round(F.coalesce(F.sum("usage.cost_usd"), F.lit(0.0)), 8).alias("usd"))
    rows = []
    for unit, (absolute, cap) in LIMITS.items():
        options = [(x, k) for x, k in ((absolute, "absolute"), (cap * WARN_PERCENT / 100 if cap is not None else None, "percent")) if x is not None]
        least, kind = min(options, key=lambda o: (o[0], o[1]))
        rows.append(F.struct(F.lit(unit).alias("unit"), F.lit(float(least)).alias("threshold"), F.lit(kind).alias("kind"), F.col(unit).alias("current")))
    out = now.select("job_id", F.inline(F.array(*rows)))
    return out.withColumn("warn", F.col("current") >= F.col("threshold"))


def run_summary(s: SparkSession, d: str) -> DataFrame:
    """One row for each run: readings, pages, empty ones, warnings, usage, first and last extraction."""
    empty = F.coalesce(~F.col("content").rlike(r"\S"), F.lit(True))
    r = base(s, d, "run_id", "job_id", "page_id", empty.alias("empty"), F.greatest(F.coalesce(F.size("warnings"), F.lit(0)), F.lit(0)).alias("n"), "usage", "extracted_at")
    return r.groupBy("run_id").agg(
        F.count("*").alias("n_readings"), F.count_distinct("job_id", "page_id").alias("n_pages"), F.count_if("empty").alias("n_empty"), F.sum("n").cast("bigint").alias("n_warnings"), F.sum("usage.tokens").alias("tokens"),
        F.round(F.sum("usage.compute_seconds"), 3).alias("seconds"), F.unix_micros(F.min("extracted_at")).alias("first"), F.unix_micros(F.max("extracted_at")).alias("last"),
    )


def run_identity(s: SparkSession, d: str) -> DataFrame:
    """Jobs whose readings name other than one run, adapter version by adapter, or source."""
    r = base(s, d, "job_id", "run_id", "adapter", "adapter_version", "source_key")
    jobs = r.groupBy("job_id").agg(F.count_distinct("run_id").alias("n_runs"), F.count_distinct("source_key").alias("n_sources"), F.count_distinct("adapter", "adapter_version").alias("n_versions"), F.count_distinct("adapter").alias("n_adapters"))
    return jobs.select("job_id", "n_runs", "n_sources", (F.col("n_versions") > F.col("n_adapters")).alias("versions_differ"))


def extractor_comparability(s: SparkSession, d: str) -> DataFrame:
    """Next readings of a source's pages by the same stage, compared: comparable, or by what they differ, and of the comparable ones how their grades stand."""
    q = once(quality(raw(s, d, "adapter_version", "model")).select("reading_id", "source_key", "stage", "page_number", "adapter", "adapter_version", "model", "grade", F.when(F.col("result_format").isin(*X.STRUCTURED), "schema_aware").otherwise("signals_only").alias("basis")))
    names = ("reading_id", "adapter", "adapter_version", "model", "grade", "basis")
    a, b = ([F.col(c).alias(f"{side}_{c}") for c in names] for side in "ab")
    # a page of a source by one stage has a few readings
    j = q.select("source_key", "page_number", "stage", *a).join(q.select("source_key", "page_number", F.col("stage").alias("b_stage"), *b), ["source_key", "page_number"]).filter("a_reading_id < b_reading_id")
    same = lambda c: F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    missing = F.col("a_adapter").isNull() | F.col("b_adapter").isNull()
    status = F.when(missing, "incomparable_unknown").when(~same("adapter"), "incomparable_adapter").when(F.col("a_adapter_version").isNull() | F.col("b_adapter_version").isNull(), "incomparable_unknown").when(~same("adapter_version") | ~same("model"), "incomparable_extractor").otherwise("comparable")
    grades = F.when(status != "comparable", "incomparable_extraction").when(~same("basis"), "incomparable_basis").when(F.col("a_grade") == F.col("b_grade"), "equal").when(F.col("a_grade") < F.col("b_grade"), "worse").otherwise("better")
    return j.groupBy(status.alias("status"), grades.alias("grades")).agg(F.count("*").alias("n_pairs"))


def unknown_words(s: SparkSession, d: str) -> DataFrame:
    """The first unknown words of each reading, in order: those the corpus's own lexicon (words on ten pages or more) doesn't hold."""
    words = reads(s, d).filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "job_id", "page_id", F.posexplode(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}{3,})"), 1)).alias("at", "word"))
    first = words.groupBy("reading_id", "job_id", "page_id", "word").agg(F.min("at").alias("at"))
    lexicon = first.select("word", "job_id", "page_id").distinct().groupBy("word").agg(F.count("*").alias("pages")).filter("pages >= 10").select("word")
    rest = first.join(lexicon, "word", "left_anti")
    # a page's words, as many as it has
    return rest.groupBy("reading_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "word"))), 1, SAMPLE).alias("w")).select("reading_id", F.array_join("w.word", " ").alias("sample"))


def line_ends(s: SparkSession, d: str) -> DataFrame:
    """Documents whose line ends aren't single line feeds, with the text as corrections keep it."""
    docs = s.read.parquet(f"{d}/documents.parquet").filter(F.col("text").contains("\r"))
    fixed = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return docs.select("doc_id", F.length("text").cast("bigint").alias("was"), F.length(fixed).cast("bigint").alias("now"), F.md5(fixed).alias("md5"))


def large_changes(s: SparkSession, d: str) -> DataFrame:
    """Pages of which more than half of the scan's words were changed."""
    c = word_changes(s, d).withColumn("changed", F.greatest("added", "removed"))
    return c.filter(F.col("changed") > 0.5 * (F.col("kept") + F.col("removed"))).select("job_id", "page_id", "changed")


def page_accounting(s: SparkSession, d: str) -> DataFrame:
    """Of each job's pages: with text, without, without any attempt, and whether these add up."""
    p = pages(s, d).select("job_id", F.coalesce(F.col("selected_output.text").rlike(r"\S"), F.lit(False)).alias("full"), F.coalesce("attempt_count", F.lit(0)).alias("n"))
    out = p.groupBy("job_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("full")).alias("extracted"), F.count_if(~F.col("full") & (F.col("n") > 0)).alias("failed"), F.count_if(~F.col("full") & (F.col("n") == 0)).alias("not_attempted"))
    return out.withColumn("adds_up", F.col("n_pages") == F.col("extracted") + F.col("failed") + F.col("not_attempted"))


def decision_counts(s: SparkSession, d: str) -> DataFrame:
    """Dispositions of each source's pages, and how many a person has seen."""
    return pages(s, d).groupBy("source_key", "disposition").agg(F.count("*").alias("n_pages"), F.count_if("human_review_performed").alias("n_reviewed"))


def worst_first(s: SparkSession, d: str) -> DataFrame:
    """Held readings of each page in the order they are to be looked at: fewest other warnings, least odd signs, first come."""
    q = once(quality(raw(s, d)).select("reading_id", "job_id", "page_id", "quality_warnings", "suspicious_ratio")).filter(F.size("quality_warnings") > 0)
    other = F.size(F.array_except("quality_warnings", F.array(F.lit("low_confidence"))))
    keyed = q.select("reading_id", "job_id", "page_id", (other > 0).alias("held"), F.round("suspicious_ratio", 2).alias("odd"))
    return O.latest(keyed, ["job_id", "page_id"], [F.asc("held"), F.asc("odd"), F.asc("reading_id")]).select("job_id", "page_id", "reading_id")


QUERIES = {f.__name__: f for f in (
    coverage_signals, loop_signals, misread_signals, split_words, model_remarks, old_letters_lost, derived_costs, warning_thresholds, run_summary, run_identity, extractor_comparability, unknown_words, line_ends, large_changes,
    page_accounting, decision_counts, worst_first,
)}

# --- SQL ---------------------------------------------------------------


def _re2(pattern: str) -> str:
    """A pattern of the functions in the other engine's names of scripts."""
    return pattern.replace("IsLatin", "Latin").replace("IsCyrillic", "Cyrillic").replace("IsGreek", "Greek").replace("IsInherited", "Inherited").replace("'", "''")


def _len(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{_re2(pattern)}'))"


_T = f"(SELECT reading_id, coalesce(content, '') AS t FROM {READS} q0)"
_LIST = r"string_split_regex(regexp_replace(t, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_VALUE = f"trim(regexp_extract(x, '^.*{G.LEADER}(.*)$', 1), ' ')"
ORACLES = {
    "coverage_signals": f"""SELECT reading_id, CASE WHEN n > 0 THEN round(mixed::DOUBLE / n, 4) ELSE 0.0 END AS mixed_script_ratio, p AS private_use, f AS foreign_script,
 array_to_string(list_filter([CASE WHEN n >= 20 AND round(mixed::DOUBLE / n, 4) >= 0.05 THEN 'mixed_script_tokens' END, CASE WHEN p >= 3 THEN 'private_use_characters' END, CASE WHEN f >= 3 AND f < 0.1 * l THEN 'foreign_script_characters' END], lambda x: x IS NOT NULL), ';') AS warnings
 FROM (SELECT reading_id, {_len('t', r'[\p{L}]')} AS l, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Latin}}')::INT + regexp_matches(x, '\\p{{Cyrillic}}')::INT + regexp_matches(x, '\\p{{Greek}}')::INT > 1)) AS mixed,
 {_len('t', G.PRIVATE)} - {_len('t', G.PRIVATE_BULLET)} AS p, len(regexp_extract_all(regexp_replace(t, '{_re2(G.HOME)}', '', 'g'), '[\\p{{L}}\\p{{M}}]')) AS f FROM (SELECT *, regexp_extract_all(t, '{X.TOKEN}') AS w FROM {_T} z) z1) z2""",
    "loop_signals": rf"""WITH c AS (SELECT reading_id, t, unnest(generate_series(1, length(t))) AS i FROM {_T} z), r AS (SELECT reading_id, g, count(*) AS n FROM (SELECT reading_id, x, i - row_number() OVER (PARTITION BY reading_id, x ORDER BY i) AS g, x AS y FROM (SELECT reading_id, i, substring(t, i, 1) AS x FROM c) a WHERE regexp_matches(x, '\p{{L}}')) b GROUP BY reading_id, g, y),
 m AS (SELECT reading_id, max(n) AS n FROM r GROUP BY 1)
 SELECT z.reading_id, CASE WHEN m.n >= 2 THEN m.n ELSE 0 END AS letter_run, NOT regexp_matches(regexp_extract(u, '([^\n]*)$', 1), '{X.RULE_LINE}') AND len(list_filter(generate_series(1, least(length(u) // 20, 200)), lambda k: right(u, 20 * k) = repeat(right(u, k), 20))) > 0 AS tail_repeats
 FROM (SELECT reading_id, regexp_replace(t, '\s+$', '') AS u FROM {_T} z0) z LEFT JOIN m USING (reading_id)""",
    "misread_signals": rf"SELECT *, unfinished >= 10 AND numeric_lines < unfinished / 2 AS labels_without_values FROM (SELECT reading_id, {_len('t', G.CAPITAL_SIGN)} AS capital_signs, len(list_filter({_LIST}, lambda x: regexp_matches(x, '{G.LEADER}') AND NOT regexp_matches({_VALUE}, '\p{{Nd}}') AND NOT regexp_matches({_VALUE}, '^(?:{G.ROMAN})$'))) AS unfinished, len(list_filter({_LIST}, lambda x: regexp_matches(x, '\p{{Nd}}') AND NOT regexp_matches(x, '\p{{L}}'))) AS numeric_lines FROM {_T} z) z1",
    "model_remarks": rf"SELECT doc_id, regexp_matches(coalesce(text, ''), '{_re2(G.OMITTED)}') AS partial_transcription, len(list_filter(string_split_regex(coalesce(text, ''), '\n\s*\n'), lambda p: regexp_matches(p, '{_re2(G.NOTE_LINE)}') AND regexp_matches(p, '{_re2(G.ABOUT_THE_IMAGE)}'))) > 0 AS model_commentary FROM documents",
    "old_letters_lost": rf"SELECT source_key, count(*) AS n_readings, count(*) FILTER ({_len('t', r'\p{L}')} >= 200 AND len(regexp_extract_all(regexp_replace(t, '[^\p{{L}}]', '', 'g'), '\p{{Cyrillic}}')) >= 300 AND NOT regexp_matches(t, '{X.PRE_REFORM}') AND {_len('t', G.HARD_SIGN)} <= greatest(1.0, 0.01 * {_len('t', X.TOKEN)})) AS n_lost FROM (SELECT reading_id, any_value(source_key) AS source_key, any_value(coalesce(content, '')) AS t FROM readings WHERE lower(lang) = 'orus' GROUP BY 1) z GROUP BY 1",
    "derived_costs": f"SELECT adapter, round(sum(cost), 8) AS cost, count(*) AS n_readings, count(basis) AS n_known, CASE count(DISTINCT basis) WHEN 0 THEN 'none' WHEN 1 THEN max(basis) ELSE 'mixed' END AS basis FROM (SELECT adapter, coalesce(usage.cost_usd, CASE WHEN usage.tokens IS NOT NULL THEN {PER_PAGE} * coalesce(usage.pages, 0) + {PER_1K_TOKENS} * (usage.tokens / 1000.0) END) AS cost, CASE WHEN usage.cost_usd IS NOT NULL THEN 'adapter_reported' WHEN usage.tokens IS NOT NULL THEN 'configured_rate' END AS basis FROM {BASE} b) z GROUP BY 1",
    "warning_thresholds": f"SELECT job_id, unit, threshold, kind, current, current >= threshold AS warn FROM (SELECT job_id, unnest(['pages', 'tokens', 'usd']) AS unit, unnest([8.0::DOUBLE, 16000.0, 0.05]) AS threshold, unnest(['percent', 'percent', 'absolute']) AS kind, unnest([p, t, c]) AS current FROM (SELECT job_id, coalesce(sum(usage.pages), 0)::DOUBLE AS p, coalesce(sum(usage.tokens), 0)::DOUBLE AS t, round(coalesce(sum(usage.cost_usd), 0), 8)::DOUBLE AS c FROM {BASE} b GROUP BY 1) z) z1",
    "run_summary": rf"SELECT run_id, count(*) AS n_readings, count(DISTINCT job_id || '/' || page_id) AS n_pages, count(*) FILTER (coalesce(NOT regexp_matches(content, '\S'), true)) AS n_empty, sum(coalesce(len(warnings), 0))::BIGINT AS n_warnings, sum(usage.tokens)::BIGINT AS tokens, round(sum(usage.compute_seconds), 3) AS seconds, epoch_us(min(extracted_at)) AS first, epoch_us(max(extracted_at)) AS last FROM {BASE} b GROUP BY 1",
    "run_identity": f"SELECT job_id, count(DISTINCT run_id) AS n_runs, count(DISTINCT source_key) AS n_sources, count(DISTINCT adapter || '/' || adapter_version) > count(DISTINCT adapter) AS versions_differ FROM {BASE} b GROUP BY 1",
    "extractor_comparability": f"""WITH q AS (SELECT z.reading_id, r.source_key, r.page_number, r.adapter, x.adapter_version, x.model, z.grade, CASE WHEN z.result_format IN ('json', 'csv', 'markdown_table') THEN 'schema_aware' ELSE 'signals_only' END AS basis FROM ({SQL_QUALITY}) z JOIN {READS} r USING (reading_id) JOIN (SELECT reading_id, any_value(adapter_version) AS adapter_version, any_value(model) AS model FROM readings GROUP BY 1) x USING (reading_id)),
 j AS (SELECT CASE WHEN a.adapter IS NULL OR b.adapter IS NULL THEN 'incomparable_unknown' WHEN a.adapter <> b.adapter THEN 'incomparable_adapter' WHEN a.adapter_version IS NULL OR b.adapter_version IS NULL THEN 'incomparable_unknown' WHEN a.adapter_version <> b.adapter_version OR a.model IS DISTINCT FROM b.model THEN 'incomparable_extractor' ELSE 'comparable' END AS status, a.basis AS ab, b.basis AS bb, a.grade AS ag, b.grade AS bg FROM q a JOIN q b USING (source_key, page_number) WHERE a.reading_id < b.reading_id)
 SELECT status, CASE WHEN status <> 'comparable' THEN 'incomparable_extraction' WHEN ab <> bb THEN 'incomparable_basis' WHEN ag = bg THEN 'equal' WHEN ag < bg THEN 'worse' ELSE 'better' END AS grades, count(*) AS n_pairs FROM j GROUP BY ALL""",
    "unknown_words": rf"WITH w AS (SELECT reading_id, job_id, page_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM (SELECT reading_id, job_id, page_id, regexp_extract_all(lower(content), '\p{{L}}{{3,}}') AS l FROM {READS} q WHERE result_format IN ('text', 'markdown')) q1), f AS (SELECT reading_id, job_id, page_id, word, min(pos) AS pos FROM w GROUP BY ALL), lex AS (SELECT word FROM (SELECT DISTINCT word, job_id, page_id FROM f) GROUP BY word HAVING count(*) >= 10) SELECT reading_id, array_to_string(list(word ORDER BY pos)[1:15], ' ') AS sample FROM f WHERE word NOT IN (SELECT word FROM lex) GROUP BY 1",
    "line_ends": "SELECT doc_id, length(text) AS was, length(u) AS now, md5(u) AS md5 FROM (SELECT doc_id, text, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS u FROM documents WHERE contains(text, chr(13))) z",
    "large_changes": f"SELECT job_id, page_id, greatest(added, removed) AS changed FROM ({LEDGER_SQL['word_changes']}) z WHERE greatest(added, removed) > 0.5 * (kept + removed)",
    "page_accounting": rf"SELECT *, n_pages = extracted + failed + not_attempted AS adds_up FROM (SELECT job_id, count(*) AS n_pages, count(*) FILTER (f) AS extracted, count(*) FILTER (NOT f AND n > 0) AS failed, count(*) FILTER (NOT f AND n = 0) AS not_attempted FROM (SELECT job_id, coalesce(regexp_matches(selected_output.text, '\S'), false) AS f, coalesce(attempt_count, 0) AS n FROM {PAGES} p) z GROUP BY 1) z1",
    "decision_counts": f"SELECT source_key, disposition, count(*) AS n_pages, count(*) FILTER (human_review_performed) AS n_reviewed FROM {PAGES} p GROUP BY 1, 2",
    "worst_first": f"SELECT job_id, page_id, reading_id FROM (SELECT r.job_id, r.page_id, z.reading_id, len(list_filter(ws, lambda x: x <> 'low_confidence')) > 0 AS held, round(suspicious_ratio, 2) AS odd FROM ({SQL_QUALITY}) z JOIN {READS} r USING (reading_id) WHERE len(ws) > 0) q QUALIFY row_number() OVER (PARTITION BY job_id, page_id ORDER BY held, odd, reading_id) = 1",
}

