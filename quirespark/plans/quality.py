"""Page quality: measures, warnings, structure, grades, repetition. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.functions import text as X

#: Each reading once: a reading delivered twice has the same content.
READS = """(SELECT reading_id, any_value(job_id) job_id, any_value(page_id) page_id, any_value(page_number) page_number, any_value(source_key) source_key, any_value(stage) stage,
 any_value(adapter) adapter, any_value(result_format) result_format, any_value(content) AS content, any_value(confidence) confidence FROM readings GROUP BY reading_id)"""


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than these, as small files have; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw(s: SparkSession, d: str, *more: str) -> DataFrame:
    """Readings as delivered, some twice: for measures that are taken in the scan."""
    cols = ("reading_id", "job_id", "page_id", "page_number", "source_key", "stage", "adapter", "result_format", "content", "confidence", *more)
    return spread(s.read.parquet(f"{d}/readings.parquet").select(*cols))


def once(measured: DataFrame) -> DataFrame:
    """Each reading once: duplicates are dropped from the narrow rows, after the measures."""
    return measured.dropDuplicates(["reading_id"])


def reads(s: SparkSession, d: str, *more: str) -> DataFrame:
    """Each reading once with its content."""
    return once(raw(s, d, *more))


def with_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(X.metrics(F.col("content")))


METRICS = ("character_count", "replacement_count", "control_count", "suspicious_count", "suspicious_ratio", "token_count", "token_mean", "token_max", "token_short_ratio", "whitespace_ratio", "latin_ratio", "letter_count", "digit_count", "pre_reform_count", "final_hard_signs")


def quality(df: DataFrame) -> DataFrame:
    """Readings with measures, ``quality_warnings``, ``page_type``, ``type_confidence``, ``type_reason``, ``grade``."""
    m = {k: F.col(k) for k in METRICS}
    out = with_metrics(df).withColumns(X.signals(F.col("content")))
    s = {k: F.col(k) for k in ("line_count", "pipe_line_ratio", "column_line_ratio", "digit_ratio")}
    out = out.withColumn("quality_warnings", X.warnings(m, F.col("content"), F.col("result_format"), F.col("confidence"))).withColumn("__c", X.classify(m, s, F.col("content"), F.col("result_format")))
    return out.withColumns({"page_type": F.col("__c.type"), "type_confidence": F.col("__c.confidence"), "type_reason": F.col("__c.reason"), "grade": X.grade_signals(F.col("quality_warnings"), F.col("confidence"))}).drop("__c")


def text_metrics(s: SparkSession, d: str) -> DataFrame:
    return once(with_metrics(raw(s, d)).select("reading_id", *METRICS))


def quality_warnings(s: SparkSession, d: str) -> DataFrame:
    return once(quality(raw(s, d)).select("reading_id", F.array_join("quality_warnings", ";").alias("warnings")))


def structural_classify(s: SparkSession, d: str) -> DataFrame:
    return once(quality(raw(s, d)).select("reading_id", "page_type", "type_confidence", "type_reason", "pipe_line_ratio", "column_line_ratio", "digit_ratio"))


def page_quality(s: SparkSession, d: str) -> DataFrame:
    """Flagship: number of readings, warnings and mean measures by stage, page type and grade."""
    q = once(quality(raw(s, d)).select("reading_id", "stage", "page_type", "grade", F.size("quality_warnings").alias("n_warnings"), "token_count", "suspicious_ratio"))
    return q.groupBy("stage", "page_type", "grade").agg(
        F.count("*").alias("n_readings"), F.sum("n_warnings").cast("bigint").alias("n_warnings"), F.sum("token_count").alias("n_tokens"),
        F.round(F.avg("suspicious_ratio"), 6).alias("mean_suspicious"),
    )


def grade_distribution(s: SparkSession, d: str) -> DataFrame:
    """Zero-filled counts of each grade, by whether the reading has a confidence."""
    graded = once(quality(raw(s, d)).select("reading_id", "grade", "confidence")).withColumn("basis", F.when(F.col("confidence").isNull(), "warnings_only").otherwise("with_confidence"))
    return graded.groupBy("basis").agg(*[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"])


def routes(s: SparkSession, d: str) -> DataFrame:
    """Route of each page: read tables as tables, leave blanks, a person for what is unsure."""
    q = once(quality(raw(s, d)).select("reading_id", "page_type", "type_confidence"))
    action = F.when(F.col("type_confidence").isNull() | (F.col("type_confidence") < 0.65), "review").when(F.col("page_type") == "blank", "skip").when(F.col("page_type") == "table_likely", "extract_table").otherwise("extract_text")
    return q.select("reading_id", "page_type", action.alias("action"))


def rule_lines(s: SparkSession, d: str) -> DataFrame:
    full = F.filter(X.lines(F.coalesce("content", F.lit(""))), lambda x: x.rlike(r"\S"))
    n = lambda c: F.size(c).cast("bigint")
    return once(raw(s, d).select("reading_id", full.alias("full")).select("reading_id", n(F.filter("full", lambda x: x.rlike(X.RULE_LINE))).alias("rule_lines"), n(F.col("full")).alias("full_lines")))


def repetition_lines(s: SparkSession, d: str) -> DataFrame:
    """Most often repeated line of each reading, rule lines aside, and whether it makes a loop."""
    full = reads(s, d).select("reading_id", F.explode(X.lines(F.coalesce("content", F.lit("")))).alias("line")).filter(F.col("line").rlike(r"\S") & ~F.col("line").rlike(X.RULE_LINE))
    per = full.groupBy("reading_id", F.trim("line").alias("line")).agg(F.count("*").alias("n"))
    return per.groupBy("reading_id").agg(F.max("n").alias("most"), F.sum("n").alias("n_lines")).select("reading_id", "most", "n_lines", (F.col("most") >= F.greatest(F.lit(20.0), 0.3 * F.col("n_lines"))).alias("is_loop"))


def repeated_page_text(s: SparkSession, d: str) -> DataFrame:
    """Short texts that one adapter read on three pages or more, blanks aside."""
    key = F.trim(F.regexp_replace("content", r"\s+", " "))
    short = raw(s, d).select("adapter", "job_id", "page_id", key.alias("k")).filter((F.length("k") < 200) & F.col("k").rlike(r"[\p{L}\p{N}]"))
    return short.groupBy("adapter", "k").agg(F.count_distinct("job_id", "page_id").alias("n_pages")).filter("n_pages >= 3")


def markers(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.array_join(X.instruction_markers(F.col("text")), ";").alias("markers"), F.coalesce(F.col("text").rlike(X.OMISSION), F.lit(False)).alias("omission")).filter("markers != '' OR omission")


def output_inflation(s: SparkSession, d: str) -> DataFrame:
    """Readings at least four times as long as the page's embedded text, by 1000 characters or more."""
    r = once(raw(s, d).select("reading_id", "job_id", "page_id", "stage", F.length(F.coalesce("content", F.lit(""))).alias("n")))
    layer = r.filter("stage = 'local_text'").groupBy("job_id", "page_id").agg(F.max("n").alias("parent"))
    j = r.filter("stage != 'local_text'").join(layer, ["job_id", "page_id"])
    delta = F.col("n") - F.col("parent")
    ratio = F.when(F.col("parent") > 0, F.round(F.col("n").cast("double") / F.col("parent"), 4))
    return j.select("reading_id", ratio.alias("ratio"), delta.cast("bigint").alias("delta"), ((delta >= 1000) & F.coalesce(ratio >= 4.0, F.lit(True))).alias("inflated"), F.coalesce((ratio < 0.5) | (ratio > 1.8), F.lit(False)).alias("suspicious_delta"))


def orthography(s: SparkSession, d: str) -> DataFrame:
    """Yat words, modern spelling, rejoined length and graphemes of prose readings."""
    prose = raw(s, d).filter(F.col("result_format").isin("text", "markdown") & F.col("content").isNotNull())
    return once(prose.select(
        "reading_id", X.yat_words(F.col("content")).alias("yat_words"), F.md5(X.modern_orthography(F.col("content"))).alias("modern_md5"),
        F.length(X.rejoin(F.col("content"))).cast("bigint").alias("rejoined_length"), F.size(X.graphemes(F.col("content"))).cast("bigint").alias("graphemes"),
    ))


def letters_lost(s: SparkSession, d: str) -> DataFrame:
    """Literal readings that keep under a quarter of the yat words of the page's best literal reading, where that has ``X.YAT_WORDS_MIN``; generative readings neither lose nor set the measure."""
    y = once(raw(s, d).select("reading_id", "job_id", "page_id", "adapter", X.yat_words(F.col("content")).alias("yat")))
    y = y.filter(~F.col("adapter").isin(*X.GENERATIVE)).withColumn("best", F.max("yat").over(W.partitionBy("job_id", "page_id")))
    return y.filter((F.col("best") >= X.YAT_WORDS_MIN) & (F.col("yat") < 0.25 * F.col("best"))).select("reading_id", "yat", "best")


def roughness(s: SparkSession, d: str, least: int = 20) -> DataFrame:
    """Share of a reading's words of three letters or more that the corpus's own lexicon (words on ten pages or more) holds."""
    words = reads(s, d).filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "job_id", "page_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"(\p{L}{3,})"), 1)).alias("word"))
    per = words.groupBy("reading_id", "job_id", "page_id", "word").agg(F.count("*").alias("n"))
    lexicon = per.select("word", "job_id", "page_id").distinct().groupBy("word").agg(F.count("*").alias("pages")).filter("pages >= 10").select("word", F.lit(1).alias("known"))
    return per.join(lexicon, "word", "left").groupBy("reading_id").agg(F.sum("n").cast("bigint").alias("n_words"), F.round(F.sum(F.col("n") * F.coalesce("known", F.lit(0))).cast("double") / F.sum("n"), 4).alias("known_share")).filter(F.col("n_words") >= least)


def scoring_clean(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL")
    return docs.select("doc_id", F.length(X.clean_for_scoring(F.col("text"))).cast("bigint").alias("clean_length"), F.md5(X.strip_thoughts(F.col("text"))).alias("thoughtless"))


# --- SQL ---------------------------------------------------------------


def _n(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, '{_p(pattern)}'))"


def _p(pattern: str) -> str:
    return pattern.replace(r"\p{IsLatin}", r"\p{Latin}").replace("'", "''")


_LINES = r"string_split_regex(regexp_replace(t, '(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
_ODD = f"{_n('t', X.LISTED_SYMBOLS)} + {_n('u', X.ODD_SYMBOLS)} - {_n('u', X.PLAIN_SYMBOLS)}"
SQL_METRICS = f"""SELECT reading_id, stage, result_format, confidence, t, c AS character_count, {_n('t', chr(0xFFFD))} AS replacement_count, {_n('t', X.CONTROLS)} AS control_count, s AS suspicious_count,
 CASE WHEN c > 0 THEN round(s::DOUBLE / c, 4) ELSE 0.0 END AS suspicious_ratio, n AS token_count, CASE WHEN n > 0 THEN round(list_sum(w)::DOUBLE / n, 4) END AS token_mean, coalesce(list_max(w), 0) AS token_max,
 CASE WHEN n > 0 THEN round(len(list_filter(w, lambda x: x <= 2))::DOUBLE / n, 4) END AS token_short_ratio, CASE WHEN c > 0 THEN round({_n('t', X.WHITESPACE)}::DOUBLE / c, 4) ELSE 0.0 END AS whitespace_ratio,
 CASE WHEN l > 0 THEN round({_n('t', r'[\p{Latin}]')}::DOUBLE / l, 4) ELSE 0.0 END AS latin_ratio, l AS letter_count, {_n('t', r'[\p{Nd}]')} AS digit_count, {_n('t', X.PRE_REFORM)} AS pre_reform_count,
 {_n('t', r'[\p{L}][ъЪ]([^\p{L}\p{M}]|$)')} AS final_hard_signs
 FROM (SELECT *, length(t) AS c, {_ODD} AS s, {_n('t', r'[\p{L}]')} AS l, list_transform(regexp_extract_all(t, '{X.TOKEN}'), lambda x: length(regexp_replace(x, '{X.JOINERS}', '', 'g'))) AS w, len(regexp_extract_all(t, '{X.TOKEN}')) AS n
 FROM (SELECT *, coalesce(content, '') AS t, regexp_replace(coalesce(content, ''), '{_p(X.LISTED_SYMBOLS)}', '', 'g') AS u FROM {READS} q0) q1) q2"""
_PROSE = "coalesce(result_format, '') NOT IN ('json', 'csv', 'markdown_table')"
SQL_QUALITY = f"""SELECT *, CASE WHEN list_contains(ws, 'empty_text') THEN 'F' ELSE greatest(CASE least(len(list_filter(ws, lambda x: x <> 'low_confidence')), 3) WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END,
 CASE WHEN confidence IS NULL THEN 'A' WHEN confidence >= 0.9 THEN 'A' WHEN confidence >= 0.8 THEN 'B' WHEN confidence >= 0.7 THEN 'C' WHEN confidence >= 0.55 THEN 'D' ELSE 'F' END) END AS grade,
 CASE WHEN length(trim(t, ' ')) <= 2 THEN 'blank' WHEN NOT {_PROSE} THEN 'table_likely' WHEN {{joined}} THEN 'unknown' WHEN line_count >= 3 AND pipe_line_ratio >= 0.3 THEN 'table_likely'
 WHEN line_count >= 3 AND column_line_ratio >= 0.015 AND digit_ratio >= 0.25 THEN 'table_likely' WHEN mean < 3.0 AND token_count >= 20 THEN 'unknown' WHEN token_count <= 25 THEN 'sparse' ELSE 'prose' END AS page_type,
 CASE WHEN length(trim(t, ' ')) <= 2 THEN 0.95 WHEN NOT {_PROSE} THEN 0.85 WHEN {{joined}} THEN NULL WHEN line_count >= 3 AND pipe_line_ratio >= 0.3 THEN 0.75
 WHEN line_count >= 3 AND column_line_ratio >= 0.015 AND digit_ratio >= 0.25 THEN 0.6 WHEN mean < 3.0 AND token_count >= 20 THEN NULL WHEN token_count <= 25 THEN 0.6 ELSE 0.7 END::DOUBLE AS type_confidence,
 CASE WHEN length(trim(t, ' ')) <= 2 THEN 'blank' WHEN NOT {_PROSE} THEN 'structured_format' WHEN {{joined}} THEN 'joined_text' WHEN line_count >= 3 AND pipe_line_ratio >= 0.3 THEN 'pipe_lines'
 WHEN line_count >= 3 AND column_line_ratio >= 0.015 AND digit_ratio >= 0.25 THEN 'column_digits' WHEN mean < 3.0 AND token_count >= 20 THEN 'fragmented_text' WHEN token_count <= 25 THEN 'few_words' ELSE 'running_text' END AS type_reason
 FROM (SELECT *, list_filter([CASE WHEN NOT an THEN 'empty_text' END, CASE WHEN an AND character_count < 10 THEN 'short_text' END, CASE WHEN replacement_count > 0 THEN 'replacement_characters' END,
 CASE WHEN control_count > 0 THEN 'control_characters' END, CASE WHEN {_PROSE} AND suspicious_ratio >= 0.03 AND suspicious_count >= 5 THEN 'suspicious_symbol_density' END,
 CASE WHEN {_PROSE} AND mean < 3.0 AND token_count >= 20 THEN 'fragmented_text' END, CASE WHEN {_PROSE} AND {{joined}} THEN 'joined_text' END,
 CASE WHEN pre_reform_count >= 2 OR (token_count >= 20 AND final_hard_signs >= 2 AND final_hard_signs >= token_count / 100.0) THEN 'historical_orthography' END,
 CASE WHEN {_PROSE} AND digit_count >= 20 AND letter_count < 0.05 * (letter_count + digit_count) THEN 'digits_only_text' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS ws
 FROM (SELECT *, coalesce(token_mean, 0.0) AS mean, regexp_matches(t, '[\\p{{{{L}}}}\\p{{{{N}}}}]') AS an, len(f) AS line_count, CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: contains(x, '|')))::DOUBLE / len(f), 4) ELSE 0.0 END AS pipe_line_ratio,
 CASE WHEN len(f) > 0 THEN round(len(list_filter(f, lambda x: regexp_matches(x, '\\S {{{{2,}}}}\\S')))::DOUBLE / len(f), 4) ELSE 0.0 END AS column_line_ratio,
 CASE WHEN length(regexp_replace(t, '\\s', '', 'g')) > 0 THEN round(digit_count::DOUBLE / {{solid}}, 4) ELSE 0.0 END AS digit_ratio
 FROM (SELECT *, list_filter({{lines}}, lambda x: regexp_matches(x, '\\S')) AS f FROM ({{metrics}}) q3) q4) q5) q6"""
_JOINED = "(mean >= 10 AND token_max >= 80 AND token_count >= 20 AND whitespace_ratio <= 0.03 AND latin_ratio >= 0.8)"
SQL_QUALITY = SQL_QUALITY.replace("{{{{", "{").replace("}}}}", "}").replace("{{L}}", "{L}").replace("{{N}}", "{N}").replace("{{2,}}", "{2,}").replace("{joined}", _JOINED).replace("{solid}", r"len(regexp_extract_all(t, '\S'))").replace("{lines}", _LINES).replace("{metrics}", SQL_METRICS)

QUERIES = {
    "page_quality": page_quality, "text_metrics": text_metrics, "quality_warnings": quality_warnings, "structural_classify": structural_classify, "grade_distribution": grade_distribution, "route_pages": routes,
    "rule_lines": rule_lines, "repetition_lines": repetition_lines, "repeated_page_text": repeated_page_text, "instruction_markers": markers, "output_inflation": output_inflation, "orthography": orthography,
    "letters_lost": letters_lost, "lexicon_roughness": roughness, "scoring_clean": scoring_clean,
}
_FULL = rf"(SELECT reading_id, unnest({_LINES}) AS line FROM (SELECT reading_id, coalesce(content, '') AS t FROM {READS} q0) q1) q2"
_YAT = r"len(list_filter(regexp_extract_all(lower(coalesce(content, '')), '\p{L}{3,}'), lambda w: contains(w, 'ѣ')))"
ORACLES = {
    "text_metrics": f"SELECT reading_id, {', '.join(METRICS)} FROM ({SQL_METRICS}) z",
    "quality_warnings": f"SELECT reading_id, array_to_string(ws, ';') AS warnings FROM ({SQL_QUALITY}) z",
    "structural_classify": f"SELECT reading_id, page_type, type_confidence, type_reason, pipe_line_ratio, column_line_ratio, digit_ratio FROM ({SQL_QUALITY}) z",
    "page_quality": f"SELECT stage, page_type, grade, count(*) AS n_readings, sum(len(ws))::BIGINT AS n_warnings, sum(token_count)::BIGINT AS n_tokens, round(avg(suspicious_ratio), 6) AS mean_suspicious FROM ({SQL_QUALITY}) z GROUP BY ALL",
    "grade_distribution": f"SELECT CASE WHEN confidence IS NULL THEN 'warnings_only' ELSE 'with_confidence' END AS basis, {', '.join(f'count(*) FILTER (grade = {chr(39)}{g}{chr(39)}) AS grade_{g.lower()}' for g in 'ABCDF')} FROM ({SQL_QUALITY}) z GROUP BY 1",
    "route_pages": f"SELECT reading_id, page_type, CASE WHEN type_confidence IS NULL OR type_confidence < 0.65 THEN 'review' WHEN page_type = 'blank' THEN 'skip' WHEN page_type = 'table_likely' THEN 'extract_table' ELSE 'extract_text' END AS action FROM ({SQL_QUALITY}) z",
    "rule_lines": rf"SELECT reading_id, count(*) FILTER (regexp_matches(line, '^[ .·_\-=—–]+$') AND regexp_matches(line, '\S')) AS rule_lines, count(*) FILTER (regexp_matches(line, '\S')) AS full_lines FROM {_FULL} GROUP BY 1",
    "repetition_lines": rf"SELECT reading_id, max(n) AS most, sum(n)::BIGINT AS n_lines, max(n) >= greatest(20.0, 0.3 * sum(n)) AS is_loop FROM (SELECT reading_id, trim(line, ' ') AS line, count(*) AS n FROM {_FULL} WHERE regexp_matches(line, '\S') AND NOT regexp_matches(line, '^[ .·_\-=—–]+$') GROUP BY 1, 2) q3 GROUP BY 1",
    "repeated_page_text": rf"SELECT adapter, k, count(DISTINCT job_id || '/' || page_id) AS n_pages FROM (SELECT adapter, job_id, page_id, trim(regexp_replace(content, '\s+', ' ', 'g'), ' ') AS k FROM {READS} q0) q1 WHERE length(k) < 200 AND regexp_matches(k, '[\p{{L}}\p{{N}}]') GROUP BY 1, 2 HAVING count(DISTINCT job_id || '/' || page_id) >= 3",
    "instruction_markers": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{m}') THEN '{m}' END" for m in X.INSTRUCTION_MARKERS) + f"], lambda x: x IS NOT NULL), ';') AS markers, coalesce(regexp_matches(text, '{X.OMISSION}'), false) AS omission FROM documents WHERE len(list_filter([" + ", ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in X.INSTRUCTION_MARKERS) + f"], lambda x: x)) > 0 OR coalesce(regexp_matches(text, '{X.OMISSION}'), false)",
    "output_inflation": f"SELECT reading_id, ratio, (n - parent)::BIGINT AS delta, (n - parent) >= 1000 AND coalesce(ratio >= 4.0, true) AS inflated, coalesce(ratio < 0.5 OR ratio > 1.8, false) AS suspicious_delta FROM (SELECT r.reading_id, length(coalesce(r.content, '')) AS n, p.parent, CASE WHEN p.parent > 0 THEN round(length(coalesce(r.content, ''))::DOUBLE / p.parent, 4) END AS ratio FROM {READS} r JOIN (SELECT job_id, page_id, max(length(coalesce(content, ''))) AS parent FROM {READS} q WHERE stage = 'local_text' GROUP BY 1, 2) p USING (job_id, page_id) WHERE r.stage <> 'local_text') z",
    "orthography": rf"SELECT reading_id, {_YAT} AS yat_words, md5(regexp_replace(regexp_replace(translate(lower(content), 'ѣіѳѵ', 'еифи'), 'ъ([^\p{{L}}])', '\1', 'g'), 'ъ$', '')) AS modern_md5, length(regexp_replace(content, '(\p{{L}}\p{{M}}*)[-‐]\s*\n\s*(\p{{Ll}})', '\1\2', 'g')) AS rejoined_length, len(regexp_extract_all(content, '\P{{M}}[\p{{M}}\x{{200c}}\x{{200d}}]*')) AS graphemes FROM {READS} q WHERE result_format IN ('text', 'markdown') AND content IS NOT NULL",
    "letters_lost": f"SELECT reading_id, yat, best FROM (SELECT reading_id, yat, max(yat) OVER (PARTITION BY job_id, page_id) AS best FROM (SELECT reading_id, job_id, page_id, {_YAT} AS yat FROM {READS} q WHERE adapter <> 'vision') q1) q2 WHERE best >= 10 AND yat < 0.25 * best",
    "scoring_clean": rf"SELECT doc_id, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '\{{hw:([^}}]*)\}}', '\1', 'g'), '\[(\?|illegible)\]|\||\.{{3,}}|( \.){{3,}}', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS clean_length, md5(trim(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?is)^.*?</think>|<think>.*$', '', 'g'), ' ')) AS thoughtless FROM documents WHERE text IS NOT NULL",
    "lexicon_roughness": rf"WITH per AS (SELECT reading_id, job_id, page_id, word, count(*) AS n FROM (SELECT reading_id, job_id, page_id, unnest(regexp_extract_all(lower(content), '\p{{L}}{{3,}}')) AS word FROM {READS} q WHERE result_format IN ('text', 'markdown')) q1 GROUP BY ALL), lex AS (SELECT word FROM (SELECT DISTINCT word, job_id, page_id FROM per) GROUP BY word HAVING count(*) >= 10) SELECT reading_id, sum(n)::BIGINT AS n_words, round(sum(CASE WHEN lex.word IS NULL THEN 0 ELSE n END)::DOUBLE / sum(n), 4) AS known_share FROM per LEFT JOIN lex USING (word) GROUP BY 1 HAVING sum(n) >= 20",
}
