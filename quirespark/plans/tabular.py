"""Table payloads of readings: rows, coercion, arithmetic, schema grades. Queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.operators import tables as TB
from quirespark.plans.quality import READS, reads

SPEC = [TB.ColumnSpec("record"), TB.ColumnSpec("amount", "integer"), TB.ColumnSpec("expected_amount", "integer")]
CHECK = "amount == expected_amount"


def _structured(s: SparkSession, d: str) -> DataFrame:
    return reads(s, d).filter(F.col("result_format").isin("json", "csv", "markdown_table")).select("reading_id", "result_format", "content")


def table_rows(s: SparkSession, d: str) -> DataFrame:
    return TB.records(_structured(s, d), SPEC).select("reading_id", "row_no", "record", "amount_raw", "amount", "amount_error", "expected_amount")


def markdown_rows(s: SparkSession, d: str) -> DataFrame:
    return TB.records(_structured(s, d).filter("result_format = 'markdown_table'"), SPEC).select("reading_id", "row_no", "record", "amount_raw", "amount", "amount_error", "expected_amount")


def check_arithmetic(s: SparkSession, d: str) -> DataFrame:
    return TB.run_check(TB.records(_structured(s, d).filter("result_format = 'markdown_table'"), SPEC), CHECK, {"amount", "expected_amount"})


def parse_errors(s: SparkSession, d: str) -> DataFrame:
    p = _structured(s, d).withColumn("p", TB.payload("content", "result_format"))
    return p.groupBy("result_format", F.coalesce("p.error", F.lit("")).alias("error")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("p.rows")), F.lit(0)).cast("bigint").alias("n_rows"))


def schema_grades(s: SparkSession, d: str) -> DataFrame:
    df = _structured(s, d)
    rows = TB.records(df, SPEC)
    return TB.schema_grade(df, rows, TB.run_check(rows, CHECK, {"amount", "expected_amount"}), SPEC)


def coerce_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers of lines' cells in several spellings, coerced back; one row a spelling and outcome."""
    li = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_extendedprice").alias("x"))
    cents = F.round(F.col("x"), 2)
    spelled = F.array(
        F.struct(F.lit("plain").alias("how"), cents.cast("decimal(18,2)").cast("string").alias("raw")), F.struct(F.lit("comma").alias("how"), F.format_number(cents, 2).alias("raw")),
        F.struct(F.lit("space").alias("how"), F.translate(F.format_number(cents, 2), ",", " ").alias("raw")), F.struct(F.lit("broken").alias("how"), F.concat(cents.cast("decimal(18,2)").cast("string"), F.lit("-")).alias("raw")),
    )
    out = li.select(F.col("x"), F.inline(spelled)).withColumn("v", TB.coerce_number(F.col("raw"), False))
    return out.groupBy("how").agg(F.count("v").alias("n_numbers"), F.count_if(F.abs(F.col("v") - F.col("x")) < 0.005).alias("n_equal"), F.count_if(F.col("v").isNull()).alias("n_errors"))


_NUM = r"""CASE WHEN regexp_full_match(@, '[+-]?\d{1,3}(\.\d{3})+') THEN replace(@, '.', '') WHEN regexp_full_match(@, '[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?') THEN @ WHEN regexp_full_match(@, '[+-]?\d{1,3}(,\d{3})+(\.\d+)?') THEN replace(@, ',', '')
 WHEN regexp_full_match(@, '[+-]?\d{1,3}( \d{3})+(\.\d+)?') THEN replace(@, ' ', '') END"""
_MD = rf"""(SELECT reading_id, rn - 3 AS row_no, trim(c[1], ' ') AS record, trim(c[2], ' ') AS amount_raw, trim(c[3], ' ') AS exp_raw FROM (
 SELECT reading_id, rn, string_split(regexp_replace(regexp_replace(trim(line, ' '), '^\|', ''), '\|$', ''), '|') AS c FROM (
 SELECT reading_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS rn FROM {READS} q WHERE result_format = 'markdown_table' AND starts_with(trim(content, ' '), '|') AND regexp_matches(string_split(content, chr(10))[2], '^\| ---')) q1
 WHERE starts_with(trim(line, ' '), '|')) q2 WHERE rn > 2 AND len(list_filter(c, lambda x: trim(x, ' ') <> '')) > 0)"""
_CO = rf"""(SELECT reading_id, row_no, NULLIF(record, '') AS record, amount_raw, CASE WHEN av = floor(av) THEN av END AS amount, CASE WHEN amount_raw <> '' AND (av IS NULL OR av <> floor(av)) THEN 'not_integer' END AS amount_error, CASE WHEN ev = floor(ev) THEN ev END AS expected_amount
 FROM (SELECT *, try_cast({_NUM.replace('@', 'amount_raw')} AS DOUBLE) AS av, try_cast({_NUM.replace('@', 'exp_raw')} AS DOUBLE) AS ev FROM {_MD} m) m2)"""
QUERIES = {"table_rows": table_rows, "markdown_rows": markdown_rows, "check_arithmetic": check_arithmetic, "parse_errors": parse_errors, "schema_grades": schema_grades, "coerce_numbers": coerce_numbers}
ORACLES = {
    "markdown_rows": f"SELECT reading_id, row_no::BIGINT AS row_no, record, amount_raw, amount, amount_error, expected_amount FROM {_CO} z",
    "check_arithmetic": f"SELECT reading_id, count(d) AS checked, count(*) FILTER (d <= 0) AS passed, count(*) FILTER (d > 0) AS failed, count(*) FILTER (d IS NULL) AS unchecked, CASE WHEN count(d) > 0 THEN round(count(*) FILTER (d <= 0)::DOUBLE / count(d), 4) END AS pass_rate FROM (SELECT reading_id, abs(amount - expected_amount) AS d FROM {_CO} z) y GROUP BY 1",
    "coerce_numbers": "SELECT how, CASE how WHEN 'broken' THEN 0 ELSE count(*) END AS n_numbers, CASE how WHEN 'broken' THEN 0 ELSE count(*) END AS n_equal, CASE how WHEN 'broken' THEN count(*) ELSE 0 END AS n_errors FROM lineitem, (VALUES ('plain'), ('comma'), ('space'), ('broken')) v(how) GROUP BY how",
}
