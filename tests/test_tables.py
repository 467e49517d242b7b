import json

import pytest
from pyspark.sql import functions as F

from quirespark.operators import tables as TB
from quirespark.plans import quality
from quirespark.functions import text as X

SPEC = [TB.ColumnSpec("record"), TB.ColumnSpec("amount", "integer", aliases=("sum",)), TB.ColumnSpec("expected_amount", "integer")]


@pytest.mark.parametrize(
    ("text", "fmt", "error"),
    [
        (None, "csv", "empty_content"), ("  ", "json", "empty_content"), ("no table", "markdown_table", "no_markdown_table_found"), ('a,"b', "csv", "invalid_csv"), ("{", "json", "invalid_json"),
        ("[1]", "json", "unrecognized_json_shape"), ("[]", "json", "empty_json_records"), ("x", "text", "content_not_table"),
    ],
)
def test_parse_errors(text, fmt, error):
    assert TB.parse_payload(text, fmt)["error"] == error


def test_parse_shapes():
    assert TB.parse_payload('a,b\n"x\ny",2\n , \n', "csv")["rows"] == [["x\ny", "2"]]
    assert TB.parse_payload('{"headers":["a"],"rows":[["1"],[2]]}', "json")["rows"] == [["1"], ["2"]]
    assert TB.parse_payload('[{"a":1},{"b":null,"a":2}]', "json")["header"] == ["a", "b"]
    md = TB.parse_payload("t\n| a | A |\n|---|---:|\n| 1 |\n| | |\n\n| c |\n|---|\n| 2 |", "markdown_table")
    assert md["rows"] == [["1", None]] and md["issues"] == ["ignored_table", "duplicate_header", "row_width_mismatch"]


def test_coercion(spark):
    raw = ["1,084,598", "1 084 598", "1.084.598", "1,5", "12 34", "161.168", "-7", "1e3", "", "x", "1 234", None]
    df = spark.createDataFrame([(x,) for x in raw], "r string")
    got = df.select(TB.coerce_number(F.col("r"), True).alias("i"), TB.coerce_number(F.col("r"), False).alias("n")).collect()
    assert [r["i"] for r in got] == [1084598, 1084598, 1084598, None, None, 161168, -7, 1000, None, None, 1234, None]
    assert [r["n"] for r in got] == [1084598, 1084598, None, None, None, 161.168, -7, 1000, None, None, 1234, None]


def test_checks_refuse_code():
    for bad in ("a", "a == b == c", "a < b", "__import__('os') == 1", "c == 1", "a ** 2 == b"):
        with pytest.raises((ValueError, SyntaxError)):
            TB.compile_check(bad, {"a", "b"})


def workload(n):
    """Pages of four kinds in the proportions of the end-to-end acceptance test."""
    rows, i = [], 0
    for k in range(1, 3 * n + 1):
        i += 1
        if k % 3 == 1:
            rows.append((i, json.dumps({"record": f"s-{k}", "amount": i, "expected_amount": i}), "json", 0.99))
        elif k % 3 == 2:
            rows.append((i, f"record,amount,expected_amount\ns-{k},not-an-integer,{i}", "csv", 0.99))
        else:
            rows.append((i, f"| record | amount | expected_amount |\n| --- | --- | --- |\n| s-{k} | {i + 1} | {i} |", "markdown_table", 0.99))
    for k in range(2 * n):
        rows.append((i + k + 1, f"The clerk wrote page {k} with a broken � sign.", "text", 0.42))
    i += 2 * n
    for k in range(2 * n):
        rows.append((i + k + 1, f"Вѣстникъ и лѣсъ {k}: كتاب देव 書", "markdown", 0.91))
    i += 2 * n
    return rows + [(i + k + 1, f"A clean sentence of page {k} stands here for control.", "text", 0.99) for k in range(n)]


def test_acceptance_workload(spark):
    n = 20
    df = spark.createDataFrame(workload(n), "reading_id long, content string, result_format string, confidence double")
    prose = quality.quality(df.filter("result_format IN ('text', 'markdown')"))
    assert {r["grade"]: r["count"] for r in prose.groupBy("grade").count().collect()} == {"A": n, "B": 2 * n, "F": 2 * n}
    t = df.filter("result_format NOT IN ('text', 'markdown')")
    rows = TB.records(t, SPEC)
    checks = TB.run_check(rows, "amount == expected_amount", {"amount", "expected_amount"})
    assert checks.agg(F.sum("checked"), F.sum("passed"), F.sum("failed"), F.sum("unchecked")).first() == (2 * n, n, n, n)
    graded = TB.schema_grade(t, rows, checks, SPEC)
    assert {r["schema_grade"]: r["count"] for r in graded.groupBy("schema_grade").count().collect()} == {"A": n, "B": n, "D": n}
    assert graded.agg(F.sum("coercion_errors")).first()[0] == n


def test_empty_table(spark):
    df = spark.createDataFrame([], "reading_id long, content string, result_format string")
    assert TB.records(df, SPEC).count() == 0 and X.band(F.lit(None).cast("double"), X.PASS_BANDS, "D") is not None
