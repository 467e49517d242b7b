from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.plans import quality


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first()["x"]


def test_tokens_marks_and_joiners(spark):
    assert one(spark, "naïve étude क्‍ष 12 x2y", X.tokens) == ["naïve", "étude", "क्ष", "x", "y"]


def test_metrics_of_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",)], "content string")
    rows = df.select(*[c.alias(k) for k, c in X.metrics(F.col("content")).items()]).collect()
    assert [r["token_count"] for r in rows] == [0, 0, 0] and rows[0]["token_mean"] is None and rows[0]["suspicious_ratio"] == 0.0


def test_lines_at_unusual_ends(spark):
    assert one(spark, "a\r\nb\x0bc d\n", X.lines) == ["a", "b", "c", "d"]


def test_rejoin_and_orthography(spark):
    assert one(spark, "auth-\nority and Saint-\nOrne", X.rejoin) == "authority and Saint-\nOrne"
    assert one(spark, "Вѣрно, архивъ", X.modern_orthography) == "верно, архив"
    assert one(spark, "лѣсъ ѣ вѣкъ", X.yat_words) == 2


def test_page_range_and_natural_key(spark):
    assert one(spark, "1-3, 7,2", X.page_range) == [1, 2, 3, 7]
    assert [one(spark, x, X.page_range) for x in ("1-2000000000", "3-1", "x", "0-2", "")] == [None] * 5
    names = spark.createDataFrame([("p10.jpg",), ("p2.jpg",), ("p1.jpg",)], "n string")
    assert [r[0] for r in names.orderBy(X.natural_key(F.col("n"))).collect()] == ["p1.jpg", "p2.jpg", "p10.jpg"]


def test_spreadsheet_guard_and_markers(spark):
    assert one(spark, "=1+1", X.spreadsheet_safe) == "'=1+1" and one(spark, "1+1", X.spreadsheet_safe) == "1+1"
    assert one(spark, "a <THINK> b [/INST]", X.instruction_markers) == ["<think>", "[/inst]"]
    assert one(spark, "<think>x</think> y <think> z", X.strip_thoughts) == "y"


def test_quality_of_edge_texts(spark):
    long = "word " * 60_000
    rows = [(1, None, "text", None), (2, "", "text", 0.4), (3, "....", "text", 0.95), (4, "x � y", "text", 0.95), (5, long, "text", 0.95), (6, "{}", "json", 0.95), (7, "т ѣ ѣ", "markdown", 0.95)]
    got = {r["reading_id"]: r for r in quality.quality(spark.createDataFrame(rows, "reading_id long, content string, result_format string, confidence double")).collect()}
    assert got[1]["quality_warnings"] == ["empty_text"] and got[1]["grade"] == "F" and got[1]["page_type"] == "blank"
    assert "low_confidence" in got[2]["quality_warnings"] and got[3]["quality_warnings"] == ["empty_text"]
    assert "replacement_characters" in got[4]["quality_warnings"] and got[5]["grade"] == "A" and got[5]["page_type"] == "prose"
    assert got[6]["page_type"] == "blank" and "historical_orthography" in got[7]["quality_warnings"]


def test_quality_of_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([], "reading_id long, content string, result_format string, confidence double, grade string, token_count string")
    assert quality.quality(df).count() == 0
