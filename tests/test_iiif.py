import json

from pyspark.sql import functions as F

from quirespark.sources import iiif as I

TWO, THREE = "http://iiif.io/api/image/2/context.json", "http://iiif.io/api/image/3/context.json"


def ask(spark, *documents):
    df = spark.createDataFrame([(i, d if isinstance(d, str | None) else json.dumps(d)) for i, d in enumerate(documents)], "i int, d string")
    return [r["u"] for r in df.select("i", I.image_request(F.lit("https://host/svc/"), I.image_info(F.col("d"))).alias("u")).orderBy("i").collect()]


def test_largest_allowed_image(spark):
    size = {"width": 4000, "height": 3000}
    got = ask(
        spark, {"@context": TWO, **size}, {"@context": THREE, **size, "maxWidth": 10}, {"@context": TWO, **size, "maxWidth": 1000}, {"@context": TWO, **size, "profile": ["level1", {"maxArea": 1_000_000}]},
        {"@context": TWO, **size, "maxWidth": 2000, "profile": [{"maxWidth": 1500}, {"maxHeight": 900}]}, {"@context": TWO, **size, "maxWidth": 900, "profile": "level0", "sizes": [{"width": 400, "height": 300}, {"width": 800, "height": 600}, {"width": 1000, "height": 750}]},
        {"@context": TWO, **size, "maxWidth": 90, "profile": "level0", "sizes": [{"width": 400, "height": 300}]}, {"@context": "http://library.stanford.edu/iiif/image-api/1.1/context.json", **size}, {"@context": TWO, "width": 0, "height": 5}, "not json", None,
    )
    url = "https://host/svc/full/{}/0/default.jpg".format
    assert got == [url("full"), url("max"), url("1000,"), url("1154,"), url("1200,"), url("800,"), None, None, None, None, None]


def test_secrets_and_waits(spark):
    rows = spark.createDataFrame([("https://h/a?api_key=abc&page=3#x", "7", 1), ("https://h/a?page=3;Signature=s%20", "soon", 3), ("plain", None, 9), (None, "-5", 0), ("x", "1e9", 0), ("x", "nan", 1)], "t string, r string, n int")
    got = [(r["a"], r["b"]) for r in rows.select(I.redacted(F.col("t")).alias("a"), I.retry_wait(F.col("r"), F.col("n")).alias("b")).collect()]
    assert got == [("https://h/a?api_key=redacted&page=3#x", 7.0), ("https://h/a?page=3;Signature=redacted", 8.0), ("plain", 60.0), (None, 0.0), ("x", 60.0), ("x", 2.0)]
