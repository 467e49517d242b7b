import random
import struct
import zlib

from pyspark.sql import functions as F

from quirespark.operators import compare as C
from quirespark.operators import geometry as G
from quirespark.operators import ordered as O
from quirespark.sources import extractors as E
from quirespark.sources import pages as P
from quirespark.sources import sinks as K
from quirespark.streaming import checkpoint as S


def test_run_strings(spark):
    df = spark.createDataFrame([("a", n) for n in (3, 1, 2, 2, 7)] + [("b", None), ("b", 5)], "k string, n int")
    assert {r["k"]: (r["runs"], r["n"]) for r in O.run_strings(df, ["k"], "n").collect()} == {"a": ("1-3, 7", 4), "b": ("5", 1)}


def test_crossing_runs_and_median(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, None, 5, 1])], "k string, i int, v int")
    assert O.first_crossing(df, ["k"], ["i"], "v", 10).first()["i"] == 2
    assert O.flagged_runs(df, ["k"], ["i"], F.col("v") == 5, 1).count() == 2
    assert spark.range(1).select(O.upper_median(F.array(*[F.lit(x) for x in (4, 1, 3, 2)])).alias("m")).first()["m"] == 3


def test_compare_and_contest():
    r = C.compare("The cat sat on 1,200 mats", "The cot sat on 1,300 mats")
    assert 0.5 < r["ratio"] < 1 and r["numbers"] == ["1,200", "1,300"]
    assert C.compare(None, "x") is None and C.compare("", "")["ratio"] == 1.0
    long = C.compare("a " * 11_000, "a " * 10_999)
    assert abs(long["ratio"] - 2 * 10_999 / 21_999) < 1e-12 and len(long["spans"]) == 1
    spans = C.contested("дом стоит 12 лет", "дoм стоит 13 лет")
    assert [s["kind"] for s in spans] == ["homoglyph", "number"] and spans[0]["settled"] == "дом"


def test_contested_of_long_texts(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(12_000)]
    other = list(words)
    for i in (5, 3000, 3001, 7000, 11_998):
        other[i] = "zz"
    del other[9000]
    base, witness = " ".join(words), " ".join(other)
    spans = C.contested(base, witness)
    assert [s["base"] for s in spans] == [words[5], f"{words[3000]} {words[3001]}", words[7000], words[9000], words[11_998]]
    assert all(base[s["start"] : s["end"]] == s["base"] for s in spans)
    df = spark.createDataFrame([(base, witness)], "a string, b string")
    put = F.transform(C.contest("a", "b"), lambda s: s.withField("settled", s["witness"]))
    assert df.select(C.edition(F.col("a"), put).alias("e")).first()["e"].split() == other
    assert len(C.contested("a " * 12_000, "a " * 11_999)) == 1
    for _ in range(50):
        x, y = (r.choices("abc", k=r.randint(0, 30)) for _ in range(2))
        whole = [t[1:] for t in C.difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes() if t[0] != "equal"]
        assert C.differences(x, y) == whole


def test_edition(spark):
    df = spark.createDataFrame([("the cot sat", "the cat sat")], "a string, b string")
    spans = F.transform(C.contest("a", "b"), lambda s: s.withField("settled", s["witness"]))
    assert df.select(C.edition(F.col("a"), spans).alias("e")).first()["e"] == "the cat sat"


def test_settle_takes_the_latest_sure_decision(spark):
    spans = spark.createDataFrame([("s1", "a", "b"), ("s2", "c", "d"), ("s3", "e", "f")], "span_id string, base string, witness string")
    dec = spark.createDataFrame([("s1", "a", "low", 1), ("s1", "b", "high", 2), ("s2", "x", "high", 1)], "span_id string, text string, confidence string, decided_at int")
    assert {r["span_id"]: r["status"] for r in C.settle(spans, dec).collect()} == {"s1": "settled", "s2": "proposed", "s3": "open"}


def test_tiles_against_brute_force(spark):
    rnd = random.Random(3)
    items = [(p, i, *(x, y, x + 9000, y + 7000)) for p in range(5) for i in range(40) for x, y in [(rnd.randrange(0, 990_000), rnd.randrange(0, 990_000))]]
    tiles = [(p, t, (t % 2) * 500_000, (t // 2) * 500_000, (t % 2 + 1) * 500_000, (t // 2 + 1) * 500_000) for p in range(5) for t in range(4)]
    got = {(r["page_id"], r["item"]): r["tile"] for r in G.assign_tiles(spark.createDataFrame(items, "page_id int, item int, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(tiles, "page_id int, tile int, x0 int, y0 int, x1 int, y1 int")).collect()}
    for p, i, x0, y0, x1, y1 in items:
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        assert got[(p, i)] == int(cx >= 500_000) + 2 * int(cy >= 500_000)
    assert all(r["area_whole"] and r["within"] and r["overlaps"] == 0 for r in G.partition_faults(spark.createDataFrame(tiles, "page_id int, tile int, x0 int, y0 int, x1 int, y1 int")).collect())


def test_reading_order(spark):
    two = [(0, 0, 100, 10), (0, 20, 40, 30), (60, 20, 100, 30), (0, 40, 40, 50), (60, 40, 100, 50)]
    assert G.order_lines(two, 5) == [0, 1, 3, 2, 4] or G.order_lines(two, 5) == [0, 1, 2, 3, 4]
    assert G.order_lines([], 5) == []
    df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(two)], "page_id int, item int, x0 int, y0 int, x1 int, y1 int")
    assert sorted(r["position"] for r in G.reading_order(df, gap=5).collect()) == [1, 2, 3, 4, 5]


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿one\ftwo\f  \n".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"\f\fx\r\n")
    got = sorted((r["path"][-5], r["page_number"] or 0, r["content"], r["error"]) for r in P.text_pages(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "one", None), ("a", 2, "two", None), ("b", 0, None, "unreadable_text"), ("d", 1, "", None), ("d", 2, "", None), ("d", 3, "x\r\n", None)]


def png(w, h):
    def chunk(n, b):
        return struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", 11811, 11811, 1)) + chunk(b"IDAT", b"")


def test_image_pages(spark, tmp_path):
    jpg = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x02\x01\x01\x2c\x01\x2c\x00\x00\xff\xc0\x00\x0b\x08\x00\x20\x00\x10\x01\x01\x11\x00"
    for name, data in (("p10.png", png(3, 4)), ("p2.jpg", jpg), ("p1.png", b"\x89PNG broken"), ("p3.jpg", b"")):
        (tmp_path / name).write_bytes(data)
    rows = P.image_pages(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [r["name"] for r in rows] == ["p1.png", "p2.jpg", "p10.png"]
    assert (rows[1]["width"], rows[1]["height"], rows[1]["dpi"]) == (16, 32, 300) and (rows[2]["width"], rows[2]["dpi"]) == (3, 300)
    assert rows[0]["error"]


def test_alto():
    ok = b"<alto><Layout><Page><TextLine><String CONTENT='a' HPOS='1' VPOS='2' WIDTH='3' HEIGHT='4' CC='09'/></TextLine></Page></Layout></alto>"
    words, error = P.parse_alto(ok)
    assert error is None and words[0]["confidence"] == 0.5 and words[0]["x1"] == 4
    assert P.parse_alto(b"<!DOCTYPE x><a/>")[1] == "doctype_refused" and P.parse_alto(b"<a>")[1] == "malformed_xml" and P.parse_alto(None)[1] == "empty_file"


def test_extractors(spark):
    class Odd:
        name, version = "odd", "1"

        def extract(self, page_id, content):
            if content == "boom":
                raise TimeoutError
            return E.Reading(content, confidence=2.0 if content == "sure" else 0.5)

    assert E.conformance(object()) and not E.conformance(Odd())
    df = spark.createDataFrame([("1", "x"), ("2", None)], "page_id string, content string")
    assert {r["page_id"]: r["content"] for r in E.extract(df, "text").collect()} == {"1": "x", "2": ""}
    assert E.problems(Odd().extract("1", "sure")) == "confidence_out_of_range"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("j", 2, "b & <c>\x01"), ("j", 1, None), ("k", 1, "=x y")], "job_id string, page_number int, text string")
    tei = {r["job_id"]: r["tei"] for r in K.tei_pages(df).collect()}
    from xml.etree import ElementTree

    assert all(ElementTree.fromstring(x) is not None for x in tei.values()) and tei["j"].index('n="1"') < tei["j"].index('n="2"')
    assert {r["job_id"]: r["transcript"] for r in K.transcripts(df).collect()}["j"] == "\fb & <c>\x01"
    K.write_jsonl(df, str(tmp_path / "j"))
    K.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "c")).filter("text LIKE \"'=%\"").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(f"p{rnd.randrange(6)}", i, rnd.choice(["start", "response", "complete", "fail", "restart", "decide"])) for i in range(120)]
    schema = "page_id string, ts int, kind string"
    for n in range(3):
        spark.createDataFrame(rows[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = S.track(stream).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["page_id"]: (r["state"], r["steps"], r["refused"]) for r in spark.sql("SELECT page_id, max_by(struct(state, steps, refused), steps + refused) AS s FROM states GROUP BY 1").select("page_id", "s.*").collect()}
    batch = {r["page_id"]: (r["state"], r["steps"], r["refused"]) for r in S.fold(spark.createDataFrame(rows, schema)).collect()}
    assert last == batch
