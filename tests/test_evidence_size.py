"""Lineage and line matching at more rows than a recursion may have, with gaps and repeated rows."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_evidence import brute

from quirespark.functions import align as A
from quirespark.plans import evidence

PAGE = "job_id string, page_id string, page_number int, selected_output struct<text: string>"


def test_lineage_depth_of_many_parts(spark, tmp_path):
    spark.range(1_200_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = evidence.lineage_depth(spark, str(tmp_path)).groupBy("depth").count().collect()
    assert {r["depth"]: r["count"] for r in got} == {k: min(2 ** (k + 1), 1_200_000) - 2**k for k in range(21)}


def test_lineage_depth_with_gaps(spark, tmp_path):
    keys = [None, -4, 0, 1, 1, 2, 7, 40, 2**29 - 1, 2**29, 2**62]
    spark.createDataFrame([(k,) for k in keys], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, evidence.lineage_depth(spark, str(tmp_path)).collect()))
    assert got == [(1, 0), (1, 0), (2, 1), (7, 2), (40, 5), (2**29 - 1, 28), (2**29, 29), (2**62, 62)]


def tables(spark, at, pages, readings):
    """pages: page_id, page_number, text. readings: reading_id, page_id, stage, content, days of extraction and of ingestion."""
    day = lambda n: F.expr(f"TIMESTAMP '2024-01-01' + make_dt_interval({n})")
    r = spark.createDataFrame(readings, "reading_id bigint, page_id string, stage string, content string, e int, i int")
    r.select("reading_id", F.lit("j").alias("job_id"), "page_id", "stage", "content", day("e").alias("extracted_at"), day("i").alias("ingested_at")).write.parquet(f"{at}/readings.parquet")
    spark.createDataFrame([("j", p, n, (t,)) for p, n, t in pages], PAGE).coalesce(1).write.parquet(f"{at}/page_results.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rnd = random.Random(3)
    many = ["".join(rnd.choice("abcd ") for _ in range(30)) for _ in range(150)]
    pages = [
        ("twice", 5, "the other text"), ("twice", 2, "first of two texts\nsecond line"), ("null", 1, None), ("none", 1, "no reading of it"), ("empty", 1, "\n \n"),
        ("odd", 1, "ab\n\t\t\t\nÀÉ ßx\n\U0001f600\U0001f600 b\n  tab\tTAB  "), ("many", 1, "\n".join(many)),
    ]
    readings = [
        (1, "twice", "local_ocr", "frist of two texts\nsecond  LINE\nsecond lime", 1, 1), (1, "twice", "image", "delivered again", 9, 2), (2, "twice", "image", "the other text", 5, 1), (3, "null", "local_ocr", "some text", 1, 1),
        (4, "empty", "local_ocr", "some text", 1, 1), (5, "odd", "local_ocr", "\t\t\t\nàé ßx\n\U0001f600\U0001f600 c\ntab tab\n\n", 1, 1), (6, "many", "local_ocr", "an old one", 1, 1), (7, "many", "local_ocr", "\n".join(many[::-1]), 2, 1),
        (8, "one", "local_ocr", "no page of it", 1, 1),
    ]
    return tables(spark, tmp_path_factory.mktemp("odd"), pages, readings), pages, {r[1]: r[3] for r in readings if r[0] in (1, 3, 4, 5, 7) and r[5] == 1}


def grams(line):
    t = " ".join(line.strip(" ").lower().replace("\t", " ").split(" ")) if line.strip() else " "
    while "  " in t:
        t = t.replace("  ", " ")
    return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}


def expected(pages, scans, k):
    out = []
    for p, text in [(p, t) for p, n, t in pages if t is not None and n != 5 and p in scans]:
        ref, got = ([(i, x) for i, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= 3] for t in (text, scans[p]))
        for i, x in ref:
            found = sorted((-n, j, x, y) for j, y in got if (n := len(grams(x) & grams(y))))[:k]
            out += [(p, i, j, -n, r, x, y) for r, (n, j, x, y) in enumerate(found, 1)]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_candidates_of_odd_lines(spark, odd, k):
    at, pages, scans = odd
    got = sorted((r["page_id"], r["ref_no"], r["got_no"], r["shared"], r["rank"]) for r in evidence.trigram_candidates(spark, at, k).collect())
    assert got == sorted(x[:5] for x in expected(pages, scans, k)) and {x[0] for x in got} == {"twice", "odd", "many"}


def test_matched_lines_of_odd_lines(spark, odd):
    at, pages, scans = odd
    got = sorted((r["page_id"], r["ref_no"], r["edits"], r["missing"]) for r in evidence.matched_lines(spark, at).collect())
    want = sorted((p, i, e := brute(x, y), e * 2 > len(x)) for p, i, _, _, _, x, y in expected(pages, scans, 1))
    assert got == want and any(r[2] for r in got)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab\U0001f600", max_size=80), st.text(alphabet="ab\U0001f600", max_size=90))
def test_infix_edits(ref, win):
    assert A.infix_edits(ref, win) == brute(ref, win) == A.semiglobal(ref, win)[0]


@pytest.mark.parametrize("query", [evidence.trigram_candidates, evidence.matched_lines])
def test_texts_are_shuffled_and_not_their_trigrams(spark, odd, query):
    plan = query(spark, odd[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Generate posexplode" not in plan and plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("cells, block", [(1, 1), (7, 40), (4_000_000, 200_000)])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.text(alphabet="ab \U0001f600", max_size=9), max_size=6)] * 2), min_size=1, max_size=5), st.integers(1, 4))
def test_shared_trigrams_in_pieces(cells, block, pages, k):
    kept = A.CELLS, A.BLOCK
    A.CELLS, A.BLOCK = cells, block
    try:
        kind = pa.list_(pa.struct([("no", pa.int32()), ("clean", pa.string())]))
        a, b = (pa.array([[{"no": i, "clean": x} for i, x in enumerate(p[side])] for p in pages], kind) for side in (0, 1))
        got = []
        for x, y in A._blocks(a, b):
            ref, other, (i, j, shared, rank), n = A._nearest(x, y, k)
            assert len(n) == len(x) and n.sum() == len(i)
            got += zip(ref[0].take(pa.array(i)).to_pylist(), other[0].take(pa.array(j)).to_pylist(), shared.tolist(), rank.tolist(), strict=True)
    finally:
        A.CELLS, A.BLOCK = kept
    own = lambda t: {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}
    want = []
    for ref, other in pages:
        for i, x in enumerate(ref):
            found = sorted((-n, j) for j, y in enumerate(other) if (n := len(own(x) & own(y))))[:k]
            want += [(i, j, -n, r) for r, (n, j) in enumerate(found, 1)]
    assert got == want
