import json

from quirespark.operators import drift, nested

RECORDS = [
    (1, None), (2, "not json"), (3, "[]"), (4, "{}"),
    (5, json.dumps({"pages": [{"page_number": 1, "attempts": [{"stage": "a", "warnings": ["x", {"code": "y"}]}, {"stage": "b"}]}, {"page_number": 2}, {"page_number": 2, "attempts": []}]})),
    (6, json.dumps({"payload": {"pages": {"p1": {"page_number": 7, "attempts": {"stage": "a", "warnings": "z"}}, "p2": {"page_number": 8, "attempts": None}}}})),
    (7, json.dumps({"pages": {"page_number": 9, "attempts": [{"stage": "a", "warnings": None}]}})),
]


def test_page_warnings(spark):
    df = spark.createDataFrame([(*r, "extra") for r in RECORDS], "record_id long, record_json string, label string")
    got = sorted(tuple(r) for r in nested.page_warnings(df).collect())
    assert got == sorted([(5, 1, 1, 1), (5, 1, 1, 2), (5, 1, 2, 0), (5, 2, 0, 0), (5, 2, 0, 0), (6, 7, 1, 1), (6, 8, 0, 0), (7, 9, 1, 0)])


def test_parent_links_and_map_keys(spark):
    nodes = nested.shred(spark.createDataFrame(RECORDS, "record_id long, record_json string"))
    rows = nodes.collect()
    labels = {(r["record_id"], r["label"]) for r in rows}
    assert all((r["record_id"], r["parent"]) in labels for r in rows if r["parent"] is not None)
    assert {r["map_key"] for r in rows if r["record_id"] == 6 and r["table"] == "pages"} == {"p1", "p2"}
    attempts = nested.table(nodes, "pages.attempts", ("stage",))
    assert attempts.count() == 4 and nested.tables(nodes)["pages.attempts"] == ["stage"]


def test_map_keys_never_become_names(spark):
    element = {"page_number": 1, "attempts": [{"stage": "a", "warnings": ["x"]}]}
    rows = [(i, json.dumps({"pages": {f"page_{i}_{k}": element for k in range(5)}, "kept": {"one": {"list": [1]}, "two": {"list": [2]}}, "by_id": {f"id{i}.{k}": {"parts": [{"n": k}]} for k in range(10)}})) for i in range(40)]
    rows += [(100 + i, json.dumps({"pages": [element, {"page_number": 2, "attempts": []}]})) for i in range(3)]
    df = spark.createDataFrame(rows, "record_id long, record_json string").repartition(7)
    repeated = nested.repeated_members(df, "record_json")
    assert set(repeated) == {"pages", "pages.attempts", "pages.attempts.warnings", "kept.one.list", "kept.two.list", "by_id", "by_id.parts"}
    assert repeated["pages"] == {"page_number", "attempts"} and repeated["by_id"] == {"parts"}
    got = nested.shred(df)
    assert got.filter("table = 'by_id'").count() == 400 and got.filter("table = 'pages.attempts'").count() == 203
    assert nested.page_warnings(df).count() == 40 * 5 + 3 * 2


def test_shred_of_no_rows(spark):
    assert nested.page_warnings(spark.createDataFrame([], "record_id long, record_json string")).count() == 0


def line(n, file_no, line_no, o):
    return (f"p{n}", file_no, line_no, o if isinstance(o, str | None) else json.dumps(o))


FILES = [
    line(1, 1, 1, {"job_id": "a", "v": "1", "hold": {"policy": "0.9"}, "gone": 5, "t": 3}), line(1, 1, 2, {"job_id": "b", "v": "2", "hold": {"policy": "0.8"}, "t": 4, "gone": None}),
    line(1, 1, 3, '{"job_id": "c", "torn'), line(1, 1, 4, None),
    line(1, 2, 1, {"job_id": "b", "schema": {"v": "2"}, "policy": "0.8", "t": "4", "new": True}), line(1, 2, 1, {"job_id": "b", "schema": {"v": "2"}, "policy": "0.8", "t": "4", "new": True}),
    line(1, 2, 2, {"job_id": "c", "schema": {"v": "9"}, "policy": "0.7", "t": "4", "void": None}),
    line(1, 4, 1, {"job_id": "b", "other": 1}), line(2, 1, 1, {"job_id": "z", "x": [1]}),
]
SCHEMA = "producer string, file_no int, line_no int, raw_line string"


def test_changes(spark):
    got = {tuple(r)[1:] for r in drift.found(spark.createDataFrame(FILES, SCHEMA)).collect()}
    assert got == {
        (2, "renamed", "v", "schema.v"), (2, "renamed", "hold.policy", "policy"), (2, "removed", "gone", ""), (2, "added", "", "new"), (2, "type_changed", "t", "t"),
    }


def test_same_values_in_several_fields_are_used_once(spark):
    f = [line(1, 1, 1, {"job_id": "a", "x": 1, "y": 1}), line(1, 2, 1, {"job_id": "a", "z": 1})]
    got = sorted(tuple(r)[2:] for r in drift.found(spark.createDataFrame(f, SCHEMA)).collect())
    assert got == [("removed", "y", ""), ("renamed", "x", "z")]


def test_unified_shape(spark):
    df = drift.unify(spark.createDataFrame(FILES, SCHEMA))
    rows = df.orderBy("producer", "file_no", "line_no").collect()
    assert len(rows) == len(FILES) and sum(r["torn"] for r in rows) == 2
    assert dict(df.dtypes)["t"] == "string" and dict(df.dtypes)["x"] == "array<string>" and dict(df.dtypes)["new"] == "boolean"
    assert rows[0]["schema__v"] == "1" and rows[4]["schema__v"] == "2"


def test_renames_of_other_producers_lose_no_value(spark):
    f = [line(1, 1, 1, {"job_id": "a", "x": "1"}), line(1, 2, 1, {"job_id": "a", "y": "1"}), line(2, 1, 1, {"job_id": "b", "y": "2"}), line(2, 2, 1, {"job_id": "b", "z": "2"}), line(3, 1, 1, {"job_id": "c", "x": "3", "z": "4"})]
    rows = drift.unify(spark.createDataFrame(f, SCHEMA)).collect()
    values = sorted(v for r in rows for k, v in r.asDict().items() if k in ("x", "y", "z") and v is not None)
    assert values == ["1", "1", "2", "2", "3", "4"]


def test_whole_numbers_are_kept(spark):
    f = [line(1, 1, 1, {"job_id": "a", "n": 9007199254740993, "d": 0.1, "e": 1e300, "w": 3}), line(1, 1, 2, {"job_id": "b", "n": 1, "d": 2, "e": 1, "w": 4})]
    df = drift.unify(spark.createDataFrame(f, SCHEMA))
    kinds = dict(df.dtypes)
    assert kinds["n"] == kinds["w"] == "bigint" and kinds["d"] == "decimal(38,20)" and kinds["e"] == "double"
    assert df.filter("line_no = 1").first()["n"] == 9007199254740993


def test_lattice_and_no_rows(spark):
    assert drift.promote("number", "boolean") == "string" and drift.promote("array", "number") == "array"
    assert drift.found(spark.createDataFrame([], SCHEMA)).count() == 0
