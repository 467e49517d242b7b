"""Table payloads: parsing, alignment to a declared schema, coercion, arithmetic checks.

Parsing is one Arrow-batched function (quoted line breaks and three JSON
shapes need it); everything after it is Column and aggregate work.

Defined results
* null or blank payload: parse error ``empty_content``; other text that is no table: the format's error.
* markdown: the first table counts, others are ``ignored_table``; all-blank rows are dropped.
* ragged rows are padded or cut to the header and flagged ``row_width_mismatch``.
* a cell that is blank is null without an error; grouped numbers need one kind of separator.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions import text as X

_RULE_CELL = re.compile(r"^:?-+:?$")


def md_cells(line: str) -> list[str]:
    """Cells of a pipe row, one outer pipe on each side aside."""
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") else body
    return [c.strip() for c in body.split("|")]


def parse_markdown(text: str) -> tuple[list[str], list[list[str]], int] | str:
    """(header, rows, number of tables) or an error."""
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        if line.strip().startswith("|"):
            blocks[-1].append(line)
        elif blocks[-1]:
            blocks.append([])
    good = [b for b in blocks if len(b) >= 2 and all(_RULE_CELL.match(c) for c in md_cells(b[1]))]
    if not good:
        return "no_markdown_table_found"
    head, _, *rows = good[0]
    return md_cells(head), [r for r in map(md_cells, rows) if any(r)], len(good)


def parse_csv(text: str) -> tuple[list[str], list[list[str]], int] | str:
    try:
        rows = [r for r in csv.reader(io.StringIO(text), strict=True) if any(c.strip() for c in r)]
    except csv.Error:
        return "invalid_csv"
    return ([c.strip() for c in rows[0]], rows[1:], 1) if rows else "empty_csv"


def _cell(v) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def parse_json(text: str) -> tuple[list[str], list[list[str | None]], int] | str:
    """List of objects, ``{headers, rows}`` or one object."""
    try:
        o = json.loads(text)
    except ValueError:
        return "invalid_json"
    if isinstance(o, dict) and isinstance(o.get("headers"), list) and isinstance(o.get("rows"), list) and all(isinstance(r, list) for r in o["rows"]):
        return [str(h) for h in o["headers"]], [[_cell(v) for v in r] for r in o["rows"]], 1
    records = [o] if isinstance(o, dict) else o
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        return "unrecognized_json_shape"
    if not records:
        return "empty_json_records"
    head = list(dict.fromkeys(k for r in records for k in r))
    return head, [[_cell(r.get(h)) for h in head] for r in records], 1


def parse_payload(text: str | None, fmt: str | None) -> dict:
    """header, rows, issues, error of one payload."""
    out: dict = {"header": None, "rows": None, "issues": [], "error": None}
    if text is None or not text.strip():
        return out | {"error": "empty_content"}
    parse = {"csv": parse_csv, "json": parse_json, "markdown_table": parse_markdown}.get(fmt or "")
    got = parse(text) if parse else "content_not_table"
    if isinstance(got, str):
        return out | {"error": got}
    head, rows, n = got
    issues = ["ignored_table"] if n > 1 else []
    if len({normal_header(h) for h in head}) < len(head):
        issues.append("duplicate_header")
    if any(len(r) != len(head) for r in rows):
        issues.append("row_width_mismatch")
    return {"header": head, "rows": [(list(r) + [None] * len(head))[: len(head)] for r in rows], "issues": issues, "error": None}


def normal_header(h: str) -> str:
    return " ".join(h.casefold().split())


_TYPE = T.StructType([
    T.StructField("header", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("issues", T.ArrayType(T.StringType())), T.StructField("error", T.StringType()),
])
_ARROW = pa.struct([("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("issues", pa.list_(pa.string())), ("error", pa.string())])


@F.arrow_udf(_TYPE)
def payload(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, fmts in it:
        yield pa.array([parse_payload(t, f) for t, f in zip(texts.to_pylist(), fmts.to_pylist(), strict=True)], _ARROW)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str = "string"  # string, integer or number
    required: bool = True
    aliases: tuple[str, ...] = ()


def _bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: a lambda's variable isn't expanded as a Column is."""
    return F.transform(F.array(value), f)[0]


def coerce_number(raw: Column, integer: bool) -> Column:
    """Double of a cell: plain, or grouped in threes by one kind of separator; integers also by full stops. Null where it is none."""

    def number(t: Column) -> Column:
        dots = t.rlike(r"^[+-]?\d{1,3}(?:\.\d{3})+$") if integer else F.lit(False)
        return (
            F.when(dots, F.regexp_replace(t, r"\.", "")).when(t.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"), t)
            .when(t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"), F.regexp_replace(t, ",", "")).when(t.rlike(r"^[+-]?\d{1,3}(?: \d{3})+(?:\.\d+)?$"), F.regexp_replace(t, " ", ""))
            .try_cast("double")
        )

    value = _bind(F.trim(F.regexp_replace(raw, "[\\u00a0\\u2009\\u202f]", " ")), number)
    return _bind(value, lambda v: F.when(v == F.floor(v), v)) if integer else value


def records(df: DataFrame, spec: list[ColumnSpec], key: str = "reading_id") -> DataFrame:
    """Long table: ``key``, ``row_no``, and for each declared column its raw text, ``<name>`` coerced and ``<name>_error``.

    Headers match by name or alias, case and blanks aside; the first match wins.
    """
    parsed = df.withColumn("__p", payload("content", "result_format")).filter(F.col("__p.error").isNull())
    head = F.transform("__p.header", lambda h: F.lower(F.trim(F.regexp_replace(h, r"\s+", " "))))
    base = parsed.select(key, head.alias("__h"), F.posexplode("__p.rows").alias("row_no", "__r"))
    at = {c.name: F.coalesce(*[F.nullif(F.array_position("__h", n.lower()), F.lit(0)) for n in (c.name, *c.aliases)]) for c in spec}
    raws = base.select(key, F.col("row_no").cast("bigint").alias("row_no"), *[F.try_element_at("__r", at[c.name].cast("int")).alias(f"{c.name}_raw") for c in spec])
    out = []
    for c in spec:
        raw = F.col(f"{c.name}_raw")
        blank = raw.isNull() | (F.trim(raw) == "")
        out.append(F.when(~blank, F.trim(raw) if c.kind == "string" else coerce_number(raw, c.kind == "integer")).alias(c.name))
    typed = raws.select("*", *out)
    errors = [
        F.when((F.trim(f"{c.name}_raw") != "") & F.col(c.name).isNull(), F.lit("not_integer" if c.kind == "integer" else "not_number")).alias(f"{c.name}_error") if c.kind != "string" else F.lit(None).cast("string").alias(f"{c.name}_error")
        for c in spec
    ]
    return typed.select("*", *errors)


def compile_check(expression: str, numeric: set[str]) -> tuple[Column, Column]:
    """(left, right) of ``a + b == c``: names of declared numeric columns, finite numbers, ``+ - *`` and unary minus only."""
    tree = ast.parse(expression, mode="eval").body
    if not isinstance(tree, ast.Compare) or len(tree.ops) != 1 or not isinstance(tree.ops[0], ast.Eq):
        raise ValueError("a check is one equation")

    def build(n: ast.expr) -> Column:
        if isinstance(n, ast.Name):
            if n.id not in numeric:
                raise ValueError(f"{n.id} is no declared numeric column")
            return F.col(n.id)
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -build(n.operand)
        if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Add | ast.Sub | ast.Mult):
            a, b = build(n.left), build(n.right)
            return a + b if isinstance(n.op, ast.Add) else a - b if isinstance(n.op, ast.Sub) else a * b
        raise ValueError("checks have names, numbers, + - * and unary minus")

    return build(tree.left), build(tree.comparators[0])


def run_check(rows: DataFrame, expression: str, numeric: set[str], tolerance: float = 0.0, key: str = "reading_id") -> DataFrame:
    """For each payload: rows checked, passed, failed, unchecked (an operand is null) and the pass rate (null if none was checked)."""
    left, right = compile_check(expression, numeric)
    delta = F.abs(left - right)
    done = rows.groupBy(key).agg(F.count_if(delta.isNotNull()).alias("checked"), F.count_if(delta <= tolerance).alias("passed"), F.count_if(delta > tolerance).alias("failed"), F.count_if(delta.isNull()).alias("unchecked"))
    return done.withColumn("pass_rate", F.when(F.col("checked") > 0, F.round(F.col("passed") / F.col("checked"), 4)))


def schema_grade(parsed: DataFrame, rows: DataFrame, checks: DataFrame, spec: list[ColumnSpec], key: str = "reading_id") -> DataFrame:
    """Grade of each payload against its schema: F for no table, no rows or none of the required columns; else the worst of coverage and pass-rate bands, B at best with coercion errors or structure issues."""
    head = F.transform("__p.header", lambda h: F.lower(F.trim(F.regexp_replace(h, r"\s+", " "))))
    required = [c for c in spec if c.required]
    have = sum((F.array_contains("__h", c.name).cast("int") for c in required), F.lit(0))
    base = parsed.withColumn("__p", payload("content", "result_format")).withColumn("__h", head)
    base = base.select(key, F.col("__p.error").alias("parse_error"), F.coalesce(F.size("__p.rows"), F.lit(0)).cast("bigint").alias("row_count"), F.round(F.coalesce(have, F.lit(0)) / max(1, len(required)), 4).alias("coverage"), F.coalesce(F.size("__p.issues"), F.lit(0)).cast("bigint").alias("issues"))
    errors = rows.groupBy(key).agg(sum((F.count_if(F.col(f"{c.name}_error").isNotNull()) for c in spec), F.lit(0)).cast("bigint").alias("coercion_errors"))
    j = base.join(errors, key, "left").join(checks.select(key, "pass_rate"), key, "left").withColumn("coercion_errors", F.coalesce("coercion_errors", F.lit(0)).cast("bigint"))
    bad = F.col("parse_error").isNotNull() | (F.col("row_count") <= 0) | (F.col("coverage") == 0)
    worst = F.greatest(X.band(F.col("coverage"), X.COVERAGE_BANDS, "D"), F.coalesce(X.band(F.col("pass_rate"), X.PASS_BANDS, "D"), F.lit("A")), F.when((F.col("coercion_errors") > 0) | (F.col("issues") > 0), "B").otherwise("A"))
    return j.withColumn("schema_grade", F.when(bad, "F").otherwise(worst)).withColumn("row_count", F.when(F.col("parse_error").isNull(), F.col("row_count")).otherwise(F.lit(0)).cast("bigint"))
