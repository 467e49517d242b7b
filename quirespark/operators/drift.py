"""Schemas that drift between files: one table of one shape, and every change.

Method. The lines of all files are parsed in parallel into leaves (dotted path,
type, value). A file's header is the set of its paths with their types; files
of a producer are compared in order by a join on file number less one. A field
that goes and one that comes are the same field renamed if they have the same
values for the jobs in both files; that is counted by a join on producer, file
and job, never by comparing files as wholes. All headers are folded through
the promotion lattice

    integer -> decimal -> number -> string,  boolean -> string,  array <- anything (a list of one)

to the union schema, renames followed to one canonical path, and the lines are
cast to it. A rename counts for its producer's files only; two names that one
producer has side by side in a file stay two columns for all.

Defined results
* torn lines (no JSON object) have a row in the unified table with ``torn``
  true and no fields; they don't count as evidence.
* null values don't make a field; null or repeated lines change nothing.
* a field with several types in one file has the most frequent one (ties: the first by name).
* whole numbers up to 18 digits are kept exactly, numbers up to 38 digits with
  20 behind the point too; what is longer or has an exponent is a double.
* several candidates for a rename: most equal jobs first, then by name; each field is used once.
* a file without its predecessor has no changes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.session import stored

JOB = "job_id"


#: Steps of the lattice's numbers: how their text looks.
WHOLE, EXACT = r"^-?\d{1,18}$", r"^-?\d{1,18}\.?\d{0,20}$"


def leaves(o: dict, prefix: str = "") -> Iterator[tuple[str, str, str]]:
    """(path, type, value as text) of the members that aren't objects and aren't null."""
    for k, v in o.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}.")
        elif v is not None:
            kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "array"
            yield f"{prefix}{k}", kind, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _parse(line: str | None) -> dict | None:
    if not line:
        return None
    try:
        o = json.loads(line)
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def flatten(files: DataFrame, job: str = JOB) -> DataFrame:
    """``producer``, ``file_no``, ``line_no``, ``job_id``, ``fields`` (map path -> struct of type and value; null for a torn line). Narrow."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = pa.struct([("type", pa.string()), ("value", pa.string())])
        for b in batches:
            jobs, fields = [], []
            for t in b.column(3).to_pylist():
                o = _parse(t)
                if o is None:
                    jobs.append(None)
                    fields.append(None)
                else:
                    jobs.append(str(o[job]) if o.get(job) is not None else None)
                    fields.append([(p, {"type": k, "value": v}) for p, k, v in {x[0]: x for x in leaves(o)}.values()])
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(jobs, pa.string()), pa.array(fields, pa.map_(pa.string(), value))], names=["producer", "file_no", "line_no", "job_id", "fields"])

    return files.select("producer", "file_no", "line_no", "raw_line").mapInArrow(scan, "producer string, file_no int, line_no int, job_id string, fields map<string,struct<type:string,value:string>>")


def headers(flat: DataFrame) -> DataFrame:
    """The fields of each file: ``producer``, ``file_no``, ``path``, ``type``."""
    one = flat.select("producer", "file_no", F.explode("fields").alias("path", "x")).groupBy("producer", "file_no", "path", F.col("x.type").alias("type")).agg(F.count("*").alias("n"))
    best = one.groupBy("producer", "file_no", "path").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("b"))
    return best.select("producer", "file_no", "path", F.col("b.type").alias("type"))


def _pairs(flat: DataFrame) -> DataFrame:
    """(producer, file_no) of the files that have their predecessor."""
    files = flat.filter(F.col("fields").isNotNull()).select("producer", "file_no").distinct()
    return files.join(files.select("producer", (F.col("file_no") + 1).alias("file_no")), ["producer", "file_no"], "left_semi")


def changes(flat: DataFrame) -> DataFrame:
    """``producer``, ``file_no``, ``change_kind``, ``old_field``, ``new_field`` of every change against the file before."""
    head = stored(headers(flat), "headers")
    pairs = stored(_pairs(flat), "file-pairs")
    now = head.join(pairs, ["producer", "file_no"], "left_semi")
    was = head.withColumn("file_no", F.col("file_no") + 1).join(pairs, ["producer", "file_no"], "left_semi").withColumnRenamed("type", "was")
    both = stored(now.join(was, ["producer", "file_no", "path"], "full"), "compared")
    typed = both.filter(F.col("type").isNotNull() & F.col("was").isNotNull() & (F.col("type") != F.col("was")))
    gone = both.filter(F.col("type").isNull()).select("producer", "file_no", F.col("path").alias("old_field"))
    came = both.filter(F.col("was").isNull()).select("producer", "file_no", F.col("path").alias("new_field"))
    # values of the fields that went, in the file before, and of those that came, by job
    values = flat.filter(F.col("job_id").isNotNull()).select("producer", "file_no", "job_id", F.explode("fields").alias("path", "x")).select("producer", "file_no", "job_id", "path", F.col("x.value").alias("value"))
    old = values.withColumn("file_no", F.col("file_no") + 1).withColumnRenamed("path", "old_field").join(gone, ["producer", "file_no", "old_field"], "left_semi").groupBy("producer", "file_no", "job_id", "old_field").agg(F.max("value").alias("a"))
    new = values.withColumnRenamed("path", "new_field").join(came, ["producer", "file_no", "new_field"], "left_semi").groupBy("producer", "file_no", "job_id", "new_field").agg(F.max("value").alias("b"))
    # a job's fields that went meet its fields that came: as many as the two headers differ
    same = old.join(new, ["producer", "file_no", "job_id"]).groupBy("producer", "file_no", "old_field", "new_field").agg(F.count("*").alias("jobs"), F.count_if(F.col("a") == F.col("b")).alias("equal")).filter(F.col("equal") == F.col("jobs"))
    order = (F.desc("equal"), F.asc("new_field"))
    first = same.withColumn("i", F.row_number().over(W.partitionBy("producer", "file_no", "old_field").orderBy(*order))).withColumn("j", F.row_number().over(W.partitionBy("producer", "file_no", "new_field").orderBy(F.desc("equal"), F.asc("old_field"))))
    renamed = stored(first.filter("i = 1 AND j = 1").select("producer", "file_no", "old_field", "new_field"), "renamed")
    removed = gone.join(renamed, ["producer", "file_no", "old_field"], "left_anti")
    added = came.join(renamed, ["producer", "file_no", "new_field"], "left_anti")
    out = ("producer", "file_no", "change_kind", "old_field", "new_field")
    return (
        renamed.withColumn("change_kind", F.lit("renamed")).select(*out)
        .unionByName(removed.select("producer", "file_no", F.lit("removed").alias("change_kind"), "old_field", F.lit("").alias("new_field")))
        .unionByName(added.select("producer", "file_no", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), "new_field"))
        .unionByName(typed.select("producer", "file_no", F.lit("type_changed").alias("change_kind"), F.col("path").alias("old_field"), F.col("path").alias("new_field")))
    )


def found(files: DataFrame) -> DataFrame:
    """p6_found."""
    return changes(stored(flatten(files), "leaves"))


_STEPS = ("integer", "decimal", "number")


def promote(a: str, b: str) -> str:
    """Least type of the lattice that holds both."""
    if a == b:
        return a
    if a in _STEPS and b in _STEPS:
        return max(a, b, key=_STEPS.index)
    return "array" if "array" in (a, b) else "string"


def canonical(renames: list[tuple[str, str]], counts: dict[str, int], apart: set[tuple[str, str]] = frozenset()) -> dict[str, str]:
    """Path -> the most used path among those that renames connect (ties: first by name); no two paths of ``apart`` are put together."""
    root: dict[str, str] = {}
    members: dict[str, set[str]] = {}

    def find(p: str) -> str:
        members.setdefault(p, {p})
        while root.setdefault(p, p) != p:
            p = root[p]
        return p

    for a, b in sorted(renames):
        x, y = find(a), find(b)
        if x != y and not any((p, q) in apart or (q, p) in apart for p in members[x] for q in members[y]):
            root[x] = y
            members[y] |= members.pop(x)
    groups: dict[str, list[str]] = {}
    for p in sorted(set(root) | set(counts)):
        groups.setdefault(find(p), []).append(p)
    return {p: min(g, key=lambda x: (-counts.get(x, 0), x)) for g in groups.values() for p in g}


def unify(files: DataFrame) -> DataFrame:
    """All lines in one shape: keys, ``torn``, and a column for each canonical field, dots as two underscores.

    The driver sees paths, types, renames and pairs of paths that stand side by
    side, which are as many as the schema has fields, not the data. Paths that
    a file has side by side are never put together, so that no line loses a
    value.
    """
    flat = stored(flatten(files), "leaves")
    value = F.col("x.value")
    step = F.when(F.col("x.type") != "number", F.col("x.type")).when(value.rlike(WHOLE), "integer").when(value.rlike(EXACT), "decimal").otherwise("number")
    typed = flat.select("producer", "file_no", F.explode("fields").alias("path", "x")).groupBy("producer", "file_no", "path", step.alias("type")).agg(F.count("*").alias("n"))
    typed = stored(typed, "types")
    types = typed.groupBy("path", "type").agg(F.count_distinct("producer", "file_no").alias("n")).collect()
    moved = stored(changes(flat).filter("change_kind = 'renamed'").select("producer", "old_field", "new_field").distinct(), "moved")
    renames = moved.select("old_field", "new_field").distinct().collect()
    # of the paths that renames connect, those that stand side by side in a file
    linked = moved.select(F.explode(F.array("old_field", "new_field")).alias("path")).distinct()
    own = typed.select("producer", "file_no", "path").distinct().join(linked, "path", "left_semi").groupBy("producer", "file_no").agg(F.sort_array(F.collect_set("path")).alias("paths"))  # as many as a schema has
    pair = F.explode(F.flatten(F.transform("paths", lambda a: F.transform(F.filter("paths", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    apart = {(r["a"], r["b"]) for r in own.select("paths").distinct().select(pair.alias("p")).select("p.*").distinct().collect()}
    counts: dict[str, int] = {}
    for r in types:
        counts[r["path"]] = counts.get(r["path"], 0) + r["n"]
    home = canonical([(r["old_field"], r["new_field"]) for r in renames], counts, apart)
    kind: dict[str, str] = {}
    for r in sorted(types, key=lambda r: (r["path"], r["type"])):
        p = home.get(r["path"], r["path"])
        kind[p] = promote(kind[p], r["type"]) if p in kind else r["type"]
    names: dict[str, list[str]] = {}
    for p in sorted(counts):
        names.setdefault(home.get(p, p), []).append(p)
    cast = {"integer": "bigint", "decimal": "decimal(38,20)", "number": "double", "boolean": "boolean"}
    columns = []
    for p in sorted(kind):
        if p == JOB:
            continue
        x = F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names[p]])
        if kind[p] in cast:
            c = x["value"].try_cast(cast[kind[p]])
        elif kind[p] == "array":
            c = F.when(x["type"] == "array", F.from_json(x["value"], "array<string>")).when(x["value"].isNotNull(), F.array(x["value"]))
        else:
            c = x["value"]
        columns.append(c.alias(p.replace(".", "__")))
    return flat.select("producer", "file_no", "line_no", "job_id", F.col("fields").isNull().alias("torn"), *columns)
