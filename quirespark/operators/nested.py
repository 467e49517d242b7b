"""Deeply nested records as related flat tables: Dewey labelling.

Method. Every object in a record, and every value of a repeated member, is a
node. Its label is the path of ordinals that leads to it (``2.1.3``: the third
element under the first element under the second member list), its schema path
the names on the way (``pages.attempts.warnings``). Labels are given in one
parse of the record; a node's parent is its label cut by one step, so that
parent links need no second look at the data. The nodes of one schema path are
one table; scalar members are its columns.

Which members are repeated is found over all records (a member that is an
array anywhere is repeated everywhere), so that a single value or object in
place of a list is a list of one. An object in place of a repeated member
whose own members are all objects and none of the element's is a map: its
members are the elements, their names the ``key``. A member that is never an
array but has objects under more than ``MAP_KEYS`` names is a map as well. The
keys of maps never become names: what reaches the driver is as large as the
schema, whatever the number of records.

Defined results
* null record, or text that is no JSON object: no nodes.
* null in place of a list: no elements; null elements are kept as elements.
* records in an envelope (``envelopes``) are taken out of it.
* repeated rows are labelled each; ``record_id`` is the caller's key.
* values are kept as text, objects and arrays that aren't nodes as JSON.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import stored

ENVELOPES = ("payload",)


def _object(text: str | None, envelopes: Iterable[str]) -> dict | None:
    if not text:
        return None
    try:
        o = json.loads(text)
    except ValueError:
        return None
    for e in envelopes:
        if isinstance(o, dict) and isinstance(o.get(e), dict):
            o = o[e]
    return o if isinstance(o, dict) else None


def _is_map(o: dict, known: set[str]) -> bool:
    return bool(o) and all(isinstance(v, dict) for v in o.values()) and not known & o.keys()


#: More names than this with objects under them, over all records, are keys of a map and no members.
MAP_KEYS = 64
#: Stand in a path around a name that may be a map's key.
_KEY, _END = "\x01", "\x02"


class ArrayPaths:
    """Paths of the arrays met, with the names of their elements' members, and of objects that may be maps with their keys."""

    def __init__(self):
        self.arrays: dict[str, set[str]] = {}
        self.maybe: dict[str, set[str]] = {}
        self.elements: dict[str, set[str]] = {}

    def add(self, o: dict, prefix: str = "") -> None:
        for k, v in o.items():
            if not isinstance(v, list | dict) or not v:
                if isinstance(v, list):
                    self.arrays.setdefault(f"{prefix}{k}", set())
                continue
            path = f"{prefix}{k}"
            if isinstance(v, list):
                names = self.arrays.setdefault(path, set())
                for x in v:
                    if isinstance(x, dict):
                        names.update(x)
                        self.add(x, f"{path}.")
            elif all(isinstance(x, dict) for x in v.values()):
                keys, names = self.maybe.setdefault(path, set()), self.elements.setdefault(path, set())
                if path not in self.arrays and len(keys) <= MAP_KEYS:
                    keys.update(v)
                known = path in self.arrays or len(keys) > MAP_KEYS
                for key, x in v.items():
                    names.update(x)
                    self.add(x, f"{path}." if known else f"{path}{_KEY}{key}{_END}.")
            else:
                self.add(v, f"{path}.")

    def maps(self) -> set[str]:
        return {p for p, keys in self.maybe.items() if _KEY not in p and (p in self.arrays or len(keys) > MAP_KEYS)}

    def resolved(self) -> ArrayPaths:
        """The same with the keys of known maps dropped from the paths, and those of plain objects left as they are."""
        out, maps = self, self.maps()
        while True:
            nxt = ArrayPaths()
            for kind in ("arrays", "maybe", "elements"):
                for p, v in getattr(out, kind).items():
                    getattr(nxt, kind).setdefault(_without_keys(p, maps), set()).update(v)
            new = nxt.maps()
            if new == maps:
                return nxt
            out, maps = nxt, new


def _without_keys(path: str, maps: set[str]) -> str:
    """The path without the names that follow one of the maps."""
    at = path.find(_KEY)
    while at >= 0:
        if path[:at] in maps:
            path = path[:at] + path[path.index(_END, at) + 1 :]
            at = path.find(_KEY, at)
        else:
            at = path.find(_KEY, at + 1)
    return path


def repeated_members(df: DataFrame, column: str, envelopes: Iterable[str] = ENVELOPES) -> dict[str, set[str]]:
    """Path -> names of the elements' members, of all members that are repeated in some record. As large as the schema, not the data: each task gives at most ``MAP_KEYS`` + 1 names under an object, and objects that other tasks know as maps are put together without their keys before they are collected."""
    env = tuple(envelopes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ArrayPaths()
        for b in batches:
            for t in b.column(0).to_pylist():
                o = _object(t, env)
                if o is not None:
                    found.add(o)
        found = found.resolved()
        rows = [(kind, p, sorted(v)) for kind in ("arrays", "maybe", "elements") for p, v in getattr(found, kind).items()]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string()))], names=["kind", "path", "names"])

    rows = stored(df.select(column).mapInArrow(scan, "kind string, path string, names array<string>"), "members")
    # maps that some task knows, without keys above them; then all rows with these maps' keys dropped
    names = F.slice(F.array_distinct(F.flatten(F.collect_list("names"))), 1, MAP_KEYS + 1)
    plain = rows.filter(~F.col("path").contains(_KEY)).groupBy("kind", "path").agg(names.alias("names")).collect()
    arrays = {r["path"] for r in plain if r["kind"] == "arrays"}
    maps = {r["path"] for r in plain if r["kind"] == "maybe" and (r["path"] in arrays or len(r["names"]) > MAP_KEYS)}
    path = F.col("path")
    for m in sorted(maps):
        path = F.regexp_replace(path, f"^{re.escape(m)}{_KEY}[^{_END}]*{_END}", m.replace("\\", "\\\\").replace("$", "\\$"))
    found = ArrayPaths()
    for r in rows.select("kind", path.alias("path"), "names").groupBy("kind", "path").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names")).collect():
        getattr(found, r["kind"]).setdefault(r["path"], set()).update(r["names"])
    found = found.resolved()
    out = {p.replace(_KEY, ".").replace(_END, ""): v for p, v in found.arrays.items()}
    for m in found.maps():
        out.setdefault(m, set()).update(found.elements.get(m, ()))
    return out


def label(o: dict, repeated: dict[str, set[str]]) -> Iterator[tuple[list[int], str, str | None, dict[str, str | None]]]:
    """(label, schema path, key in a map, scalar members) of each node of a record, parents first."""

    def text(v) -> str | None:
        return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))

    def visit(value, at: list[int], path: str, key: str | None) -> Iterator:
        if not isinstance(value, dict):
            yield at, path, key, {"value": text(value)}
            return
        fields, below = {}, []

        def members(obj: dict, prefix: str, name: str) -> None:
            for k, v in obj.items():
                p = f"{path}.{name}{k}" if path else f"{name}{k}"
                if p in repeated:
                    below.append((p, v))
                elif isinstance(v, dict):
                    members(v, p, f"{name}{k}.")
                else:
                    fields[f"{name}{k}"] = text(v)

        members(value, path, "")
        yield at, path, key, fields
        for nth, (p, v) in enumerate(sorted(below, key=lambda x: x[0]), 1):
            if v is None:
                continue
            if isinstance(v, dict):
                items = list(v.items()) if _is_map(v, repeated[p]) else [(None, v)]
            else:
                items = [(None, x) for x in v] if isinstance(v, list) else [(None, v)]
            for i, (k, x) in enumerate(items, 1):
                yield from visit(x, [*at, nth, i], p, k)

    yield from visit(o, [], "", None)


def shred(df: DataFrame, key: str = "record_id", column: str = "record_json", envelopes: Iterable[str] = ENVELOPES, tables: Iterable[str] | None = None) -> DataFrame:
    """Nodes of all records: ``key``, ``label``, ``parent`` (null for the record itself), ``table``, ``ordinal``, ``map_key``, ``fields``.

    The ordinal counts from 1 within the parent's list; labels hold, for each
    step, which list and which element. One scan for the repeated members, one
    for the labels; no shuffle of the data. ``tables`` are the schema paths that
    are wanted; the others are labelled but not given out.
    """
    env, wanted = tuple(envelopes), None if tables is None else frozenset(tables)
    repeated = repeated_members(df, column, env)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, tables, keys, fields = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                o = _object(t, env)
                if o is None:
                    continue
                for at, path, k, f in label(o, repeated):
                    if wanted is not None and path not in wanted:
                        continue
                    ids.append(i)
                    labels.append(at)
                    tables.append(path)
                    keys.append(k)
                    fields.append(list(f.items()))
            yield pa.record_batch(
                [pa.array(ids, b.schema.field(0).type), pa.array(labels, pa.list_(pa.int32())), pa.array(tables, pa.string()), pa.array(keys, pa.string()), pa.array(fields, pa.map_(pa.string(), pa.string()))],
                names=["id", "steps", "table", "map_key", "fields"],
            )

    kind = df.schema[key].dataType.simpleString()
    nodes = df.select(key, column).mapInArrow(scan, f"id {kind}, steps array<int>, table string, map_key string, fields map<string,string>")
    steps = F.col("steps")
    return nodes.select(
        F.col("id").alias(key), F.array_join(steps, ".").alias("label"),
        F.when(F.size(steps) > 0, F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 2, F.lit(0))), ".")).alias("parent"),
        "table", F.when(F.size(steps) > 0, F.element_at(steps, -1)).alias("ordinal"), "map_key", "fields",
    )


def table(nodes: DataFrame, path: str, columns: Iterable[str], key: str = "record_id") -> DataFrame:
    """The flat table of a schema path: key, label, parent, ordinal, map key and the named members as text columns."""
    own = nodes.filter(F.col("table") == path)
    return own.select(key, "label", "parent", "ordinal", "map_key", *[F.try_element_at("fields", F.lit(c)).alias(c.replace(".", "_")) for c in columns])


def tables(nodes: DataFrame) -> dict[str, list[str]]:
    """Schema path -> its members' names. As large as the schema."""
    rows = nodes.select("table", F.explode(F.map_keys("fields")).alias("c")).distinct().groupBy("table").agg(F.sort_array(F.collect_set("c")).alias("c")).collect()
    return {r["table"]: r["c"] for r in rows}


def page_warnings(records: DataFrame) -> DataFrame:
    """p3_found: record_id, page_number, attempt_no, warning_no of each warning of each attempt; zeros where there are none.

    The label of a warning holds its page and attempt, so parents are found by
    truncation and no table is joined: one shuffle of narrow rows by record.
    """
    nodes = shred(records.select("record_id", "record_json"), tables=("pages", "pages.attempts", "pages.attempts.warnings"))
    steps = F.split("label", r"\.")
    step = lambda i: F.coalesce(F.try_element_at(steps, F.lit(i)).cast("int"), F.lit(0))
    rows = nodes.select(
        "record_id", F.array_join(F.slice(steps, 1, 2), ".").alias("page"), step(4).alias("attempt_no"), step(6).alias("warning_no"),
        F.when(F.col("table") == "pages", F.try_element_at("fields", F.lit("page_number")).cast("int")).alias("page_number"),
    ).repartition("record_id")
    attempts = rows.groupBy("record_id", "page", "attempt_no").agg(F.max("page_number").alias("page_number"), F.max("warning_no").alias("n"))
    pages = attempts.groupBy("record_id", "page").agg(F.max("page_number").alias("page_number"), F.sort_array(F.collect_list(F.struct("attempt_no", "n"))).alias("a"))
    # the page's own row has attempt 0: it stands only where there is no other
    own = F.when(F.size("a") > 1, F.slice("a", 2, F.size("a"))).otherwise(F.col("a"))
    each = pages.select("record_id", "page_number", F.explode(own).alias("x"))
    numbers = F.when(F.col("x.n") > 0, F.sequence(F.lit(1), F.col("x.n"))).otherwise(F.array(F.lit(0)))
    return each.select("record_id", "page_number", F.col("x.attempt_no").alias("attempt_no"), F.explode(numbers).alias("warning_no"))
