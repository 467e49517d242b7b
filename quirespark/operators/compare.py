"""Comparison of two readings: token ratio, difference spans, contested words, applied decisions.

Sequence alignment has no relational form; it runs in Arrow batches over pairs
that a join on the page has already made, so that its quadratic cost is per
pair of pages and never per pair of tables.

Defined results
* a null side: null comparison; two texts without tokens: ratio 1.
* texts beyond ``MOST_TOKENS`` tokens are cut at runs of tokens that stand once
  in both, and aligned piece by piece; a stretch without such a run is aligned
  as a whole, so that every pair has its ratio and spans at any length.
* a run of two words or more that stands elsewhere in the other reading is
  ``moved``: it is contested, but nothing settles it.
* ties of alignment: the leftmost longest block first.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TOKENS = 10_000
MOST_SPANS = 20
#: Tokens on end that make an anchor, and the least number of tokens between two cuts.
RUN, PIECE = 5, 1000
CONTEXT = 5
SIMILAR = 0.6
_TOKEN = re.compile(r"\d+(?:[ ,.  ]\d{3})+(?!\d)|\d+|[^\W\d_](?:[\ẁ-ͯ]*[\ẁ-ͯ])?")
# Latin letters and the Cyrillic letters they look like.
LATIN_LOOK = "aceopxyABCEHKMOPTX"
CYRILLIC_LOOK = "асеорхуАВСЕНКМОРТХ"
_LOOK = str.maketrans(LATIN_LOOK, CYRILLIC_LOOK)


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end); numbers keep their grouped thousands together."""
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]


def compare(left: str | None, right: str | None) -> dict | None:
    """ratio, spans (texts of both sides with context), numbers that differ."""
    if left is None or right is None:
        return None
    a = [t for t, _, _ in tokens(unicodedata.normalize("NFC", left))]
    b = [t for t, _, _ in tokens(unicodedata.normalize("NFC", right))]
    na, nb = Counter(t for t in a if t[0].isdigit()), Counter(t for t in b if t[0].isdigit())
    numbers = sorted(((na - nb) + (nb - na)).elements())
    if not a and not b:
        return {"ratio": 1.0, "spans": [], "numbers": []}
    apart = differences(a, b)
    equal = len(a) - sum(i2 - i for i, i2, _, _ in apart)
    spans = [
        {"kind": "insert" if i == i2 else "delete" if j == j2 else "replace", "left": " ".join(a[max(0, i - CONTEXT) : i2 + CONTEXT]), "right": " ".join(b[max(0, j - CONTEXT) : j2 + CONTEXT])}
        for i, i2, j, j2 in apart[:MOST_SPANS]
    ]
    return {"ratio": 2 * equal / (len(a) + len(b)), "spans": spans, "numbers": numbers[:MOST_SPANS]}


_COMPARED = T.StructType([
    T.StructField("ratio", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))),
    T.StructField("numbers", T.ArrayType(T.StringType())),
])
_SPAN = pa.struct([("kind", pa.string()), ("left", pa.string()), ("right", pa.string())])


@F.arrow_udf(_COMPARED)
def compared(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("ratio", pa.float64()), ("spans", pa.list_(_SPAN)), ("numbers", pa.list_(pa.string()))])
    for a, b in it:
        yield pa.array([compare(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)


def homoglyph(literal: str, reader: str) -> bool:
    """Whether the literal word mixes in look-alike letters and otherwise equals the reader's."""
    return literal != reader and literal.translate(_LOOK) == reader.translate(_LOOK)


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The longest rising run of places of ``RUN`` tokens on end that stand once in each text."""

    def single(x: list[str]) -> dict[tuple[str, ...], int]:
        runs = [tuple(x[i : i + RUN]) for i in range(len(x) - RUN + 1)]
        n = Counter(runs)
        return {r: i for i, r in enumerate(runs) if n[r] == 1}

    mine, theirs = single(a), single(b)
    pairs = [(i, theirs[r]) for r, i in mine.items() if r in theirs]
    ends: list[int] = []
    last: list[int] = []
    before = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def differences(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """Stretches that differ, as bounds in both; texts of over ``MOST_TOKENS`` lose their common ends, are cut at anchors and aligned piece by piece, without an anchor as a whole."""
    head, tail, cuts = 0, 0, []
    if max(len(a), len(b)) > MOST_TOKENS:
        shorter = min(len(a), len(b))
        while head < shorter and a[head] == b[head]:
            head += 1
        while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        cuts = [(head, head)]
        for i, j in anchors(a[head : len(a) - tail], b[head : len(b) - tail]):
            if max(head + i - cuts[-1][0], head + j - cuts[-1][1]) >= PIECE:
                cuts.append((head + i, head + j))
    out = []
    for (i0, j0), (i1, j1) in itertools.pairwise([*(cuts or [(0, 0)]), (len(a) - tail, len(b) - tail)]):
        m = difflib.SequenceMatcher(None, a[i0:i1], b[j0:j1], autojunk=False)
        out += [(i0 + i, i0 + i2, j0 + j, j0 + j2) for tag, i, i2, j, j2 in m.get_opcodes() if tag != "equal"]
    return out


def contested(base: str | None, witness: str | None, known: frozenset[str] = frozenset()) -> list[dict]:
    """Word-level differences in the base's offsets, each with a kind and what settles it."""
    if base is None or witness is None:
        return []
    a, b = tokens(base), tokens(witness)
    out, seen = [], Counter()
    left, right = [t for t, _, _ in a], [t for t, _, _ in b]
    apart = differences(left, right)
    gone = {tuple(left[i:i2]) for i, i2, j, j2 in apart if j == j2 and i2 - i > 1}
    come = {tuple(right[j:j2]) for i, i2, j, j2 in apart if i == i2 and j2 - j > 1}
    moved = gone & come
    for i, i2, j, j2 in apart:
        start = a[i][1] if i < len(a) else len(base)
        end = a[i2 - 1][2] if i2 > i else start
        mine, theirs = base[start:end], witness[b[j][1] : b[j2 - 1][2]] if j2 > j else ""
        if i == i2 and tuple(right[j:j2]) in moved or j == j2 and tuple(left[i:i2]) in moved:
            kind, settled = "moved", None
        elif any(c.isdigit() for c in mine + theirs):
            kind, settled = "number", None
        elif homoglyph(theirs, mine):
            kind, settled = "homoglyph", mine
        elif mine.lower() in known and theirs.lower() not in known:
            kind, settled = "word", mine
        elif theirs.lower() in known and mine.lower() not in known:
            kind, settled = "word", theirs
        else:
            kind, settled = "word", None
        seen[(mine, theirs)] += 1
        ident = hashlib.sha256("\x1f".join((mine, theirs, kind, str(seen[(mine, theirs)]))).encode()).hexdigest()[:16]
        out.append({"span_id": f"sp_{ident}", "kind": kind, "start": start, "end": end, "base": mine, "witness": theirs, "settled": settled})
    return out


_CONTEST = T.ArrayType(T.StructType([
    T.StructField("span_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.StringType()), T.StructField("witness", T.StringType()), T.StructField("settled", T.StringType()),
]))


@F.arrow_udf(_CONTEST)
def contest(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("span_id", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.string()), ("witness", pa.string()), ("settled", pa.string())]))
    for a, b in it:
        yield pa.array([contested(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)


def edition(base: Column, spans: Column) -> Column:
    """The base text with settled spans put in, from the end; a fold over the sorted spans inside the JVM."""
    edits = F.reverse(F.array_sort(F.transform(F.filter(spans, lambda s: s["settled"].isNotNull()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["settled"].alias("text")))))
    return F.aggregate(edits, base, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["text"], F.substring(t, e["end"] + 1, F.length(t))))


def settle(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Spans with the latest decision of high confidence for one of their two readings; other decisions leave them open as ``proposed``.

    ``spans``: page key columns, span_id, base, witness. ``decisions``: span_id, text, confidence, decided_at.
    """
    last = decisions.withColumn("__i", F.row_number().over(W.partitionBy("span_id").orderBy(F.desc("decided_at"), F.desc("text")))).filter("__i = 1").drop("__i")
    j = spans.join(last, "span_id", "left")
    good = (F.col("confidence") == "high") & ((F.col("text") == F.col("base")) | (F.col("text") == F.col("witness")))
    return j.withColumn("status", F.when(good, "settled").when(F.col("text").isNotNull(), "proposed").otherwise("open"))
