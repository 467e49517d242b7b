"""Approximate matching: pieces and trigrams of lines, semi-global distance, edit distance of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE, STEP = 400, 200
#: Characters of the lines that are compared in one go, and pairs of lines counted at a time.
BLOCK, CELLS = 200_000, 4_000_000


def pieces(line: Column) -> Column:
    """Long lines as overlapping pieces of ``PIECE`` characters, ``STEP`` apart; short ones whole."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(line) - F.lit(STEP + 1), F.lit(0)), F.lit(STEP))
    return F.when(F.length(line) <= PIECE, F.array(line)).otherwise(F.transform(starts, lambda i: F.substring(line, i + 1, F.lit(PIECE))))


def cleaned(text: Column) -> Column:
    """What trigrams are taken of: lower case, blanks collapsed."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def trigrams(text: Column) -> Column:
    """Distinct three-character windows of a text, blanks collapsed; a shorter text is its own window."""

    def windows(t: Column) -> Column:
        return F.when(F.length(t) < 3, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))

    # bound to a lambda's variable, so that the cleaned text is made once and not once a window
    return F.array_distinct(F.transform(F.array(cleaned(text)), windows)[0])


def lines(text: Column, raw: bool = False) -> Column:
    """A text's lines of three characters or more: ``no``, ``clean`` and, if asked for, the line as it stands; none of a null."""
    numbered = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("no"), x.alias("line"))), lambda x: F.length(F.trim(x["line"])) >= 3)
    return F.coalesce(F.transform(numbered, lambda x: F.struct(x["no"].alias("no"), cleaned(x["line"]).alias("clean"), *([x["line"].alias("line")] if raw else []))), F.array())


def _windows(clean: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all lines, each filled up to three with -1, and the lengths."""
    n = pc.utf8_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(clean.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if (n < 3).any():
        full = np.maximum(n, 3)
        padded = np.full(int(full.sum()), -1)
        padded[np.arange(len(codes)) + np.repeat(np.cumsum(full - n) - (full - n), n)] = codes
        return padded, full
    return codes, n


def _distinct(x: np.ndarray) -> np.ndarray:
    """The sorted values once each; ``np.unique`` hashes them, which takes several times as long."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shared_trigrams(ref: pa.Array, ref_page: np.ndarray, got: pa.Array, got_page: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each cleaned reference line the ``k`` lines of its page that share most distinct trigrams, ties to the first: reference line, line, number shared, rank. Both sides in the order of pages. Exact at any number of lines: pairs are counted ``CELLS`` at a time."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(ref) or not len(got):
        return none
    (a, na), (b, nb) = _windows(ref), _windows(got)
    rank = np.zeros(0x110001, np.int64)
    rank[a], rank[b] = 1, 1
    rank[-1] = 0
    rank = np.cumsum(rank)
    size = int(rank[-1]) + 1
    rank[-1] = 0
    pages = int(max(ref_page[-1], got_page[-1])) + 1
    first = np.searchsorted(got_page, np.arange(pages))
    lines_of = np.bincount(got_page, minlength=pages)
    width = int(lines_of.max())

    def grams(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, line = rank[codes], np.repeat(np.arange(len(n)), n - 2)
        at = np.arange(len(line)) + 2 * line
        return (r[at] * size + r[at + 1]) * size + r[at + 2], line

    (ga, la), (gb, lb) = grams(a, na), grams(b, nb)
    space = size**3
    if space * max(pages * width, len(ref)) >= 2**62:
        kinds, both = np.unique(np.concatenate([ga, gb]), return_inverse=True)
        ga, gb, space = both[: len(ga)], both[len(ga) :], len(kinds)
    post = _distinct((got_page[lb] * space + gb) * width + lb - first[got_page[lb]])
    post, post_line = post // width, post % width
    own = _distinct(la * space + ga)
    own_line, own_gram = own // space, own % space
    low, high = (np.searchsorted(post, ref_page[own_line] * space + own_gram, side) for side in ("left", "right"))
    # the cells of a reference line: the lines of its page
    cells = lines_of[ref_page]
    ends, row_ends = np.cumsum(cells), np.searchsorted(own_line, np.arange(len(ref)), "right")
    out, start = [none], 0
    while start < len(ref):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        begins, n = ends[start:stop] - cells[start:stop] - before, int(ends[stop - 1]) - before
        shared = np.zeros(n, np.int64)
        row, last = int(row_ends[start - 1]) if start else 0, int(row_ends[stop - 1])
        hits = np.cumsum(high[row:last] - low[row:last])
        done, base = 0, row
        while row < last:
            to = max(row + 1, base + int(np.searchsorted(hits, done + CELLS, "right")))
            each = high[row:to] - low[row:to]
            at = np.repeat(low[row:to] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            shared += np.bincount(np.repeat(begins[own_line[row:to] - start], each) + post_line[at], minlength=n)
            row, done = to, int(hits[to - base - 1])
        some = np.flatnonzero(cells[start:stop])
        if len(some):
            begins = begins[some]
            score = shared * width + (width - 1) - (np.arange(n) - np.repeat(begins, cells[start:stop][some]))
            best = np.empty((k, len(some)), np.int64)
            for i in range(k):
                best[i] = np.maximum.reduceat(score, begins)
                score[begins + width - 1 - best[i] % width] = -1
            best = best.T
            found = best >= width
            line, order = np.nonzero(found)
            best = best[found]
            out.append((start + some[line], first[ref_page[start + some[line]]] + width - 1 - best % width, best // width, order + 1))
        start = stop
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _blocks(a: pa.Array, b: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Pages in runs of about ``BLOCK`` characters of both sides."""

    def upto(x: pa.Array) -> np.ndarray:
        n = np.concatenate([[0], np.cumsum(pc.utf8_length(x.flatten().flatten()[1]).to_numpy(zero_copy_only=False).astype(np.int64))])
        return n[np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64))]

    n, start = upto(a) + upto(b), 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(n, (int(n[start - 1]) if start else 0) + BLOCK, "right")))
        yield a.slice(start, stop - start), b.slice(start, stop - start)
        start = stop


def _nearest(a: pa.Array, b: pa.Array, k: int) -> tuple[list[pa.Array], list[pa.Array], tuple[np.ndarray, ...], np.ndarray]:
    """Columns of both sides' lines, their pairs, and how many of them each page has."""
    pages = [np.repeat(np.arange(len(x)), pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in (a, b)]
    ref, got = a.flatten().flatten(), b.flatten().flatten()
    pairs = shared_trigrams(ref[1], pages[0], got[1], pages[1], k)
    return ref, got, pairs, np.bincount(pages[0][pairs[0]], minlength=len(a))


def _listed(n: np.ndarray, kind: pa.StructType, *columns: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))


def nearest_lines(k: int):
    """UDF of a page's ``lines`` of two texts: the ``k`` lines that share most trigrams with each of the first."""
    kind = pa.struct([("ref_no", pa.int64()), ("got_no", pa.int64()), ("shared", pa.int64()), ("rank", pa.int64())])

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in kind])))
    def udf(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in it:
            out = []
            for a, b in _blocks(*batch):
                ref, got, (i, j, shared, rank), n = _nearest(a, b, k)
                out.append(_listed(n, kind, ref[0].take(pa.array(i)), got[0].take(pa.array(j)), pa.array(shared), pa.array(rank)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    # else the filter of empty lists that Spark puts before ``inline`` runs it a second time
    return udf.asNondeterministic()


def semiglobal(reference: str | None, window: str | None) -> tuple[int, int, int] | None:
    """(edits, start, end): the stretch of the window nearest to the whole reference; ties: the leftmost end, then the shortest stretch."""
    if reference is None or window is None:
        return None
    n = len(window)
    w = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, ch in enumerate(reference, 1):
        up, diagonal = row + 1, row[:-1] + (w != ord(ch))
        new, origin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], origin[0] = i, 0
        new[1:] = np.where(diagonal <= up[1:], diagonal, up[1:])
        origin[1:] = np.where(diagonal <= up[1:], start[:-1], start[1:])
        # insertions run left to right: a running minimum of new[j] - j
        lead = new - np.arange(n + 1)
        best = np.minimum.accumulate(lead)
        at = np.maximum.accumulate(np.where(lead == best, np.arange(n + 1), 0))
        row, start = best + np.arange(n + 1), origin[at]
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


_MATCH = T.StructType([T.StructField("edits", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.arrow_udf(_MATCH)
def semiglobal_match(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    kind = pa.struct([("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    for a, b in it:
        out = [semiglobal(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
        yield pa.array([None if r is None else dict(zip(("edits", "start", "end"), r, strict=True)) for r in out], kind)


def infix_edits(reference: str, window: str) -> int:
    """The edits of ``semiglobal`` alone, for lines of any length: a column of its table as the bits of two integers."""
    if not reference or reference in window:
        return 0
    at: dict[str, int] = {}
    for i, ch in enumerate(reference):
        at[ch] = at.get(ch, 0) | 1 << i
    full, last = (1 << len(reference)) - 1, 1 << len(reference) - 1
    up, down, edits = full, 0, len(reference)
    least = edits
    for ch in window:
        same = at.get(ch, 0)
        level = ((same & up) + up ^ up) | same
        more, less = down | full & ~(level | up), up & level
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
            least = min(least, edits)
        more = more << 1 & full
        up, down = less << 1 & full | full & ~(same | down | more), more & (same | down)
    return least


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("ref_no", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("edits", T.IntegerType())])))
def nearest_edits(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Of a page's ``lines`` of two texts, those of the first that share a trigram with one of the second: their length, and the edits to the nearest stretch of the line that shares most."""
    kind = pa.struct([("ref_no", pa.int64()), ("n", pa.int32()), ("edits", pa.int32())])
    for batch in it:
        out = []
        for a, b in _blocks(*batch):
            ref, got, (i, j, _, _), n = _nearest(a, b, 1)
            line = ref[2].take(pa.array(i))
            edits = pa.array([infix_edits(x, y) for x, y in zip(line.to_pylist(), got[2].take(pa.array(j)).to_pylist(), strict=True)], pa.int32())
            out.append(_listed(n, kind, ref[0].take(pa.array(i)), pc.utf8_length(line), edits))
        yield pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))


# as above: once
nearest_edits = nearest_edits.asNondeterministic()


def distance(a: str | None, b: str | None) -> int | None:
    """Edit distance of two whole texts of any length: a column of the table as the bits of two integers (Myers, Hyyrö), exact."""
    if a is None or b is None:
        return None
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, edits = full, 0, len(a)
    for ch in b:
        same = at.get(ch, 0)
        level = ((same & up) + up ^ up) | same
        more, less = down | full & ~(level | up), up & level
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        more = (more << 1 | 1) & full
        up, down = less << 1 & full | full & ~(same | down | more), more & (same | down)
    return edits


@F.arrow_udf(T.LongType())
def edit_distance(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in it:
        yield pa.array([distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())
