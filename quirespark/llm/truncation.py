"""Text cut off by field limits or in transfer.

Method. A cut copy shares words with the whole one, from its beginning on or,
where a head is misread, left out or another, from further on. Near-copies are
found by bands over the whole texts: each text's runs of ``RUN`` words, from its
first word to its last, winnowed so that any ``RUN + SPAN - 1`` words on end that
two texts share leave them a band in common. Two sorts of bands more serve short
and often misread copies: min-hashes of the five-word shingles of the first
``HEAD`` words, which a misread word leaves some of, and the first ``START``
words, which copies cut very short still have. Exact copies are collapsed first;
each band's members are compared with the longest of the band, in characters. A
pair is verified by the shingles themselves
(containment of 0.8) over the whole texts, then the shorter's end is aligned in
the longer: if the longer goes on inside the word, sentence, row or value, the
shorter is cut. A text that its longest copies don't verify meets all longer
members of its bands that can hold its last characters: those that share the
mark of them (the least hash of their windows). What no copy decides is scored
by terminality: closing marks, page numbers, running feet, and for lines
without a closing mark P(end | closing words) and P(end | beginning words),
counted over all lines of the corpus.

Defined results
* null, empty and blank texts, and stubs of up to ``STUB_WORDS`` words: not cut.
* a text that ends with an ellipsis put in place of the rest is cut.
* JSON whose brackets or strings stay open, tables and CSV whose last row is
  short, open or ends in a number that another cell of it continues: cut.
* an end that the longer copy closes (a heading, a list line) is whole.
* repeated rows: the same text has the same result.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.functions.align import semiglobal
from quirespark.llm.repetition import Words, _mix, _positions
from quirespark.session import stored

STUB_WORDS = 3
SIMILARITY = 0.8
SHINGLE = 5
#: Words of a text's beginning that are banded; words of its start that make a band of their own.
HEAD, START = 24, 10
BANDS, ROWS = 6, 3
#: Words of a run; runs on end of which the one with the least hash makes a band.
RUN, SPAN = 20, 8
#: Characters of texts that are hashed at a time.
BLOCK = 1 << 18
#: Last characters of a text that a longer copy has to hold; windows of which their mark is made.
TAIL, WINDOW = 40, 8
#: A line without a closing mark is whole if this share of the lines that begin alike end there.
WHOLE_SHARE = 0.25
#: Closing words that end a line in less than this share of the lines they close don't end a text; lines it takes to say so.
CLOSING_SHARE, CLOSING_LINES = 0.2, 8

#: Marks that end a sentence, and what may close it behind them.
_ENDS, _CLOSERS = ".!?…", "”“\"'’»)]*_"
#: Words, marks and brackets apart, of which a page number alone on its line is made at most.
NUMBER_WORDS = 6
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)$")
_INNER_END = re.compile(r"[^\W\d_]{3,}[.!?][”“\"»)’]*\s+[«„“\"(‘¿¡—–]*[^\W\d_]")
# Abbreviations after which a number or name has to follow.
_ABBREVIATED = re.compile(r"(?:^|\()(?:No|Nr|nr|fol|vol|n\.?º|nº|№|p|S|Bd|St|с|стр|л)\.?$", re.I)
_GERMAN_DAY = re.compile(r"\b(?:[Aa]m|[Vv]om|[Dd]en|[Dd]es|[Zz]um)\s+\d{1,2}\.$")
_NUMBER = r"(?=[^\s\])—–-]*\d)[0-9lIOoSBZ]{1,5}|(?-i:[lIO]{2,4})|(?=[ivxlcdm])m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})"
PAGE_NUMBER = re.compile(
    rf"^[\[(—–\-−\s]*(?:(?:page|seite|strona|página|pagina|pág\.?|стр\.?|стор\.?|сторінка|страница|fol\.?|folio|f\.|p\.|s\.|л\.)\s*)?(?:{_NUMBER})\s?[rv]?\.?[\])—–\-−\s]*$", re.I
)
_GAP = re.compile(r"\s{2,}")
_HEAD_YEAR = re.compile(r"^#*\s*[^\W\d_][\w’'\-]*(?: [^\W\d_][\w’'\-]*){0,2}, [\dlOISB]{3,5}$")
_TOKEN = re.compile(r"[^\W_]+")

# Signs and letters that recognition engines put for others.
MISREADS = str.maketrans({"€": "e", "†": "t", "ɑ": "a", "0": "o", "1": "l", "5": "s", "9": "g", "2": "z", "!": "i", "|": None, "­": None})
HOMOGLYPHS = str.maketrans("aceopxyumkbhtAEKMHOPCTXByiI", "асеорхуитквнтАЕКМНОРСТХВуіІ")
_CYR = re.compile(r"[а-яёіїєґѣ]", re.I)


def fold_word(w: str) -> str:
    """A word as it was before an engine misread some of its characters, as far as its script tells."""
    if w.isdigit():
        return w
    if _CYR.search(w):
        return w.translate(HOMOGLYPHS)
    return w.translate(MISREADS) if not w.isalpha() or "ɑ" in w else w


@lru_cache(maxsize=200_000)
def _key_word(w: str, first: bool) -> str:
    w = fold_word(w)
    return "0" if w.isdigit() else w.lower() if first or not w[:1].isupper() else "X"


def line_key(line: str, n: int = 3) -> list[str]:
    """The line's first words: the first as it is, later ones with capital as X, numbers as 0."""
    if "|" in line or "\xad" in line:
        line = line.translate({0x7C: None, 0xAD: None})
    out: list[str] = []
    for m in _TOKEN.finditer(line):
        out.append(_key_word(m[0], not out))
        if len(out) == n:
            break
    return out


def is_foot(line: str) -> bool:
    """Page number, or running foot in capitals, alone or side by side."""
    n = len(line.split())
    if n > 9:
        return False
    if "  " in line or "\t" in line:
        pieces = _GAP.split(line)
        if len(pieces) == 1 and PAGE_NUMBER.match(line) or any(PAGE_NUMBER.match(x) and x[0] != "(" for x in pieces):
            return True
    elif n <= NUMBER_WORDS and PAGE_NUMBER.match(line):
        return True
    if n > 8 or re.match(r"\d+[.)]\s", line):
        return False
    letters = sum(map(str.isalpha, line))
    return letters >= 4 and sum(map(str.isupper, line)) >= 0.7 * letters


def closes(line: str) -> bool:
    """Whether the line ends with a mark that ends a sentence."""
    body = line.rstrip(_CLOSERS)
    end = body[-1:]
    if end not in _ENDS or end == "…" and body == line or not end:
        return False
    if line[-1] != ".":
        return True
    return not (line[-2:-1].isdigit() and _GERMAN_DAY.search(line)) and not _ABBREVIATED.search(line[:-1].rsplit(None, 1)[-1] if len(line) > 1 else "")


def prose_state(text: str) -> tuple[str, str | None]:
    """(``whole``, ``cut`` or ``ask``, key to ask for)."""
    s = text.rstrip()
    tokens = _TOKEN.findall(s)
    if len(tokens) <= STUB_WORDS:
        return "whole", None
    lines = s.split("\n")
    last = lines[-1].strip()
    if _ELLIPSIS.search(s):
        return "cut", None
    before = lines[-2].strip() if len(lines) > 1 else ""
    if len(last) == 1 and last.isalpha() and (last.isupper() or before and not closes(before)):
        return "cut", None  # a letter, not a Roman number
    if before[:1].islower() and not closes(before) and not before[-1].isdigit() and re.fullmatch(r"\d{1,4}|[ivxlcdm]+", last):
        return "cut", None  # the number stands in a sentence
    if PAGE_NUMBER.match(last) or _HEAD_YEAR.match(last) or is_foot(last):
        return "whole", None
    if closes(last):
        return "whole", None
    if re.search(r"\.{4,}|(?:\. ){4,}|(?:·\s?){4,}", last):
        return ("whole" if last[-1].isdigit() else "cut"), None
    if _INNER_END.search(last) and len(last) > 25:
        return "cut", None
    if re.match(r"[(\[]?\d+[.)\]]+\s+\S", last):
        return "cut", None
    if re.match(r"[-*•]\s+\S", last) and re.match(r"[-*•]\s+\S", before):
        return "whole", None
    key = line_key(last)
    if not key:
        return "cut", None
    if len(lines) == 1 and len(tokens) > 12:
        return "cut", None
    n = len(_TOKEN.findall(last))
    if before and not closes(before) and not is_foot(before):
        # a line after an unfinished one is whole only on better evidence
        return ("cut", None) if n < 3 else ("ask", "!" + " ".join(key) + _suffix(n))
    return "ask", " ".join(key) + _suffix(n)


def _suffix(n: int) -> str:
    """Class of a line's length, kept with its key."""
    return f"|{n}" if n <= 3 else "|+" if n <= 6 else "|++"


def csv_fields(line: str) -> tuple[list[str], bool]:
    """(fields, whether a quote stays open)."""
    out, field, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(field)
            field = ""
        else:
            field += c
    return [*out, field], quoted


def table_state(text: str, fmt: str) -> str:
    s = text.strip()
    if _ELLIPSIS.search(s):
        return "cut"
    if fmt == "json":
        if s[:1] not in "[{":
            return "whole"
        try:
            json.loads(s)
            return "whole"
        except ValueError:
            pass
        depth, quoted, escaped = 0, False, False
        for c in s:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = quoted
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c in "[{") - (c in "]}")
        return "cut" if quoted or depth > 0 else "whole"
    lines = [x for x in s.split("\n") if x.strip()]
    if fmt == "markdown_table":
        if "|" not in s:
            return prose_state(text)[0] if len(_TOKEN.findall(s)) > 6 else "whole"
        head, last = lines[0].strip(), lines[-1].strip()
        if not head.startswith("|"):
            return "whole"
        return "cut" if not last.endswith("|") or last.count("|") < head.count("|") else "whole"
    if "," not in s:
        return "whole"
    head, _ = csv_fields(lines[0])
    row, open_ = csv_fields(lines[-1])
    if open_ or len(row) < len(head) or len(lines) == 1:
        return "cut" if len(head) > 1 else "whole"
    digits = [re.sub(r"\D", "", f) for f in row]
    last = digits[-1]
    others = [d for d in digits[1:-1] if d]
    return "cut" if not row[-1].strip() or any(o != last and o.startswith(last) for o in others) else "whole"


def state(text: str | None, fmt: str | None) -> tuple[str, str | None]:
    if not text or not text.strip():
        return "whole", None
    if fmt in ("json", "csv", "markdown_table"):
        return table_state(text, fmt), None
    return prose_state(text)


def closing_words(line: str) -> tuple[str, str]:
    """Keys of a line's last two words and of its last word: capitals as X, numbers as 0."""
    words = [_key_word(w, False) for w in _TOKEN.findall(line)[-2:]]
    return "$" + " ".join(words), "$" + (words[-1] if words else "")


def line_stats(texts: list[str | None], out: Counter) -> None:
    """Adds (key, how the line ended): of the lines that begin a unit, for every prefix of up to three words, and of all lines without a closing mark, for their closing words.

    0: it went on; 1: it was the text's last; 2: it ended and the text went on.
    """
    for t in texts:
        if not t:
            continue
        lines = [x.strip() for x in t.rstrip().split("\n")]
        last, begins, foot = len(lines) - 1, True, None
        for i, line in enumerate(lines):
            if line:
                closed = closes(line)
                follows = lines[i + 1] if i < last else ""
                foot_next = None
                if closed:
                    ends = 0
                elif i == last:
                    ends = 1
                else:
                    foot_next = bool(follows) and is_foot(follows)
                    ends = 2 if not follows or foot_next else 0
                    if line[-1] not in _HYPHENS:  # a text's last line may be cut itself
                        two, one = closing_words(line)
                        out[(two, ends)] += 1
                        if one != two:
                            out[(one, ends)] += 1
                if begins:
                    key = line_key(line)
                    n = len(_TOKEN.findall(line)) if ends else 9
                    for k in range(1, len(key) + 1):
                        out[(" ".join(key[:k]) + f"|{k}", ends if n == k else 0)] += 1
                    if len(key) == 3:
                        p = " ".join(key)
                        out[(p + "|+", ends if 3 < n <= 6 else 0)] += 1
                        out[(p + "|++", ends if n > 6 else 0)] += 1
                # the next line begins a unit if this one ended one
                begins = closed or not follows or (is_foot(line) if foot is None else foot)
                foot = foot_next
            else:
                begins, foot = True, None


_HYPHENS = "-¬­=‐‑"
_A = np.random.default_rng(20_011).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(20_021).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)
_WORDS = re.compile(r"[^\W_]+")


def min_hash(words: Words, texts: list[str | None]) -> np.ndarray:
    """Band keys of the texts' beginnings, one row a text, 0 where it has none: ``BANDS`` of the first ``HEAD`` words, one of the first ``START``."""
    flat: list[int] = []
    ends = []
    for t in texts:
        if t:
            flat += words([m[0].lower() for m in islice(_WORDS.finditer(t), HEAD)])
        ends.append(len(flat))
    w, e = np.array(flat, np.uint64), np.array(ends, np.int64)
    lens = np.diff(np.concatenate([[0], e]))
    keys = np.zeros((len(texts), BANDS + 1), np.int64)
    if len(w) < SHINGLE:
        return keys
    pos = _positions(e, len(w))
    h = w[: len(w) - SHINGLE + 1]
    for i in range(1, SHINGLE):
        h = _mix(h, w[i : len(w) - SHINGLE + 1 + i])
    h = h[np.nonzero(pos[SHINGLE - 1 :] >= SHINGLE - 1)[0]]
    has = np.nonzero(lens >= SHINGLE)[0]
    if not len(has):
        return keys
    first = np.concatenate([[0], np.cumsum(lens[has] - SHINGLE + 1)[:-1]])
    for b in range(BANDS):
        key = np.full(len(has), b + 1, np.uint64)
        for r in range(ROWS):
            k = b * ROWS + r
            key = _mix(key, np.minimum.reduceat((h * _A[k] + _B[k]) >> np.uint64(20), first))
        keys[has, b] = key.view(np.int64)
    start = np.nonzero(lens[has] >= START)[0]
    key = np.full(len(start), BANDS + 1, np.uint64)
    for i in range(START - SHINGLE + 1):
        key = _mix(key, h[first[start] + i])
    keys[has[start], BANDS] = key.view(np.int64)
    return keys


_BASE = 0x9E3779B97F4A7C15
_BLANK = re.compile(r"\s")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a word may hold a character, by code point."""
    return np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=4)
def _powers_of(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2**64."""
    return _powers_of(base, max(BLOCK, 1 << (n - 1).bit_length()))[:n]


def _sums(values: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """Hash of each stretch of the values, whatever stands before it: its polynomial modulo 2**64."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, n), out=total[1:])
    return (total[ends] - total[starts]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[starts]


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """(pieces, the text each is of): about ``BLOCK`` characters at a time, longer texts parted at a blank."""
    pieces, of, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            blank = _BLANK.search(t, at + BLOCK) if len(t) - at > BLOCK else None
            end = blank.start() if blank else len(t)
            pieces.append(t[at:end].lower())
            of.append(i)
            size, at = size + end - at, end
            if size >= BLOCK:
                yield pieces, of
                pieces, of, size = [], [], 0
    if pieces:
        yield pieces, of


def _word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of all texts, by arrays of all their characters."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for pieces, of in _blocks(texts):
        c = np.frombuffer(("\n".join(pieces) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.concatenate([[False], _letters()[c]])  # a line end stands behind the last
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        hashes.append(_mix(_sums(c, starts, ends), np.uint64(1)))
        owners.append(np.array(of)[np.searchsorted(np.cumsum([len(x) + 1 for x in pieces]), starts, side="right")])
    return np.concatenate(hashes), np.concatenate(owners)


def runs(texts: list[str | None]) -> pa.ListArray:
    """Band keys of whole texts: of each ``SPAN`` runs of ``RUN`` words on end the one with the least hash, of fewer runs all. Texts under ``RUN`` words have none."""
    words, owner = _word_hashes(texts)
    n = max(len(words) - RUN + 1, 0)
    keys, of = np.zeros(0, np.uint64), owner[:n]
    if n:
        keys = _mix(_sums(words, slice(0, n), slice(RUN, n + RUN)), np.uint64(BANDS + 2))
        same = owner[RUN - 1 :] == of
        keys, of = keys[same], of[same]
    few = np.bincount(of, minlength=len(texts))[of] < SPAN
    short, short_of = keys[few], of[few]
    keys, of = keys[~few], of[~few]
    if len(keys):
        least = np.lib.stride_tricks.sliding_window_view(keys, SPAN).min(axis=1)
        same = of[SPAN - 1 :] == of[: len(least)]
        keys, of = least[same], of[: len(least)][same]
    keys, of = np.concatenate([keys, short]), np.concatenate([of, short_of])
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    ends = np.cumsum(np.bincount(of[new], minlength=len(texts)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys[new].view(np.int64)))


_SCAN = "reading_id bigint, source_key string, result_format string, verdict string, key string, two string, one string, digest binary, length int, open boolean, bands array<bigint>, runs array<bigint>, ends int, n bigint"
_SCHEMA = pa.schema([
    ("reading_id", pa.int64()), ("source_key", pa.string()), ("result_format", pa.string()), ("verdict", pa.string()), ("key", pa.string()),
    ("two", pa.string()), ("one", pa.string()), ("digest", pa.binary()), ("length", pa.int32()), ("open", pa.bool_()), ("bands", pa.list_(pa.int64())), ("runs", pa.list_(pa.int64())), ("ends", pa.int32()), ("n", pa.int64()),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass: each reading's state and band keys, and the line keys summed by the task (rows without a verdict)."""
    words, stats = Words(), Counter()

    def rows(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.record_batch([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)

    def flush() -> pa.RecordBatch:
        out = rows(key=[k for k, _ in stats], ends=[e for _, e in stats], n=list(stats.values()))
        stats.clear()
        return out

    for b in batches:
        texts, fmts = b.column(2).to_pylist(), b.column(3).to_pylist()
        states = [state(t, f) for t, f in zip(texts, fmts, strict=True)]
        line_stats([t for t, f in zip(texts, fmts, strict=True) if f not in ("json", "csv", "markdown_table")], stats)
        keys = min_hash(words, texts)
        bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS + 1).cast(pa.list_(pa.int64()))
        close = [closing_words(t.rstrip().rsplit("\n", 1)[-1]) if s[0] == "ask" else (None, None) for t, s in zip(texts, states, strict=True)]
        yield rows(
            reading_id=b.column(0), source_key=b.column(1), result_format=b.column(3), verdict=[s[0] for s in states], key=[s[1] for s in states],
            two=[c[0] for c in close], one=[c[1] for c in close], digest=b.column(4), length=[len(_plain(t)) for t in texts],
            open=[open_end(t, f) for t, f in zip(texts, fmts, strict=True)], bands=bands, runs=runs(texts),
        )
        if len(stats) > 200_000:
            yield flush()
    if stats:
        yield flush()


def open_end(text: str | None, fmt: str | None) -> bool:
    """Whether a longer copy could show that the text goes on: its end isn't closed by a mark."""
    if not text:
        return False
    if fmt in ("json", "csv", "markdown_table"):
        return True
    return not closes(_ELLIPSIS.sub("", text.rstrip()).rstrip().rsplit("\n", 1)[-1])


def _plain(text: str | None) -> str:
    """A text with its blanks made one, without an ellipsis at its end."""
    return _ELLIPSIS.sub("", " ".join(text.split())) if text else ""


def _shape(text: str) -> str:
    """A text with its blanks made one and its line ends kept: a blank line as a vertical tab. No ellipsis at its end."""
    lines = [" ".join(x.split()) for x in text.strip().split("\n")]
    return _ELLIPSIS.sub("", re.sub(r"\n{2,}", "\v", "\n".join(lines))).rstrip()


_BLANKS = str.maketrans("\n\v", "  ")


def _goes_on(a: str, b: str, end: int, table: bool) -> str:
    """What the longer copy says of the shorter's end, which stands at ``end`` in it."""
    rest = b[end:]
    if a[-1].isalnum() and rest[0].isalnum():
        return "cut"
    line = re.split(r"[\n\v]", rest, maxsplit=1)
    if any(map(str.isalnum, line[0])):
        return "cut"  # the sentence or the row goes on
    if table or len(line) == 1 or rest[len(line[0])] == "\v":
        return "on"
    return "cut" if line[1][:1].islower() else "on"


def verified(short: str, long: str, fmt: str | None = "text") -> str | None:
    """``cut`` if the longer goes on inside the shorter's last word, sentence, row or value, ``on`` if it goes on behind it; ``closed`` if the shorter ends with a mark that ends a sentence; None if they are no near-copies or it can't be told."""
    a, b = _shape(short), _shape(long)
    table = fmt in ("json", "csv", "markdown_table")
    if not a or not table and closes(re.split(r"[\n\v]", a)[-1]):
        return "closed"
    if len(b) <= len(a):
        return None
    flat_a, flat_b = a.translate(_BLANKS), b.translate(_BLANKS)
    wa, wb = _WORDS.findall(flat_a.lower()), _WORDS.findall(flat_b.lower())
    sa = {tuple(wa[i : i + SHINGLE]) for i in range(len(wa) - SHINGLE + 1)}
    sb = {tuple(wb[i : i + SHINGLE]) for i in range(len(wb) - SHINGLE + 1)}
    if not sa or len(sa & sb) < SIMILARITY * len(sa):
        return None
    tail = flat_a[-TAIL:]
    at = flat_b.rfind(tail)
    end = at + len(tail)
    if at < 0:  # misread or spaced otherwise: the nearest stretch
        low = max(0, len(flat_a) - TAIL - len(flat_a) // 5 - TAIL)
        for low, high in ((low, len(flat_a) + len(flat_a) // 5 + TAIL), (0, len(flat_b))):  # elsewhere, if the beginnings differ
            edits, _, end = semiglobal(tail, flat_b[low:high])
            end += low
            if edits <= len(tail) // 5:
                break
        else:
            return None
    return _goes_on(a, b, end, table) if end < len(b) else None


def align(short: str, long: str) -> str | None:
    """``cut`` if the shorter ends where the longer goes on inside a word, sentence, row or value; None if they are no near-copies or it can't be told."""
    return "cut" if verified(short, long) == "cut" else None


@F.arrow_udf(T.StringType())
def _verified(short: pa.Array, long: pa.Array, fmt: pa.Array) -> pa.Array:
    return pa.array([verified(a, b, f) if a and b else None for a, b, f in zip(short.to_pylist(), long.to_pylist(), fmt.to_pylist(), strict=True)], pa.string())


def marks(text: str) -> np.ndarray:
    """The least hash of each ``TAIL`` characters on end, over their windows of ``WINDOW``: whoever holds the same characters has the same mark."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c) - WINDOW + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(WINDOW if n > 0 else 0):
        h = _mix(h, c[i : n + i])
    k = TAIL - WINDOW + 1
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, k).min(axis=1)).view(np.int64) if n >= k else np.zeros(0, np.int64)


def _marked(shorts: bool):
    """Rows (digest, mark): the mark of a shorter text's end, or all marks of a longer one. 0 stands for ends under ``TAIL`` characters, which any text may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(marks(_plain(t)[-TAIL:]) if shorts else marks(" ".join(t.split()))) for t in b.column(1).to_pylist()]
            found = [m if shorts and len(m) else np.append(m, 0) for m in found]
            n = np.array([len(m) for m in found], np.int64)
            yield pa.record_batch({"digest": b.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), "mark": pa.array(np.concatenate(found) if len(found) else np.zeros(0), pa.int64())})

    return run


def _nearly(keys: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of ``keys`` that equal one of ``whole`` but for a misreading in one word, which keeps its first or its last two letters."""

    def holed(df: DataFrame, name: str) -> DataFrame:
        words = F.split(F.col("key"), " ")
        one = df.filter(~F.col("key").startswith("!") & (F.size(words) > 1)).select(
            F.col("key").alias(name), F.posexplode(words).alias("at", f"{name}_word"), words.alias("w")
        ).select(name, f"{name}_word", F.concat_ws(" ", F.transform("w", lambda x, i: F.when(i == F.col("at"), "*").otherwise(x))).alias("hole"))
        w = F.col(f"{name}_word")
        ends = F.array(F.concat(F.lit("<"), F.substring(w, 1, 2)), F.concat(F.lit(">"), F.substring(w, -2, 2)))
        return one.filter(F.length(w) >= 2).withColumn("end", F.explode(ends))

    a, b = holed(keys, "a"), holed(whole, "b")
    return a.join(b, ["hole", "end"]).filter((F.length("b_word") >= 4) & (F.levenshtein("a_word", "b_word") <= 2)).select(F.col("a").alias("key")).distinct()


def _unending(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """Closing words (``two``) after which lines go on: P(end | two words) leaning on P(end | last word) with the weight of four lines. That a line ends in just any name or number says nothing."""
    counted = stats.filter(F.col("key").startswith("$")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ends") == 2, F.col("n")).otherwise(0)).alias("e"))
    keys = asked.select("two", "one").distinct()
    j = keys.join(counted.select(F.col("key").alias("two"), F.col("n").alias("n2"), F.col("e").alias("e2")), "two", "left").join(counted.select(F.col("key").alias("one"), F.col("n").alias("n1"), F.col("e").alias("e1")), "one", "left").fillna(0, ["n1", "e1", "n2", "e2"])
    p = (F.col("e2") + 4 * F.coalesce(F.try_divide("e1", "n1"), F.lit(0.5))) / (F.col("n2") + 4)
    told = (F.col("n2") >= CLOSING_LINES) | (F.col("n1") >= CLOSING_LINES) & ~F.col("one").isin("$X", "$0")
    return j.filter((p < CLOSING_SHARE) & told).select("two", F.lit(True).alias("unending"))


def _likely(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``df`` without most of the rows whose digest isn't among the wanted ones, so that a join doesn't shuffle them: bits by hash are broadcast, 2**26 at most."""
    word, bit = "shiftrightunsigned(xxhash64(digest), 44)", "cast(xxhash64(digest) & 63 as int)"
    bits = wanted.groupBy(F.expr(word).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"))
    return df.withColumn("word", F.expr(word)).join(F.broadcast(bits), "word").filter(f"(shiftrightunsigned(bits, {bit}) & 1) = 1").drop("word", "bits")


def truncation(df: DataFrame) -> DataFrame:
    """One row for each reading: ``reading_id``, ``source_key``, ``truncated``, ``evidence`` (``aligned``, ``closing``, ``terminality`` or null).

    Shuffles: line keys (summed by each task), band keys, the texts of compared
    pairs only, and marks of the bands of texts that their longest copies don't
    verify. Small results are written before they are joined, so that the plan
    knows their size.
    """
    digest = F.unhex(F.md5(F.concat_ws("\0", F.coalesce("result_format", F.lit("")), F.col("content"))))
    texts = df.select(F.col("reading_id").cast("bigint").alias("reading_id"), "source_key", "content", "result_format", digest.alias("digest"))
    both = stored(texts.mapInArrow(_scan, _SCAN), "scanned")
    scanned = both.filter(F.col("verdict").isNotNull()).drop("ends", "n")
    counts = stored(both.filter(F.col("verdict").isNull()).groupBy("key", "ends").agg(F.sum("n").alias("n")), "line-counts")
    stats = stored(
        counts.filter(~F.col("key").startswith("$")).groupBy("key").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("ends") > 0, F.col("n")).otherwise(0)).alias("n_ends"), F.sum(F.when(F.col("ends") == 2, F.col("n")).otherwise(0)).alias("n_inner"))
        # a short key may be a broken word that only texts cut there have: it needs a text that went on after it
        .filter((F.col("n_all") >= 5) & (F.col("n_ends") >= WHOLE_SHARE * F.col("n_all")) & (F.col("key").endswith("+") | (F.col("n_inner") >= 1))),
        "line-keys",
    )
    good = (F.col("n_ends") >= 2 * WHOLE_SHARE * F.col("n_all")) & (F.col("n_all") >= 8)
    strict = stats.filter(good).select(F.concat(F.lit("!"), F.col("key")).alias("key"))
    whole = stats.filter(~F.col("key").endswith("|++") | good).select("key")
    ask = scanned.filter("verdict = 'ask'")
    keys = ask.select("key").distinct()
    known = whole.union(strict)
    begun = keys.join(known, "key", "left_semi").union(_nearly(keys.join(known, "key", "left_anti"), whole)).withColumn("begun", F.lit(True))
    asked = stored(ask.select("key", "two").distinct().join(begun, "key", "left").join(_unending(ask, counts), "two", "left"), "asked")
    # near-copies among distinct texts; those with an open end meet the longest of their band. Most bands hold one text,
    # or none with an open end: they are counted by their key alone, and only the members of the others are looked at
    def shared(keys: str) -> DataFrame:
        banded = scanned.select("digest", "length", "open", F.explode(keys).alias("band")).filter("band != 0")
        # whether several texts have a band, not how often one was read; another hash for each band, so that no two texts are taken for one in all of theirs
        counted = banded.withColumn("text", F.hash("digest", "band")).groupBy("band").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.bool_or("open").alias("open"))
        return banded.join(stored(counted.filter("a != b AND open").select("band"), f"shared-{keys}"), "band")

    # runs that several texts share are few, so that they are looked at apart
    texts_of = stored(shared("bands").union(shared("runs")).groupBy("band", "digest").agg(F.first("length").alias("length"), F.first("open").alias("open")), "band-texts")
    longest = texts_of.groupBy("band").agg(F.max(F.struct("length", "digest")).alias("top"), F.count("*").alias("n")).filter("n > 1").select("band", F.col("top.digest").alias("long"))
    members = stored(texts_of.join(longest, "band").select("band", "digest", "length", "open", "long"), "members")
    pairs = members.filter("open AND digest != long").select("digest", "long").distinct()
    # no semi-join, which the optimizer would put before the broadcast bits
    body = _likely(texts.select("digest", "content", "result_format"), members).join(members.select("digest").distinct(), "digest").groupBy("digest").agg(F.first("content").alias("content"), F.first("result_format").alias("fmt"))
    body = stored(body, "bodies")

    def compared(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(body.select("digest", F.col("content").alias("short_text"), "fmt"), "digest")
            .join(body.select(F.col("digest").alias("long"), F.col("content").alias("long_text")), "long")
            .select("digest", "long", _verified("short_text", "long_text", "fmt").alias("found"))
        )

    tried = stored(compared(pairs), "tried")
    # what no longest copy verifies meets the other longer ones of its bands that share the mark of its end
    left = tried.groupBy("digest").agg(F.max("found").alias("found")).filter("found IS NULL").select("digest")
    ends = stored(members.join(left, "digest", "left_semi").select("band", "digest", "length"), "ends")
    near = members.join(ends.select("band").distinct(), "band", "left_semi").select("band", F.col("digest").alias("long"), F.col("length").alias("long_length"))
    schema = "digest binary, mark bigint"
    tails = body.select("digest", "content").join(left, "digest", "left_semi").mapInArrow(_marked(True), schema)
    held = body.select("digest", "content").join(near.select(F.col("long").alias("digest")).distinct(), "digest", "left_semi").mapInArrow(_marked(False), schema)
    held = held.join(tails.select("mark").distinct(), "mark", "left_semi").withColumnRenamed("digest", "long")
    # an ellipsis at the longer's end isn't in its length
    more = ends.join(tails, "digest").join(near.join(held, "long"), ["band", "mark"]).filter("digest != long AND long_length + 3 > length").select("digest", "long").distinct()
    more = compared(more.join(tried, ["digest", "long"], "left_anti"))
    told = tried.select("digest", "found").union(more.select("digest", "found")).filter("found IN ('cut', 'on')").groupBy("digest").agg(F.min("found").alias("copy"))
    told = stored(told, "told")
    out = scanned.join(asked, ["key", "two"], "left").join(told, "digest", "left")
    unasked = F.col("verdict") == "ask"
    evidence = (
        F.when(F.col("copy") == "cut", "aligned").when(F.col("verdict") == "cut", "terminality")
        .when(unasked & (F.col("copy") == "on"), None).when(unasked & F.col("unending"), "closing").when(unasked & F.col("begun").isNull(), "terminality")
    )
    return (
        out.withColumn("evidence", evidence)
        .groupBy("reading_id").agg(F.first("source_key").alias("source_key"), F.min("evidence").alias("evidence"))
        .select("reading_id", "source_key", F.col("evidence").isNotNull().alias("truncated"), "evidence")
    )


def found(df: DataFrame) -> DataFrame:
    """p4_found: readings whose content was cut."""
    return truncation(df).filter("truncated").select("reading_id")


def by_source(df: DataFrame) -> DataFrame:
    """For each source the number of its readings, how many are cut, and their share."""
    return truncation(df).groupBy("source_key").agg(F.count("*").alias("n_readings"), F.count_if("truncated").alias("n_cut"), F.avg(F.col("truncated").cast("double")).alias("cut_share"))
