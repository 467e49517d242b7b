"""Garbled text from a wrong character encoding: round-trip repair.

Method. A text that was decoded with the wrong table is re-encoded under each
candidate legacy table and strictly decoded as the encoding that was meant.
The unit of a trial is a maximal run of non-ASCII characters, because every
candidate table agrees with ASCII below 0x80; so a text garbled only in part
is repaired only there. A trial stands if it lowers the garbling cost of the
words it touches; the best table of a text is kept and the trial is repeated
on its result, which peels nested layers until none lowers the cost.

Defined results
* null text -> null text, not garbled; empty or blank text -> itself.
* text without any suspicious character passes a vectorised test and no more.
* bytes that were lost (U+FFFD, or runs of ``?`` inside words) can't be
  restored: the text counts as garbled, ``encoding_status`` is ``lost``.
* ties between tables go to the first in ``WRONG``.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters beyond ASCII of the languages the corpus holds, and of
# the foreign names that occur in correct text.
LATIN_LETTERS = "ÀÂÆÇÈÉÊËÎÏÔŒÙÛÜŸÄÖẞÁÍÑÓÚĄĆĘŁŃŚŹŻàâæçèéêëîïôœùûüÿäößáíñóúąćęłńśźżãõåøòìðþÅØÃÕ"
CYRILLIC_LETTERS = "".join(map(chr, range(0x410, 0x450))) + "ЁёЄєІіЇїҐґѢѣѲѳѴѵ"
TYPOGRAPHY = "’‘“”„‚«»‹›—–…№ºª§¿¡° ­¬‐‑·•×½"
# Tables that text is wrongly decoded with, most usual first.
WRONG = (
    "cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "cp866", "koi8-r",
    "mac-roman", "iso8859-2", "iso8859-5", "cp852", "mac-cyrillic", "iso8859-15", "koi8-u",
)
# (wrong, meant) pairs of single-byte tables.
SINGLE = (
    ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "cp866"), ("latin-1", "cp866"), ("cp437", "cp866"), ("koi8-r", "cp866"), ("cp866", "koi8-r"),
    ("mac-roman", "cp1251"), ("mac-cyrillic", "cp1251"), ("cp1251", "mac-cyrillic"), ("cp1251", "koi8-u"), ("cp1252", "koi8-u"), ("latin-1", "koi8-u"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("latin-1", "iso8859-2"), ("cp1250", "iso8859-2"),
    ("iso8859-2", "cp1250"), ("cp437", "cp852"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"),
    ("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("cp1252", "cp437"), ("cp852", "cp1250"), ("cp1250", "cp852"), ("cp1251", "cp1250"),
)
# Signs that recognition engines put for Latin letters.
MISREAD = "€†ɑ"

_GOOD = frozenset(LATIN_LETTERS + CYRILLIC_LETTERS)
_TYPO = frozenset(TYPOGRAPHY)
_LATIN = frozenset(LATIN_LETTERS)
_CYR = frozenset(CYRILLIC_LETTERS)
_RUNS = re.compile(r"([^\x00-\x7f]+)")
_WORD = re.compile(r"[^ \n\t\r]+")
# A raised figure in a long word: the Polish letters stand there in the Central European tables.
_RAISED = re.compile(r"[^\W\d_]{3,}[³¹]|[³¹][^\W\d_]{3,}")
# A capital or a cedilla between small letters: no engine misreads so, and no word is spelled so.
_STRONG = re.compile(r"[a-z][À-Þ¸][a-z]")
_CONTROL = re.compile(r"[\x00-\x1f]")


# Classes of characters for the vectorised test.
_OTHER, _ALOW, _AUP, _CLOW, _CUP, _LLOW, _LUP, _PLOW, _PUP, _OPEN, _CLOSE, _OK, _MISREAD, _BAD, _ASK = range(15)


def _classes() -> np.ndarray:
    t = np.full(0x110000, _BAD, np.uint8)
    t[:0x80] = _OTHER

    def put(chars: str, k: int) -> None:
        t[[ord(c) for c in chars]] = k

    put("abcdefghijklmnopqrstuvwxyz", _ALOW)
    put("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _AUP)
    for c in CYRILLIC_LETTERS:
        put(c, _CUP if c.isupper() else _CLOW)
    for x in range(0xC0, 0x100):
        if x not in (0xD7, 0xF7):
            t[x] = _LUP if chr(x).isupper() else _LLOW
    for c in "ŒœĄąĆćĘęŁłŃńŚśŹźŻż":
        put(c, _PUP if c.isupper() else _PLOW)
    put("“„«—–…№º§¿", _OPEN)
    put("”»", _CLOSE)
    put("’­¬‐‑", _OK)
    put(MISREAD, _MISREAD)
    put("?", _ASK)
    return t


_TABLE = _classes()
_IS_LETTER = np.zeros(15, bool)
_IS_LETTER[[_ALOW, _AUP, _CLOW, _CUP, _LLOW, _LUP, _PLOW, _PUP]] = True
_IS_LOW = np.zeros(15, bool)
_IS_LOW[[_ALOW, _CLOW, _LLOW, _PLOW]] = True


def suspicious(texts: list[str | None]) -> np.ndarray:
    """Which texts ``repair`` has to look at closely.

    They hold a character outside the alphabets, a typographic sign inside a
    word, a case break, three accented Latin letters in a row, mixed scripts,
    or traces of lost bytes. One table look-up a character over the batch.
    """
    if not len(texts):
        return np.zeros(0, bool)
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):  # blocks of bounded size
        size += len(t) if t else 0
        if size > 2_000_000 or i == len(texts) - 1:
            out.append(_suspicious(texts[at : i + 1]))
            at, size = i + 1, 0
    return np.concatenate(out)


def _suspicious(texts: list[str | None]) -> np.ndarray:
    lens = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    cp = np.frombuffer(("\n".join(t or "" for t in texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    b = _TABLE[cp]
    if not (b > _AUP).any():
        return np.zeros(len(lens), bool)
    b, c = b[:-1], b[1:]
    a = np.concatenate([[_OTHER], b[:-1]]).astype(np.uint8)
    let_a, let_c = _IS_LETTER[a], _IS_LETTER[c]
    ascii_ = (b == _ALOW) | (b == _AUP)
    two_before = np.concatenate([[False, False], (ascii_[1:] & ascii_[:-1])[:-1]])
    two_after = np.concatenate([(ascii_[1:] & ascii_[:-1])[1:], [False, False]])
    cyr, lat = (b == _CLOW) | (b == _CUP), (b == _LLOW) | (b == _LUP)
    lat_a, lat_c = (a == _LLOW) | (a == _LUP), (c == _LLOW) | (c == _LUP)
    mark = (b == _OPEN) | (b == _CLOSE)
    odd = (b == _BAD) | (b == _MISREAD) & (cp[np.arange(len(b)) - 1] == 0xE2)
    odd |= lat & lat_a & lat_c
    odd |= ((b == _CUP) | (b == _LUP)) & _IS_LOW[a]
    odd |= (b == _CUP) & ((c == _OPEN) | (c == _CLOSE) | (c == _OK))
    odd |= cyr & (lat_a | lat_c | two_before | two_after)
    odd |= (b == _OPEN) & let_a & let_c
    odd |= mark & ((c == _OPEN) | (c == _CLOSE))
    odd |= (b == _ASK) & ((c == _ASK) | let_a & let_c)
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    return np.logical_or.reduceat(odd[: int(lens.sum())], starts)


def repaired(texts: list[str | None]) -> list[str | None]:
    """The texts as they should read."""
    return [repair(t)[0] if o else t for t, o in zip(texts, suspicious(texts), strict=True)]


@lru_cache(maxsize=None)
def _to_byte(name: str) -> dict[str, int]:
    """Character -> byte of a table; undefined bytes are their C1 controls, as web decoders have it."""
    out = {}
    for b in range(128, 256):
        try:
            ch = bytes([b]).decode(name)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    return out


@lru_cache(maxsize=200_000)
def word_cost(w: str) -> float:
    """Garbling cost of a word: 0 for words any of the alphabets could have."""
    cost, prev, run = 0.0, "", 0
    n = len(w)
    for i, ch in enumerate(w):
        if ch < "\x80":
            if ch.isupper() and prev.islower():
                cost += 0.5
            elif prev in _CYR and ch.isalpha():
                cost += 1
            run = 0
        elif ch in _GOOD:
            if prev:
                if ch.isupper() and prev.islower():
                    cost += 1
                if ch.islower() and i >= 2 and prev.isupper() and w[i - 2].isupper():
                    cost += 0.5
                if i == 1 and n > 3 and prev.islower() and prev in _CYR and w[1:].rstrip(".,;:!?»”)").isupper():
                    cost += 2
                if (ch in _CYR) != (prev in _CYR) and prev.isalpha():
                    cost += 1
            run = run + 1 if ch in _LATIN else 0
            if run >= 3:
                cost += 1.5 if run == 3 else 0.7
            if ch in "ãõåøòìðþÅØÃÕ":
                cost += 0.4
        elif ch in "—–…":
            run, ch = 0, ""
        elif ch in _TYPO:
            after = w[i + 1] if i + 1 < n else ""
            if after.isalpha() and prev.isalpha() and ch not in "’‘­¬‐‑·":
                cost += 1
            elif ch in "‚¬·•×°½‹›£" and (prev.isalpha() or after.isalpha()) or ch in "ªº‘" and prev.isalpha() and prev != "n" and prev != "N":
                cost += 0.7
            elif prev and prev in _TYPO and ch not in "’”»":
                cost += 0.5
            elif ch in "“„«№§" and prev.isalpha():
                cost += 0.7
            run = 0
        elif "\x80" <= ch < "\xa0":
            cost += 2
            run = 0
        elif ch == "�":
            cost += 2
        else:
            cost += 1.5
            run = 0
        prev = ch
    return cost


@lru_cache(maxsize=500_000)
def _run_undone(run: str, wrong: str, meant: str) -> str:
    """A run of non-ASCII characters re-encoded and decoded, where both work strictly."""
    table = _to_byte(wrong)
    try:
        return bytes([table[c] for c in run]).decode(meant)
    except (KeyError, UnicodeDecodeError):
        return run


def _undo(w: str, wrong: str, meant: str) -> str:
    """The word with each of its runs undone."""
    parts = _RUNS.split(w)
    for i in range(1, len(parts), 2):
        parts[i] = _run_undone(parts[i], wrong, meant)
    new = "".join(parts)
    return w if _CONTROL.search(new) else new


def _better(w: str, wrong: str, meant: str) -> tuple[str, float]:
    """(the word undone, cost saved) if that is cheaper, else (the word, 0)."""
    return _judged(w, _undo(w, wrong, meant), wrong, meant)


def _judged(w: str, new: str, wrong: str, meant: str) -> tuple[str, float]:
    if new == w:
        return w, 0.0
    before, after = word_cost(w), word_cost(new)
    drop = before - after
    if before == after == 0 and (wrong, meant) in _SWAPPED and w.isupper() and new.islower():
        return new, 0.0  # these tables swap the cases: a lower-case word shows as capitals
    if drop <= 0:
        return w, 0.0
    if meant == "utf-8":
        return (new, drop) if after < 0.7 or drop >= 2 else (w, 0.0)
    # A single-byte table decodes anything: the result has to be a flawless word of one script,
    # and signs that recognition engines put for letters prove nothing.
    if after > 0 or any(c in MISREAD for c in w):
        return w, 0.0
    core = new.strip("«»“”„’.,;:!?()—–-…\n")
    if len(core) < 2 or not (all(c in _CYR or c == "-" for c in core) or meant in ("cp1252", "cp1250", "iso8859-2", "cp852", "cp850", "cp437", "mac-roman") and not any(c in _CYR for c in core)):
        return w, 0.0
    return new, drop


# Cyrillic letters, most frequent first.
_RANK = {c: i for i, c in enumerate("оеаинтсрвлкмдпуяызьбгчйхжюшцщэфъёіїєґѣѳ")}


def _rarity(w: str) -> float:
    """Mean rank of a word's letters by frequency."""
    ranks = [_RANK.get(c, 40) for c in w.lower() if c.isalpha()]
    return sum(ranks) / len(ranks) if ranks else 0.0


def _applied(w: str, wrong: str, meant: str) -> str:
    """The word under the table that the text was found to be garbled by: strict UTF-8 is then evidence enough."""
    if meant == "utf-8":
        new = _undo(w, wrong, meant)
        if new != w and (word_cost(new) <= word_cost(w) or not w.strip(".,;:!?»«“”„()").isalpha()):
            return new
    new, drop = _better(w, wrong, meant)
    if not drop and meant in ("cp1251", "koi8-r", "koi8-u", "cp866", "mac-cyrillic") and not any(c in _CYR or "A" <= c <= "z" for c in w):
        # single letters of a text that is Cyrillic: they cost nothing in either script
        other = _undo(w, wrong, meant)
        if word_cost(other) == 0 and all(c in _CYR or c in ".,;:!?-" for c in other):
            return other
    if not drop and wrong == "cp866" and meant == "cp1251":
        # two Cyrillic tables that overlap in letters: their frequencies decide
        other = _undo(w, wrong, meant)
        if word_cost(other) == 0 and _rarity(other) < _rarity(w):
            return other
    return new


@lru_cache(maxsize=200_000)
def _readings(run: str) -> dict[int, str]:
    """The tables that change a run of non-ASCII characters, by number, with what it becomes."""
    out = {}
    for i, p in enumerate(_PAIRS):
        if p[1] == "utf-8" and len(run) < 2:
            continue  # a character of UTF-8 beyond ASCII shows as two signs or more
        new = _run_undone(run, *p)
        if new != run and not _CONTROL.search(new):
            out[i] = new
    return out


@lru_cache(maxsize=200_000)
def _gains(w: str) -> tuple[tuple[int, float, frozenset[str], float], ...]:
    """For each table that makes the word cheaper: its number, cost saved, characters changed, and share of frequent letters for tables with swapped cases."""
    out = []
    parts = _RUNS.split(w)
    runs = [_readings(r) for r in parts[1::2]]
    for i in sorted(set().union(*runs)):
        p = _PAIRS[i]
        new = "".join(runs[k // 2].get(i, x) if k % 2 else x for k, x in enumerate(parts))
        new, drop = _judged(w, new, *p)
        if drop:
            out.append((i, drop, frozenset(w) - frozenset(new), sum(c in _FREQUENT for c in new.lower()) / len(new) if p in _SWAPPED else 0.0))
    return tuple(out)


def _trials(bad: list[str]) -> list[tuple[int, float, int, int]]:
    """Over all distinct costly words, for each table that saves anything: its number, cost saved, words changed, distinct characters changed."""
    sums: dict[int, list] = {}
    for w in bad:
        for i, drop, chars, share in _gains(w):
            t = sums.setdefault(i, [0.0, 0, set(), 0.0])
            t[0] += drop
            t[1] += 1
            t[2] |= chars
            t[3] += share
    return [(i, saved * share / words if _PAIRS[i] in _SWAPPED else saved, words, len(chars)) for i, (saved, words, chars, share) in sorted(sums.items())]


_LOST_INNER = re.compile(r"[^\W\d_]\?+[^\W\d_]")
_LOST_WORD = re.compile(r"[^\W\d_]\?{2,}|\?{2,}[^\W\d_]|(?<!\S)\?{3,}(?!\S)")


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """(text as it should read, layers undone, whether bytes were lost)."""
    if not text or (text.isascii() and "?" not in text):
        return text, 0, False
    layers, least = 0, float("inf")
    while True:
        bad = sorted(w for w in set(_WORD.findall(text)) if not w.isascii() and word_cost(w) > 0)
        cost = sum(map(word_cost, bad))
        if not cost < least:  # nothing left, or the last layer saved nothing
            break
        least = cost
        most, pair = 0.0, None
        for i, saved, words, chars in _trials(bad):
            p = _PAIRS[i]
            if saved > most + 1e-9 and (p[1] == "utf-8" and saved >= 0.7 or p[1] in ("cp1250", "iso8859-2") and saved >= 1 and any(_RAISED.search(w) for w in bad) or p[1] == "cp1252" and saved >= 1 and any(_STRONG.search(w) and _better(w, *p)[1] for w in bad) or words >= (2 if p in _SWAPPED else 3) and chars >= 2 and saved >= (1 if p in _SWAPPED else 2.5)):
                most, pair = saved, p
        if pair is None:
            break
        text, layers = _WORD.sub(lambda m, p=pair: m[0] if m[0].isascii() else _applied(m[0], *p), text), layers + 1
    inner = len(_LOST_INNER.findall(text)) if "?" in text else 0
    lost = "�" in text or inner >= 2 or "??" in text and (inner >= 1 and bool(_LOST_WORD.search(text)) or len(_LOST_WORD.findall(text)) >= 3)
    return text, layers, bool(lost)


# Tables with swapped cases; of several that fit, the letters' frequencies decide.
_SWAPPED = frozenset((a, b) for a, b in SINGLE if {a, b} <= {"cp1251", "koi8-r", "koi8-u"})
_FREQUENT = frozenset("оеаинтсрвлі")
_PAIRS = [(w, "utf-8") for w in WRONG] + list(SINGLE)
_TYPE = T.StructType([T.StructField("text", T.StringType()), T.StructField("layers", T.IntegerType()), T.StructField("lost", T.BooleanType())])
_ARROW = pa.struct([("text", pa.string()), ("layers", pa.int32()), ("lost", pa.bool_())])


@F.arrow_udf(_TYPE)
def _repair(texts: pa.Array) -> pa.Array:
    """Null for texts that stay as they are."""
    x = texts.to_pylist()
    out = []
    for t, odd in zip(x, suspicious(x), strict=True):
        r = repair(t) if odd else None
        out.append(dict(zip(("text", "layers", "lost"), r, strict=True)) if r and (r[1] or r[2]) else None)
    return pa.array(out, _ARROW)


def repair_encoding(df: DataFrame, text: str = "content", prefix: str = "encoding_") -> DataFrame:
    """``df`` with ``{prefix}text``, ``{prefix}layers`` and ``{prefix}status`` (``clean``, ``repaired``, ``lost``).

    Narrow: one scan, no shuffle. Columns of those names are replaced.
    """
    r = f"{prefix}__r"
    out = df.withColumn(r, _repair(F.col(text)))
    status = F.when(F.col(r).isNull(), "clean").when(F.col(r)["lost"], "lost").otherwise("repaired")
    return out.withColumns({
        f"{prefix}text": F.coalesce(F.col(r)["text"], F.col(text)),
        f"{prefix}layers": F.coalesce(F.col(r)["layers"], F.lit(0)),
        f"{prefix}status": status,
    }).drop(r)


def found(df: DataFrame) -> DataFrame:
    """p5_found: prose readings that a wrong encoding has spoilt, restorable or lost."""
    prose = df.filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "content")
    return prose.filter(_repair(F.col("content")).isNotNull()).select("reading_id").distinct()
