"""Noise of scanned pages: found, and repaired into continuous paragraphs.

Method. A noisy channel: a word with a sign or letter that is odd where it
stands has candidate originals, one for each way to read its odd signs; a
candidate's score is the channel's probability times the likelihood after its
neighbour under the corpus's own Kneser-Ney model; staying as it is is a
candidate too. Viterbi decodes each line over the candidates, and the decoded
path decides what was misread. The channel is estimated from the corpus by
expectation-maximisation: the odd signs of all words with one such sign are
read as every letter, or as nothing, that makes a word of the corpus, shared
by the words' likelihoods. Letters read as others of the same script, or two as one, leave no
odd sign: for the repair, rare words are read through a channel of shapes
(``misread_shapes``), whose chances are learnt in the same way. Look-ups go to the key range that holds them; a
page's lattice then brings all it needs.

Running lines are the head and foot lines of a job that agree on three pages
or more: equal ones are counted, others meet in min-hash bands over letter
trigrams inside a job, and an edit distance of at most a quarter of the length
confirms. Page numbers are told by their form at the head or foot. Words
broken at a line end are joined, unless the two parts are a compound that
stands with its hyphen elsewhere in the corpus.

Defined results
* null, empty or blank text: no noise, text unchanged.
* a content that is nothing but a number is a stub, not a page number.
* ties between candidates: as it stands, then the first by name.
* a word of which half the characters are odd signs, or whose letters make no
  word, stays; so does a misread word with no known original, but it counts.
* a reading delivered twice counts once; pages of a job count by page number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.encoding import repair, suspicious
from quirespark.llm.repetition import _NAMES, BIGRAM, GRAMS, WORD, WORD_BACKOFF, GramCounter, Model, Words, _mix, look_up, mixed, repeats, train_from
from quirespark.llm.truncation import _GAP, PAGE_NUMBER, closes, fold_word
from quirespark.session import discard, stored

# Shapes that engines take for each other, (read, printed); how often they do is learnt from the corpus.
SHAPES = (
    ("ii", "u"), ("ri", "n"), ("rn", "m"), ("rii", "m"), ("in", "m"), ("ni", "m"), ("iii", "m"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("lc", "k"), ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("h", "b"), ("b", "h"),
    ("f", "s"), ("s", "f"), ("u", "n"), ("n", "u"), ("o", "a"), ("a", "o"), ("t", "f"), ("q", "g"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("u", "ii"), ("о", "с"), ("с", "о"), ("п", "н"), ("н", "п"), ("и", "н"), ("ш", "щ"), ("ь", "ъ"),
)
#: A word seen this often at most may be a misread form of one seen ``TIMES`` as often and ``KNOWN`` times.
RARE, TIMES, KNOWN = 2, 20, 20
#: Letters a word needs to be read otherwise by one shape, and by two.
ONE_SHAPE, TWO_SHAPES = 5, 8
MIN_WORDS = 3
MIN_PAGES = 3
EDGE_BANDS = 6

# Letters an odd sign may stand for, and letters that only look like another script's.
LATIN = "abcdefghijklmnopqrstuvwxyzàâäáãåæçèéêëìíîïñòóôöõœùúûüßąćęłńśźżABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÉÈÎÖÓÜŁŚŻ"
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґѣѳАБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯІЇЄҐ"
#: Log2 likelihoods: of a word the corpus doesn't know, of one that isn't even shaped like a word, of a sign that can't stand staying where it is.
UNKNOWN, SHAPELESS, STANDS_NOT = -26.0, -40.0, -20.0
#: Readings of a sign below this share of its likeliest are left out.
LEAST_READING = 0.002
#: Channel of a sign the corpus gives no evidence of: every letter alike.
EVEN = 0.02

_LETTER = r"[^\W\d_]"
_BREAK = re.compile(rf"({_LETTER}+)([-¬­=‐‑])[ \t]*\n[ \t]*({_LETTER}+)")
_TOKEN = re.compile(r"[^\s/@]+")
_EDGE = "«»“”„’‘\"'.,;:?()[]—–-*#…"
_ORDINAL = re.compile(r"^(?:\d+(?:[½¼¾]|st|nd|rd|th|e|er|re|ère|ème|a|o|r|v|го|й|я|е|ої|ий|х|м|ст|d)?|n\.?º|№.*)$", re.I)
_ODD_SIGN = re.compile(r"[0-9!|€†ɑ]")
_VOWEL = re.compile(r"[aeiouyàâäáãåæèéêëìíîïòóôöõœùúûüąęаеёиоуыэюяіїєѣѵ]", re.I)
_MISREAD = re.compile(rf"{_LETTER}[0-9!|€†]+{_LETTER}|{_LETTER}[€†]|[€†]{_LETTER}{{2}}|ɑ|(?<![^\W_])[0-9]{_LETTER}{{3}}|{_LETTER}{{3}}[0-9](?![^\W_])")
_MIXED = re.compile(r"[А-яЁёІіЇїЄєҐґѢѣ][A-Za-z]|[A-Za-z][А-яЁёІіЇїЄєҐґѢѣ]")
_CYR = re.compile(r"[А-яЁёІіЇїЄєҐґѢѣ]")


@lru_cache(maxsize=200_000)
def misread(token: str) -> bool:
    """Whether the token holds a character that can't stand in a word."""
    if token.isalpha() and token.isascii():
        return False
    core = token.strip(_EDGE)
    if not core or _ORDINAL.match(core):
        return False
    return bool(_MISREAD.search(core) or _MIXED.search(core))


@lru_cache(maxsize=200_000)
def odd_signs(core: str) -> tuple[bool, tuple[int, ...]]:
    """(whether the word is Cyrillic, positions of signs that are odd in it): digits and marks beside letters, letters of the lesser script."""
    n = len(core)
    cyr = len(_CYR.findall(core))
    major = 0 < cyr >= sum(c.isascii() and c.isalpha() for c in core)
    out = []
    for i, c in enumerate(core):
        if c.isalpha() and c != "ɑ":
            if c.isascii() if major else _CYR.match(c):
                out.append(i)
        elif _ODD_SIGN.match(c) and (c == "ɑ" or i and core[i - 1].isalpha() or i + 1 < n and core[i + 1].isalpha()):
            out.append(i)
    return major, tuple(out)


@lru_cache(maxsize=200_000)
def doubtful(token: str) -> bool:
    """Whether a word holds an odd sign: what the decoder looks at. Ordinals aren't words."""
    if token.isalpha() and token.isascii():
        return False
    core = token.strip(_EDGE)
    if len(core) < 2 or _ORDINAL.match(core):
        return False
    at = odd_signs(core)[1]
    return bool(at) and 2 * len(at) <= len(core) + 1 and sum(c.isalpha() for c in core) > len(at) // 2


class Channel(NamedTuple):
    """(Cyrillic word or not, sign) -> its readings with log2 probabilities, likeliest first."""

    table: dict[tuple[bool, str], tuple[tuple[str, float], ...]]

    def readings(self, cyr: bool, sign: str) -> tuple[tuple[str, float], ...]:
        return self.table.get((cyr, sign)) or tuple((c, log2(EVEN)) for c in ("", *(CYRILLIC if cyr else LATIN)))


def channel_of(counts: list[tuple[bool, str, str, float]]) -> Channel:
    """Channel from expected counts of (Cyrillic, sign, reading, count)."""
    sums: dict[tuple[bool, str], dict[str, float]] = {}
    for cyr, sign, reading, n in counts:
        sums.setdefault((cyr, sign), {})[reading] = n
    table = {}
    for at, row in sorted(sums.items()):
        total, best = sum(row.values()) + 0.5, max(row.values())
        table[at] = tuple(sorted(((c, log2(n / total)) for c, n in row.items() if n >= LEAST_READING * best), key=lambda x: (-x[1], x[0])))
    return Channel(table)


def candidates(core: str, channel: Channel) -> list[tuple[str, float]]:
    """(candidate, log2 of the channel's probability) of a doubtful word: every combination of its signs' readings, those below ``LEAST_READING`` of the likeliest aside."""
    cyr, at = odd_signs(core)
    out, start = [("", 0.0)], 0
    for i in at:
        part = core[start:i]
        options = channel.readings(cyr, core[i])
        out = [(s + part + c, lp + q) for s, lp in out for c, q in options]
        floor = max(lp for _, lp in out) + log2(LEAST_READING)
        out = [x for x in out if x[1] >= floor]
        start = i + 1
    return [(s + core[start:], lp) for s, lp in out]


def shaped(word: str) -> bool:
    """Whether letters could make a word: all of one script, a vowel among them, capitals only in front or throughout."""
    return word.isalpha() and bool(_VOWEL.search(word)) and (word[1:].islower() or word.isupper() or len(word) == 1) and bool(_CYR.search(word)) != any(c.isascii() for c in word)


def edges(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(line, its inner neighbour) of the first two and last two lines that aren't blank."""
    lines = [x.strip() for x in text.split("\n")]
    full = [i for i, x in enumerate(lines) if x]
    if len(full) < 2:
        return [(lines[i], "") for i in full], []
    tops = [(lines[i], lines[i + 1] if i + 1 < len(lines) else "") for i in full[:2]]
    feet = [(lines[i], lines[i - 1] if i else "") for i in full[:-3:-1]]
    return tops, feet


def split_edge(line: str) -> tuple[bool, str]:
    """(whether a page number stands in the line, what is left of it)."""
    pieces = _GAP.split(line)
    numbers = [p for p in pieces if PAGE_NUMBER.match(p)]
    return bool(numbers), " ".join(p for p in pieces if not PAGE_NUMBER.match(p))


def norm_line(line: str) -> str:
    """A line's letters, case and misread signs aside."""
    return " ".join("".join(c for c in fold_word(w).lower() if c.isalpha()) for w in line.split()).strip()


def head_or_foot(line: str) -> bool:
    """Whether a line may be a running line by its form."""
    n = len(line.split())
    return 0 < n <= 9 and len(line) <= 70 and not closes(line) and line[-1] not in ",;:-¬­=" and not line[0].islower()


def page_parts(text: str) -> tuple[bool, list[str]]:
    """(page number at head or foot, possible running lines).

    A line is apart from the text if a blank line follows (at the foot: comes
    before), if it is a title by its capitals, or if the text begins anew there
    (at the foot: had ended).
    """
    tops, feet = edges(text)
    if not feet:
        return False, []
    number, running = False, []
    for top, side in ((True, tops), (False, feet)):
        (line, inner), *more = side
        has, rest = split_edge(line)
        number |= has

        def apart(line: str, inner: str, top: bool = top) -> bool:
            words = [w for w in line.split() if w[0].isalpha()]
            titled = len(words) <= 6 and 2 * sum(w[0].isupper() for w in words) > len(words) > 0 and len(line) <= 45
            return not inner or titled or (not inner[0].islower() if top else closes(inner))

        if rest and head_or_foot(rest) and (has or apart(rest, inner)):
            running.append(rest)
        if more and (has and not rest or rest and head_or_foot(rest)):
            line2, inner2 = more[0]
            has2, rest2 = split_edge(line2)
            # a number on the second line counts beside a running line, not inside a list
            number |= has2 and not rest2 and not (has and not rest)
            if rest2 and head_or_foot(rest2) and (has2 or not rest and apart(rest2, inner2)):
                number |= has2
                running.append(rest2)
    return number, [n for x in dict.fromkeys(running) if len(n := norm_line(x)) >= 4]


_ODD = [int(x) | 1 for x in np.random.default_rng(31_007).integers(1, 2**61, EDGE_BANDS)]
_MASK = (1 << 63) - 1


@lru_cache(maxsize=100_000)
def bands(norm: str) -> list[int]:
    """Min-hash values of the line's letter trigrams."""
    s = f"  {norm} "
    hashes = [xxhash.xxh3_64_intdigest(g) for g in {s[i : i + 3] for i in range(len(s) - 2)}]
    return [min([(h * a >> 7) & _MASK for h in hashes]) ^ k for k, a in enumerate(_ODD)]


def misread_sites(texts: list[str]) -> np.ndarray:
    """How many places of each text may hold a misread character: one table look-up a character over the batch."""
    from quirespark.llm.encoding import _AUP, _ALOW, _CLOW, _CUP, _IS_LETTER, _TABLE

    lens = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(lens):
        return lens
    cp = np.frombuffer(("\n".join(texts) + "\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    k = _TABLE[cp]
    letter, plain, cyr = _IS_LETTER[k], (k == _ALOW) | (k == _AUP), (k == _CLOW) | (k == _CUP)
    digit = (cp >= 0x30) & (cp <= 0x39)
    sign = (cp == 0x7C) | (cp == 0x21) | (cp == 0x20AC) | (cp == 0x2020)
    site = (digit | sign)[1:-1] & (letter[:-2] | letter[2:]) | (cp[1:-1] == 0x251)
    site |= plain[1:-1] & (cyr[:-2] | cyr[2:])
    counted = np.concatenate([[0], np.cumsum(np.concatenate([[False], site]))])
    ends = np.cumsum(lens)
    return counted[np.minimum(ends, len(counted) - 1)] - counted[ends - lens]


@lru_cache(maxsize=200_000)
def _edges(w: str) -> tuple[str, str, str]:
    core = w.strip(_EDGE)
    at = w.find(core) if core else 0
    return w[:at], core, w[at + len(core) :]


#: (before, word, after, channel, whether it is another word than it stands)
Cell = tuple[str, str, str, float, bool]


def cells(w: str, channel: Channel, cache: dict[str, list[Cell]]) -> list[Cell]:
    """The ways to read a token: first as it stands; a misread word that nothing makes a known word of keeps its signs."""
    if w not in cache:
        before, core, after = _edges(w)
        cyr, at = odd_signs(core) if doubtful(w) else (False, ())
        wordlike = bool(at) and shaped("".join(("а" if cyr else "a") if i in at else c for i, c in enumerate(core)))
        spoilt = wordlike and misread(w)
        cache[w] = [(before, core, after, STANDS_NOT if spoilt else 0.0, False)]
        if spoilt:
            cache[w].append((before, core, after, log2(EVEN) + (0.0 if shaped(core) else UNKNOWN - SHAPELESS), True))
        if wordlike:
            cache[w] += [(before, c, after, lp, True) for c, lp in candidates(core, channel)]
    return cache[w]


def lattices(lines: list[list[str]], channel: Channel, cache: dict[str, list[Cell]]) -> list[tuple[int, int, list[list[Cell]]]]:
    """(line, first word, ways to read each word) of the runs of doubtful words with their neighbours: a word that has one reading cuts the lattice."""
    out = []
    for n, words in enumerate(lines):
        i = 0
        while i < len(words):
            if not doubtful(words[i]):
                i += 1
                continue
            j = i
            while j < len(words) and doubtful(words[j]):
                j += 1
            a = max(0, i - 1)
            out.append((n, a, [cells(w, channel, cache) if k + a >= i and k + a < j else cells(w, channel, cache)[:1] for k, w in enumerate(words[a : j + 1])]))
            i = j
    return out


def _asked(runs: list, ids: Words) -> tuple[np.ndarray, np.ndarray, dict[str, int], np.ndarray]:
    """(kind, key) of all the model has to tell for these lattices; index and hashes of their words."""
    vocabulary = sorted({c[1].lower() for _, _, row in runs for cell in row for c in cell})
    hashes = np.array(ids(vocabulary), np.uint64) if vocabulary else np.zeros(0, np.uint64)
    index = {w: i for i, w in enumerate(vocabulary)}
    left, right = set(), set()
    for _, _, row in runs:
        for x, y in zip(row, row[1:]):
            a, b = [index[c[1].lower()] for c in x], [index[c[1].lower()] for c in y]
            left.update(a)
            right.update((i, j) for i in a for j in b)
    pairs = np.array(sorted(right), np.int64).reshape(-1, 2)
    two = _mix(hashes[pairs[:, 0]], hashes[pairs[:, 1]])
    backs = hashes[sorted(left)]
    kind = np.concatenate([np.full(len(hashes), WORD), np.full(len(backs), WORD_BACKOFF), np.full(len(two), BIGRAM)]).astype(np.int32)
    return kind, np.concatenate([hashes, backs, two]).view(np.int64), index, hashes


Told = dict[tuple[int, int], float]


def _signed(k: int) -> int:
    return k - (1 << 64) if k >> 63 else k


def decode(told: Told, ids: Words, lines: list[list[str]], channel: Channel, cache: dict[str, list[Cell]] | None = None) -> list[tuple[list[str], int]]:
    """For each line its likeliest words, and how many of them are other words than stand there: Viterbi, channel times bigram likelihood."""
    cache = {} if cache is None else cache
    out = [(list(x), 0) for x in lines]
    known: dict[str, tuple[int, float, float]] = {}

    def word(w: str) -> tuple[int, float, float]:
        """(hash, likelihood, back-off) of a word."""
        if w not in known:
            k = ids([w.lower()])[0]
            p = told.get((WORD, _signed(k)))
            known[w] = (k, p if p is not None else UNKNOWN if shaped(w) else SHAPELESS, told.get((WORD_BACKOFF, _signed(k)), 0.0))
        return known[w]

    def after(a: str, b: str) -> float:
        ka, _, back = word(a)
        kb, p, _ = word(b)
        two = told.get((BIGRAM, _signed(mixed(ka, kb))))
        return two if two is not None else back + p

    for n, start, row in lattices(lines, channel, cache):
        best = [[(c[3] + word(c[1])[1], 0) for c in row[0]]]
        for x, y in zip(row, row[1:]):
            step = []
            for c in y:
                top, k = max((best[-1][i][0] + after(a[1], c[1]), -i) for i, a in enumerate(x))
                step.append((top + c[3], -k))
            best.append(step)
        k = max(range(len(row[-1])), key=lambda i: (best[-1][i][0], -i))
        words, changed = out[n]
        for i in range(len(row) - 1, -1, -1):
            c = row[i][k]
            if c[4]:
                words[start + i] = "".join(c[:3])
                changed += 1
            k = best[i][k][1]
        out[n] = (words, changed)
    return out


_PAGE = "reading_id bigint, job_id string, page_number int, lines array<string>, doubtful int, signs int, number boolean, broken boolean, compounds array<string>, norms array<string>, bands array<array<bigint>>"
_SCAN = f"{GRAMS}, {_PAGE}, inline array<string>"
_AT_HYPHEN = re.compile(rf"-(?={_LETTER})")
_AT_BREAK = re.compile(rf"([-¬­=‐‑])[ \t]*\n[ \t]*({_LETTER}+)")
_AFTER = re.compile(rf"{_LETTER}+")


def _letters_before(text: str, end: int) -> str:
    at = end
    while at and text[at - 1].isalpha():
        at -= 1
    return text[at:end]


def breaks(text: str) -> list[tuple[str, str, str]]:
    """(part before, mark, part after) of the words broken at a line end."""
    return [(left, m[1], m[2]) for m in _AT_BREAK.finditer(text) if (left := _letters_before(text, m.start()))]


def compounds(text: str) -> list[str]:
    """Words of two parts with a hyphen inside a line, lower-case."""
    return [f"{left}-{_AFTER.match(text, m.end())[0]}".lower() for m in _AT_HYPHEN.finditer(text) if (left := _letters_before(text, m.start()))]


_SCHEMA = pa.schema([
    ("ord", pa.int8()), ("key", pa.int64()), ("ctx", pa.int64()), ("low", pa.int64()), ("n", pa.int64()),
    ("reading_id", pa.int64()), ("job_id", pa.string()), ("page_number", pa.int32()), ("lines", pa.list_(pa.string())), ("doubtful", pa.int32()), ("signs", pa.int32()),
    ("number", pa.bool_()), ("broken", pa.bool_()), ("compounds", pa.list_(pa.string())), ("norms", pa.list_(pa.string())),
    ("bands", pa.list_(pa.list_(pa.int64()))), ("inline", pa.list_(pa.string())),
])


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.record_batch([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch], least: int = MIN_WORDS) -> Iterator[pa.RecordBatch]:
    """One pass: bigram sums, compounds that stand inside a line, and each page's marks, with its lines that hold doubtful words if there are ``least`` such words."""
    words, counter, inline = Words(), GramCounter(order=2), set()
    letters = re.compile(r"[^\W\d_]+")
    for b in batches:
        texts = [t or "" for t in b.column(3).to_pylist()]
        odd = suspicious(texts)
        fixed = [repair(t) if o else (t, 0, False) for t, o in zip(texts, odd, strict=True)]
        flat: list[int] = []
        ends = []
        for f in fixed:
            flat += words(letters.findall(f[0].lower()))
            ends.append(len(flat))
        w, e = np.array(flat, np.uint64), np.array(ends, np.int64)
        for cols in counter.add(w, e):
            yield _rows(**dict(zip(_NAMES, cols, strict=True)))
        share = repeats(w, e).share
        keep = [i for i, f in enumerate(fixed) if not f[1] and not f[2] and share[i] < 0.25 and texts[i].strip()]
        out: dict[str, list] = {k: [] for k in ("lines", "doubtful", "signs", "number", "broken", "compounds", "norms", "bands")}
        sites = misread_sites(texts)
        for i in keep:
            t = texts[i]
            bad = [x for x in (_TOKEN.findall(t) if sites[i] >= least else ()) if doubtful(x)]
            out["doubtful"].append(len(bad))
            out["signs"].append(sum(map(misread, bad)))
            out["lines"].append([x for x in t.split("\n") if any(doubtful(y) for y in x.split())] if len(bad) >= least else [])
            number, norms = page_parts(t)
            out["number"].append(number)
            out["norms"].append(norms)
            out["bands"].append([bands(n) for n in norms])
            sure, maybe = False, set()
            for left, mark, right in breaks(t) if "\n" in t else ():
                if right[0].isupper() and not (left[-1].isupper() and len(left) > 1):
                    continue
                if mark in "-‐‑":
                    maybe.add(f"{left}-{right}".lower())
                else:
                    sure = True
            out["broken"].append(sure)
            out["compounds"].append(sorted(maybe))
            if "-" in t:
                inline.update(compounds(t))
        at = pa.array(keep, pa.int64())
        yield _rows(reading_id=b.column(0).take(at), job_id=b.column(1).take(at), page_number=b.column(2).take(at), **out)
        if len(inline) > 100_000:
            yield _rows(inline=[sorted(inline)])
            inline = set()
    for cols in counter.flush():
        yield _rows(**dict(zip(_NAMES, cols, strict=True)))
    if inline:
        yield _rows(inline=[sorted(inline)])


def running_lines(scanned: DataFrame) -> DataFrame:
    """(job_id, norm) of the lines that stand on ``MIN_PAGES`` pages of their job, small misreadings aside."""
    x = F.explode(F.arrays_zip("norms", "bands")).alias("x")
    once = scanned.select("job_id", "page_number", x).groupBy("job_id", "page_number", F.col("x.norms").alias("norm")).agg(F.first("x.bands").alias("bands"))
    once = stored(once, "edge-lines")
    equal = once.groupBy("job_id", "norm").agg(F.count("*").alias("n"), F.any_value("bands").alias("bands"))
    accepted = equal.filter(F.col("n") >= MIN_PAGES).select("job_id", "norm")
    seen = once.select("job_id", "page_number", "norm", F.explode("bands").alias("band"))
    counted = equal.select("job_id", "norm", "n", F.explode("bands").alias("band"))
    top = counted.groupBy("job_id", "band").agg(F.max(F.struct("n", "norm")).alias("top"), F.sum("n").alias("all")).filter(F.col("all") >= MIN_PAGES).select("job_id", "band", F.col("top.norm").alias("top"))
    near = seen.join(top, ["job_id", "band"]).filter(F.levenshtein("norm", "top") <= F.floor(F.length("top") / 4))
    whole = near.groupBy("job_id", "band", "top").agg(F.count_distinct("page_number").alias("pages")).filter(F.col("pages") >= MIN_PAGES)
    return near.join(whole.select("job_id", "band"), ["job_id", "band"], "left_semi").select("job_id", "norm").unionByName(accepted).distinct()


def scan(df: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, Model]:
    """(stored marks of the pages and in-line compounds of prose readings, the corpus's bigram model)."""
    prose = df.filter(F.col("result_format").isin("text", "markdown")).select(F.col("reading_id").cast("bigint").alias("reading_id"), "job_id", F.col("page_number").cast("int").alias("page_number"), "content")
    scanned = stored(prose.mapInArrow(lambda batches: _scan(batches, least), _SCAN), "pages")
    return scanned, train_from(scanned.filter(F.col("ord").isNotNull()).select(*_NAMES), order=2, kinds=(WORD, BIGRAM, WORD_BACKOFF))


_WAYS = "token string, n bigint, cyr boolean, sign string, reading string, kind int, key bigint"


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every way to read the odd sign of each word that has one."""
    ids = Words()
    for b in batches:
        rows, words = [], []
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            core = token.strip(_EDGE)
            cyr, at = odd_signs(core)
            if len(at) == 1:
                i = at[0]
                for c in ("", *(CYRILLIC if cyr else LATIN)):
                    word = core[:i] + c + core[i + 1 :]
                    if shaped(word):
                        rows.append((token, n, cyr, core[i], c))
                        words.append(word.lower())
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        key = np.array(ids(words), np.uint64).view(np.int64) if words else np.zeros(0, np.int64)
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
        yield pa.record_batch([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(np.full(len(key), WORD, np.int32)), pa.array(key)], names=["token", "n", "cyr", "sign", "reading", "kind", "key"])


def learn_channel(pages: DataFrame, model: Model, rounds: int = 2) -> Channel:
    """Channel of the corpus: expected readings of each odd sign, by expectation-maximisation from an even start.

    ``pages`` has ``lines`` with doubtful words. Words are counted once before
    anything is looked up. The driver sees a row for each sign and letter of an
    alphabet, whatever the corpus's size.
    """
    tokens = pages.select(F.explode("lines").alias("line")).select(F.explode(F.split("line", r"[\s/@]+")).alias("token"))
    odd = r"[0-9!|€†ɑ]|[А-яЁёІіЇїЄєҐґѢѣ][A-Za-z]|[A-Za-z][А-яЁёІіЇїЄєҐґѢѣ]"
    tokens = tokens.filter(F.col("token").rlike(odd) & F.col("token").rlike(r"\p{L}{2}")).groupBy("token").agg(F.count("*").alias("n"))
    ways = look_up(tokens.mapInArrow(_ways, _WAYS), model).filter(F.col("p").isNotNull()).select("token", "n", "cyr", "sign", "reading", F.pow(F.lit(2.0), F.col("p").cast("double")).alias("w"))
    ways = stored(ways, "ways")
    at = ["cyr", "sign", "reading"]
    counts = None
    for _ in range(rounds):
        weighed = ways if counts is None else ways.join(F.broadcast(counts), at).withColumn("w", F.col("w") * F.col("c")).drop("c")
        shared = weighed.withColumn("c", F.col("n") * F.col("w") / F.sum("w").over(W.partitionBy("token")))  # as many rows as the alphabet has letters
        rows = shared.groupBy(*at).agg(F.sum("c").alias("c")).collect()
        counts = pages.sparkSession.createDataFrame(rows, "cyr boolean, sign string, reading string, c double") if rows else None
        if counts is None:
            break
    discard(ways)
    return channel_of([tuple(r) for r in rows])


_ASKED = "reading_id bigint, kind int, key bigint"


def decoded(pages: DataFrame, model: Model, channel: Channel) -> DataFrame:
    """``reading_id``, ``changed`` (words the decoder reads otherwise), ``fixes`` (lines with their decoded form) of pages with ``lines``.

    Each page's lattice asks the model once; the answers come back to the page.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, cache = Words(), {}
        for b in batches:
            if len(cache) > 200_000:
                cache.clear()
            kinds, keys, n = [], [], []
            for lines in b.column(1).to_pylist():
                kind, key, _, _ = _asked(lattices([x.split() for x in lines], channel, cache), ids)
                kinds.append(kind)
                keys.append(key)
                n.append(len(key))
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), n), pa.int64()), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys))], names=["reading_id", "kind", "key"])

    one = pages.select("reading_id", "lines").dropDuplicates(["reading_id"])
    told = look_up(one.mapInArrow(ask, _ASKED), model).filter(F.col("p").isNotNull())
    told = told.groupBy("reading_id").agg(F.collect_list(F.struct("kind", "key", "p")).alias("told"))  # as long as one page's lattice
    fix = T.StructType([T.StructField("line", T.StringType()), T.StructField("fixed", T.StringType())])
    out = T.StructType([T.StructField("changed", T.IntegerType()), T.StructField("fixes", T.ArrayType(fix))])

    @F.arrow_udf(out)
    def udf(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ids, cache = Words(), {}
        for lines, told in it:
            if len(cache) > 200_000:
                cache.clear()
            rows = []
            answers = told.flatten()
            triples = list(zip(answers.field(0).to_pylist(), answers.field(1).to_pylist(), answers.field(2).to_pylist(), strict=True)) if len(answers) else []
            at = 0
            for xs, n in zip(lines.to_pylist(), told.value_lengths().to_pylist(), strict=True):
                heard = {(k, key): p for k, key, p in triples[at : at + (n or 0)]}
                at += n or 0
                got = decode(heard, ids, [x.split() for x in xs], channel, cache)
                rows.append({"changed": sum(c for _, c in got), "fixes": [{"line": x, "fixed": " ".join(words)} for x, (words, c) in zip(xs, got, strict=True) if c]})
            yield pa.array(rows, pa.struct([("changed", pa.int32()), ("fixes", pa.list_(pa.struct([("line", pa.string()), ("fixed", pa.string())])))]))

    return one.join(told, "reading_id", "left").select("reading_id", udf("lines", "told").alias("d")).select("reading_id", "d.*")


KINDS = ("hyphen_break", "misread_characters", "running_header", "page_number")


def found(df: DataFrame) -> DataFrame:
    """p7_found: one row for each kind of noise in a prose reading.

    One scan counts the bigrams and marks the pages; only lines with doubtful
    words are decoded once model and channel stand. Readings that repeat or are
    garbled have no row. The kinds are four narrow results and one distinct.
    """
    scanned, model = scan(df)
    pages = scanned.filter(F.col("reading_id").isNotNull())
    headed = pages.select("reading_id", "job_id", F.explode("norms").alias("norm")).join(running_lines(pages), ["job_id", "norm"], "left_semi").select("reading_id")
    inline = scanned.filter(F.col("inline").isNotNull()).select(F.explode("inline").alias("compound")).distinct()
    broken = pages.select("reading_id", F.explode("compounds").alias("compound")).join(inline, "compound", "left_anti").select("reading_id")
    odd = pages.filter(F.col("doubtful") >= MIN_WORDS)
    read = decoded(odd, model, learn_channel(odd, model)).filter(F.col("changed") >= MIN_WORDS).select("reading_id")
    parts = [
        (broken, "hyphen_break"), (pages.filter("broken").select("reading_id"), "hyphen_break"), (read, "misread_characters"),
        (headed, "running_header"), (pages.filter("number").select("reading_id"), "page_number"),
    ]
    out = None
    for part, kind in parts:
        rows = part.select("reading_id", F.lit(kind).alias("noise"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def noise(df: DataFrame) -> DataFrame:
    """One row for each reading with noise: ``reading_id`` and a boolean for each of ``KINDS``."""
    return found(df).groupBy("reading_id").agg(*[F.bool_or(F.col("noise") == k).alias(k) for k in KINDS])


def shape_ways(word: str) -> list[tuple[str, tuple[int, ...]]]:
    """(other word, numbers of the shapes exchanged) for every exchange of one or two shapes of a word."""
    if len(word) < ONE_SHAPE:
        return []
    places = [(i, k) for k, (read, _) in enumerate(SHAPES) for i in range(len(word) - len(read) + 1) if word.startswith(read, i)]
    out: dict[str, tuple[int, ...]] = {}
    for n, (i, k) in enumerate(places):
        read, printed = SHAPES[k]
        one = word[:i] + printed + word[i + len(read) :]
        out.setdefault(one, (k,))
        for j, m in places[n + 1 :] if len(word) >= TWO_SHAPES else ():
            lo, hi = ((i, k), (j, m)) if i < j else ((j, m), (i, k))
            if lo[0] + len(SHAPES[lo[1]][0]) <= hi[0]:
                (x, kx), (y, ky) = lo, hi
                out.setdefault(word[:x] + SHAPES[kx][1] + word[x + len(SHAPES[kx][0]) : y] + SHAPES[ky][1] + word[y + len(SHAPES[ky][0]) :], (k, m))
    out.pop(word, None)
    return list(out.items())


def misread_shapes(prose: DataFrame, rounds: int = 2) -> DataFrame:
    """``reading_id``, ``word``, ``printed`` of the rare words that the channel of shapes takes for well-known ones.

    ``prose`` has ``reading_id`` and ``content``. Every word of the corpus is
    counted once; a rare word stands in ``RARE`` readings at most, which its
    count keeps. How often a shape is misread is learnt by
    expectation-maximisation; the driver sees a row for each shape.
    """
    words = prose.select("reading_id", F.explode(F.regexp_extract_all("content", F.lit(r"(\p{L}{3,})"), 1)).alias("w"))
    seen = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.lower("w")).alias("small"), F.min("reading_id").alias("a"), F.max("reading_id").alias("b"))
    seen = stored(seen.filter((F.col("n") <= RARE) | (F.col("n") >= KNOWN)), "words")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, other, list(by)) for w in b.column(0).to_pylist() for other, by in shape_ways(w)]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int32()))], names=["word", "printed", "by"])

    rare = seen.filter(F.col("n") <= RARE)
    # names are no evidence: a known word is written small at least half of the time
    known = seen.filter((F.col("n") >= KNOWN) & (2 * F.col("small") >= F.col("n"))).select(F.col("word").alias("printed"), F.col("n").alias("times"))
    found = rare.select("word").mapInArrow(ways, "word string, printed string, by array<int>").join(known, "printed").join(rare, "word").filter(F.col("times") >= TIMES * F.col("n"))
    found = stored(found.select("word", "printed", "by", "times", "a", "b"), "shapes")
    chance = [1.0 / len(SHAPES)] * len(SHAPES)
    for _ in range(rounds + 1):
        table = F.array(*map(F.lit, chance))
        weight = F.col("times") * F.aggregate("by", F.lit(1.0), lambda acc, k: acc * F.get(table, k))
        shared = found.withColumn("w", weight).withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy("word")))  # as many rows as a word has shapes, squared
        counts = {r["k"]: r["c"] for r in shared.select(F.explode("by").alias("k"), "share").groupBy("k").agg(F.sum("share").alias("c")).collect()}
        total = sum(counts.values()) + len(SHAPES)
        chance = [(counts.get(k, 0.0) + 1.0) / total for k in range(len(SHAPES))]
    best = shared.groupBy("word").agg(F.max(F.struct("w", "printed")).alias("best"), F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    return best.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("reading_id"), "word", F.col("best.printed").alias("printed"))


_LETTERS3 = re.compile(rf"{_LETTER}{{3,}}")


def clean(text: str | None, running: set[str], fixes: dict[str, str] | None = None, hyphened: frozenset[str] = frozenset(), printed: dict[str, str] | None = None) -> str | None:
    """The text as continuous paragraphs: running lines and page numbers gone, broken words joined (``hyphened`` compounds keep their hyphen), misread words decoded (lines in ``fixes``, words in ``printed``)."""
    if not text or not text.strip():
        return text
    lines = text.split("\n")

    def strip(side: list[int]) -> None:
        for i in [k for k in side if lines[k].strip()][:2]:
            number, rest = split_edge(lines[i].strip())
            if (number and not rest) or (rest and norm_line(rest) in running):
                lines[i] = ""
            else:
                break

    if sum(bool(x.strip()) for x in lines) > 1:
        strip(list(range(len(lines))))
        strip(list(range(len(lines) - 1, -1, -1)))
    if fixes:
        lines = [fixes.get(x, x) for x in lines]

    def join(m: re.Match) -> str:
        whole = m[2] in "-‐‑" and (not m[3][0].islower() or f"{m[1]}-{m[3]}".lower() in hyphened)
        return f"{m[1]}-{m[3]}" if whole else m[1] + m[3]

    body = _BREAK.sub(join, "\n".join(lines))
    paragraphs = []
    for block in re.split(r"\n\s*\n", body):
        text_ = ""
        for line in block.split("\n"):
            if not line.strip():
                continue
            if text_ and (line.lstrip()[:1] in "#|-*" or text_.lstrip().startswith("#") and "\n" not in text_):
                text_ += "\n" + line.strip()
            else:
                text_ += (" " if text_ else "") + line.strip()
        if text_:
            paragraphs.append(text_)
    out = "\n\n".join(paragraphs)
    if printed:

        def put(m: re.Match) -> str:
            new = printed.get(m[0].lower())
            return m[0] if new is None else new.capitalize() if m[0][0].isupper() else new

        out = _LETTERS3.sub(put, out)
    return out


def paragraphs(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with ``clean_text``; needs ``reading_id``, ``job_id``, ``page_number`` and ``result_format``; other formats keep their text.

    What the job, the corpus and the model tell of a reading reaches it by one
    join on the reading.
    """
    scanned, model = scan(df.withColumn("content", F.col(text)), least=1)
    pages = scanned.filter(F.col("reading_id").isNotNull())
    heads = pages.select("reading_id", "job_id", F.explode("norms").alias("norm")).distinct().join(running_lines(pages), ["job_id", "norm"], "left_semi").select("reading_id", "norm")
    inline = scanned.filter(F.col("inline").isNotNull()).select(F.explode("inline").alias("compound")).distinct()
    kept = pages.select("reading_id", F.explode("compounds").alias("compound")).distinct().join(inline, "compound", "left_semi").select("reading_id", "compound")
    marks = heads.select("reading_id", "norm", F.lit(None).cast("string").alias("compound")).unionByName(kept.select("reading_id", F.lit(None).cast("string").alias("norm"), "compound"))
    marks = marks.groupBy("reading_id").agg(F.collect_set("norm").alias("__running"), F.collect_set("compound").alias("__kept"))  # as many as a page has
    odd = pages.filter(F.size("lines") > 0)
    fixed = decoded(odd, model, learn_channel(odd, model)).select("reading_id", F.col("fixes").alias("__fixes"))
    prose = df.filter(F.col("result_format").isin("text", "markdown")).select(F.col("reading_id").cast("bigint").alias("reading_id"), F.col(text).alias("content"))
    shapes = misread_shapes(prose).groupBy("reading_id").agg(F.collect_list(F.struct("word", "printed")).alias("__printed"))  # a page's own words
    known = marks.join(fixed, "reading_id", "full").join(shapes, "reading_id", "full").withColumnRenamed("reading_id", "__id")

    @F.arrow_udf(T.StringType())
    def udf(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for cols in it:
            rows = zip(*[c.to_pylist() for c in cols], strict=True)
            yield pa.array([clean(t, set(r or ()), {x["line"]: x["fixed"] for x in f or ()}, frozenset(k or ()), {x["word"]: x["printed"] for x in w or ()}) for t, r, f, k, w in rows], pa.string())

    prose = F.col("result_format").isin("text", "markdown")
    out = df.join(known, F.col("reading_id").cast("bigint") == F.col("__id"), "left")
    cleaned = udf(F.when(prose, F.col(text)), F.col("__running"), F.col("__fixes"), F.col("__kept"), F.col("__printed"))
    return out.withColumn("clean_text", F.coalesce(cleaned, F.col(text))).drop("__running", "__fixes", "__kept", "__printed", "__id")


def page_texts(pages: DataFrame) -> DataFrame:
    """``job_id``, ``page_id`` and the selected text of each page (``page_results``) as continuous paragraphs, null where none was selected; rows delivered twice count once."""
    text = F.col("selected_output.text")
    one = pages.select("job_id", "page_id", "page_number", text.alias("content")).dropDuplicates(["job_id", "page_id"])
    # tables and JSON keep their lines
    fmt = F.when(text_is_prose(F.col("content")), "text").otherwise("table")
    keyed = one.withColumn("reading_id", F.xxhash64("job_id", "page_id")).withColumn("result_format", fmt)
    return paragraphs(keyed).select("job_id", "page_id", "clean_text")


def text_is_prose(text):
    """Column: whether a text without a format is no JSON, table or rows of comma-separated values."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([^\n]*)", 1)
    return ~(first.rlike(r"^[\[{|]") | (first.rlike(r"^[^\s,]+(?:,[^\s,]+)+$") & text.rlike(r"\n[^\n]*,[^\n]*")))
