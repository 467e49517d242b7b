"""Language of documents and of their segments: multilingual mixture inference.

Method. Character n-gram likelihoods of each language are fitted on a bounded
sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash of the key, so that
it doesn't depend on order) and cleaned by re-estimation, since labels may be
wrong. A document is a mixture of languages over its sentences:
expectation-maximisation estimates the proportions from the sentences'
likelihoods, and the language set is the one of the best likelihood less
``PENALTY`` for each language, found by dropping languages greedily. A
language's sentences are counted by their responsibilities under the mixture,
so that a short or doubtful sentence goes to the languages the text is known to
hold. A text that no language of the model explains (``REJECT``) has none.

Defined results
* null, empty or wordless text -> no language, no segments.
* a language of a mixed text has to be responsible for ``MIN_SENTENCES``
  sentences, rounded; if none is, the one responsible for the most words is the
  text's language.
* a text in a language the model doesn't know: no language, segments ``und``.
* equal likelihoods -> the first in ``LANGUAGES``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.encoding import repaired

LANGUAGES = ("en", "de", "fr", "es", "pl", "ru", "uk")
SAMPLE_ROWS = 6000
PENALTY = 6.0
#: A text is in none of the languages if its log-likelihood a character lies this part of the way from the fitted texts' mean to that of unknown n-grams.
REJECT = 0.25
#: Words a text or sentence needs to be judged so.
REJECT_WORDS = 8
MIN_SENTENCES = 2
MIN_SENTENCE_WORDS = 4

# Codes and names of the languages; frk is German print, orus old Russian print.
NAMES = {
    "en": "en", "eng": "en", "english": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "frk": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "es": "es", "spa": "es", "spanish": "es",
    "pl": "pl", "pol": "pl", "polish": "pl", "ru": "ru", "rus": "ru", "russian": "ru", "orus": "ru",
    "uk": "uk", "ukr": "uk", "ukrainian": "uk",
}
# German months, before which a number with a stop is a date.
_MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()

WORD = re.compile(r"[^\W\d_]+(?:[’'][^\W\d_]+)?")
_JOIN = re.compile(r"[-­¬=‐‑]\n(?=[^\W\d_])")
_END = re.compile(r"[.!?…][”“\"»)’.!?…]*\s+(?=[«„“\"(‘¿¡—–-]*\s*(?:[^\W\d_a-zà-ÿа-яёіїєѣąćęłńśźż]|\d{1,2}\s+[^\W\d_]))")
# A sentence that begins with a number follows a whole word, no abbreviation.
_BEFORE_NUMBER = re.compile(r"[^\W\d_]{4}[”“\"»)’]*$")
# Abbreviations after which no sentence ends.
_SHORT = re.compile(r"\b(?:Nr|No|fol|n|vol|Bd)$")
_DATE = re.compile(r"\D?\d{1,2}\.\s+(?:" + "|".join(_MONTHS) + ")")


def named_language(label):
    """Column: the language a label names exactly, else null (lists, unknown codes, empty, null)."""
    base = F.regexp_replace(F.lower(F.trim(label)), r"^([a-z]+)[-_][a-z0-9]{2,4}$", "$1")
    pairs = [F.lit(x) for kv in NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), base)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower-case; words broken at line ends are joined."""
    if "\n" in text:
        text = _JOIN.sub("", text)
    low = text.lower()
    out, at = [], 0
    for m in _END.finditer(text):
        k = m.start()
        if text[m.end() : m.end() + 1].isdigit() and not _BEFORE_NUMBER.search(text, max(0, k - 8), k):
            continue
        if text[k] == ".":
            before = text[max(0, k - 4) : k]
            if _SHORT.search(before) or (before[-1:].isdigit() and _DATE.match(text, max(0, k - 2), min(len(text), m.end() + 10))):
                continue
        if len(low) == len(text) and (w := WORD.findall(low, at, k)):
            out.append(w)
        elif len(low) != len(text) and (w := WORD.findall(text[at:k].lower())):
            out.append(w)
        at = m.end()
    if w := WORD.findall(text[at:].lower()):
        out.append(w)
    return out


def _grams(w: str) -> list[str]:
    w = f" {w} "
    return [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 4] for i in range(len(w) - 3)] + ([w] if len(w) > 4 else [])


class LanguageModel:
    """Additively smoothed n-gram likelihoods of each language; a word's score is kept after its first use."""

    def __init__(self, counts: list[Counter]):
        vocabulary = {g for c in counts for g, n in c.items() if n > 1}
        totals = [sum(n for g, n in c.items() if g in vocabulary) for c in counts]
        floor = [log(0.3 / (t + 0.3 * len(vocabulary) + 1)) for t in totals]
        self.floor = np.array(floor)
        self.reject = -np.inf
        self.table = {
            g: tuple(log((c.get(g, 0) + 0.3) / (t + 0.3 * len(vocabulary) + 1)) for c, t in zip(counts, totals, strict=True))
            for g in vocabulary
        }
        self.cache: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.matrix = None

    def index(self, words: list[str]) -> list[int]:
        cache = self.cache
        try:
            return [cache[w] for w in words]
        except KeyError:
            pass
        for w in words:
            if w not in cache:
                grams = _grams(w)
                found = [self.table[g] for g in grams if g in self.table]
                row = (np.sum(found, axis=0) if found else np.zeros(len(LANGUAGES))) + (len(grams) - len(found)) * self.floor.mean()
                # n-grams of a word overlap: scaled to about one word's evidence
                cache[w] = len(self.rows)
                self.rows.append(row / 3.0)
        return [cache[w] for w in words]

    def trim(self) -> None:
        if len(self.rows) > 400_000:
            self.cache, self.rows, self.matrix = {}, [], None

    def scores(self, groups: list[list[str]]) -> np.ndarray:
        """Log-likelihood of each group of words in each language."""
        if not groups:
            return np.zeros((0, len(LANGUAGES)))
        flat = [i for g in groups for i in self.index(g)]
        starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
        if self.matrix is None or len(self.matrix) < len(self.rows):
            self.matrix = np.array(self.rows)
        return np.add.reduceat(self.matrix[flat], starts, axis=0)


def fit(labelled: list[tuple[str, str]], rounds: int = 3) -> LanguageModel:
    """Model from (text, language) pairs of which most are right: fitted, then re-estimated from its own sentence labels."""
    parts = [(s, LANGUAGES.index(lang)) for text, lang in labelled for s in sentences(text) if len(s) >= 3]
    model = None
    for _ in range(rounds):
        counts = [Counter() for _ in LANGUAGES]
        by_words = [Counter() for _ in LANGUAGES]
        for s, k in parts:
            by_words[k].update(s)
        for k, words in enumerate(by_words):
            for w, n in words.items():
                for g in _grams(w):
                    counts[k][g] += n
        model = LanguageModel(counts)
        if parts:
            best = model.scores([s for s, _ in parts]).argmax(axis=1)
            parts = [(s, int(b)) for (s, _), b in zip(parts, best, strict=True)]
    if model is not None:
        if parts:
            mean = float((model.scores([s for s, _ in parts]).max(axis=1) / [_size(s) for s, _ in parts]).mean())
            model.reject = mean + REJECT * (0.6 * float(model.floor.mean()) - mean)  # about 0.6 n-grams' weight a character
        model.cache, model.rows, model.matrix = {}, [], None
    return model


def _size(words: list[str]) -> int:
    """Characters of a sentence's words with their blanks."""
    return sum(map(len, words)) + len(words)


def responsibilities(lik: np.ndarray, pi: np.ndarray, keep: list[int]) -> np.ndarray:
    """Share of each sentence that each language of the set is responsible for."""
    own = lik[:, keep]
    joint = np.exp(own - own.max(axis=1, keepdims=True)) * pi + 1e-300
    return joint / joint.sum(axis=1, keepdims=True)


def mixture(lik: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, list[int]]:
    """(proportions, language set) of one text from the log-likelihoods of its sentences."""
    top = lik - lik.max(axis=1, keepdims=True)

    def em(keep: list[int]) -> tuple[np.ndarray, float]:
        p = np.exp(top[:, keep])
        pi = np.full(len(keep), 1 / len(keep))
        for _ in range(12):
            joint = p * pi
            norm = joint.sum(axis=1, keepdims=True) + 1e-300
            pi = (joint / norm).mean(axis=0)
        return pi, float(np.log((p * pi).sum(axis=1) + 1e-300).sum())

    keep = sorted(set(lik.argmax(axis=1).tolist()))
    pi, best = em(keep)
    while len(keep) > 1:
        k = int(pi.argmin())
        rest = keep[:k] + keep[k + 1 :]
        pi2, less = em(rest)
        if best - less > penalty:
            break
        keep, pi, best = rest, pi2, less
    return pi, keep


_SEG = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])
_OUT = T.StructType([
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("proportions", T.ArrayType(T.DoubleType())),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("n_words", T.IntegerType()),
    T.StructField("segments", T.ArrayType(_SEG)),
])


def infer(model: LanguageModel, texts: list[str | None], with_segments: bool = True) -> list[dict]:
    """Languages, proportions, confidence, number of words and segments of each text."""
    split = [sentences(t) if t else [] for t in texts]
    flat = [s for x in split for s in x]
    lik = model.scores(flat)
    best = lik.argmax(axis=1) if len(flat) else np.zeros(0, int)
    first = best.tolist()
    e = np.exp(lik - lik.max(axis=1, keepdims=True)) if len(flat) else lik
    conf = (e.max(axis=1) / e.sum(axis=1)) if len(flat) else np.zeros(0)
    top = lik.max(axis=1) if len(flat) else np.zeros(0)
    out, at = [], 0
    for x in split:
        n, lens = len(x), [len(s) for s in x]
        if not n:
            out.append({"languages": [], "proportions": [], "confidence": None, "n_words": 0, "segments": []})
            continue
        b, c = first[at : at + n], conf[at : at + n]
        words, sizes = sum(lens), [_size(s) for s in x]
        alien = [lens[i] >= REJECT_WORDS and top[at + i] < model.reject * sizes[i] for i in range(n)]
        if words >= REJECT_WORDS and float(top[at : at + n].sum()) < model.reject * sum(sizes):
            langs, pi, alien = [], [], [True] * n
        elif b.count(b[0]) == n:
            langs, pi = [b[0]], [1.0]
        else:
            use = [i for i in range(n) if lens[i] >= MIN_SENTENCE_WORDS and not alien[i]] or list(range(n))
            own = lik[at : at + n][use]
            pi_, keep = mixture(own)
            share = responsibilities(own, pi_, keep)
            count = share.sum(axis=0)
            chosen = [(k, p) for k, p, m in zip(keep, pi_.tolist(), count, strict=True) if m >= MIN_SENTENCES - 0.5]
            if not chosen:
                by = (share * np.array([lens[i] for i in use])[:, None]).sum(axis=0)
                chosen = [(keep[int(by.argmax())], 1.0)]
            total = sum(p for _, p in chosen) or 1.0
            langs, pi = [k for k, _ in chosen], [p / total for _, p in chosen]
        segments: list[dict] = []
        for i in range(n if with_segments else 0):
            lang = "und" if alien[i] else LANGUAGES[int(b[i])]
            sure = float(c[i])
            if segments and segments[-1]["lang"] == lang:
                segments[-1]["words"] += lens[i]
                segments[-1]["confidence"] = min(segments[-1]["confidence"], sure)
            else:
                segments.append({"words": lens[i], "lang": lang, "confidence": sure})
        out.append({
            "languages": [LANGUAGES[k] for k in langs], "proportions": pi,
            "confidence": float(np.dot(c, lens)) / words, "n_words": words, "segments": segments,
        })
        at += n
    return out


def fit_on(df: DataFrame, text: str, label: str, key: str, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Model fitted on about ``sample_rows`` labelled rows (at most twice as many): those whose hash of ``key`` is below a threshold."""
    labelled = df.select(F.col(text).alias("t"), named_language(F.col(label)).alias("l"), F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000_007)).alias("h")).filter(F.col("l").isNotNull())
    n = labelled.count()
    limit = 1_000_000_007 if n <= sample_rows else int(1_000_000_007 * sample_rows / n)
    rows = labelled.filter((F.col("h") < limit) & (F.length("t") > 40)).limit(2 * sample_rows).collect()
    rows.sort(key=lambda r: (r["h"], r["t"]))
    return fit([(t, r["l"]) for r, t in zip(rows, repaired([r["t"] for r in rows]), strict=True)])


def identify_languages(df: DataFrame, text: str = "content", label: str = "lang", key: str = "reading_id", model: LanguageModel | None = None, with_segments: bool = True) -> DataFrame:
    """``df`` with ``language`` (struct of languages, proportions, confidence, n_words, segments). Garbled text counts as it should read.

    Narrow: one scan beside the bounded fit, no shuffle.
    """
    model = model or fit_on(df, text, label, key)
    held = df.sparkSession.sparkContext.broadcast((model.table, model.floor, model.reject))
    kind = _arrow()

    @F.arrow_udf(_OUT)
    def udf(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = LanguageModel.__new__(LanguageModel)
        m.table, m.floor, m.reject = held.value
        m.cache, m.rows, m.matrix = {}, [], None
        for texts in it:
            m.trim()
            yield pa.array(infer(m, repaired(texts.to_pylist()), with_segments), kind)

    return df.withColumn("language", udf(F.col(text)))


def _arrow() -> pa.DataType:
    seg = pa.struct([("words", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    return pa.struct([("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64())), ("confidence", pa.float64()), ("n_words", pa.int32()), ("segments", pa.list_(seg))])


def found(df: DataFrame) -> DataFrame:
    """p2_found: languages of readings that are mixed, unlabelled or labelled wrongly."""
    prose = df.filter(F.col("result_format").isin("text", "markdown")).select("reading_id", "lang", "content")
    langs = F.col("language.languages")
    return (
        identify_languages(prose, with_segments=False)
        .filter((F.col("language.n_words") >= 10) & ((F.size(langs) > 1) | named_language(F.col("lang")).isNull() | (named_language(F.col("lang")) != F.get(langs, F.lit(0)))))
        .select("reading_id", F.explode(langs).alias("lang_code"))
        .distinct()
    )
