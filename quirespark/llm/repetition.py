"""Repetition inside a document: perplexity under a Spark-counted modified Kneser-Ney model.

Method. Spark counts the n-grams (order 3) of the whole corpus, after each
task has summed its own; discounts D1, D2, D3+ of each order come from the
counts of counts; interpolated probabilities are joined bottom up and written
as hash arrays sorted by key, a file for each range of keys, in the shared
folder. Nothing of the model's size passes the driver, and no worker holds the
model: look-ups are sent to the range that holds their key (``look_up``), where
a task opens that range's array only.

A text's perplexity is taken twice: under the corpus model, and under the
model mixed with a cache of the text's own earlier 4-grams. Corpus perplexity
alone can't tell a page said twice from one said once, so the bands are on the
ratio of the two. Without any repetition the ratio is 1/(1-CACHE) = 2, one bit
a word. The lower band of a language is the ratio of a text of which a quarter
(``share``) is repeated, less a margin: how many bits a repeated word saves
there is fitted over all texts of that language. A text below its language's
band is rejected as repeating; ``found`` lets an exact share of repeated words
verify what the bands reject.

Defined results
* null, empty or wordless text: perplexity null, share 0, band ``none``.
* texts of under four words have nothing to repeat: share 0.
* words are runs of letters, case aside; garbled text counts as it should read.
* a label that names no language has the band of ``und``; a language with few
  repeated words leans on all languages' fit (``PRIOR_WORDS``).
* repeated rows have the same result; ``found`` gives each id once.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirespark.llm.encoding import repaired
from quirespark.session import discard, kept_until_exit, shared_dir, stored

CACHE = 0.5
#: Share of its words that a repeating text says again.
SHARE = 0.25
#: A language's lower band allows repeated words this part of the language's mean saving.
MARGIN = 0.6
#: Words by which all languages' fit counts beside a language's own.
PRIOR_WORDS = 200.0
#: Rows of a range shard: what one task sorts, writes and looks up in.
SHARD_ROWS = 500_000
#: A context with more continuations than this is joined in parts of this size.
HOT_ROWS = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


class Words:
    """64-bit ids of words, kept by each worker for the words it has met."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        ids = self.ids
        try:
            return [ids[w] for w in words]
        except KeyError:
            if len(ids) > 1_000_000:
                ids.clear()
            for w in words:
                if w not in ids:
                    ids[w] = xxhash.xxh3_64_intdigest(w)
            return [ids[w] for w in words]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b."""
    x = (a ^ (a >> _S)) * _M + b
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def mixed(a: int, b: int) -> int:
    """``_mix`` of two whole numbers."""
    x = ((a ^ (a >> 29)) * 0x9E3779B97F4A7C15 + b) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF


def _tokens(words: Words, texts: list[str | None], as_read: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word ids of all texts, where each text ends)."""
    flat: list[int] = []
    ends = []
    for t in texts if as_read else repaired(texts):
        if t:
            flat += words(_WORD.findall(t.lower()))
        ends.append(len(flat))
    return np.array(flat, np.uint64), np.array(ends, np.int64)


def _positions(ends: np.ndarray, n: int) -> np.ndarray:
    """Position of each token inside its text."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
    return np.arange(n) - np.repeat(starts, np.diff(np.concatenate([[0], ends])))


def _i64(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


GRAMS = "ord tinyint, key bigint, ctx bigint, low bigint, n bigint"


class GramCounter:
    """Tri- and bigrams of some batches at a time, summed in the task before any shuffle."""

    def __init__(self, order: int = 3, size: int = 1_500_000):
        self.order, self.size = order, size
        self.held: dict[int, list[np.ndarray]] = {k: [] for k in range(2, order + 1)}
        self.tokens = 0

    def add(self, w: np.ndarray, ends: np.ndarray) -> list[list[pa.Array]]:
        """Counts of what is full after these texts: columns ord, key, ctx, low, n."""
        if len(w) < 2:
            return []
        pos = _positions(ends, len(w))
        k2 = _mix(w[:-1], w[1:])  # at i: words i, i+1
        ok = pos[1:] >= 1
        self.held[2].append(np.stack([k2[ok], w[:-1][ok], w[1:][ok]]))
        if len(w) > 2 and self.order > 2:
            k3 = _mix(k2[:-1], w[2:])
            ok = pos[2:] >= 2
            self.held[3].append(np.stack([k3[ok], k2[:-1][ok], k2[1:][ok]]))
        self.tokens += len(w)
        return self.flush() if self.tokens > self.size else []

    def flush(self) -> list[list[pa.Array]]:
        out = []
        for order, parts in self.held.items():
            if parts:
                a = np.concatenate(parts, axis=1)
                _, first, n = np.unique(a[0], return_index=True, return_counts=True)
                a = a[:, first]
                out.append([pa.array(np.full(a.shape[1], order, np.int8)), _i64(a[0].copy()), _i64(a[1].copy()), _i64(a[2].copy()), pa.array(n)])
            self.held[order] = []
        self.tokens = 0
        return out


_NAMES = ["ord", "key", "ctx", "low", "n"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counter = Words(), GramCounter()
    for b in batches:
        for cols in counter.add(*_tokens(words, b.column(0).to_pylist())):
            yield pa.record_batch(cols, names=_NAMES)
    for cols in counter.flush():
        yield pa.record_batch(cols, names=_NAMES)


def _discounted(c: str, d: dict[str, float]):
    v = F.col(c).cast("double")
    return v - F.when(v <= 1, d["d1"]).when(v <= 2, d["d2"]).otherwise(d["d3"])


def _discounts(df: DataFrame, c: str) -> dict[str, float]:
    """Modified Kneser-Ney discounts from the counts of counts (four numbers reach the driver)."""
    r = df.agg(*[F.count_if(F.col(c) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, r[f"n{i}"] or 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return {"d1": min(0.95, max(0.05, 1 - 2 * y * n2 / n1)), "d2": min(1.9, max(0.1, 2 - 3 * y * n3 / n2)), "d3": min(2.8, max(0.2, 3 - 4 * y * n4 / n3))}


def _context(df: DataFrame, c: str, d: dict[str, float]) -> DataFrame:
    """Total, back-off weight and number of continuations of each context."""
    n = F.col(c)
    return df.groupBy("ctx").agg(
        F.sum(n).cast("double").alias("total"),
        ((d["d1"] * F.count_if(n == 1) + d["d2"] * F.count_if(n == 2) + d["d3"] * F.count_if(n > 2)) / F.sum(n)).alias("gamma"),
        F.count("*").alias("n_rows"),
    )


def joined_in_parts(many: DataFrame, one: DataFrame, key: str, salt: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``many`` with ``one``, whose ``n_rows`` says how many rows of ``many`` its key has.

    A key of more than ``hot_rows`` rows is cut into parts by the hash ``salt``
    and its row of ``one`` repeated for each part. There are at most
    ``rows of many / hot_rows`` such keys; the list of them is broadcast.
    """
    parts = F.ceil(F.col("n_rows") / hot_rows).cast("int")
    hot = F.broadcast(one.filter(F.col("n_rows") > hot_rows).select(key, parts.alias("__parts")))
    cut = many.join(hot, key, "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(salt), F.col("__parts"))).otherwise(0).cast("int")).drop("__parts")
    spread = one.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n_rows")
    return cut.join(spread, [key, "__part"]).drop("__part")


class Model(NamedTuple):
    """A folder of sorted hash arrays; the highest ``bits`` bits of a key name the file that holds it."""

    folder: str
    bits: int

    def shard(self, key="key"):
        return F.shiftrightunsigned(F.col(key), 64 - self.bits).cast("int") if self.bits else F.lit(0)


#: Tables of a model: word, bigram and trigram probabilities (log2), back-off weights of words and of bigrams.
WORD, BIGRAM, TRIGRAM, WORD_BACKOFF, BIGRAM_BACKOFF = 1, 2, 3, 12, 13


def train(df: DataFrame, text: str, kinds: tuple[int, ...] = (WORD, BIGRAM, TRIGRAM)) -> Model:
    """Model of all rows of ``df``: hash arrays of log2 values."""
    return train_from(df.select(F.col(text).alias("t")).mapInArrow(_count, GRAMS), kinds=kinds)


def train_from(partial: DataFrame, order: int = 3, kinds: tuple[int, ...] = (WORD, BIGRAM, TRIGRAM)) -> Model:
    """``train`` from the tasks' own sums (columns ``GRAMS``); ``order`` 2 or 3; ``kinds`` are the tables to write."""
    grams = stored(partial.groupBy("ord", "key").agg(F.first("ctx").alias("ctx"), F.first("low").alias("low"), F.sum("n").alias("n")), "ngrams")
    bi = grams.filter("ord = 2")
    if order == 3:
        tri = grams.filter("ord = 3")
        cont = tri.groupBy(F.col("low").alias("key")).agg(F.count("*").alias("c"))
        bi = stored(bi.join(cont, "key", "left").select("key", "ctx", "low", F.coalesce("c", F.lit(1)).alias("c")), "bigrams")
    else:
        bi = bi.withColumnRenamed("n", "c")
    uni = bi.groupBy(F.col("low").alias("key")).agg((F.sum("c") if order == 3 else F.count("*")).cast("double").alias("c"), F.count("*").alias("n_rows"))
    total = uni.agg(F.sum("c")).first()[0] or 1.0
    uni = uni.select("key", (F.col("c") / total).alias("p"), "n_rows")
    d2 = _discounts(bi, "c")
    c2 = _context(bi, "c", d2)
    p2 = (
        joined_in_parts(joined_in_parts(bi, c2, "ctx", "low"), uni.withColumnRenamed("key", "low"), "low", "ctx")
        .select("key", (F.greatest(_discounted("c", d2), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("p")).alias("p"))
    )
    parts = {WORD: uni.drop("n_rows"), BIGRAM: p2, WORD_BACKOFF: c2.select(F.col("ctx").alias("key"), F.col("gamma").alias("p"))}
    if order == 3:
        p2 = stored(p2, "bigram-p")
        d3 = _discounts(tri, "n")
        c3 = _context(tri, "n", d3)
        p3 = (
            tri.join(c3.drop("n_rows"), "ctx").join(p2.select(F.col("key").alias("low"), "p"), "low")
            .select("key", (F.greatest(_discounted("n", d3), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("p")).alias("p"))
        )
        parts |= {BIGRAM: p2, TRIGRAM: p3, BIGRAM_BACKOFF: c3.select(F.col("ctx").alias("key"), F.col("gamma").alias("p"))}
    shards = max(1, -(-grams.count() // SHARD_ROWS))
    spark = grams.sparkSession
    model = Model(kept_until_exit(spark, f"{shared_dir(spark)}/kn-{uuid.uuid4().hex}"), (shards - 1).bit_length())
    rows = None
    for kind in sorted(set(kinds) & set(parts)):
        part = parts[kind].select(F.lit(kind).alias("kind"), "key", F.log2(F.greatest("p", F.lit(1e-12))).cast("float").alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    _write_sorted(rows, model)
    discard(grams, bi, p2)
    return model


def _write_sorted(rows: DataFrame, model: Model) -> None:
    """Hash arrays sorted by key, a file for each table and key range, written by the tasks; a repeated task writes the same file."""
    folder = model.folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        total, run, keys, values = 0, None, [], []

        def close() -> None:
            if run is not None:
                tag = uuid.uuid4().hex
                for end, parts in (("v", values), ("k", keys)):
                    with fs.open_output_stream(f"{path}/.{tag}") as out:
                        out.write(np.concatenate(parts).tobytes())
                    fs.move(f"{path}/.{tag}", f"{path}/{run[0]}-{run[1]}.{end}")

        for b in batches:
            kind, shard, k, v = (b.column(i).to_numpy() for i in range(4))
            cuts = np.nonzero((np.diff(kind) != 0) | (np.diff(shard) != 0))[0] + 1
            for i, j in zip([0, *cuts], [*cuts, len(k)], strict=True):
                if j > i:
                    if run != (kind[i], shard[i]):
                        close()
                        run, keys, values = (kind[i], shard[i]), [], []
                    keys.append(k[i:j])
                    values.append(v[i:j])
                    total += j - i
        close()
        yield pa.record_batch([pa.array([total], pa.int64())], names=["n"])

    ordered = rows.select("kind", model.shard().alias("shard"), "key", "p").repartition("kind", "shard").sortWithinPartitions("kind", "shard", "key")
    ordered.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _fs(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if ":" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Shards:
    """The sorted arrays of a model, opened file by file; the last ``held`` stay open. Local files are mapped, not read."""

    def __init__(self, folder: str, held: int = 16):
        self.fs, self.path = _fs(folder)
        self.held = held
        self.open: OrderedDict[tuple[int, int], tuple[np.ndarray, np.ndarray] | None] = OrderedDict()

    def arrays(self, kind: int, shard: int) -> tuple[np.ndarray, np.ndarray] | None:
        at = (kind, shard)
        if at not in self.open:
            from pyarrow.fs import FileType, LocalFileSystem

            name = f"{self.path}/{kind}-{shard}"
            if self.fs.get_file_info(f"{name}.k").type == FileType.NotFound:
                self.open[at] = None
            elif isinstance(self.fs, LocalFileSystem):
                self.open[at] = np.memmap(f"{name}.k", np.int64, "r"), np.memmap(f"{name}.v", np.float32, "r")
            else:
                self.open[at] = np.frombuffer(self.fs.open_input_file(f"{name}.k").readall(), np.int64), np.frombuffer(self.fs.open_input_file(f"{name}.v").readall(), np.float32)
            while len(self.open) > self.held:
                self.open.popitem(last=False)
        self.open.move_to_end(at)
        return self.open[at]

    def look(self, kind: np.ndarray, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """log2 value of each key, NaN where the model has none."""
        out = np.full(len(keys), np.nan, np.float32)
        order = np.lexsort((keys, shard, kind))
        kind, shard, keys = kind[order], shard[order], keys[order]
        cuts = np.nonzero((np.diff(kind) != 0) | (np.diff(shard) != 0))[0] + 1
        for i, j in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            arrays = self.arrays(int(kind[i]), int(shard[i])) if j > i else None
            if arrays is not None:
                k, v = arrays
                at = np.minimum(np.searchsorted(k, keys[i:j]), len(k) - 1)
                hit = k[at] == keys[i:j]
                out[order[i:j][hit]] = v[at[hit]]
        return out


def look_up(asked: DataFrame, model: Model) -> DataFrame:
    """``asked`` (with ``kind`` int and ``key`` bigint) with ``p``: the model's log2 value, null if it has none.

    The rows go to the key range that holds them; where many ask for one range
    the range's rows are split over several tasks (rebalancing), each of which
    opens that one file.
    """
    folder = model.folder
    sent = asked.withColumn("__shard", model.shard()).hint("rebalance", "__shard")
    at = [sent.columns.index(c) for c in ("kind", "__shard", "key")]
    names = [*asked.columns, "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        for b in batches:
            p = shards.look(*(b.column(i).to_numpy() for i in at))
            yield pa.record_batch([*b.columns[:-1], pa.array(p, mask=np.isnan(p))], names=names)

    schema = T.StructType([*asked.schema.fields, T.StructField("p", T.FloatType())])
    return sent.mapInArrow(run, schema)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: how many equal ones came before it, and whether it is the first."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s)) - start
    return rank, rank == 0


class Repeats(NamedTuple):
    """What a block of texts repeats: words, share of repeated words, and of each token whether a 4-gram ends there again, with the cache's probability."""

    w: np.ndarray
    ends: np.ndarray
    lens: np.ndarray
    pos: np.ndarray
    share: np.ndarray
    cachep: np.ndarray
    hit: np.ndarray


def repeats(w: np.ndarray, ends: np.ndarray) -> Repeats:
    n = len(w)
    lens = np.diff(np.concatenate([[0], ends])) if len(ends) else np.zeros(0, np.int64)
    pos = _positions(ends, n)
    doc = np.repeat(np.arange(len(ends)), lens).astype(np.uint64)
    rep, cachep, hit = np.zeros(n + 1, np.int64), np.zeros(n), np.zeros(n, bool)
    if n >= 4:
        k3 = _mix(_mix(w[:-2], w[1:-1]), w[2:])
        k4 = _mix(k3[:-1], w[3:])
        i4 = np.nonzero(pos[3:] >= 3)[0]
        if len(i4):
            d = doc[i4 + 3]
            r4, first = _ranks(_mix(k4[i4], d))
            again = ~first
            if again.any():
                r3, _ = _ranks(_mix(k3[i4], d))
                cachep[i4[again] + 3] = r4[again] / np.maximum(r3[again], 1)
                hit[i4[again] + 3] = True
                np.add.at(rep, i4[again], 1)
                np.add.at(rep, i4[again] + 4, -1)
    marked = np.concatenate([[0], np.cumsum(np.cumsum(rep)[:n] > 0)])
    share = np.where(lens > 0, (marked[ends] - marked[ends - lens]) / np.maximum(lens, 1), 0.0) if len(ends) else np.zeros(0)
    return Repeats(w, ends, lens, pos, share, cachep, hit)


def _trigrams(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of the trigrams that end at the positions ``at``."""
    return _mix(_mix(w[at - 2], w[at - 1]), w[at])


def _saved():
    """Column: bits a repeated word saves, log2 of the mixture over the model's own probability; ``p`` is log2 of the latter."""
    return F.log2(CACHE * F.col("cachep") * F.pow(F.lit(2.0), -F.col("p")) + (1 - CACHE)) - F.log2(F.lit(1 - CACHE))


_TOKENS = "doc bigint, kind int, key bigint, cachep float"
_FACTS = "doc bigint, n_words int, repeated_share double"


def _tokens_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token of each text the n-gram by which the corpus model scores it, summed over equal tokens of a text apart from the cache."""
    words = Words()
    for b in batches:
        r = repeats(*_tokens(words, b.column(1).to_pylist()))
        n = len(r.w)
        doc = np.repeat(b.column(0).to_numpy(), r.lens)
        key, kind = r.w.copy(), np.minimum(r.pos + 1, 3).astype(np.int32)
        two, three = np.nonzero(r.pos == 1)[0], np.nonzero(r.pos >= 2)[0]
        if n:
            key[two] = _mix(r.w[two - 1], r.w[two])
            key[three] = _trigrams(r.w, three)
        yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(kind), _i64(key), pa.array(r.cachep.astype(np.float32))], names=["doc", "kind", "key", "cachep"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        r = repeats(*_tokens(words, b.column(1).to_pylist()))
        yield pa.record_batch([b.column(0), pa.array(r.lens.astype(np.int32)), pa.array(r.share)], names=["doc", "n_words", "repeated_share"])


def repetition(df: DataFrame, text: str = "content", key: str = "reading_id") -> DataFrame:
    """``df`` with ``repetition`` (struct of n_words, perplexity, adapted_perplexity, repeated_share).

    Trains on all rows of ``df``, so that every n-gram asked for is in the
    model; a key's first row stands for repeated ones. Shuffles: n-grams summed
    by each task, and a row of eight-byte keys for each token.
    """
    own = df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("t"))
    model = train(own, "t")
    one = own.groupBy("doc").agg(F.first("t").alias("t"))
    one = stored(one, "texts")
    p = look_up(one.mapInArrow(_tokens_out, _TOKENS), model).withColumn("p", F.coalesce("p", F.lit(-40.0).cast("float")))
    sums = p.groupBy("doc").agg(F.sum(F.col("p").cast("double")).alias("lp"), F.sum(F.when(F.col("cachep") > 0, _saved())).alias("saved"))
    facts = one.mapInArrow(_facts, _FACTS).join(sums, "doc", "left")
    n = F.col("n_words")
    bits = -F.col("lp") / n
    adapted = bits + 1 - F.coalesce("saved", F.lit(0.0)) / n
    none = F.col("lp").isNull()
    struct = F.struct(n, F.when(~none, F.pow(F.lit(2.0), bits)).alias("perplexity"), F.when(~none, F.pow(F.lit(2.0), adapted)).alias("adapted_perplexity"), "repeated_share")
    scored = facts.select(F.col("doc").alias("__doc"), struct.alias("repetition"))
    return df.join(scored, F.col(key).cast("bigint") == F.col("__doc"), "left").drop("__doc")


def band_language(lang):
    """Column: the language by whose bands a text is judged: what its label names, else ``und``. Eight values."""
    from quirespark.llm.language import named_language

    return F.coalesce(named_language(lang), F.lit("und"))


def lower_bands(saved: DataFrame, share: float = SHARE) -> dict[str, float]:
    """Lower band of log2(adapted perplexity / perplexity) of each language.

    ``saved`` has ``band_lang``, ``bits`` (saved by repetition) and ``again``
    (words repeated) of each text that repeats anything. A text of which
    ``share`` is repeated has the ratio 1 - share x (bits a repeated word
    saves); the band allows it ``MARGIN`` of that. Eight rows reach the driver.
    """
    rows = saved.groupBy("band_lang").agg(F.sum("bits").alias("bits"), F.sum("again").alias("again")).collect()
    bits, again = sum(r["bits"] for r in rows), sum(r["again"] for r in rows)
    return {r["band_lang"]: 1 - MARGIN * share * (r["bits"] + PRIOR_WORDS * bits / again) / (r["again"] + PRIOR_WORDS) for r in rows if again}


def _band(bands: dict[str, float]):
    """Column: the lower band of ``band_lang``, null where nothing is repeated in it."""
    out = F.lit(None).cast("double")
    for lang, low in sorted(bands.items()):
        out = F.when(F.col("band_lang") == lang, F.lit(low)).otherwise(out)
    return out


def perplexity_bands(df: DataFrame, text: str = "content", lang: str = "lang", key: str = "reading_id", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``repetition`` with ``band``: ``repeats`` (below its language's ratio band), ``low`` or ``high`` (outside its language's bands of the corpus perplexity, quantiles over all its texts), ``within`` or ``none``."""
    scored = repetition(df, text, key).withColumn("band_lang", band_language(F.col(lang)))
    r = F.col("repetition")
    scored = stored(scored.drop(text), "perplexities")
    ratio = F.log2(r["adapted_perplexity"] / r["perplexity"])
    again = r["n_words"] * r["repeated_share"]
    ratios = lower_bands(scored.filter(again > 0).select("band_lang", (r["n_words"] * (1 - ratio)).alias("bits"), again.alias("again")))
    p = r["perplexity"]
    quantiles = scored.groupBy("band_lang").agg(F.percentile_approx(p, low, 1000).alias("lower_band"), F.percentile_approx(p, high, 1000).alias("upper_band"))
    band = (
        F.when(p.isNull(), "none").when(ratio < _band(ratios), "repeats")
        .when(p < F.col("lower_band"), "low").when(p > F.col("upper_band"), "high").otherwise("within")
    )
    return scored.join(F.broadcast(quantiles), "band_lang", "left").withColumn("band", band)  # eight languages


_HITS = "reading_id bigint, band_lang string, n_words int, share double, keys array<bigint>, cached array<float>"
_FIRST = f"{GRAMS}, {_HITS}"
_FIRST_SCHEMA = pa.schema([
    ("ord", pa.int8()), ("key", pa.int64()), ("ctx", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("reading_id", pa.int64()), ("band_lang", pa.string()),
    ("n_words", pa.int32()), ("share", pa.float64()), ("keys", pa.list_(pa.int64())), ("cached", pa.list_(pa.float32())),
])


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram sums, and of the texts with any cache hit the trigrams that end where a 4-gram comes again."""
    words, counter = Words(), GramCounter()

    def rows(**cols) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        return pa.record_batch([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in _FIRST_SCHEMA], schema=_FIRST_SCHEMA)

    for b in batches:
        w, ends = _tokens(words, b.column(2).to_pylist())
        for cols in counter.add(w, ends):
            yield rows(**dict(zip(_NAMES, cols, strict=True)))
        r = repeats(w, ends)
        at = np.nonzero(r.hit)[0]
        if len(at):
            text = np.searchsorted(ends, at, side="right")
            who, first = np.unique(text, return_index=True)
            offsets = pa.array(np.append(first, len(at)), pa.int32())
            take = pa.array(who)
            yield rows(
                reading_id=b.column(0).take(take), band_lang=b.column(1).take(take), n_words=pa.array(r.lens[who].astype(np.int32)), share=pa.array(r.share[who]),
                keys=pa.ListArray.from_arrays(offsets, _i64(_trigrams(w, at))), cached=pa.ListArray.from_arrays(offsets, pa.array(r.cachep[at].astype(np.float32))),
            )
    for cols in counter.flush():
        yield rows(**dict(zip(_NAMES, cols, strict=True)))


def judged(df: DataFrame) -> DataFrame:
    """Each prose reading that says four words twice: ``reading_id``, ``band_lang``, ``share``, ``ratio`` and its language's ``lower_ratio``.

    A text without a cache hit has the ratio 2 whatever the model says, so it
    lies above every band. One scan counts the corpus's n-grams and marks the
    hits; the trigram at a hit stands in the corpus, so one look-up a hit gives
    the exact ratio.
    """
    prose = df.filter(F.col("result_format").isin("text", "markdown")).select(F.col("reading_id").cast("bigint").alias("reading_id"), band_language(F.col("lang")).alias("band_lang"), "content")
    first = stored(prose.mapInArrow(_first_pass, _FIRST), "first-pass")
    model = train_from(first.filter(F.col("ord").isNotNull()).select(*_NAMES), kinds=(TRIGRAM,))
    texts = first.filter(F.col("reading_id").isNotNull()).dropDuplicates(["reading_id"])
    hits = texts.select("reading_id", "band_lang", "n_words", "share", F.explode(F.arrays_zip("keys", "cached")).alias("x"))
    hits = hits.select("reading_id", "band_lang", "n_words", "share", F.lit(TRIGRAM).alias("kind"), F.col("x.keys").alias("key"), F.col("x.cached").alias("cachep"))
    one = F.any_value
    scored = look_up(hits, model).groupBy("reading_id").agg(one("band_lang").alias("band_lang"), one("n_words").alias("n_words"), one("share").alias("share"), F.sum(_saved()).alias("bits"))
    scored = stored(scored, "ratios")
    bands = lower_bands(scored.select("band_lang", "bits", (F.col("n_words") * F.col("share")).alias("again")))
    return scored.select("reading_id", "band_lang", "share", (1 - F.col("bits") / F.col("n_words")).alias("ratio"), _band(bands).alias("lower_ratio"))


def found(df: DataFrame, share: float = SHARE) -> DataFrame:
    """p1_found: prose readings below their language's band that, counted exactly, repeat at least ``share`` of their words."""
    return judged(df).filter((F.col("ratio") < F.col("lower_ratio")) & (F.col("share") >= share)).select("reading_id")
