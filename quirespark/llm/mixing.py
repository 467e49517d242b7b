"""Mixing sources to target weights.

Method. Sizes are tokens of a public tokenizer. A mix is as large as its
scarcest source allows: the least of cap / share, a source's cap being its
tokens times ``max_repeats``. The total is cut into equal blocks and the blocks
are given to the sources by Sainte-Lague (highest quotients share/(2q+1)),
then each source's blocks to its shards the same way, by the shards' tokens;
so every shard has an integer quota and picks its documents by itself, in the
order of a seeded hash: whole rounds over the shard first, then those that the
rest of the quota holds, then the one document that brings it nearest. The
scarcest source takes every document ``max_repeats`` times.

Shards are hash ranges of a source's documents of bounded size, so that a
source with a third of all rows is many tasks, and the running sums never
cross a shard. The driver sees one row for each source of ``mix_targets``; the
shards' quotas are given on the executors, a row for each shard. A shard misses
its quota by less than half a document, so that the error of a share falls as
sources grow; ``shares`` reports it.

Defined results
* source names count with case, blanks and hyphens aside; null sources belong to no mix.
* null and empty texts have no tokens and are never chosen.
* repeated rows of a ``doc_id`` count once.
* a source without documents can't contribute; its share is spread over the
  others in proportion, and ``shares`` reports it with 0.
* ties of quotients: the first by name; ties of hashes: the lower ``doc_id``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirespark.llm.tokenize import token_counts
from quirespark.session import stored

#: Tokens of a block, the unit of all quotas, whatever the size of a mix; documents of a shard.
BLOCK_TOKENS = 64
SHARD_DOCS = 50_000


def source_name(col):
    """A source's name as it is usually spelled."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats by highest quotients w/(2q+1), ties to the first; a divisor is searched, so that the number of seats costs nothing."""
    w = np.array(weights, dtype=float)
    out = np.zeros(len(w), np.int64)
    if seats <= 0 or w.sum() <= 0:
        return out.tolist()

    def given(d: float) -> np.ndarray:
        # a party has q seats if w/(2q-1) >= d
        return np.where(w > 0, np.floor((w / d + 1) / 2), 0).astype(np.int64)

    low, high = w.sum() / (2 * (seats + len(w)) + 1) / 4, float(w.max()) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() >= seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while out.sum() < seats:  # the last few by quotients
        out[int(np.argmax(w / (2 * out + 1)))] += 1
    return out.tolist()


def _sized(documents: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, n_tokens, rank hash of the documents of the mixes' sources."""
    wanted = F.broadcast(targets.select(source_name(F.col("source")).alias("source")).distinct())  # as many rows as mix_targets at most
    docs = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").join(wanted, "source", "left_semi")
    sized = token_counts(docs).select("doc_id", "source", "n_tokens").filter("n_tokens > 0").dropDuplicates(["doc_id"])
    return stored(sized.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "sized")


_QUOTAS = "mix_name string, source string, shard int, quota bigint, shard_tokens bigint, max_repeats int"


def _plan(sized: DataFrame, targets: DataFrame, seed: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(quotas by mix, source and shard; documents with their shard)."""
    spark = sized.sparkSession
    docs = sized.join(F.broadcast(_shards(sized)), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("shards")).cast("int")).drop("shards")
    docs = stored(docs, "sharded")
    held = docs.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t"))
    tokens = {r["source"]: r["t"] for r in held.groupBy("source").agg(F.sum("t").alias("t")).collect()}
    rows = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("mix_name", "source").collect()
    seats = []
    for mix in sorted({r["mix_name"] for r in rows if r["mix_name"] is not None}):
        own = [r for r in rows if r["mix_name"] == mix and r["source"] in tokens and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
        if not own:
            continue
        whole = sum(r["target_share"] for r in own)
        total = min(tokens[r["source"]] * r["max_repeats"] / (r["target_share"] / whole) for r in own)
        given = sainte_lague([r["target_share"] for r in own], int(total / block))
        seats += [(mix, r["source"], n, int(r["max_repeats"])) for r, n in zip(own, given, strict=True)]

    def share_out(rows: pd.DataFrame) -> pd.DataFrame:
        """Blocks of a source to its shards, a row each."""
        rows = rows.sort_values("shard")
        quota = np.array(sainte_lague(rows["t"].tolist(), int(rows["seats"].iloc[0])), np.int64) * block
        out = rows.assign(quota=np.minimum(quota, rows["t"] * rows["max_repeats"]), shard_tokens=rows["t"])
        return out[["mix_name", "source", "shard", "quota", "shard_tokens", "max_repeats"]]

    mixes = F.broadcast(spark.createDataFrame(seats, "mix_name string, source string, seats bigint, max_repeats int"))  # as many rows as mix_targets at most
    return held.join(mixes, "source").groupBy("mix_name", "source").applyInPandas(share_out, _QUOTAS), docs


def _shards(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.ceil(F.count("*") / SHARD_DOCS).alias("shards"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK_TOKENS) -> DataFrame:
    """Chosen documents: ``mix_name``, ``source``, ``doc_id``, ``n_times``, ``n_tokens`` (of one copy)."""
    quotas, docs = _plan(_sized(documents, targets, seed), targets, seed, block)
    w = W.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = docs.withColumn("upto", F.sum("n_tokens").over(w))
    # a quota row for each mix, source and shard; as shards grow with the data, the plan decides how to join
    joined = ordered.join(quotas, ["source", "shard"])
    rounds = F.floor(F.col("quota") / F.col("shard_tokens"))
    j = joined.withColumn("rounds", rounds).withColumn("rest", F.col("quota") - rounds * F.col("shard_tokens"))
    shard = W.partitionBy("source", "shard", "mix_name")
    inside = F.col("upto") <= F.col("rest")
    j = j.withColumn("missing", F.col("rest") - F.coalesce(F.max(F.when(inside, F.col("upto"))).over(shard), F.lit(0)))
    gap = F.abs(F.col("n_tokens") - F.col("missing"))
    nearest = F.min(F.when(~inside & (gap < F.col("missing")), F.struct(gap.alias("gap"), "h", "doc_id"))).over(shard)
    last = inside | F.coalesce(nearest["doc_id"] == F.col("doc_id"), F.lit(False))
    times = F.least(F.col("rounds") + last.cast("int"), F.col("max_repeats"))
    return j.select("mix_name", "source", "doc_id", times.cast("int").alias("n_times"), "n_tokens").filter("n_times > 0")


def shares(documents: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK_TOKENS) -> DataFrame:
    """For each source of a mix: target and actual share and their difference, tokens, documents and most repeats of one document."""
    chosen = mix(documents, targets, seed, block).groupBy("mix_name", "source").agg(
        F.sum(F.col("n_times") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("n_times").alias("most_repeats")
    )
    goal = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = goal.join(chosen, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"])
    actual = F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy("mix_name"))), F.lit(0.0))
    return out.withColumn("actual_share", actual).withColumn("error", F.col("actual_share") - F.col("target_share"))
