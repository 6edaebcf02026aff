"""Mixing sources to target weights (problem 7).

Method: capped water-filling. Sources are given their share of the total; those that
would need more than their most repeats are clamped there, and what they leave is
shared out among the others by weight until all fit. Whole repeats are copied; the
fractional one takes documents in a seeded order up to its budget.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.runtime import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The seeded order is read in so many buckets per source, so that only one bucket of a source is ever sorted.
BUCKETS = 1 << 16
#: Rows of the target table that the driver holds at most.
MAX_SOURCES = 100_000
#: Characters that go to the tokenizer at once.
PART = 100_000


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(enc, text: str) -> int:
    """Tokens of a text; very long texts go in parts that end before a space, where the pattern splits anyway."""
    total, at = 0, 0
    while len(text) - at > PART:
        cut = at + PART
        while cut > at and not (text[cut] == " " and text[cut - 1].isalnum()):
            cut -= 1
        cut = cut if cut > at else at + PART
        total += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(enc.encode_ordinary(text[at:]))


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that take part: those with a source and a non-empty text."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for texts in batches:
            yield pd.Series([count_tokens(enc, t) for t in texts], dtype="int64")

    tokens = F.pandas_udf(count, "bigint")
    part = documents.filter(F.col("source").isNotNull() & (F.length("text") > 0))
    return part.select("doc_id", "source", tokens("text").alias("n_tokens"))


def water_fill(total: float, available: dict[str, int], weight: dict[str, float], repeats: dict[str, int]) -> dict[str, float]:
    """Size for each source: by weight, none over its available size times its repeats.

    What clamped sources leave goes to the others by weight. If all are clamped, the
    sum stays under the total: more than every source's most cannot be had.
    """
    cap = {s: float(available.get(s, 0)) * max(repeats[s] or 0, 0) for s in weight}
    size = {s: 0.0 for s in weight}
    open_ = {s for s in weight if cap[s] > 0 and weight[s] > 0}
    left = float(total)
    while open_ and left > 0:
        scale = left / math.fsum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * scale >= cap[s]}
        for s in over or open_:
            size[s] = cap[s] if s in over else weight[s] * scale
        if not over:
            break
        left -= math.fsum(cap[s] for s in over)
        open_ -= over
    return size


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(quotas, targets with available tokens): per source whole repeats and the token budget of the fractional one.

    The total is that of all documents that take part, if not given. Targets with a
    null source or share count for nothing; a null number of repeats for none.
    """
    spark = sizes.sparkSession
    rows = targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy("source").agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    per_source = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = spark.createDataFrame([(r.source,) for r in rows], "source string")
    available = {r.source: r.tokens for r in per_source.join(F.broadcast(wanted), "source", "left_semi").collect()}
    if total is None:
        total = per_source.agg(F.sum("tokens")).first()[0] or 0
    size = water_fill(total, available, {r.source: r.target_share for r in rows}, {r.source: r.max_repeats for r in rows})
    quota = []
    for r in rows:
        have = available.get(r.source, 0)
        whole = int(size[r.source] // have) if have else 0
        quota.append((r.source, float(r.target_share), int(r.max_repeats or 0), have, whole, int(size[r.source] - whole * have)))
    schema = "source string, target_share double, max_repeats int, available_tokens bigint, whole int, budget bigint"
    return spark.createDataFrame(quota, schema), wanted


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies): each document of the mixture with how often it is used.

    Copies never exceed the source's max_repeats. The fractional repeat takes the
    documents of a source in the order of a seeded hash of doc_id while they fit its
    budget, so a source misses its size by less than a document. Sources without a
    target, or that the corpus lacks, give no rows.
    """
    sizes = materialize(sized(documents, vocabulary))
    quotas, _ = plan(sizes, targets, total)
    return drawn(sizes, quotas, seed)


def drawn(sizes: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.join(F.broadcast(quotas.select("source", "whole", "budget")), "source").withColumn("u", order)
    rows = rows.withColumn("bucket", F.pmod("u", F.lit(BUCKETS)))
    # Sums per bucket are combined on the map side: at most BUCKETS rows per source are shuffled by each task.
    sums = rows.groupBy("source", "bucket", "budget").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("after", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = sums.filter(F.col("after") > F.col("budget")).groupBy("source").agg(
        F.min("bucket").alias("cut"), F.min_by(F.col("after") - F.col("n"), "bucket").alias("used"))
    rows = rows.join(F.broadcast(cuts), "source", "left")
    below = F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))
    plain = rows.filter(below | (F.col("bucket") > F.col("cut"))).withColumn("extra", F.when(below, 1).otherwise(0))
    inside = Window.partitionBy("source").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = rows.filter(F.col("bucket") == F.col("cut")).withColumn(
        "extra", F.when(F.col("used") + F.sum("n_tokens").over(inside) <= F.col("budget"), 1).otherwise(0))
    return plain.unionByName(at_cut).select(
        "doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra")).cast("int").alias("copies")).filter(F.col("copies") > 0)


def shares(documents: DataFrame, targets: DataFrame, seed: int = 42, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """What came of the targets: source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share; one row per source with a target."""
    sizes = materialize(sized(documents, vocabulary))
    quotas, _ = plan(sizes, targets, total)
    used = drawn(sizes, quotas, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    mixed = quotas.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    everything = mixed.agg(F.sum("mixed_tokens").alias("everything"))
    return mixed.join(F.broadcast(everything)).select(
        "source", "target_share", "max_repeats", "available_tokens", "mixed_tokens",
        F.round(F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), "everything"), F.lit(0.0)), 6).alias("actual_share"))
