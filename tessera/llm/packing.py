"""Packing by optimal length buckets.

Documents are cut into segments of at most ``max_len`` words, so the global
histogram of segment lengths has at most ``max_len`` entries. Dynamic programming
over it picks the ``n_buckets`` upper bounds that give the least padding. Inside
each bucket, segments in hash-random order fill batches: as many segments as fit
in ``token_budget`` when each is padded to the bucket's bound.

A segment's place in its bucket is a distributed prefix sum: segments are dealt
to (bucket, key range) groups, the groups' counts are summed in a small table,
and only the rank within a group needs its rows together. The number of ranges
grows with spark.sql.shuffle.partitions and doesn't change the result. What is
shuffled are narrow rows without text.

Defined results
- null or empty text, or blanks only: one row with segment 0, n_tokens 0 and null bucket, batch and slot; nothing is dropped.
- repeated rows: each takes a place of its own; rows equal in doc_id and length share their set of places.
- null doc_id: packed like any other.
- an empty table: empty result. Fewer distinct lengths than buckets: a bucket for each length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shards, word_count, written

MAX_LEN = 2048
N_BUCKETS = 16
TOKEN_BUDGET = 1 << 16
SEED = "pack"


def boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Upper bounds, ascending, that minimise the sum of (bound - length) over all; of equal choices that with the lower bounds."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.float64)
    m, k = len(lengths), min(n_buckets, len(lengths))
    # padded size of all lengths in (i, j] with the bound lengths[j - 1]; the true sizes are the same for any choice
    best = np.concatenate([[0.0], lengths * count[1:]])
    came = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(1, k):
        new, back = best.copy(), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (count[j] - count[:j])
            back[j] = int(np.argmin(cost))
            new[j] = cost[back[j]]
        best = new
        came.append(back)
    out, j = [], m
    for back in reversed(came):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(back[j])
    return sorted(out)


def pack(docs: DataFrame, *, max_len: int = MAX_LEN, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """A row a segment: doc_id, segment, first_token, n_tokens, bucket, bucket_len, batch, slot."""
    spark = docs.sparkSession
    sizes = written(docs.select("doc_id", word_count(F.col("text")).alias("words")), "pack-sizes")
    last = F.greatest(F.floor((F.col("words") - 1) / max_len), F.lit(0)).cast("int")
    cut = sizes.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("segment"))
    first = F.col("segment").cast("long") * max_len
    cut = cut.select("doc_id", "segment", first.alias("first_token"), F.least(F.lit(max_len), F.col("words") - first).alias("n_tokens"))
    histogram = {r["n_tokens"]: r["n"] for r in cut.where("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    bounds = boundaries(histogram, n_buckets)
    if not bounds:
        empty = {"bucket": "int", "bucket_len": "long", "batch": "long", "slot": "int"}
        return cut.select("*", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    bits = (shards(spark) - 1).bit_length()
    upper = F.array(*[F.lit(b).cast("long") for b in bounds])
    bucket = F.size(F.filter(upper, lambda b: b < F.col("n_tokens")))
    key = F.xxhash64(F.lit(SEED), "doc_id", "segment")
    cut = cut.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket)).withColumn("key", key).withColumn("shard", F.shiftright("key", 64 - bits))
    full = cut.where("n_tokens > 0")
    counts = full.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")
    counts = written(counts.select("bucket", "shard", before.alias("before")), "pack-offsets")
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "doc_id", "segment", "n_tokens")) - 1
    placed = full.withColumn("rank", rank).join(counts, ["bucket", "shard"])
    place = F.col("before") + F.col("rank")
    length = F.get(upper, F.col("bucket"))
    room = F.greatest(F.floor(F.lit(token_budget) / length), F.lit(1)).cast("long")
    names = ("doc_id", "segment", "first_token", "n_tokens", "bucket")
    placed = placed.select(*names, length.alias("bucket_len"), F.floor(place / room).cast("long").alias("batch"), (place % room).cast("int").alias("slot"))
    empty = cut.where("n_tokens = 0").select(*names, F.lit(None).cast("long").alias("bucket_len"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return placed.unionByName(empty)
