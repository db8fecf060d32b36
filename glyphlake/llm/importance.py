"""Resampling towards a target distribution: documents are weighed by how much more their hashed word runs occur in target texts.

Every run of 1 to ``runs`` consecutive words falls into one of ``BUCKETS`` buckets. The bucket totals of the documents and of
the target texts are sums on Spark; the logarithm of the ratio of the two smoothed shares, in thousandths and floored, is a
bucket's gain. A document's weight is bit-sliced: its bucket counts become planes of one bit a bucket, so do the sizes of the
positive and of the negative gains. The AND of a count plane and a gain plane, its set bits counted and multiplied by the power
of two of both planes, summed over all pairs of planes, is the exact sum of the gains of all features.

Drawing the highest of weight plus Gumbel noise, which a hash of the id gives, samples without replacement in proportion to the
weights. All rows are sorted in ranges over the cluster and numbered by range and place, so no task ranks them all.

Defined cases: null and empty texts and texts without a word have no feature and weight 0; a null id counts as the text ``null``
in its noise; repeated rows are judged one by one and, when drawn, rank one after the other; an empty table gives an empty result;
without target texts all gains come from the smoothing. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import stored

# Number of buckets, thousandths, the words a drawn document has at least, the share drawn in percent, the seed.
BUCKETS = 10_000
SCALE = 1000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

# In UTF-8 bytes with A-Z lower-cased: what is neither ASCII nor a digit or letter of it belongs to words too.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CACHED_WORDS = 1 << 18

_FEATURES = "struct<n_words:bigint,n_features:bigint,buckets:array<int>,counts:array<bigint>>"
_bucket = lru_cache(CACHED_WORDS)(lambda feature: crc32(feature) % BUCKETS)


def bucket_counts(text: bytes | None, runs: int = 1) -> tuple[int, int, dict[int, int]]:
    """Number of words, number of features, and how many features fall into each bucket that has any."""
    words = WORD.findall((text or b"").lower())
    counts: Counter[int] = Counter()
    number = 0
    for length in range(1, min(runs, len(words)) + 1):
        features = words if length == 1 else (b" ".join(words[i : i + length]) for i in range(len(words) - length + 1))
        for feature, n in Counter(features).items():
            counts[_bucket(feature)] += n
            number += n
    return len(words), number, counts


def text_features(text: Column | str, runs: int = 1) -> Column:
    """Words, features and bucket counts of a text as a struct."""

    @F.arrow_udf(_FEATURES)
    def features(texts: pa.Array) -> pa.Array:
        found = [bucket_counts(t, runs) for t in texts.to_pylist()]
        ends = pa.array(np.cumsum([0, *(len(c) for _, _, c in found)]), pa.int32())
        buckets = pa.array([b for _, _, c in found for b in c], pa.int32())
        counts = pa.array([n for _, _, c in found for n in c.values()], pa.int64())
        parts = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
        lists = [pa.ListArray.from_arrays(ends, buckets), pa.ListArray.from_arrays(ends, counts)]
        return pa.StructArray.from_arrays([*parts, *lists], ["n_words", "n_features", "buckets", "counts"])

    column = F.col(f"`{text}`") if isinstance(text, str) else text
    return features.asNondeterministic()(column.cast("binary"))


def bucket_totals(found: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of ``(buckets, counts)``: every task hands out one row a bucket."""

    def added(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            buckets, counts = (batch.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add.at(total, buckets, counts)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held, pa.int32()), "n": pa.array(total[held])})

    sums = found.select("buckets", "counts").mapInArrow(added, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums.collect():  # at most BUCKETS rows
        totals[bucket] = n
    return totals


def gains(documents: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The gain of every bucket, in thousandths, floored; in doubles."""
    all_documents, all_targets = float(documents.sum()), float(targets.sum())
    return np.array(
        [
            math.floor(SCALE * math.log((t + 1.0) * (all_documents + BUCKETS) / ((s + 1.0) * (all_targets + BUCKETS))))
            for s, t in zip(documents.tolist(), targets.tolist())
        ],
        np.int64,
    )


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Row ``j`` holds bit ``j`` of every value, packed in 64-bit words; as many rows as the largest value has bits."""
    bits = int(values.max(initial=0)).bit_length()
    planes = (values[None, :] >> np.arange(bits, dtype=values.dtype)[:, None] & 1).astype(np.uint8)
    packed = np.packbits(planes, axis=1)
    padded = np.zeros((bits, -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view(np.uint64)


class GainPlanes:
    """Bit planes of the sizes of positive and negative gains."""

    def __init__(self, values: np.ndarray):
        self.signed = [(1, bit_planes(np.maximum(values, 0))), (-1, bit_planes(np.maximum(-values, 0)))]

    def total(self, buckets: np.ndarray, counts: np.ndarray) -> int:
        """Sum of count times gain over the buckets of one document."""
        dense = np.zeros(BUCKETS, np.int64)
        dense[buckets] = counts
        planes = bit_planes(dense)
        total = 0
        for sign, gain in self.signed:
            for j, plane in enumerate(planes):
                held = np.bitwise_count(plane & gain).sum(axis=1, dtype=np.int64)
                total += sign * sum(int(n) << (j + k) for k, n in enumerate(held.tolist()))
        return total


def weighed(found: DataFrame, values: np.ndarray) -> DataFrame:
    """``found`` with ``weight``, the floored mean of the gains of a row's features."""
    shared = found.sparkSession.sparkContext.broadcast(values)  # BUCKETS numbers
    made: list[GainPlanes] = []

    @F.arrow_udf("bigint")
    def totals(buckets: pa.Array, counts: pa.Array) -> pa.Array:
        if not made:
            made.append(GainPlanes(shared.value))
        ends = buckets.offsets.to_numpy()
        b, n = buckets.values.to_numpy(), counts.values.to_numpy()
        return pa.array([made[0].total(b[i:j], n[i:j]) for i, j in zip(ends, ends[1:])], pa.int64())

    summed = found.withColumn("__total", totals("buckets", "counts"))
    floored = F.expr("(__total - pmod(__total, n_features)) div n_features")
    return summed.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0).cast("long"))).drop("__total")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id in thousandths, floored: the same in every run."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_sample(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    runs: int = 1,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every row of ``docs``; rank is null where a row is not drawn."""
    known = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_features(text, runs).alias("f")).select("doc_id", "f.*")
    known = stored(known)
    aimed = targets.select(text_features(target_text, runs).alias("f")).select("f.*")
    rows = weighed(known, gains(bucket_totals(known), bucket_totals(aimed)))
    rows = rows.select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("fit"),
    )
    # Sorted in ranges; the id that Spark gives in a sorted table is range number and place in the range.
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    ordered = rows.orderBy(F.desc("fit"), F.desc("score"), "doc_id", "__row").withColumn("__at", F.monotonically_increasing_id())
    ordered = ordered.withColumn("part", F.shiftright("__at", 33)).withColumn("place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    placed = stored(ordered.select("doc_id", "n_features", "weight", "score", "fit", "part", "place"))
    # One row a range: as many as the sort has tasks.
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("fit"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("fit", F.sum("fit").over(Window.partitionBy()))
    before = parts.select(
        "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.expr(f"fit * {int(percent)}L div 100").alias("drawn")
    )
    rank = F.col("ahead") + F.col("place") + 1
    return placed.join(F.broadcast(before), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (rank <= F.col("drawn")), rank).alias("rank")
    )
