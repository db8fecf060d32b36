"""SimHash near-duplicates: a self-join of fingerprints on binary tries.

A fingerprint takes the majority of every bit over the XXH64 hashes of all 4-word shingles. Two fingerprints within
``BUDGET`` differing bits agree fully on at least one of ``BUDGET + 1`` bands. For every band the bits are rotated so
that the band leads; the trie over the rotated values is then joined with itself: pairs of nodes are followed together,
differing bits are added up, and a pair is given up once its budget is spent, which for the leading band is zero. Top
levels of the tries are spread over the cluster as groups; a group with very many values is cut in chunks that meet in
pairs, so no task holds more than ``2 * CHUNK`` values. A group hands out a spanning forest of its links, never all pairs.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any others;
a text with fewer than four words is hashed as one shingle; equal texts meet as one fingerprint; rows repeated or without
an id get the component of their fingerprint; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, repeat
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stored
from glyphlake.llm.components import connected

SHINGLE = 4
SEED = 42
BUDGET = 4
BITS = 64
GROUP = 20_000  # values aimed at in a group
CHUNK = 100_000  # values of a group before it is cut
FRONTIER = 1 << 18  # pairs of nodes followed at once
LEAF = 48  # pairs of values below which nodes are compared directly

# ---- fingerprints --------------------------------------------------------------------------


def fingerprint(data: bytes) -> int:
    """Of a UTF-8 text, as an unsigned number."""
    words = data.lower().split()  # bytes: only A-Z is lowered, only the six gap characters split
    n = len(words) - SHINGLE + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    views = (joined[a : b - 1] for a, b in zip(starts, ends[SHINGLE - 1 :]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, views, repeat(SEED)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    found = [fingerprint(t) if t else 0 for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())


def fingerprints(text: Column | str) -> Column:
    """Fingerprint of a text as a bigint with the same 64 bits."""
    return F.arrow_udf(_fingerprints, "bigint")(text)


# ---- the trie join -------------------------------------------------------------------------


def bands(budget: int = BUDGET) -> list[tuple[int, int]]:
    """First bit and width of every band."""
    edges = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _every_pair(a_lo, a_n, b_lo, b_n) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of many small products of ranges, a bounded number at a time."""
    sizes = a_n * b_n
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + 1, 1 << 21)[1:], "right")
    for part in np.split(np.arange(len(sizes)), cuts):
        if len(part):
            size = sizes[part]
            which = np.repeat(part, size)
            place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            yield a_lo[which] + place // b_n[which], b_lo[which] + place % b_n[which]


def trie_join(
    values: np.ndarray, lead: int, budget: int, meet: Callable[[np.ndarray, np.ndarray], None], leaf: int = LEAF
) -> None:
    """Call ``meet(i, j)`` with all index pairs i < j of sorted distinct ``values`` (uint64) within the budget.

    The first ``lead`` bits have no budget: only equal nodes are followed down to that depth.
    """
    top = values >> np.uint64(BITS - lead) if lead else np.zeros(len(values), np.uint64)
    cuts = np.flatnonzero(np.diff(top)) + 1
    lo, hi = np.r_[0, cuts], np.r_[cuts, len(values)]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    todo = [(lead, np.stack([lo, hi, lo, hi, np.zeros_like(lo)]).astype(np.int64))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        depth, nodes = todo.pop()
        if nodes.shape[1] > FRONTIER:
            half = nodes.shape[1] // 2
            todo += [(depth, nodes[:, :half]), (depth, nodes[:, half:])]
            continue
        small = ((nodes[1] - nodes[0]) * (nodes[3] - nodes[2]) <= leaf) | (depth == BITS)
        a_lo, a_hi, b_lo, b_hi, _ = nodes[:, small]
        if len(a_lo):
            for i, j in _every_pair(a_lo, a_hi - a_lo, b_lo, b_hi - b_lo):
                near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i < j)
                if near.any():
                    meet(i[near], j[near])
        nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        if depth not in ones:
            bit = (values >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.r_[0, np.cumsum(bit.astype(np.int64))]
        c = ones[depth]
        a_lo, a_hi, b_lo, b_hi, spent = nodes
        a_mid, b_mid = a_hi - (c[a_hi] - c[a_lo]), b_hi - (c[b_hi] - c[b_lo])
        apart = a_lo != b_lo
        below = np.concatenate(
            [
                np.stack([a_lo, a_mid, b_lo, b_mid, spent]),
                np.stack([a_mid, a_hi, b_mid, b_hi, spent]),
                np.stack([a_lo, a_mid, b_mid, b_hi, spent + 1]),
                np.stack([a_mid, a_hi, b_lo, b_mid, spent + 1])[:, apart],  # mirrored for a node with itself
            ],
            axis=1,
        )
        a_n, b_n = below[1] - below[0], below[3] - below[2]
        alive = (a_n > 0) & (b_n > 0) & (below[4] <= budget) & ((below[0] != below[2]) | (a_n > 1))
        todo.append((depth + 1, below[:, alive]))


class _Forest:
    """Components of the positions of an array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def meet(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


def _rotated(values: np.ndarray, first: int) -> np.ndarray:
    return values if not first else (values << np.uint64(first)) | (values >> np.uint64(BITS - first))


def _links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links in one group."""
    band = table.column("band")[0].as_py()
    first, width = bands()[band]
    plain = np.unique(table.column("fp").to_numpy()).view(np.uint64)
    turned = _rotated(plain, first)
    order = np.argsort(turned)
    forest = _Forest(len(plain))
    trie_join(turned[order], width, BUDGET, forest.meet)
    own = plain[order].view(np.int64)
    hung = forest.root != np.arange(len(own))
    return pa.table({"a": own[hung], "b": own[forest.root[hung]]})


def near_links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the fingerprints (column ``fp``, distinct) linked by few differing bits."""
    number = prints.count()
    depth = min(BITS // (BUDGET + 1), max(0, ceil(log2(max(1, number) / GROUP))))
    turned = [_turn(F.col("fp"), first) for first, _ in bands()]
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.shiftrightunsigned(t, BITS - depth) if depth else F.lit(0).cast("long") for t in turned]))
    ).toDF("fp", "band", "node")
    # At most 5 * 2^12 groups, whatever the input: a broadcast of proven size.
    sizes = keyed.groupBy("band", "node").count().where(F.col("count") > CHUNK)
    keyed = keyed.join(F.broadcast(sizes), ["band", "node"], "left").withColumn(
        "parts", F.coalesce(F.ceil(F.col("count") / CHUNK), F.lit(1)).cast("int")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meetings = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = meetings.select(
        "fp", "band", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    ).groupBy("band", "node", "x", "y")
    return grouped.applyInArrow(_links, "a bigint, b bigint")


def _turn(value: Column, first: int) -> Column:
    if not first:
        return value
    return F.shiftleft(value, first).bitwiseOR(F.shiftrightunsigned(value, BITS - first))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row: the smallest id reachable over links, the row's own included."""
    prints = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`")).alias("fp")))
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    linked = stored(distinct.join(roots, "fp"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    components = linked.join(named, "root").select("fp", "component_id")
    every = distinct.join(components, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )
    return prints.join(every, "fp").select("doc_id", "fp", "component_id")


def one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id names their group of near copies, one row an id; rows without an id are kept."""
    key = F.col(f"`{doc_id}`")
    kept = near_duplicates(docs, doc_id, text).where(F.col("doc_id") == F.col("component_id"))
    kept = kept.select(F.col("doc_id").alias(doc_id)).distinct()
    named = docs.where(key.isNotNull()).join(kept, doc_id, "left_semi").dropDuplicates([doc_id])
    return named.select(*docs.columns).unionByName(docs.where(key.isNull()))
