"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream, cut into blocks of ``BLOCK`` words. A source's target is filled by slots: whole
rounds over all its blocks, then part of a round whose last slot is cut short. Seeded hashes draw for every output shard how
many slots of each source it gets: a source's counts over the shards are one multinomial draw that sums to its slots.
Running sums of the counts number the slots of a source, shard after shard. Slot ``n`` of a round takes the block that a
keyed permutation of the source's block numbers gives, so every round takes a block once at most. Blocks and slots meet by
source and block number; ``blocks()`` gives the shards themselves.

Positions in a stream are sums over hashed buckets of about ``BUCKET`` rows, then sums inside a bucket; sums over buckets and
over shards are taken in two levels. So a source with a third of all rows is no larger task than others. Reruns agree: everything follows from hashes of the rows.

Defined cases: a null text has size 0; documents of size 0 take nothing; a null source is a source of its own, the last;
a source without words has target 0; rows without an id or repeated rows are numbered and placed one after the other, so
each has a row of its own in the result, of size 0 too; an empty table gives an empty result. No document is taken more than ``CAP`` times.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import stored

# Weights by the order of sources, the share of all words to take, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0

BLOCK = 64
BUCKET = 2_000
SLOTS_AT_ONCE = 1 << 14
SHARD_SLOTS = 1 << 14
# Slots that one task lists: the table they are listed from is tiny, so its bytes say nothing about the work.
TASK_SLOTS = 1 << 18
# Rounds of the permutation, and buckets or shards summed up by one task.
ROUNDS = 32
GROUP = 4_096
SEED = 20

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) with ``sid`` and ``target``.

    What a source at its cap leaves over goes to the others by weight: in the order of cap per weight, the level at the
    first source below its cap is the level of all that follow. One row a source: small next to the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "__w", F.get(F.array(*map(F.lit, weights)), (F.col("sid") - 1) % len(weights)).cast("double")
    )
    everywhere = Window.partitionBy()
    before = Window.orderBy(F.col("__cap") / F.col("__w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.withColumn("__cap", cap * F.col("source_size").cast("double")).withColumn(
        "__level",
        (share * F.sum(F.col("source_size").cast("double")).over(everywhere) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        / (F.sum("__w").over(everywhere) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))),
    )
    free = F.when(F.col("__cap") > F.col("__w") * F.col("__level"), F.col("__level"))
    return level.withColumn("__level", F.max(free).over(everywhere)).select(
        "source", "source_size", "sid", F.least("__cap", F.coalesce(F.col("__w") * F.col("__level"), F.col("__cap"))).alias("target")
    )


def permuted(n: Column, size: Column, *key: Column) -> Column:
    """Place of ``n`` in a permutation of ``0 .. size - 1`` chosen by ``key``.

    A round pairs every number with its mirror image around a keyed centre; a keyed bit of the larger of both tells
    whether the pair changes places. Pairs stay pairs, so each round is one to one for any size.
    """

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(SEED + 2), *key, r), size) - x, size)
        moved = F.xxhash64(F.lit(SEED + 3), *key, r, F.greatest(x, mirror)) < 0
        return F.when(moved, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), n.cast("long"), turn)


def _ahead(counts: DataFrame, order: str, value: str) -> DataFrame:
    """``counts`` (sid, order, value) with ``ahead``: the sum of the values before each row of its source."""
    group = F.floor(F.col(order) / GROUP).alias("__group")
    before = Window.partitionBy("sid").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("sid", group).agg(F.sum(value).alias("__sum"))
    tops = tops.select("sid", "__group", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("sid", "__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    near = counts.select("*", group).withColumn("__near", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    met = near.join(tops, ["sid", "__group"])
    return met.select("sid", order, value, (F.col("__before") + F.col("__near")).alias("ahead"))


def _filled(sources: DataFrame) -> DataFrame:
    """``(sid, blocks, whole, rest, slots)`` of the sources that are taken: whole rounds, words of the last, all slots."""
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.round(F.col("target") - whole * F.col("source_size")).cast("long")
    return (
        sources.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
        .withColumn("rest", rest)
        .withColumn("whole", whole)
        .withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / BLOCK))
        .where("slots > 0")
        .select("sid", "blocks", "whole", "rest", "slots")
    )


def _tasks(slots: int) -> int:
    return max(1, ceil(slots / TASK_SLOTS))


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(sid, shard, slots)``: how many slots of each source every output shard draws, for a result of ``targets``.

    There are as many shards as give each about ``shard_slots`` slots; a count that comes out as 0 has no row.
    """
    filled = _filled(sources)
    number = filled.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, ceil(number / shard_slots))
    # A source of many slots is cut before its slots are listed.
    parts = filled.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOTS_AT_ONCE))))
    first = F.col("part") * SLOTS_AT_ONCE
    slots = parts.repartition(_tasks(number), "sid", "part").select(
        "sid", F.explode(F.sequence(first, F.least(first + SLOTS_AT_ONCE, F.col("slots")) - 1)).alias("slot")
    )
    drawn = F.pmod(F.xxhash64(F.lit(SEED + 1), "sid", "slot"), F.lit(shards))
    return slots.groupBy("sid", drawn.alias("shard")).agg(F.count("*").alias("slots"))


def _slots(sources: DataFrame, counts: DataFrame, number: int) -> DataFrame:
    """All ``number`` slots as ``(sid, shard, slot, draw, block, words)``: which block every slot takes, and how many of its words."""
    numbered = _ahead(counts, "shard", "slots").join(_filled(sources).drop("slots"), "sid")
    slots = numbered.repartition(_tasks(number), "sid", "shard").withColumn(
        "slot", F.explode(F.sequence(F.col("ahead"), F.col("ahead") + F.col("slots") - 1))
    )
    slots = slots.withColumn("draw", F.floor(F.col("slot") / F.col("blocks"))).withColumn("n", F.pmod("slot", "blocks"))
    block = permuted(F.col("n"), F.col("blocks"), F.col("sid"), F.col("draw"))
    words = F.when(F.col("draw") < F.col("whole"), F.lit(BLOCK)).otherwise(F.least(F.lit(BLOCK), F.col("rest") - F.col("n") * BLOCK))
    return slots.select("sid", "shard", "slot", "draw", block.alias("block"), words.alias("words"))


class Mix:
    """The mix of a table.

    ``documents()`` tells how much of each row is taken, ``texts()`` gives the taken texts row by row, ``blocks()`` the
    output shards in blocks.
    """

    def __init__(
        self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard_slots: int = SHARD_SLOTS
    ):
        self.docs, self.doc_id, self.text = docs, doc_id, text
        size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
        self.row = F.xxhash64(F.lit(SEED), *(F.col(f"`{c}`") for c in docs.columns))
        sized = stored(
            docs.select(
                F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), self.row.alias("__row")
            )
        )
        self.sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
        self.counts = stored(shard_counts(self.sources, shard_slots))
        self.slots = self.counts.agg(F.sum("slots")).first()[0] or 0
        self.placed = stored(self._placed(sized))

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Every row with its place in the stream of its source."""
        buckets = max(1, ceil(sized.count() / BUCKET))
        named = self.sources.withColumnRenamed("source", "__source")
        rows = sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source")
        rows = rows.withColumn("bucket", F.pmod("__row", F.lit(buckets)))
        sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
        sums = _ahead(sums, "bucket", "words").drop("words")
        inside = Window.partitionBy("sid", "bucket").orderBy("__row", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).withColumn("nth", F.row_number().over(inside))
        return rows.join(sums, ["sid", "bucket"]).select(
            "doc_id", "__row", "nth", "size", "sid", "source_size", "target", (F.col("start") + F.col("ahead")).alias("start")
        )

    def _pieces(self) -> DataFrame:
        """Taken words: for a row of size above 0 and a draw, ranges ``[low, high)`` of its words."""
        first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
        parts = self.placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        # The slots grow with the words, though their table starts from a few sources: never to be broadcast.
        slots = _slots(self.sources, self.counts, self.slots).hint("merge")
        met = parts.join(slots, ["sid", "block"])
        low = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
        high = F.least(F.col("block") * BLOCK + F.col("words") - F.col("start"), F.col("size"))
        return met.select(*self.placed.columns, "shard", "slot", "draw", low.alias("low"), high.alias("high")).where("high > low")

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target (of the source) and taken words of every row."""
        keys = ["doc_id", "__row", "nth", "size", "sid", "source_size", "target", "start"]
        taken = self._pieces().select(*keys, (F.col("high") - F.col("low")).alias("taken"))
        none = self.placed.select(*keys, F.lit(0).cast("long").alias("taken"))
        every = taken.unionByName(none).groupBy(*keys).agg(F.sum("taken").alias("taken"))
        return every.select("doc_id", "size", "source_size", "target", "taken")

    def blocks(self) -> DataFrame:
        """The output shards: ``shard, place, source, slot, n_words, text``, one row a slot, places from 1 in each shard.

        A text holds the words of its block, joined by one space; the order inside a shard is drawn by a hash. A shard
        has about ``shard_slots`` rows and is ordered by one task.
        """
        once = self.docs.withColumn("__row", self.row).dropDuplicates(["__row"])
        words = F.regexp_extract_all(F.col(f"`{self.text}`"), F.lit(f"({WORD})"), F.lit(1))
        met = once.select("__row", words.alias("__words")).join(self._pieces(), "__row")
        piece = F.array_join(F.slice("__words", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")), " ")
        parts = met.select("sid", "shard", "slot", "start", "nth", (F.col("high") - F.col("low")).alias("n"), piece.alias("piece"))
        whole = parts.groupBy("sid", "shard", "slot").agg(
            F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("start", "nth", "piece"))).alias("pieces")
        )
        drawn = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 4), "sid", "slot"), "sid", "slot")
        placed = whole.withColumn("place", F.row_number().over(drawn)).join(self.sources.select("sid", "source"), "sid")
        text = F.array_join(F.transform("pieces", lambda p: p["piece"]), " ")
        return placed.select("shard", "place", "source", "slot", "n_words", text.alias("text"))

    def texts(self) -> DataFrame:
        """Rows like the input's, one for every draw of a row, with the words taken and what follows each."""
        taken = (
            self._pieces()
            .groupBy("doc_id", "__row", "size", "sid", "start", "draw")
            .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("__ranges"), F.sum(F.col("high") - F.col("low")).alias("taken"))
            .select("__row", "draw", "size", "taken", "__ranges")
        )
        once = self.docs.withColumn("__row", self.row).dropDuplicates(["__row"])
        columns = [c for c in self.docs.columns if c != "__row"]
        met = once.select(*(F.col(f"`{c}`") for c in columns), "__row").join(taken, "__row")
        # A word with the gap after it; what stands before the first word belongs to it.
        split = F.when(F.col("taken") < F.col("size"), F.split(F.col(f"`{self.text}`"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"))
        met = met.withColumn("__words", split)
        lead = F.when(F.col(f"`{self.text}`").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
        met = met.withColumn("__lead", lead)
        cut = F.transform(
            "__ranges",
            lambda r: F.array_join(F.slice("__words", (r["low"] + F.col("__lead") + 1).cast("int"), (r["high"] - r["low"]).cast("int")), ""),
        )
        shown = F.when(F.col("taken") < F.col("size"), F.array_join(cut, "")).otherwise(F.col(f"`{self.text}`"))
        return met.withColumn(self.text, shown).select(*(F.col(f"`{c}`") for c in columns))
