"""Removal of repeated byte strings: Burrows-Wheeler transforms of shards, merged by refining their interleave.

Indexing every byte would cost more than the text is worth, so texts are first parsed into phrases, as is done to build
transforms of repetitive collections: a phrase starts at an anchor, a byte position whose hashed 16 bytes are least among
``RADIUS`` positions on both sides. Anchors depend on the bytes around them only, so equal strings hold the same phrases.

A shard (a Spark partition of documents) lists its phrase suffixes with the symbol before each: its transform over the
phrase alphabet. Merging never sorts suffixes again. All suffixes start in one interval; a round splits the intervals by one
symbol, as each suffix hands its interval on to the suffix one phrase longer, through the symbol before it (the LF step).
Intervals are named by a hash instead of their place, which is all that is needed to tell repeats. An interval with one
suffix has found its common prefix with all others and leaves; rounds end when the phrases that fit in the length are used
up. What is left are repeated intervals: places where a string of the length may repeat.

There an exact check follows: around an anchor, windows of the length form a block. Blocks with the same bytes are settled at
once, so copies cost one row a block; blocks that meet different ones are compared by groups of windows, and window by window
only where those groups differ in part; all by 128-bit hashes. Windows with too few anchors (runs of one byte, say) are
compared singly.

Defined cases: a null text counts as empty; texts shorter than the length keep every byte; a text that occurs twice, or a row
that is repeated, loses every byte once it has the length; an empty table gives an empty result; texts are taken as bytes,
matches never cross documents; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import Scratch, stored

LENGTH = 400
GRAM = 16
RADIUS = 32
GROUP = 16  # windows compared at once before single ones
PIECE = 1 << 22  # bytes hashed at once

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for k in range(8):
        count = len(range(k, n, 8))
        words[k::8] = np.frombuffer(data, np.uint64, count, k)
    return _mixed(_mixed(words[:-8]) + words[8:])


def anchors(data: bytes) -> np.ndarray:
    """Positions whose hash is least within ``RADIUS`` positions, the leftmost of equals, ascending."""
    found = []
    last = len(data) - GRAM  # the last position with a hash
    for at in range(0, last + 1, PIECE):
        low, high = max(0, at - RADIUS), min(last + 1, at + PIECE + RADIUS)
        h = _gram_hashes(data[low : high + GRAM - 1])
        wall = np.full(RADIUS, np.iinfo(np.uint64).max)
        least, width = np.concatenate([wall, h, wall]), 1
        while width < RADIUS:  # least of the next `width` positions
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        good = (h < least[: len(h)]) & (h <= least[RADIUS + 1 : RADIUS + 1 + len(h)])
        place = np.flatnonzero(good) + low
        found.append(place[(place >= at) & (place < at + PIECE)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


class Blocks:
    """The windows of a text around its anchors.

    Of a window starting at ``p`` the anchors from ``p + RADIUS`` on, before ``p + reach``, are sure. Windows with two of
    them belong to the block of the first: starts ``low`` to ``high``. ``fewest`` and ``most`` phrases fit in its windows.
    """

    def __init__(self, data: bytes):
        self.data = data
        a = self.anchors = anchors(data)
        n = len(data)
        reach = LENGTH - GRAM + 1 - RADIUS
        before, after = np.r_[-n, a[:-1]], np.r_[a[1:], 3 * n]
        self.low = np.maximum(np.maximum(before - RADIUS + 1, after - reach + 1), 0)
        self.high = np.minimum(a - RADIUS, n - LENGTH)
        self.full = self.low <= self.high
        number = np.arange(len(a))
        self.fewest = np.searchsorted(a, self.low + reach) - number - 1
        self.most = np.searchsorted(a, self.high + reach) - number - 1

    def symbol(self, k: int) -> int:
        """Of the phrase from anchor k up to the end of the next anchor's bytes, as a signed number."""
        return xxhash.xxh64_intdigest(self.data[self.anchors[k] : self.anchors[k + 1] + GRAM]) - (1 << 63)

    def bare(self) -> list[tuple[int, int]]:
        """Ranges of starts whose windows are in no block."""
        ranges, at = [], 0
        for low, high in zip(self.low[self.full].tolist(), self.high[self.full].tolist()):
            if low > at:
                ranges.append((at, low - 1))
            at = max(at, high + 1)
        if at <= len(self.data) - LENGTH:
            ranges.append((at, len(self.data) - LENGTH))
        return ranges

    def needed(self) -> np.ndarray:
        """Rounds in which each suffix takes part: its own, and those that lead to suffixes before it."""
        need = np.where(self.full, self.most, 0)
        for k in range(1, len(need)):
            if need[k - 1] - 1 > need[k]:
                need[k] = need[k - 1] - 1
        return need


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shard's suffixes: text key, anchor, next anchor, symbol, phrases needed and wanted; bare texts have no anchor."""
    for batch in batches:
        keys, rows = [], []
        for data in batch.column(0).to_pylist():
            if data is None or len(data) < LENGTH:
                continue
            blocks = Blocks(data)
            key = hashlib.md5(data).digest()
            need = blocks.needed().tolist()
            fewest, full = blocks.fewest.tolist(), blocks.full.tolist()
            a = blocks.anchors.tolist()
            for k in range(len(a) - 1):
                if need[k] > 0:
                    keys.append(key)
                    rows.append((a[k], a[k + 1], blocks.symbol(k), need[k], fewest[k] if full[k] else 0))
            if blocks.bare():
                keys.append(key)
                rows.append((-1, -1, 0, 0, 0))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int16(), pa.int16())
        yield pa.record_batch(
            [pa.array(keys, pa.binary()), *(pa.array(c, t) for c, t in zip(columns, kinds))],
            ["key", "at", "following", "symbol", "need", "fewest"],
        )


def merged_intervals(phrases: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, at)`` of the suffixes whose interval still repeats after all phrases that fit in their shortest window.

    Reads tables in ``scratch``.
    """
    place = F.xxhash64("key", "at")
    suffixes = phrases.where("at >= 0")
    alphabet = suffixes.groupBy("symbol").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("symbol")
    live = suffixes.join(alphabet, "symbol", "left_semi").dropDuplicates(["key", "at"])
    live = scratch.stored(live.withColumn("interval", F.col("symbol")))
    repeated = [live.where("fewest = 1").select("key", "at")]
    most = live.agg(F.max("need")).first()[0] or 0
    for level in range(2, most + 1):
        order = Window.partitionBy("key").orderBy("at")
        step = live.withColumn("__at", F.lead("at").over(order)).withColumn("__interval", F.lead("interval").over(order))
        step = step.where((F.col("__at") == F.col("following")) & (F.col("need") >= level))
        step = scratch.stored(step.withColumn("interval", F.xxhash64("symbol", "__interval")).drop("__at", "__interval"))
        shared = step.groupBy("interval").count().where("count > 1").select("interval")
        live = scratch.stored(step.join(shared, "interval", "left_semi"))
        repeated.append(live.where(F.col("fewest") == level).select("key", "at"))
        if live.isEmpty():
            break
    every = repeated[0]
    for part in repeated[1:]:
        every = every.unionByName(part)
    return every


def _halves(data: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed numbers."""
    digest = xxhash.xxh128_intdigest(data)
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a block in groups of ``GROUP`` by their distance to the anchor, which is the same in equal windows.

    ``core``: the bytes that all windows of such a group share; ``hull``: those that the windows there cover.
    """
    names = ["key", "low", "start", "stop", "core_one", "core_two", "hull_one", "hull_two", "copies"]
    kinds = (pa.binary(), *[pa.int32()] * 3, *[pa.int64()] * 5)
    for batch in batches:
        rows = []
        for key, anchor, low, high, copies, body in zip(
            *(batch.column(c).to_pylist() for c in ("key", "anchor", "low", "high", "copies", "body"))
        ):
            for number in range((anchor - high) // GROUP, (anchor - low) // GROUP + 1):
                nearest, farthest = anchor - number * GROUP, anchor - number * GROUP - GROUP + 1
                start, stop = max(farthest, low), min(nearest, high)
                core = body[nearest - low : farthest - low + LENGTH]
                hull = body[start - low : stop - low + LENGTH]
                rows.append((key, low, start, stop, *_halves(core), *_halves(hull), copies))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to check, with their bytes; bare ranges as blocks without a symbol."""
    names = ["key", "symbol", "anchor", "low", "high", "one", "two", "body"]
    kinds = (pa.binary(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        rows = []
        for key, data, places in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "places"))):
            blocks = Blocks(data)
            ranges = []
            for k in np.searchsorted(blocks.anchors, [p for p in places if p >= 0]).tolist():
                ranges.append((blocks.symbol(k), int(blocks.anchors[k]), int(blocks.low[k]), int(blocks.high[k])))
            if -1 in places:
                for low, high in blocks.bare():
                    ranges += [(None, None, x, min(x + 4095, high)) for x in range(low, high + 1, 4096)]
            for symbol, anchor, low, high in ranges:
                body = data[low : high + LENGTH]
                rows.append((key, symbol, anchor, low, high, *_halves(body), body))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the asked ranges (start, stop, copies) of blocks: hash, how often it is there, start.

    Windows that meet an equal one in the batch are settled here: one row with their number stands for all of them, and
    their starts follow as runs, rows without a hash. Periodic passages shrink to a period this way.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            keys, lows, bodies, asked = (part.column(c).to_pylist() for c in ("key", "low", "body", "asked"))
            ranges = [(i, r["start"], r["stop"], r["copies"]) for i, rs in enumerate(asked) for r in rs]
            digests = (
                xxhash.xxh128_digest(bodies[i][x - lows[i] : x - lows[i] + LENGTH]) for i, a, b, _ in ranges for x in range(a, b + 1)
            )
            pairs = np.frombuffer(b"".join(digests), np.dtype([("one", np.int64), ("two", np.int64)]))
            counts = [b - a + 1 for _, a, b, _ in ranges]
            which = np.repeat(np.arange(len(ranges)), counts)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
            block, first, copies = (np.array([r[k] for r in ranges], np.int64)[which] for k in (0, 1, 3))
            start = first + inside
            order = np.lexsort((pairs["two"], pairs["one"]))
            sorted_pairs = pairs[order]
            heads = np.flatnonzero(np.r_[True, sorted_pairs[1:] != sorted_pairs[:-1]]) if len(order) else order
            chosen, total = order[heads], np.add.reduceat(copies[order], heads) if len(order) else copies
            met = np.zeros(len(order), bool)
            met[order] = np.repeat(np.diff(np.r_[heads, len(order)]) > 1, np.diff(np.r_[heads, len(order)]))
            places = np.flatnonzero(met)
            opens = np.r_[True, (np.diff(start[places]) != 1) | (np.diff(block[places]) != 0)] if len(places) else places
            run_first = places[np.flatnonzero(opens)]
            run_last = places[np.r_[np.flatnonzero(opens)[1:] - 1, len(places) - 1]] if len(places) else places
            none = pa.nulls(len(run_first), pa.int64())
            key = pa.array(keys, pa.binary())
            yield pa.record_batch(
                {
                    "one": pa.concat_arrays([pa.array(np.ascontiguousarray(pairs["one"][chosen])), none]),
                    "two": pa.concat_arrays([pa.array(np.ascontiguousarray(pairs["two"][chosen])), none]),
                    "copies": pa.concat_arrays([pa.array(total), none]),
                    "key": key.take(pa.array(np.r_[block[chosen], block[run_first]])),
                    "start": np.r_[start[chosen], start[run_first]].astype(np.int32),
                    "stop": np.r_[start[chosen], start[run_last]].astype(np.int32),
                }
            )


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def repeated_windows(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, low, high)``: ranges of window starts that occur elsewhere too, for a table of ``data`` (binary).

    Windows whose whole text occurs more than once are left to ``without_repeats``. Reads tables in ``scratch``.
    """
    search = Scratch(texts.sparkSession)
    phrases = search.stored(
        texts.select("data").mapInArrow(
            _phrases, "key binary, at int, following int, symbol bigint, need smallint, fewest smallint"
        )
    )
    chosen = merged_intervals(phrases, search).unionByName(phrases.where("at < 0").select("key", "at"))
    lists = scratch.stored(chosen.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("places")))
    search.clear()
    keyed = texts.withColumn("key", F.unhex(F.md5("data")))
    met = keyed.join(lists, "key").select("key", "data", "places")
    blocks = scratch.stored(
        met.mapInArrow(
            _block_rows, "key binary, symbol bigint, anchor int, low int, high int, one bigint, two bigint, body binary"
        )
    )
    # Equal blocks settle each other. Of those, one stands for all in the comparison with different blocks.
    same = scratch.stored(blocks.groupBy("symbol", "one", "two").agg(F.count("*").alias("copies"), F.min("key").alias("key")))
    settled = same.where("copies > 1").select("one", "two")
    whole = blocks.select("key", "low", "high", "one", "two").join(settled, ["one", "two"], "left_semi").select("key", "low", "high")
    mixed = same.where("symbol IS NOT NULL").groupBy("symbol").count().where("count > 1").select("symbol")
    asked = same.where("symbol IS NULL").unionByName(same.join(mixed, "symbol", "left_semi"))
    # Equal blocks inside one text: any of them will do.
    chosen = scratch.stored(blocks.join(asked.select("one", "two", "key", "copies"), ["one", "two", "key"]).dropDuplicates(["one", "two"]))
    groups = scratch.stored(
        chosen.where("symbol IS NOT NULL").mapInArrow(
            _group_rows,
            "key binary, low int, start int, stop int, core_one bigint, core_two bigint, hull_one bigint, hull_two bigint, copies bigint",
        )
    )
    # The same once more for groups of windows, where blocks differ only in part: groups whose core is nowhere else are out.
    core, hull = ["core_one", "core_two"], ["hull_one", "hull_two"]
    alike = scratch.stored(
        groups.groupBy(*core, *hull).agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "low", "start", "stop")).alias("at"))
    )
    part = groups.where("copies = 1").join(alike.where("copies > 1").select(*hull).distinct(), hull, "left_semi")
    differing = alike.groupBy(*core).count().where("count > 1").select(*core)
    open_groups = alike.join(differing, core, "left_semi").select("at.*", "copies")
    bare = chosen.where("symbol IS NULL").select("key", "low", F.col("low").alias("start"), F.col("high").alias("stop"), "copies")
    ranges = open_groups.unionByName(bare).groupBy("key", "low").agg(F.collect_list(F.struct("start", "stop", "copies")).alias("asked"))
    windows = scratch.stored(
        chosen.select("key", "low", "body")
        .join(ranges, ["key", "low"])
        .mapInArrow(_window_rows, "one bigint, two bigint, copies bigint, key binary, start int, stop int")
    )
    runs = windows.where("one IS NULL")
    twice = windows.where("one IS NOT NULL").groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").select("one", "two")
    single = windows.where("copies = 1").join(twice, ["one", "two"], "left_semi")
    return (
        whole.unionByName(part.select("key", F.col("start").alias("low"), F.col("stop").alias("high")))
        .unionByName(single.unionByName(runs).select("key", F.col("start").alias("low"), F.col("stop").alias("high")))
    )


def _covered(n: int, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges ``[start, end)`` that windows with the given starts cover, apart from each other and ascending."""
    spans: list[list[int]] = []
    for low, high in sorted(ranges):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high + LENGTH)
        else:
            spans.append([low, high + LENGTH])
    return [(a, min(b, n)) for a, b in spans]


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, lows, highs in zip(*(batch.column(c).to_pylist() for c in ("data", "lows", "highs"))):
            spans = _covered(len(data), list(zip(lows or (), highs or ())))
            kept, at = [], 0
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            kept.append(data[at:])
            rows.append((b"".join(kept), [{"start": a, "end": b} for a, b in spans]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], kind)]
        rest = [c for c in batch.schema.names if c not in ("data", "lows", "highs")]
        yield pa.record_batch([*(batch.column(c) for c in rest), *made], [*rest, "kept", "removed"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, kept, removed)``: the bytes that are left and the maximal ranges taken out, of every row."""
    column = F.col(f"`{text}`")
    texts = docs.select(F.coalesce(column, F.lit("")).cast("binary").alias("data"))
    key = _text_key(column)
    known = docs.select(key.alias("key"), F.octet_length(column).alias("n"))
    copies = known.where(F.col("n") >= LENGTH).groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("n")).where("c > 1")
    copied = copies.select("key", F.lit(0).alias("low"), (F.col("n") - LENGTH).cast("int").alias("high"))
    # All rows of one text find the same ranges: without repeats a list is as long as its text at most.
    scratch = Scratch(docs.sparkSession)
    ranges = repeated_windows(texts, scratch).unionByName(copied).distinct()
    lists = stored(ranges.groupBy("key").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")))
    scratch.clear()
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(column, F.lit("")).cast("binary").alias("data"), key.alias("key")
    ).withColumn("n_bytes", F.octet_length("data").cast("long"))
    met = rows.join(lists, "key", "left").select("doc_id", "n_bytes", "data", "lows", "highs")
    spans = "array<struct<start:bigint,end:bigint>>"
    return met.mapInArrow(_outcomes, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, kept binary, removed {spans}")
