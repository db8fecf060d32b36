"""SentencePiece BPE encoding and decoding by a table of distinct chunks.

A chunk is a run of blanks with the characters up to the next blank. Where no piece of the model has its marker after another
character, no piece reaches over the start of a chunk, so chunks are segmented on their own. For the same reason line ends are chunks
of their own where no piece joins them to anything, and the last character is one where no piece has it after the one before, as
a comma after a letter: a word is one chunk whatever follows it. The distinct chunks of all documents
are counted on Spark and each is segmented once, merging the best-scored pair first. Ids are joined back by position: the most
frequent chunks, a table of bounded rows and bytes, are broadcast by their hashes; a hash that any two chunks share is taken out of
the table, so it tells them apart exactly. Of the others, those that occur once in all documents are segmented at their place; a bit
set of bounded size, broadcast too, tells them from repeated ones. Every other occurrence is a row of text digest, position and chunk
that meets the table in an equi-join, and the ids of a text's rows fill the positions left open.
So no word that many documents share is ever a key of that join. A set too full to tell sends more rows to it and loses none.

Defined cases: a null text counts as empty and has the begin and end ids alone; a chunk of any length is segmented in n log n;
repeated rows are encoded one by one; ties in scores are merged from the left; an empty table gives an empty result; all columns of
the input are kept, whatever their names. Characters without a piece become byte pieces. Models whose pieces reach over blanks
or that rewrite texts are refused.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import accumulate, chain, filterfalse, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import Scratch, stored, united_bits

MARK = "▁"
#: Bounds of the broadcast table: rows, and bytes of a chunk in it.
FREQUENT = 1 << 20
FREQUENT_BYTES = 64
#: Bits of the set of repeated chunks beyond that table, as a power of two: 16 MB.
SET_BITS = 27
#: Frequencies are told apart by the logarithm, in so many steps for a doubling.
LEVELS = 64
#: Distinct chunks that a task counts before it hands them on.
COUNTED = 1 << 18
#: Characters up to which a chunk is segmented by a list of its pairs; longer ones take a heap.
SHORT = 24
#: Short chunks that are segmented together, and chunks of texts that are looked up together.
TOGETHER = 1 << 12
LOOKED_UP = 1 << 16
#: Chunks found in the broadcast table that a worker keeps, with their ids and without, so that it looks them up once.
KEPT = 1 << 17
#: Rows of an Arrow batch that are Python strings at once.
ROWS_AT_ONCE = 512

# The kinds of piece in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2

_CHUNK = re.compile(r" *[^ ]+| +")
_CHUNK_OF_LINES = re.compile(r"\n| *[^ \n]+| +")


# Every byte that is no part of a character becomes a character of its own.
codecs.register_error("glyphlake-each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def _fields(data: bytes):
    """``(number, value)`` of every field of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, content: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(content):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        # Field 3 of the trainer is the kind of model, 24 whether the marker ends a word, 35 whether bytes stand for unknown
        # characters; of the normaliser 2 is the rewriting table, 3, 4 and 5 are the blank added in front, the removal of further blanks
        # and the marker for blanks, all true unless given.
        rewrites = normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1)
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0) or trainer.get(24, 0) or rewrites:
            raise ValueError("only BPE models with byte pieces and a marker in front that leave texts as they are")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("pieces defined by the user or unused are not handled")
        if any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds) if k == NORMAL):
            raise ValueError("a piece reaches over the start of a word")
        # Names of the begin and end pieces unless the trainer gives others.
        self.begin = self.pieces.index(trainer.get(46, b"<s>").decode())
        self.end = self.pieces.index(trainer.get(47, b"</s>").decode())
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.costs = {p: -self.scores[i] for p, i in self.ids.items()}
        # What two pieces never share is segmented apart: neighbours that are in no piece together, the marker written as a blank.
        self.joined = {pair for p in self.ids for pair in map("".join, pairwise(p.replace(MARK, " ")))}
        self.cuts_lines = not any("\n" in pair for pair in self.joined)
        # Packed ids: as wide as needed; the number after the last piece is a hole.
        self.hole = len(self.pieces)
        self.code = "H" if self.hole < 1 << 16 else "I"
        byte_of = {i: int(p[1:-1], 16) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_ids = [i for i, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.bytes_of = [
            bytes([byte_of[i]]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, k) in enumerate(zip(self.pieces, self.kinds))
        ]

    def segment(self, chunk: str) -> list[int]:
        """Ids of one chunk, blanks in it written as they are: the pair of the best score is merged first, the left one of equals."""
        text = chunk.replace(" ", MARK)
        return self._ids_of(self._merged(text) if len(text) <= SHORT else self._merged_by_heap(text))

    def _ids_of(self, parts: list[str]) -> list[int]:
        found: list[int] = []
        for part in parts:
            piece = self.ids.get(part)
            found.extend([piece] if piece is not None else [self.byte_ids[b] for b in part.encode()])
        return found

    def cut_ends(self, chunks: Iterable[str]) -> dict[str, tuple[str, str]]:
        """Those chunks whose last character is in no piece with the one before, each with what stands before it and the character."""
        joined = self.joined
        return {c: (c[:-1], c[-1]) for c in chunks if c[-2:] not in joined and len(c) > 1}

    def cut_apart(self, texts: set[str]) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """The distinct chunks that ``texts`` consist of when their ends are cut, and those that are cut."""
        ends = self.cut_ends(texts)
        return list((texts - ends.keys()).union(chain.from_iterable(ends.values()))), ends

    def segment_all(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of every chunk, as ``segment`` gives them; short chunks are merged many at a time."""
        packed: list[bytes | None] = [None] * len(chunks)
        texts = [c.replace(" ", MARK) for c in chunks]
        short = [i for i, t in enumerate(texts) if len(t) <= SHORT]
        for low in range(0, len(short), TOGETHER):
            places = short[low : low + TOGETHER]
            for place, ids in zip(places, self._merged_together([texts[i] for i in places])):
                packed[place] = ids
        return [self.pack(self.segment(c)) if ids is None else ids for c, ids in zip(chunks, packed)]

    def prepare(self) -> None:
        """Make the arrays that ``segment_all`` needs, before the model is sent to the workers."""
        _ = self._characters, self._pairs

    @cached_property
    def _characters(self) -> np.ndarray:
        """The piece of every character; those without one have the number after the last piece, which is in no pair."""
        pieces = np.full(0x110000, self.hole, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                pieces[ord(piece)] = i
        return pieces

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs of pieces that make a piece, the rank of its score from the best on, and the piece; the last one is none."""
        found = {}
        for piece, made in self.ids.items():
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    found[left * (self.hole + 1) + right] = made
        keys = np.array([*sorted(found), np.iinfo(np.int64).max])
        made = np.array([*(found[k] for k in keys[:-1].tolist()), self.hole])
        ranks = np.unique([-s for s in self.scores] + [np.inf], return_inverse=True)[1]
        return keys, ranks[made], made

    def _merged_together(self, texts: list[str]) -> list[bytes | None]:
        """The packed ids of every text, all merging their best pair at once; None for one with a character that is no piece."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1)  # where a text ends a symbol stands that is in no pair; one stands before the first text too
        starts = ends - sizes
        symbols = np.full(ends[-1] + 1, self.hole)
        held = np.ones(len(symbols), bool)
        held[0] = held[ends] = False
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        symbols[held] = self._characters[codes]
        whole = np.logical_and.reduceat(~held | (symbols != self.hole), starts)
        pairs, ranks, pieces = self._pairs
        none = ranks[-1] << 32
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        offers, made = np.full(len(symbols), none), np.full(len(symbols), self.hole)

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            keys = symbols[left] * (self.hole + 1) + symbols[right]
            at = np.searchsorted(pairs, keys)
            at[pairs[at] != keys] = len(pairs) - 1
            # The rank comes first and then the place, so that the left one of equals is the least.
            offers[left], made[left] = ranks[at] << 32 | left, pieces[at]

        first = np.flatnonzero(held)
        offer(first, first + 1)
        while True:
            best = np.minimum.reduceat(offers, starts)
            best = best[best < none]
            if not len(best):
                break
            left = best & 0xFFFFFFFF
            right = after[left]
            symbols[left], offers[right], held[right] = made[left], np.iinfo(np.int64).max, False
            after[left] = following = after[right]
            before[following] = left
            offer(left, following)
            offer(before[left], left)
        ids = symbols[held].astype(self.code)
        stops = np.cumsum(np.add.reduceat(held, starts, dtype=np.int64)) * ids.itemsize
        data, low = ids.tobytes(), 0
        packed: list[bytes | None] = []
        for good, stop in zip(whole.tolist(), stops.tolist()):
            packed.append(data[low:stop] if good else None)
            low = stop
        return packed

    def _merged(self, text: str) -> list[str]:
        parts, cost, none = list(text), self.costs.get, float("inf")
        offers = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while offers and (best := min(offers)) < none:
            i = offers.index(best)
            parts[i] += parts.pop(i + 1)
            del offers[i]
            if i:
                offers[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(offers):
                offers[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _merged_by_heap(self, text: str) -> list[str]:
        n = len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is part of another
        heap: list[tuple[float, int, int]] = []
        ids, scores = self.ids, self.scores

        def offer(left: int, right: int) -> None:
            piece = ids.get(text[left : end[right]])
            if piece is not None:
                heapq.heappush(heap, (-scores[piece], left, end[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, stop = heapq.heappop(heap)
            right = after[left]
            # An offer is out of date when one of its symbols has grown or is gone.
            if not end[left] or right >= n or end[right] != stop:
                continue
            end[left], end[right] = stop, 0
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                offer(left, following)
            if before[left] >= 0:
                offer(before[left], left)
        found: list[str] = []
        i = 0
        while i < n:
            found.append(text[i : end[i]])
            i = after[i]
        return found

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.code)

    def begin_to_end(self, ids: np.ndarray, fillings: list[bytes] | None) -> np.ndarray:
        """The ids of a text between begin and end, its holes filled in order with packed ids."""
        parts, low = [np.array([self.begin], np.int32)], 0
        if fillings:
            for at, filling in zip(np.flatnonzero(ids == self.hole).tolist(), fillings):
                parts += [ids[low:at], self.unpack(filling)]
                low = at + 1
        return np.concatenate([*parts, ids[low:], np.array([self.end], np.int32)]).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for, without control pieces and the blank in front."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        text = data.decode("utf-8", "glyphlake-each-byte")
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        added = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK)
        return text[1:] if added else text


def chunks_of(text: str | None, lines: bool = False) -> list[str]:
    """The chunks of a text, with ``lines`` cut around line ends too; all together are the text with a blank in front. An empty text has
    none."""
    if not text:
        return []
    text = " " + text.replace(MARK, " ")
    # Where no blanks follow each other every blank starts a chunk, which is quicker to split than to match.
    if "  " in text or "\0" in text:
        return (_CHUNK_OF_LINES if lines else _CHUNK).findall(text)
    text = text.replace(" ", "\0 ")
    return list(filter(None, text.replace("\n", "\0\n\0").split("\0"))) if lines else text.split("\0")[1:]


def _grouped(texts: pa.Array, lines: bool, copies: bool = True) -> Iterator[list[list[str]]]:
    """The chunks of every text, as many texts together as have about ``LOOKED_UP`` chunks; without ``copies`` a text near an equal
    one has none."""
    rows, held = [], 0
    for low in range(0, len(texts), ROWS_AT_ONCE):
        seen = {None}
        for text in texts.slice(low, ROWS_AT_ONCE).to_pylist():
            rows.append(chunks_of(text, lines) if copies or text not in seen else [])
            seen.add(text)
            held += len(rows[-1])
            if held >= LOOKED_UP:
                yield rows
                rows, held = [], 0
    yield rows


def _hashes(chunks: list[str]) -> np.ndarray:
    """The hashes of chunks as Spark's ``xxhash64`` gives them, unsigned."""
    return np.fromiter((xxhash.xxh64_intdigest(c.encode(), 42) for c in chunks), np.uint64, len(chunks))


class _Known:
    """Packed ids of the frequent chunks by their hashes, and the set of repeated ones beyond them."""

    def __init__(self, hashes: np.ndarray, ids: pa.Array, repeated: np.ndarray, bits: int, hash_bits: int):
        order = np.argsort(hashes)
        # One more than there are: a hash after the last one finds it and is no match.
        self.hashes = np.append(hashes[order], np.uint64(0))
        ids = ids.take(pa.array(order))
        self.ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False))).astype(np.int32)
        self.data = b"".join(ids.to_pylist())
        self.repeated, self.bits, self.hash_bits = repeated, bits, hash_bits
        # Of a worker: packed ids of chunks whose ends are not cut yet, and such chunks that are not left open; ``KEPT`` at most from the table.
        self.kept: dict[str, bytes] = {}
        self.closed: set[str] = set()

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where hashes are in the table, -1 for those that are not."""
        at = np.searchsorted(self.hashes[:-1], hashes)
        return np.where((at < len(self.hashes) - 1) & (self.hashes[at] == hashes), at, -1)

    def found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The place of every chunk in the table, -1 for others, and which of the others may be repeated."""
        hashes = _hashes(chunks)
        at = self.places(hashes >> np.uint64(64 - self.hash_bits))
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.repeated[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)
        return at, (at < 0) & held.astype(bool)

    def packed(self, rows: list[list[str]], model: PieceModel) -> list[bytes]:
        """Packed ids of rows of chunks whose ends are not cut yet: from the table, or segmented here if they occur nowhere else; a hole
        for one that may be repeated."""
        # One look for every chunk; what a worker has not kept is looked up together.
        flat = list(chain.from_iterable(rows))
        ids = list(map(self.kept.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        texts = {flat[i] for i in missing}
        chunks, ends = model.cut_apart(texts)
        at, asked = self.found(chunks)
        known = dict.fromkeys(chunks, model.pack([model.hole]))
        often = np.flatnonzero(at >= 0)
        for i, low, stop in zip(often.tolist(), self.ends[at[often]].tolist(), self.ends[at[often] + 1].tolist()):
            known[chunks[i]] = self.data[low:stop]
        single = [chunks[i] for i in np.flatnonzero((at < 0) & ~asked).tolist()]
        known.update(zip(single, model.segment_all(single)))
        # What stands before an end may be a text that is cut itself, so all are put together before any takes its place.
        known.update([(text, known[stem] + known[last]) for text, (stem, last) in ends.items()])
        for i in missing:
            ids[i] = known[flat[i]]
        if len(self.kept) + len(texts) <= KEPT:
            self.kept.update((text, known[text]) for text in texts - self._passing(texts, chunks, ends, at))
        stops = list(accumulate(map(len, rows)))
        return [b"".join(ids[low:stop]) for low, stop in zip([0, *stops], stops)]

    def left_open(self, rows: list[list[str]], model: PieceModel) -> list[list[str]]:
        """The chunks of rows for which ``packed`` leaves holes, in order."""
        rows = [list(filterfalse(self.closed.__contains__, row)) for row in rows]
        texts = set(chain.from_iterable(rows))
        chunks, ends = model.cut_apart(texts)
        at, asked = self.found(chunks)
        wanted = {chunks[i] for i in np.flatnonzero(asked).tolist()}
        opened = {text: [text] for text in wanted & texts if text not in ends}
        opened.update([(text, [c for c in parts if c in wanted]) for text, parts in ends.items() if not wanted.isdisjoint(parts)])
        if len(self.closed) + len(texts) <= KEPT:
            self.closed |= texts - self._passing(texts, chunks, ends, at)
        return [list(chain.from_iterable(map(opened.__getitem__, filter(opened.__contains__, row)))) for row in rows]

    def _passing(self, texts: set[str], chunks: list[str], ends: dict[str, tuple[str, str]], at: np.ndarray) -> set[str]:
        """Those of ``texts`` that are not all from the table and so hardly met again."""
        others = {chunks[i] for i in np.flatnonzero(at < 0).tolist()}
        return (others & texts).union(text for text, parts in ends.items() if not others.isdisjoint(parts))


class Pieces:
    """``Pieces(spark, path)`` encodes tables and decodes columns by a model file, which is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, path: str, frequent: int = FREQUENT, frequent_bytes: int = FREQUENT_BYTES, bits: int = SET_BITS, hash_bits: int = 64):
        with open(path, "rb") as file:
            self.model = PieceModel(file.read())
        self.spark, self.frequent, self.frequent_bytes, self.bits, self.hash_bits = spark, frequent, frequent_bytes, bits, hash_bits
        self.model.prepare()
        self.shared = spark.sparkContext.broadcast(self.model)

    def chunk_counts(self, texts: DataFrame) -> DataFrame:
        """``(chunk, n)``: every distinct chunk of the column ``text`` and how often it occurs."""

        shared = self.shared

        def count(batches):
            model, counts = shared.value, Counter()

            def told():
                # All are taken out before any is added: what stands before an end may be a text that is cut itself.
                for n, parts in [(counts.pop(text), parts) for text, parts in model.cut_ends(counts).items()]:
                    for chunk in parts:
                        counts[chunk] += n
                return pa.record_batch({"chunk": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

            for batch in batches:
                for rows in _grouped(batch.column(0), model.cuts_lines):
                    counts.update(chain.from_iterable(rows))
                    if len(counts) >= COUNTED:
                        yield told()
                        counts.clear()
            yield told()

        return texts.select("text").mapInArrow(count, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))

    def _segmented(self, chunks: DataFrame, known=None) -> DataFrame:
        """``(chunk, packed ids)``, each chunk segmented once; single chunks that the table ``known`` does not ask for are left out."""
        shared = self.shared

        def segment(batches):
            model = shared.value
            for batch in batches:
                names = batch.column(0).to_pylist()
                if known is not None:
                    wanted = (batch.column(1).to_numpy() > 1) | known.value.found(names)[1]
                    names = [names[i] for i in np.flatnonzero(wanted).tolist()]
                yield pa.record_batch({"chunk": pa.array(names, pa.string()), "ids": pa.array(model.segment_all(names), pa.binary())})

        return chunks.select("chunk", "n").mapInArrow(segment, "chunk string, ids binary")

    def encoded(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """``docs`` with the ids of the whole text, begin and end ids included, in the column ``out``."""
        spark, shared, bits = self.spark, self.shared, self.bits
        scratch = Scratch(spark)
        counts = scratch.stored(self.chunk_counts(docs.select(F.col(f"`{text}`").alias("text"))))
        level = F.floor(F.log2("n") * LEVELS)
        short = F.octet_length("chunk") <= self.frequent_bytes
        least, room = None, self.frequent
        # At most 64 * LEVELS rows: from the most frequent on, as many levels as have room.
        for row in sorted(counts.where(short).groupBy(level.alias("level")).count().collect(), reverse=True):
            room -= row["count"]
            if room < 0:
                break
            least = row["level"]
        often = short & (level >= least) if least is not None else F.lit(False)
        hashed = F.shiftrightunsigned(F.xxhash64("chunk"), 64 - self.hash_bits)
        most = self._segmented(counts.where(often)).select(hashed.alias("hash"), "ids").toArrow()
        hashes = most.column("hash").to_numpy().view(np.uint64)
        clashes = self._clashes(hashes, counts.where(~often).select(hashed.alias("hash")))
        shares = hashed.isin(clashes.view(np.int64).tolist()) if len(clashes) else F.lit(False)
        rare = counts.where(~often | shares)
        slot = F.shiftrightunsigned(F.xxhash64("chunk"), 64 - bits)
        bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
        words = rare.where((F.col("n") > 1) | shares).select(slot.alias("slot")).select(F.shiftright("slot", 6).alias("word"), bit.alias("held"))
        kept = ~np.isin(hashes, clashes)
        ids = most.column("ids").combine_chunks().filter(pa.array(kept))
        known = spark.sparkContext.broadcast(_Known(hashes[kept], ids, united_bits(words, bits), bits, self.hash_bits))
        # A chunk in the broadcast table is never asked for, so the keys of the join below are rare ones.
        answers = stored(self._segmented(rare, known))
        scratch.clear()

        @F.arrow_udf("binary")
        def partly(texts: pa.Array) -> pa.Array:
            packed_ids, model = [], shared.value
            for rows in _grouped(texts, model.cuts_lines):
                packed_ids.extend(zlib.compress(ids, 1) for ids in known.value.packed(rows, model))
            return pa.array(packed_ids, pa.binary())

        @F.arrow_udf("array<string>")
        def left_open(texts: pa.Array) -> pa.Array:
            found, model = [], shared.value
            for rows in _grouped(texts, model.cuts_lines, copies=False):
                found.extend(known.value.left_open(rows, model))
            return pa.array(found, pa.list_(pa.string()))

        @F.arrow_udf("array<int>")
        def filled(packed_ids: pa.Array, fillings: pa.Array) -> pa.Array:
            model = shared.value
            rows = [model.begin_to_end(model.unpack(zlib.decompress(p)), f) for p, f in zip(packed_ids.to_pylist(), fillings.to_pylist())]
            ends = np.cumsum([0, *map(len, rows)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))

        # Documents are named by their texts, so copies close by ask once and the same ids fill all of them.
        named = [F.col(f"`{c}`") for c in docs.columns if c != out]
        said = F.col(f"`{text}`")
        key = F.substring(F.unhex(F.sha2(F.coalesce(said, F.lit("")).cast("binary"), 256)), 1, 16)
        # The key is made before a text is taken apart: beside the generator it would be made for every chunk again.
        opened = docs.select(key.alias("key"), left_open.asNondeterministic()(said).alias("open"))
        asked = opened.select("key", F.posexplode("open").alias("at", "chunk"))
        # Few rows of a text are in one task, so they are sent as they are and gathered where they meet.
        answered = asked.join(answers, "chunk").select("key", "at", "ids").repartition("key").groupBy("key")
        fillings = answered.agg(F.collect_set(F.struct("at", "ids")).alias("set"))
        fillings = fillings.select(F.col("key").alias("__asked"), F.transform(F.sort_array("set"), lambda s: s["ids"]).alias("__filling"))
        partial = docs.select(*named, key.alias("__key"), partly.asNondeterministic()(said).alias("__ids"))
        met = partial.join(fillings, F.col("__key") == F.col("__asked"), "left")
        return met.select(*named, filled.asNondeterministic()("__ids", "__filling").alias(out))

    def _clashes(self, hashes: np.ndarray, others: DataFrame) -> np.ndarray:
        """Those of the table's ``hashes`` that two chunks have: both in the table, or one of them among ``others``."""
        held, times = np.unique(hashes, return_counts=True)
        table = self.spark.sparkContext.broadcast(held)

        @F.arrow_udf("boolean")
        def taken(found: pa.Array) -> pa.Array:
            asked = found.to_numpy().view(np.uint64)
            at = np.searchsorted(table.value[:-1], asked)
            return pa.array(table.value[at] == asked)

        if not len(held):
            return held
        shared = others.where(taken("hash")).distinct().toArrow().column("hash").to_numpy().view(np.uint64)
        table.unpersist()
        return np.union1d(held[times > 1], shared)

    def decode(self, ids: Column | str) -> Column:
        """The text of a column of ids."""
        shared = self.shared

        @F.arrow_udf("string")
        def decoded(rows: pa.Array) -> pa.Array:
            model, flat, ends = shared.value, rows.values.to_numpy(), rows.offsets.to_numpy()
            return pa.array([model.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

        return decoded.asNondeterministic()(ids)


def packed(ids: Column | str) -> Column:
    """Ids as the bytes of little-endian unsigned 32-bit numbers."""

    @F.arrow_udf("binary")
    def pack(rows: pa.Array) -> pa.Array:
        flat, ends = rows.values.to_numpy().astype("<u4"), rows.offsets.to_numpy()
        return pa.array([flat[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())

    return pack(ids)
