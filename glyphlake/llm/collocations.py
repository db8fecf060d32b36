"""Frequent phrases that hang together, by partitioned mining.

The documents are dealt into ``SHARDS`` shards. A phrase with ``support`` occurrences in a language has at least its share of them in
one of the shards, so every shard is mined completely at the support lowered in proportion, level by level: first words and pairs, then
phrases whose first and last words passed the level before. Tasks count their blocks of a shard, Spark adds the counts up by phrase,
for every shard and for all. The locally frequent phrases of all shards are united; as a bit set of bounded size, which is broadcast,
they prune the next level. Whether a level counts a phrase depends on its words alone, never on the block, so the sums of a united
phrase over all shards are its exact counts, and no further pass has to find every phrase in every block again.

Words are numbered per block and phrases by the numbers of their words; between tasks the words themselves are the key, so that
counts never depend on hashes. Cuts, contained phrases and ranks are joins of the table of frequent phrases.

Defined cases: a null text is empty and a null language is ``und``; texts without a word, or with single words between marks, give
no phrase but count; a very long text is mined whole and makes its block larger; repeated rows count each time; equal scores rank
by count, then phrase in byte order; an empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import stored, united_bits

# Least count, words of the longest phrase, rows a language has, share in percent that makes a longer phrase stand for its parts.
SUPPORT = 30
LONGEST = 4
ROWS = 2000
CONTAINED = 80
SCALE = 2_000_000

#: Shards, each of many blocks: a fixed number, so that the support in a shard does not fall while the input grows.
SHARDS = 2
#: Words after which a task hands out what it has counted.
BLOCK_WORDS = 1 << 22
#: Bits of the set of candidates, as a power of two: 16 MB.
SET_BITS = 27
SEED = 13
_AT_ONCE = 1 << 18
#: Rows of phrases that a task hands out at once.
_ROWS_AT_ONCE = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)

# Marks that end a piece become line feeds, tabs blanks; a lone line feed then stands between pieces.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_TOKEN = re.compile(rb"[^ \n]+|\n")


class _Numbered(dict):
    """Words by number in the order they are met; number 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """Texts of one language with their words as numbers."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers = _Numbered({b"\n": 0})
        self.parts = [np.zeros(1, np.int32)]

    def add(self, text: bytes) -> int:
        """Take in a text; returns how many words and ends of pieces it has."""
        tokens = _TOKEN.findall(text.lower().translate(_PIECES))
        tokens.append(b"\n")
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens)))
        return len(tokens)

    def close(self) -> Block:
        """No more texts follow."""
        self.ids, self.parts = np.concatenate(self.parts), []
        self.words, self.numbers = pa.array(list(self.numbers), pa.binary()), _Numbered()
        return self

    @cached_property
    def hashes(self) -> np.ndarray:
        seed = _seed(self.lang)
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        """A hash of the phrase of ``length`` words at every position of ``at``, its language included."""
        value = self.hashes[self.ids[at]]
        for k in range(1, length):
            value = value * _STEP + self.hashes[self.ids[at + k]]
        return _mixed(value)

    def among(self, candidates: np.ndarray, bits: int, at: np.ndarray, length: int) -> np.ndarray:
        """Those positions of ``at`` whose phrase of ``length`` words is in the candidate set."""
        known = np.empty(len(at), bool)
        for i in range(0, len(at), _AT_ONCE):
            slots = (self.names(at[i : i + _AT_ONCE], length) >> np.uint64(64 - bits)).astype(np.int64)
            known[i : i + _AT_ONCE] = candidates[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)
        return at[known]

    def mined(self, candidates: np.ndarray, bits: int, length: int, known: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Parts of the phrases of ``length`` words whose parts of up to ``known`` words are all candidates, with their counts."""
        at = np.flatnonzero(self.ids).astype(np.int32)
        for n in range(1, length):
            at = _neighbours(self.among(candidates, bits, at, n) if n <= known else at)
        # Words are joined to numbered pairs, and a number with the word or pair that follows it makes a key of 64 bits.
        keys, columns = self.ids[at].astype(np.int64), []
        for k in range(1, length):
            if k > 1:
                held, keys = np.unique(keys, return_inverse=True)
                columns.append(held)
            keys = keys << 32 | self.ids[at + k]
        held, counts = np.unique(keys, return_counts=True)
        for i in range(0, len(held), _ROWS_AT_ONCE):
            yield self._phrases(held[i : i + _ROWS_AT_ONCE], columns, length), counts[i : i + _ROWS_AT_ONCE]

    def _phrases(self, keys: np.ndarray, columns: list[np.ndarray], length: int) -> pa.Array:
        words: list[pa.Array] = []
        for column in [*reversed(columns), None][: length - 1]:
            words.append(self.words.take(pa.array(keys & 0xFFFFFFFF)))
            keys = keys >> 32
            if column is not None:
                keys = column[keys]
        return pc.binary_join_element_wise(self.words.take(pa.array(keys)), *reversed(words), b" ")


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), SEED)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ value >> np.uint64(29)
    return value * _STEP


def _name(lang: Column | str, phrase: Column | str) -> Column:
    """The name of a phrase as ``Block.names`` gives it."""

    @F.arrow_udf("bigint")
    def name(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        step, values = int(_STEP), []
        for lang, phrase in zip(langs.to_pylist(), phrases.to_pylist()):
            value, seed = 0, _seed(lang)
            for word in phrase.split(b" "):
                value = (value * step + xxhash.xxh64_intdigest(word, seed)) & 0xFFFFFFFFFFFFFFFF
            values.append(value)
        return pa.array(_mixed(np.array(values, np.uint64)).view(np.int64))

    return name(lang, phrase)


def _neighbours(at: np.ndarray) -> np.ndarray:
    """The positions whose next position is in ``at`` too."""
    return at[:-1][at[1:] == at[:-1] + 1]


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[Block]:
    """The rows ``(lang, text)`` of a task as blocks of one language each, handed out before they hold many more words than
    ``block_words`` together."""
    open_blocks: dict[str, Block] = {}
    words = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if lang not in open_blocks:
                open_blocks[lang] = Block(lang)
            words += open_blocks[lang].add(text)
            if words >= block_words:
                while open_blocks:
                    yield open_blocks.popitem()[1].close()
                words = 0
    while open_blocks:
        yield open_blocks.popitem()[1].close()


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"),
    )


def phrase_counts(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    support: int = SUPPORT,
    longest: int = LONGEST,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    bits: int = SET_BITS,
) -> DataFrame:
    """``(lang, words, phrase, f)``: the phrases of a language with ``support`` occurrences, exactly counted, as a stored table.

    The row with 0 words and an empty phrase tells the number of all words of the language.
    """
    texts = _texts(docs, lang, text)
    candidates = np.zeros(1 << max(bits - 6, 0), np.uint64)
    least = -(-support // shards)
    found: list[DataFrame] = []
    # Words prune few pairs, so both are mined in one pass; then each level is pruned by the ones before.
    for lengths in [range(1, min(2, longest) + 1), *([n] for n in range(3, longest + 1))]:
        shared = texts.sparkSession.sparkContext.broadcast(candidates)

        def mine(batches: Iterator[pa.RecordBatch], lengths=lengths, shared=shared) -> Iterator[pa.RecordBatch]:
            # Any dealing will do: a frequent phrase and all its parts are frequent in some shard, whichever these are.
            shard = TaskContext.get().partitionId() % shards

            def told(block: Block, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
                langs, shard_of = pa.array([block.lang] * len(phrases), pa.string()), np.full(len(phrases), shard, np.int32)
                return pa.record_batch({"lang": langs, "phrase": phrases, "shard": shard_of, "n": counts.astype(np.int64)})

            for block in _blocks(batches, block_words):
                if lengths[0] == 1:
                    yield told(block, pa.array([b""], pa.binary()), np.array([np.count_nonzero(block.ids)]))
                for length in lengths:
                    for phrases, counts in block.mined(shared.value, bits, length, lengths[0] - 1):
                        yield told(block, phrases, counts)

        # One sum for every shard, all in one shuffle: the sum of them is the count, the greatest tells candidates.
        sums = [F.sum(F.when(F.col("shard") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(shards)]
        mined = texts.mapInArrow(mine, "lang string, phrase binary, shard int, n bigint").groupBy("lang", "phrase").agg(*sums)
        often = F.expr(" OR ".join(f"n{i} >= {least}" for i in range(shards)))
        f = F.expr(" + ".join(f"n{i}" for i in range(shards)))
        level = stored(mined.where(often | (F.octet_length("phrase") == 0)).select("lang", "phrase", f.alias("f")))
        found.append(level)
        if lengths[-1] == longest:
            break
        slot = F.shiftrightunsigned(_name("lang", "phrase"), 64 - bits)
        slots = level.where(F.octet_length("phrase") > 0).select(slot.alias("slot"))
        bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
        passed = united_bits(slots.select(F.shiftright("slot", 6).alias("word"), bit.alias("held")), bits)
        if not passed.any():
            break
        candidates = candidates | passed
    phrase = F.col("phrase").cast("string")
    words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
    united = reduce(DataFrame.union, found)
    return united.where((F.col("f") >= support) | (phrase == "")).select("lang", words.alias("words"), phrase.alias("phrase"), "f")


def _first(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def _rest(words: Column, k: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, k + 1, n - k), " ")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, words, phrase, a, l, r, score)`` of every counted phrase of two words or more, by its lowest-scoring cut."""
    parts = counts.where("words > 0").select(F.col("lang").alias("__lang"), F.col("phrase").alias("__part"), F.col("f").alias("__f"))
    cuts = (
        counts.where("words > 1")
        .withColumnRenamed("f", "a")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("w", F.split("phrase", " "))
        .withColumn("first", _first(F.col("w"), F.col("k")))
        .withColumn("rest", _rest(F.col("w"), F.col("k"), F.col("words")))
        .drop("w")
    )
    # Both parts of a frequent phrase are frequent, so they are found.
    for part, name in (("first", "l"), ("rest", "r")):
        met = cuts.join(parts, (F.col("lang") == F.col("__lang")) & (F.col(part) == F.col("__part")))
        cuts = met.withColumnRenamed("__f", name).drop("__lang", "__part", part)
    score = F.expr(f"(cast({SCALE} AS decimal(7, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "words", "phrase", "a").agg(lowest).select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_contained(phrases: DataFrame, contained: int = CONTAINED) -> DataFrame:
    """``phrases`` without those whose words lie inside a longer one that occurs nearly as often."""
    longer = phrases.where("words > 2").select("lang", "words", "a", F.split("phrase", " ").alias("w"))
    spans = longer.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("n") + 1))
    )
    inner = spans.select(F.col("lang").alias("__lang"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("__part"), "a")
    most = inner.groupBy("__lang", "__part").agg(F.max("a").alias("__most"))
    met = phrases.join(most, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__part")), "left")
    stands = F.expr(f"cast(100 AS decimal(3, 0)) * cast(__most AS decimal(19, 0)) >= cast({contained} AS decimal(3, 0)) * cast(a AS decimal(19, 0))")
    return met.where(~F.coalesce(stands, F.lit(False))).drop("__lang", "__part", "__most")


def collocations(docs: DataFrame, rows: int = ROWS, contained: int = CONTAINED, **mining) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``rows`` phrases of every language; ``mining`` as for ``phrase_counts``."""
    counts = phrase_counts(docs, **mining)
    kept = not_contained(stored(scored(counts)), contained)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows)
    totals = counts.where("words = 0").select(F.col("lang").alias("__lang"), F.col("f").alias("n"))  # one row a language
    met = best.join(totals, F.col("lang") == F.col("__lang"))
    return met.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
