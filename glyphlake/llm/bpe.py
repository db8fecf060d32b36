"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the splitting pattern is merged on its own. Every byte position that starts a token has a key: the rank of
the pair it forms with the next token, then the position. A segment tree over the positions (16 to a leaf) holds the least
key of every node, so the lowest rank, the leftmost among equals, stands at its root. A merge takes the root, joins the two
tokens and updates the keys of at most three live neighbours, each in logarithmic time: a match of a million bytes costs
n log n.

Defined cases: a null text counts as empty and has no ids; null ids decode to nothing; repeated matches are looked up in
a bounded cache of each Python worker; texts are encoded whole. Rows, other columns and their order stay untouched: both
operators are column expressions. Special tokens are never formed.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CACHED_WORDS = 1 << 19
CACHED_MATCHES = 1 << 17
CACHED_CHARS = 48
_NONE = 1 << 62
_POSITION_BITS = 32
_LEAF_BITS = 4  # a leaf of the tree covers so many byte positions, as a power of two
_POSITION = (1 << _POSITION_BITS) - 1


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and rank of every line of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one match of the splitting pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    end = list(range(1, n + 1))  # where the token starting at i ends, and so where the next one starts
    before = list(range(-1, n))  # where the token before the one starting at i starts
    find = ranks.get
    keys = [_NONE] * n
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            keys[i] = rank << _POSITION_BITS | i
    size = 1 << ((n - 1) >> _LEAF_BITS).bit_length()
    tree = [_NONE] * size + [min(keys[i << _LEAF_BITS : (i + 1) << _LEAF_BITS], default=_NONE) for i in range(size)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while (least := tree[1]) != _NONE:
        i = least & _POSITION
        gone = end[i]
        stop = end[i] = end[gone]
        keys[gone] = keys[i] = _NONE
        if stop < n:
            before[stop] = i
            rank = find(piece[i : end[stop]])
            if rank is not None:
                keys[i] = rank << _POSITION_BITS | i
        j = before[i]
        if j >= 0:
            rank = find(piece[j:stop])
            keys[j] = _NONE if rank is None else rank << _POSITION_BITS | j
        if size == 1:
            tree[1] = min(keys)
            continue
        for leaf in {i >> _LEAF_BITS, gone >> _LEAF_BITS, max(j, 0) >> _LEAF_BITS}:
            node, key = size + leaf, min(keys[leaf << _LEAF_BITS : (leaf + 1) << _LEAF_BITS])
            while tree[node] != key:
                tree[node] = key
                if node == 1:
                    break
                key = min(key, tree[node ^ 1])
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(ids)


class Tokenizer:
    """Ranks and splitting pattern in a Python worker; ids are given as the bytes of 32-bit numbers."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.ranks = ranks = parse_ranks(content)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.split = split = regex.compile(pattern).findall
        self.parted = regex.compile(r"\s ").search

        def ids(piece: str) -> bytes:
            return array("i", merge(piece.encode(), ranks)).tobytes()

        known = lru_cache(CACHED_MATCHES)(ids)

        def encode(text: str) -> bytes:
            return b"".join([known(p) if len(p) <= CACHED_CHARS else ids(p) for p in split(text)])

        @lru_cache(CACHED_WORDS)
        def spaced(word: str) -> bytes:
            if word.isalpha() and word.isascii():  # one match, as letters follow the space
                return ids(" " + word)
            return encode(" " + word)

        self.whole, self.spaced = encode, spaced

    def encode(self, text: str) -> bytes:
        """No match goes on from a character to a space after it. So where every space follows such a character, the
        text falls apart there, and words met before need no splitting."""
        if self.parted(text):
            return self.whole(text)
        first, *words = text.split(" ")
        if max(map(len, words), default=0) > CACHED_CHARS:
            rest = [self.spaced(w) if len(w) <= CACHED_CHARS else self.whole(" " + w) for w in words]
        else:
            rest = map(self.spaced, words)
        return self.whole(first) + b"".join(rest)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_tokenizers: dict[tuple[int, str], Tokenizer] = {}


def _tokenizer(content: Broadcast, pattern: str) -> Tokenizer:
    key = (content.value["id"], pattern)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(content.value["content"], pattern)
    return _tokenizers[key]


class Bpe:
    """``Bpe(spark, path, pattern)`` offers ``encode`` and ``decode`` as column functions.

    The rank file (some hundred kilobytes) is read on the driver and broadcast.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            content = file.read()
        context: SparkContext = spark.sparkContext
        shared = context.broadcast({"id": hash(content), "content": content})

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            tokenizer = _tokenizer(shared, pattern)
            found = [tokenizer.encode(t) if t else b"" for t in texts.to_pylist()]
            ends = np.cumsum([0, *map(len, found)]) // 4
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

        @F.arrow_udf("binary")
        def decode(ids: pa.Array) -> pa.Array:
            tokenizer = _tokenizer(shared, pattern)
            flat, ends = ids.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
            parts = (tokenizer.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:]))
            return pa.array(parts, pa.binary())

        # So that Spark never runs an encoding twice because its ids are used twice.
        self._encode, self._decode = encode.asNondeterministic(), decode.asNondeterministic()

    def encode(self, text: Column | str) -> Column:
        """Ids of a text as ``array<int>``."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """The bytes that ids stand for."""
        return self._decode(ids)
