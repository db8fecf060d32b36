"""Sparse (token weight) search.

``sparse_page`` answers a bounded query table the way dense search does: the query weights are
broadcast, a task lays its own documents out as postings in blocks with upper bounds, scores only the
blocks that can still reach a query's best rows, counts the matches by bit sets and hands out the best
rows and the count, so a word that half the corpus holds never becomes rows to shuffle. ``sparse_search`` is
the relational form, an equi-join on tokens, for query tables of any size and for full scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.functions.vectors import rounded
from glyphlake.operators.joins import BROADCAST_ROWS, lookup_join
from glyphlake.operators.knn import SCORE_DECIMALS, BestRows, _ids, same_group
from glyphlake.operators.ranking import rank_page, total_hits
from glyphlake.schema import PAGE_SIZE
from glyphlake.session import cut_lineage

MAX_BROADCAST_QUERIES = 8192
#: Documents that share the upper bounds of a token, and documents whose entries are laid out at once.
BLOCK_ROWS = 16
TILE_ROWS = 2048


def postings(df: DataFrame, sparse_col: str, id_col: str = "doc_id") -> DataFrame:
    """One row per (document, token) of a MAP<token, weight> column; null maps give none."""
    return df.select(id_col, F.explode(sparse_col).alias("token", "weight"))


def sparse_search(
    index_postings: DataFrame,
    query_postings: DataFrame,
    group_col: str | None = None,
    max_query_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``query_id, doc_id, score``: sum of weight products over shared tokens.

    ``query_postings`` is ``query_id, token, weight``. Only documents sharing a token appear. Small
    query tables are broadcast, large ones repeated over salts that split each token's postings;
    either way the sums are combined before the shuffle. ``group_col`` of both sides must agree,
    null in a query meaning any.
    """
    asked = query_postings.select(
        "query_id", "token", F.col("weight").alias("query_weight"), *([F.col(group_col).alias("__wanted")] if group_col else [])
    )
    pairs = lookup_join(index_postings, asked, "token", spread="doc_id", max_rows=max_query_rows)
    if group_col:
        pairs = pairs.where(F.col("__wanted").isNull() | (F.col("__wanted") == F.col(group_col)))
    score = rounded(F.sum(F.col("weight") * F.col("query_weight")), SCORE_DECIMALS)
    return pairs.groupBy("query_id", "doc_id").agg(score.alias("score"))


class Postings:
    """The entries of a batch of documents by token, in blocks of documents with the largest weight of each token in a block.

    Documents with many entries come first, so that long ones, which hold every token with a high weight, share blocks.
    """

    def __init__(self, rows: np.ndarray, places: np.ndarray, weights: np.ndarray, n_rows: int):
        held = np.bincount(rows, minlength=n_rows)
        self.order = np.argsort(-held, kind="stable")  # place in the blocks to row of the batch
        at = np.empty(n_rows, np.int64)
        at[self.order] = np.arange(n_rows)
        self.tokens, token = np.unique(places, return_inverse=True)
        self.n_rows, self.blocks = n_rows, -(-n_rows // BLOCK_ROWS)
        by = np.lexsort((at[rows], token))
        self.row, self.weight = at[rows][by], weights[by]
        cell = token[by] * self.blocks + self.row // BLOCK_ROWS
        self.start = np.searchsorted(cell, np.arange(len(self.tokens) * self.blocks + 1))
        most = np.zeros(len(self.tokens) * self.blocks)
        np.maximum.at(most, cell, np.abs(self.weight))
        self.most = most.reshape(len(self.tokens), self.blocks)
        self.bits = np.zeros((len(self.tokens), -(-n_rows // 8)), np.uint8)
        np.bitwise_or.at(self.bits, (token[by], self.row >> 3), np.uint8(128) >> (self.row & 7).astype(np.uint8))

    def known(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a query that some document of the batch holds, by their number here."""
        at = np.searchsorted(self.tokens, places)
        at[at == len(self.tokens)] = 0
        found = self.tokens[at] == places if len(self.tokens) else np.zeros(len(places), bool)
        return at[found], weights[found]

    def sharing(self, tokens: np.ndarray) -> np.ndarray:
        """Whether the documents, in the order of the blocks, hold any of the tokens."""
        return np.unpackbits(np.bitwise_or.reduce(self.bits[tokens], axis=0), count=self.n_rows).astype(bool)

    def bounds(self, tokens: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a block scores higher than this."""
        return np.abs(weights) @ self.most[tokens]

    def scores(self, tokens: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores of the documents of the given blocks, ``BLOCK_ROWS`` to a block."""
        cells = (tokens[:, None] * self.blocks + blocks[None, :]).ravel()
        low, count = self.start[cells], self.start[cells + 1] - self.start[cells]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        place = np.repeat(np.tile(np.arange(len(blocks)), len(tokens)), count) * BLOCK_ROWS + self.row[entry] % BLOCK_ROWS
        products = self.weight[entry] * np.repeat(np.repeat(weights, len(blocks)), count)
        return np.round(np.bincount(place, products, minlength=len(blocks) * BLOCK_ROWS), SCORE_DECIMALS)


class SparseBlock:
    """Query weights of a task, and the best matches and match counts of each query so far."""

    def __init__(self, frame: pd.DataFrame, size: int):
        codes, self.query_id = pd.factorize(frame["query_id"])
        names, places = np.unique(frame["token"].to_numpy().astype(str), return_inverse=True)
        self.place = {name: i for i, name in enumerate(names.tolist())}
        weights, self.size = frame["weight"].to_numpy(dtype=np.float64), size
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(self.query_id)))[:-1]
        self.asked = list(zip(np.split(places[order], ends), np.split(weights[order], ends)))
        self.groups = None
        if "__group" in frame:
            firsts = frame.groupby(codes)["__group"].first(skipna=False) if len(frame) else frame["__group"]
            self.groups = firsts.to_numpy(dtype=object)

    def begin(self) -> None:
        """Start a task."""
        queries = len(self.query_id)
        self.best, self.matches, self.scored = BestRows(queries, self.size), np.zeros(queries, dtype=np.int64), 0

    def add(self, ident: np.ndarray, column: pa.Array, groups: np.ndarray | None) -> list[tuple[int, Postings]]:
        """Meet a batch of documents; returns the entries of its tiles and where each tile starts."""
        rows, places, weights = self._entries(column)
        tiles = []
        for start in range(0, len(ident), TILE_ROWS):
            stop = min(start + TILE_ROWS, len(ident))
            low, high = np.searchsorted(rows, [start, stop])
            postings = Postings(rows[low:high] - start, places[low:high], weights[low:high], stop - start)
            tiles.append((start, postings))
            if not len(postings.tokens):
                continue
            seen = None if groups is None else same_group(self.groups, groups[start:stop][postings.order])
            found: tuple[list, list, list] = ([], [], [])
            for query, asked in enumerate(self.asked):
                tokens, query_weights = postings.known(*asked)
                if not len(tokens):
                    continue
                hit = postings.sharing(tokens)
                if seen is not None:
                    hit &= seen[query]
                self.matches[query] += np.count_nonzero(hit)
                place, scores = self._best_of(postings, tokens, query_weights, hit, self.best.floor[query])
                for out, values in zip(found, (np.full(len(place), query), scores, ident[start + postings.order[place]])):
                    out.append(values)
            if found[0]:
                self.best.offer(*found)
        return tiles

    def _best_of(self, postings, tokens, weights, hit, floor):
        """Places and scores of the matches that can be among the best: blocks whose bound is below the worst of the best so
        far are never scored."""
        bounds = postings.bounds(tokens, weights) + 0.5 * 10.0**-SCORE_DECIMALS
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] >= floor]
        first = -(-self.size // BLOCK_ROWS)
        places, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        while len(order):
            blocks, order = order[:first], order[first:]
            place = (blocks[:, None] * BLOCK_ROWS + np.arange(BLOCK_ROWS)).ravel()
            score = postings.scores(tokens, weights, blocks)
            self.scored += len(place)
            keep = place < postings.n_rows
            keep[keep] = hit[place[keep]]
            keep &= score >= floor
            places.append(place[keep])
            scores.append(score[keep])
            if len(order):
                all_scores = np.concatenate(scores)
                if len(all_scores) >= self.size:
                    floor = max(floor, -np.partition(-all_scores, self.size - 1)[self.size - 1])
                    order = order[bounds[order] >= floor]
            first *= 2
        return np.concatenate(places), np.concatenate(scores)

    def pair_scores(self, tiles: list[tuple[int, Postings]], queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of (query, row of the batch) pairs; NaN where nothing is shared or the query is -1."""
        out = np.full(len(rows), np.nan)
        for start, postings in tiles:
            inside = (rows >= start) & (rows < start + postings.n_rows) & (queries >= 0)
            if not inside.any() or not len(postings.tokens):
                continue
            at = np.empty(postings.n_rows, np.int64)
            at[postings.order] = np.arange(postings.n_rows)
            for query in np.unique(queries[inside]).tolist():
                tokens, weights = postings.known(*self.asked[query])
                if not len(tokens):
                    continue
                mine = np.flatnonzero(inside & (queries == query))
                place = at[rows[mine] - start]
                blocks, which = np.unique(place // BLOCK_ROWS, return_inverse=True)
                scores = postings.scores(tokens, weights, blocks)[which * BLOCK_ROWS + place % BLOCK_ROWS]
                out[mine] = np.where(postings.sharing(tokens)[place], scores, np.nan)
        return out

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.begin()
        for batch in batches:
            if batch.num_rows:
                groups = batch.column(2).to_numpy(zero_copy_only=False).astype(object) if self.groups is not None else None
                self.add(_ids(batch.column(0)), batch.column(1), groups)
        best, some = self.best, np.flatnonzero(self.matches)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.query_id[np.r_[best.row, some]]),
                    pa.concat_arrays([pa.array(best.ident), pa.nulls(len(some), pa.array(best.ident).type)]),
                    pa.array(np.r_[best.score, np.zeros(len(some))]),
                    pa.array(np.r_[np.zeros(len(best.row), dtype=np.int64), self.matches[some]]),
                ],
                names=["query_id", "doc_id", "score", "matches"],
            )

    def _entries(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, token place and weight of the map entries whose token some query holds."""
        offsets = column.offsets.to_numpy()
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
        coded = column.keys.dictionary_encode()
        known = np.array([self.place.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        rows = np.repeat(np.arange(len(column)), lengths)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        entry = np.repeat(offsets[:-1] - offsets[0], lengths) + inside
        places = known[coded.indices.to_numpy(zero_copy_only=False)[entry]] if len(known) else np.array([], np.int64)
        keep = places >= 0
        weights = column.items.to_numpy(zero_copy_only=False).astype(np.float64)[entry]
        return rows[keep], places[keep], weights[keep]


def sparse_page(
    index: DataFrame,
    query_postings: DataFrame,
    sparse_col: str,
    size: int = PAGE_SIZE,
    group_col: str | None = None,
    max_query_rows: int = BROADCAST_ROWS,
    max_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """``query_id, doc_id, score, rank, total``: the best ``size`` matches and how many there are.

    ``index`` holds ``doc_id`` and the MAP column. Query tables beyond the bounds take the join.
    """
    extra = [group_col] if group_col else []
    asked = query_postings.select("query_id", "token", "weight", *extra)
    head = asked.limit(max_query_rows + 1).toPandas()
    if len(head) > max_query_rows or head["query_id"].nunique() > max_queries:
        terms = index.select("doc_id", *extra, F.explode(sparse_col).alias("token", "weight"))
        scored = sparse_search(terms, asked, group_col, max_query_rows)
        return rank_page(scored, size).join(total_hits(scored), "query_id")
    if group_col:
        head = head.rename(columns={group_col: "__group"})
    rows = index.where(F.col(sparse_col).isNotNull()).select("doc_id", sparse_col, *extra)
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("matches", T.LongType()),
        ]
    )
    block = index.sparkSession.sparkContext.broadcast(SparseBlock(head, size))
    # Best rows and counts come from one scan; they are few, so they are kept for both uses.
    found = cut_lineage(rows.mapInArrow(lambda batches: block.value.scan(batches), schema))
    totals = found.where(F.col("doc_id").isNull()).groupBy("query_id").agg(F.sum("matches").alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    top = found.where(F.col("doc_id").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    return top.select("query_id", "doc_id", "score", "rank").join(totals, "query_id")


def sparse_scores_of(
    index: DataFrame, candidates: DataFrame, query_postings: DataFrame, sparse_col: str, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``query_id, doc_id, score`` of the given (query, document) candidates that share a token."""
    wanted = candidates.select("query_id", "doc_id")
    maps = lookup_join(index.select("doc_id", sparse_col), wanted, "doc_id", spread="doc_id", max_rows=max_rows)
    terms = maps.select("query_id", "doc_id", F.explode(sparse_col).alias("token", "weight"))
    asked = query_postings.select("query_id", "token", F.col("weight").alias("query_weight"))
    score = rounded(F.sum(F.col("weight") * F.col("query_weight")), SCORE_DECIMALS)
    return terms.join(asked, ["query_id", "token"]).groupBy("query_id", "doc_id").agg(score.alias("score"))
