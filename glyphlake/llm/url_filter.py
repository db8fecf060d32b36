"""URL filters: longest rule, else naive Bayes over segmented host words and path tokens.

Concatenated names in hosts are split by unigram Viterbi: the dictionary are all words of the text of all pages with their
exact counts. It stays on the cluster: the substrings of every distinct host meet it in a join, and a host is split with
the words found in it. Words of more than ``LONGEST_WORD`` letters count in the total alone, since no label of a host name
is longer. Token counts of both classes come from all pages that
a rule decides; tokens are hashed to ``SLOTS`` numbers, so the model has a fixed size and drops no token.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is judged by the class shares;
among rules of equal length the first one listed wins; without decided pages of both classes, pages outside of the rules are
allowed; repeated rows are judged each on its own; long urls are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import stored

LONGEST_WORD = 63
SLOTS = 1 << 16
PARTS = r"[a-z]+|[0-9]+|[^\x00-\x7f]+"
SMOOTHING = 1.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule as ``struct<rule, verdict>``, null where none fits."""
    found = F.lit(None)
    # Later ones replace earlier ones: the shortest comes first, and of equally long ones the last listed.
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


# ---- word segmentation ---------------------------------------------------------------------


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(word, n)``: all words of all page texts."""
    shown = F.lower(F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(shown, F.lit(r"\b[a-z]+\b"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(host, found)``: every distinct host with an array of the words it holds and their counts.

    Substrings are made row by row, so that a long host needs no long array; a host without letters keeps a row.
    """
    part = hosts.select("host").distinct()
    part = part.select("host", F.explode_outer(F.array_distinct(F.regexp_extract_all("host", F.lit("[a-z]+"), F.lit(0)))).alias("part"))
    begun = part.select("host", "part", F.explode_outer(F.sequence(F.lit(1), F.length("part"))).alias("at"))
    longest = F.least(F.lit(LONGEST_WORD), F.length("part") - F.col("at") + 1)
    cut = begun.select("host", "part", "at", F.explode_outer(F.sequence(F.lit(1), longest)).alias("n"))
    held = cut.select("host", F.col("part").substr(F.col("at"), F.col("n")).alias("word")).distinct()
    # Merged by a shuffle: the dictionary is not gathered on the driver to be broadcast.
    met = held.join(counts.hint("merge"), "word", "left")
    known = F.when(F.col("n").isNotNull(), F.struct("word", "n"))
    return met.groupBy("host").agg(F.collect_list(known).alias("found"))


class Segmenter:
    """Most likely split of a name into words; ``words`` is the number of all, where ``counts`` has only some of them."""

    def __init__(self, counts: dict[str, int], words: int | None = None):
        total = (sum(counts.values()) if words is None else words) + 1
        self.cost = {w: log(total) - log(c) for w, c in counts.items()}
        # A word not in the dictionary is the less likely the longer it is.
        self.unknown = [log(total) + log(10) * n for n in range(LONGEST_WORD + 1)]

    def split(self, name: str) -> tuple[str, ...]:
        best, start = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = (
                (best[begin] + self.cost.get(name[begin:end], self.unknown[end - begin]), begin)
                for begin in range(max(0, end - LONGEST_WORD), end)
            )
            cost, begin = min(options)
            best.append(cost)
            start.append(begin)
        words, end = [], len(name)
        while end:
            words.append(name[start[end] : end])
            end = start[end]
        return tuple(reversed(words))

    def tokens(self, host: str, path: str) -> list[str]:
        """Host words, then path tokens; digits are told by their number only."""
        return self.host_tokens(host) + path_tokens(path)

    def host_tokens(self, host: str) -> list[str]:
        found = []
        for part in re.findall(PARTS, host):
            if part.isascii() and part.isalpha():
                found += ["h:" + w for w in self.split(part)]
            else:
                found.append(f"h:{len(part)}" if part.isdigit() else "h:" + part)
        return found


def path_tokens(path: str) -> list[str]:
    return [f"p:{len(part)}" if part.isdigit() else "p:" + part for part in re.findall(PARTS, path.lower())]


# ---- naive Bayes ---------------------------------------------------------------------------


def slot(token: str) -> int:
    return zlib.crc32(token.encode()) % SLOTS


class Bayes(NamedTuple):
    """Log odds of blocking: of a page without tokens, and added by every slot."""

    prior: float
    odds: np.ndarray


def bayes(pages: Counter, tokens: dict[tuple[str, int], int]) -> Bayes | None:
    """From pages of each verdict and token counts by (verdict, slot)."""
    if not pages["block"] or not pages["allow"]:
        return None
    counts = {v: np.full(SLOTS, SMOOTHING) for v in ("allow", "block")}
    for (verdict, place), n in tokens.items():
        counts[verdict][place] += n
    shares = {v: np.log(c) - np.log(c.sum()) for v, c in counts.items()}
    return Bayes(log(pages["block"]) - log(pages["allow"]), shares["block"] - shares["allow"])


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; score is the log odds of blocking, null for pages of a rule."""
    spark = pages.sparkSession
    counts = stored(word_counts(pages, html))
    words = counts.agg(F.sum("n")).first()[0] or 0

    def host_slots(hosts: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for host, words_found in zip(hosts.to_pylist(), found.to_pylist()):
            segmenter = Segmenter({w["word"]: w["n"] for w in words_found}, words)
            rows.append([slot(t) for t in segmenter.host_tokens(host)])
        return pa.array(rows, pa.list_(pa.int32()))

    def path_slots(paths: pa.Array) -> pa.Array:
        return pa.array([[slot(t) for t in path_tokens(p)] for p in paths.to_pylist()], pa.list_(pa.int32()))

    link = F.col(f"`{url}`")
    parsed = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(link).alias("host"), path_of(link).alias("path"))
    parsed = parsed.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    split = host_words(parsed, counts).select("host", F.arrow_udf(host_slots, "array<int>")("host", "found").alias("host_slots"))
    # Spark broadcasts a small table of hosts; a larger one is shuffled, and adaptive execution splits a busy host's pages.
    read = stored(
        parsed.join(stored(split), "host").select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given"),
            F.concat("host_slots", F.arrow_udf(path_slots, "array<int>")("path")).alias("slots"),
        )
    )
    decided = read.where(F.col("given").isNotNull())
    of_class = Counter({r["given"]: r["count"] for r in decided.groupBy("given").count().collect()})
    found = decided.select("given", F.explode("slots").alias("slot")).groupBy("given", "slot").count()
    model = bayes(of_class, {(r["given"], r["slot"]): r["count"] for r in found.collect()})
    if model is None:
        score = F.lit(-1.0)
    else:
        shared = spark.sparkContext.broadcast(model)

        def log_odds(slots: pa.Array) -> pa.Array:
            odds = shared.value.odds
            return pa.array([shared.value.prior + float(odds[s].sum()) if s else shared.value.prior for s in slots.to_pylist()])

        score = F.arrow_udf(log_odds, "double")("slots")
    judged = read.withColumn("score", score)
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("given", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("given").isNull(), F.col("score")).alias("score"),
    )
