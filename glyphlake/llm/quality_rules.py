"""Quality rules: a table of thresholds compiled into one projection of text measures.

Everything is a built-in expression: no user function, no shuffle, one pass over the text.

Defined cases: a null text counts as empty; an empty or blank text has no words, its measures are 0 and the base
rule rejects it (fewer than 20 words); texts of any length are measured whole; repeated rows are judged each on its
own; an empty table gives an empty result; a text is judged by stop words only where a
column of languages is named and tells one that has a list here; columns of the input that clash with an output column are replaced when
``keep_columns`` is set, all other columns pass unchanged.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import GAP_CHARS, words_of

# The symbols counted, the window of repeated words, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30

# Very common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the and of to in is that for it with as was on be at by this from or an are not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur "
    "el los las y del se por con una su para es al lo como más o pero sus"
).split()


class Rule(NamedTuple):
    """Reject a text when ``measure`` (a ratio of two measures) is below ``low`` or above ``high``."""

    name: str
    measure: str
    per: str
    low: float | None
    high: float | None
    least: int = 1  # judged only from so many units of ``per``
    langs: tuple[str, ...] | None = None  # judged only where the language is told and one of these


# Languages with stop words above.
STOP_WORD_LANGS = ("en", "de", "fr", "es")

# The table: limits are ratios; each leaves a wide margin to ordinary prose, whatever its length. Every use of a stop word
# counts, and only texts told to be in a language with a list are judged by it.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5, 4),
    Rule("stop_words", "n_stop_word_uses", "n_words", 0.005, None, 200, STOP_WORD_LANGS),
)

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STOP_COLUMNS = ("n_stop_words", "n_stop_word_uses")


def _covered(starts: Column) -> Column:
    """Positions covered by windows that start at the given ascending positions."""
    gaps = F.zip_with(
        F.slice(starts, 1, F.size(starts) - 1),
        F.slice(starts, 2, F.size(starts) - 1),
        lambda a, b: F.least(F.lit(WINDOW), b - a),
    )
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b))


def _joined(hashes: Column, apart: int) -> Column:
    """Hashes of windows twice as long: each hash with the one ``apart`` places on."""
    n = F.size(hashes) - apart
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + apart, n), lambda a, b: F.xxhash64(a, b))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of its text column: see ``BASE_COLUMNS``, also ``n_lines``, ``n_stop_words``
    (different ones) and ``n_stop_word_uses``.

    Word windows are compared by 64-bit hashes. Only a text with two equal windows pays for finding them.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    taken = {"__text", "__words", "__lines", "__windows", "__pairs", "__starts", *BASE_COLUMNS, "n_lines", *STOP_COLUMNS}
    df = df.drop(*(c for c in df.columns if c in taken and c != text))
    keep = [F.col(f"`{c}`") for c in df.columns]

    def names(*more: str) -> list[Column]:
        return [*keep, *(F.col(c) for c in more)]

    spoken = F.split(whole, "\n")
    step = df.select(*keep, words_of(F.col(f"`{text}`")).alias("__words"), spoken.alias("__all_lines"))
    # A line counts when it has a word: with every gap removed something is left.
    step = step.select(*names("__words"), F.filter("__all_lines", lambda x: F.btrim(x, F.lit(GAP_CHARS)) != "").alias("__lines"))
    n_words = F.size("__words")
    step = step.select(
        *names("__words", "__lines"),
        n_words.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_except(F.array(*map(F.lit, STOP_WORDS)), F.col("__words"))).alias("__unused_stop_words"),
        F.size(F.filter("__words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_word_uses"),
        F.when(n_words > WINDOW, F.transform("__words", lambda w: F.xxhash64(w))).alias("__windows"),
    )
    measured = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_word_uses", "__unused_stop_words")
    for apart in (1, 2, 4):  # windows of 2, 4 and 8 words
        step = step.select(*names(*measured), _joined(F.col("__windows"), apart).alias("__windows"))
    step = step.select(
        *names(*measured),
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(
                F.zip_with(
                    "__windows", F.sequence(F.lit(1), F.size("__windows")), lambda h, i: F.struct(h.alias("h"), i.alias("i"))
                )
            ),
        ).alias("__pairs"),
    )
    m = F.size("__pairs")
    following = F.zip_with(
        F.slice("__pairs", 1, m - 1),
        F.slice("__pairs", 2, m - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    step = step.select(
        *names(*measured),
        F.when(F.col("__pairs").isNotNull(), F.sort_array(F.array_distinct(F.flatten(following)))).alias("__starts"),
    )
    return step.select(
        *names(*(c for c in measured if c[0] != "_")),
        F.coalesce(_covered(F.col("__starts")), F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.lit(len(set(STOP_WORDS))) - F.col("__unused_stop_words")).cast("long").alias("n_stop_words"),
    )


def broken(rule: Rule, lang: str | None = None) -> Column:
    """True where a row breaks the rule; ``lang`` names the column of languages, if there is one."""
    per = F.lit(1) if rule.per == "one" else F.col(rule.per)
    ratio = F.col(rule.measure) / F.greatest(per, F.lit(1))
    bounds = [ratio < rule.low] if rule.low is not None else []
    bounds += [ratio > rule.high] if rule.high is not None else []
    found = (per >= rule.least) & reduce(operator.or_, bounds)
    if rule.langs is None:
        return found
    if lang is None:
        return F.lit(False)
    return found & F.coalesce(F.col(f"`{lang}`").isin(*rule.langs), F.lit(False))


def quality_rules(
    df: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    keep_columns: bool = True,
    lang: str | None = None,
) -> DataFrame:
    """Every row of ``df`` with its measures, ``base_failed``, ``broken_rules`` and ``kept``."""
    found = measures(df, text)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(broken(r, lang), F.lit(r.name)) for r in rules)))
    made = [*BASE_COLUMNS, "n_lines", *STOP_COLUMNS]
    own = [c for c in df.columns if c not in {*made, "base_failed", "broken_rules", "kept"} or c == text]
    judged = found.select(
        *(F.col(f"`{c}`") for c in own),
        *made,
        base.alias("base_failed"),
        failed.alias("broken_rules"),
        (~base & ~reduce(operator.or_, (broken(r, lang) for r in rules))).alias("kept"),
    )
    return judged if keep_columns else judged.drop(*own)


def kept_rows(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = None
) -> DataFrame:
    """The rows that pass, with the columns of ``df``.

    A plain filter would be moved below the projections and repeat their expressions many times over; a column that
    differs from row to row keeps it above them.
    """
    judged = quality_rules(df, text, rules, lang=lang).withColumn("__place", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("__place") >= 0)).select(*(F.col(f"`{c}`") for c in df.columns))
