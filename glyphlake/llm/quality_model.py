"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics are ratios and logarithms read from the whole text. Standardised, they go through ``FEATURES`` random
cosines that approximate a Gaussian kernel. Every partition sums its normal equations, the sums are added up by Spark, and
one small system is solved. Raw ridge scores become probabilities by isotonic regression over ``BINS`` bins of rows that the
ridge fit has not seen; between the steps it is interpolated, so scores keep their order.

Labels are learned from a hashed sample of about ``MOST_ROWS`` labelled rows at most; statistics cover all documents.

Defined cases: a null text counts as empty, and empty texts get a score like any other; a null id is not held out and has no
label; a document labelled or listed more than once counts as often; without labels of both classes every score is the
share of label 1, or 0.5 without any label; an empty table gives an empty result. Equal texts get equal scores, ties are left as they
are; further columns of both tables are not read, whatever their names. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake.llm.common import stored

FEATURES = 256
BINS = 400
RIDGE = 1e-3
SIGMA = 3.0
SEED = 9
MOST_ROWS = 400_000
FOLDS = 3
HELD_OUT = 1

STATISTICS = (
    "log_words", "log_chars", "word_length", "distinct_words", "long_words", "one_letter_words", "letters", "digits", "upper",
    "spaces", "symbols", "punctuation", "high_bytes", "distinct_lines", "log_line_words", "byte_entropy", "top_word",
    "distinct_pairs", "most_lines", "stops_per_word",
)

_KINDS = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "spaces": b" \t\n\r\x0b\x0c",
    "symbols": b"#*$%&|<>@^~{}[]\\_=+/",
    "punctuation": b".,;:!?'\"()-",
    "high_bytes": bytes(range(128, 256)),
}
_MASKS = np.array([[b in set(v) for b in range(256)] for v in _KINDS.values()], float)


def statistics(data: bytes) -> list[float]:
    """Of one UTF-8 text, in the order of ``STATISTICS``."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = max(1.0, float(len(data)))
    kinds = dict(zip(_KINDS, _MASKS @ counts / n))
    share = counts[counts > 0] / n
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    w, l = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    line_tally: dict[bytes, int] = {}
    for x in lines:
        line_tally[x] = line_tally.get(x, 0) + 1
    found = {
        "log_words": np.log1p(len(words)),
        "log_chars": np.log1p(len(data)),
        "word_length": min(50.0, lengths.sum() / w),
        "distinct_words": len(tally) / w,
        "long_words": (lengths > 20).sum() / w,
        "one_letter_words": (lengths == 1).sum() / w,
        **kinds,
        "distinct_lines": len(line_tally) / l,
        "log_line_words": np.log1p(len(words) / l),
        "byte_entropy": float(-(share * np.log2(share)).sum()),
        "top_word": max(tally.values(), default=0) / w,
        "distinct_pairs": len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
        "most_lines": max(line_tally.values(), default=0) / l,
        "stops_per_word": (counts[46] + counts[33] + counts[63]) / w,
    }
    return [float(found[s]) for s in STATISTICS]


def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    flat = np.array(rows, float).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(flat))


def text_statistics(text: Column | str) -> Column:
    return F.arrow_udf(_statistics, T.ArrayType(T.DoubleType()))(text)


class Model:
    """Standardisation, random features, ridge weights and calibration steps; all of fixed size."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn = rng.normal(size=(len(STATISTICS), FEATURES)) / SIGMA
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.cos(z @ self.turn + self.shift) * np.sqrt(2 / FEATURES), np.ones(len(z))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the non-decreasing steps that fit best: neighbours out of order are pooled."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    sums = np.array(pools)
    return sums[:, 0] / sums[:, 2], np.clip(sums[:, 1] / sums[:, 2], 0, 1)


def fitted(rows: DataFrame) -> Model:
    """A model of rows (stats array, label 0 or 1, part 'fit' or 'calibrate')."""
    n = len(STATISTICS)
    sums = rows.where("part = 'fit'").agg(
        F.count("*"), F.sum("label"), *(F.avg(F.col("stats")[i]) for i in range(n)), *(F.stddev_pop(F.col("stats")[i]) for i in range(n))
    ).first()
    model = Model(np.zeros(n), np.ones(n))
    known = rows.agg(F.avg("label").alias("p")).first()["p"]
    if known is None or not 0 < known < 1 or not sums[0] or not 0 < sums[1] < sums[0]:
        model.steps = (np.array([0.0]), np.array([0.5 if known is None else float(known)]))
        return model
    model = Model(np.array(sums[2 : 2 + n], float), np.array([s if s and s > 1e-9 else 1.0 for s in sums[2 + n :]]))
    size = FEATURES + 2  # features, the constant, the label

    def equations(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = np.c_[model.features(_matrix(batch.column("stats"))), batch.column("label").to_numpy()]
            total += z.T @ z
        yield pa.record_batch({"i": np.arange(size), "sums": pa.array(list(total))})

    parts = rows.where("part = 'fit'").select("stats", F.col("label").cast("double")).mapInArrow(equations, "i bigint, sums array<double>")
    # Added up element by element, so what reaches the driver has a fixed size.
    added = parts.select("i", F.posexplode("sums").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((size, size))
    for row in added.collect():
        gram[row["i"], row["j"]] = row["x"]
    left, right = gram[:-1, :-1], gram[:-1, -1]
    model.weights = np.linalg.solve(left + RIDGE * sums[0] * np.eye(size - 1) / FEATURES, right)

    def raw(batches):
        for batch in batches:
            values = model.raw(_matrix(batch.column("stats")))
            yield pa.record_batch({"raw": values, "label": batch.column("label")})

    seen = rows.where("part = 'calibrate'").select("stats", F.col("label").cast("double")).mapInArrow(raw, "raw double, label double")
    binned = seen.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * BINS / 3).alias("bin"))
    bins = sorted(binned.agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w")).collect())
    if bins:
        model.steps = isotonic(*(np.array([b[k] for b in bins], float) for k in ("x", "y", "w")))
    return model


def scored(df: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``df`` with the score of its ``stats``."""

    def score(stats: pa.Array) -> pa.Array:
        return pa.array(model.scores(_matrix(stats)))

    return df.withColumn(out, F.arrow_udf(score, "double")("stats"))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``.

    Rows whose crc32 of the id leaves remainder ``HELD_OUT`` are never learned from; of the others one remainder serves
    the ridge fit, the other the calibration.
    """
    key = F.col(f"`{doc_id}`")
    described = stored(docs.select(key.alias("doc_id"), text_statistics(F.col(f"`{text}`")).alias("stats")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    usable = labels.select(key.alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1)")
    usable = usable.where(fold != HELD_OUT)
    number = usable.count()
    if number > MOST_ROWS:
        usable = usable.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * MOST_ROWS / number))
    part = F.when(fold == (HELD_OUT + 1) % FOLDS, "calibrate").otherwise("fit")
    rows = stored(described.join(usable, "doc_id").select("stats", "label", part.alias("part")))
    found = scored(described, fitted(rows))
    return found.select(
        "doc_id",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
