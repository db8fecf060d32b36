"""Importance resampling, SentencePiece encoding and collocations against plain versions and the library."""

import hashlib
import math
import pickle
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glyphlake.llm.collocations import collocations, phrase_counts
from glyphlake.llm.common import bound_arrow, stored, table
from glyphlake.llm.importance import BUCKETS, GainPlanes, bit_planes, bucket_counts, importance_sample
from glyphlake.llm.pieces import PieceModel, Pieces, _Known, chunks_of
from glyphlake.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def bounded(spark):
    bound_arrow(spark)


# ---- Importance resampling -----------------------------------------------------------------


def lowered(value):
    return re.sub("[A-Z]", lambda m: m[0].lower(), value or "")


def plain_buckets(value, runs):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(value))
    return [zlib.crc32(" ".join(found[i : i + k]).encode()) % BUCKETS for k in range(1, runs + 1) for i in range(len(found) - k + 1)]


def plain_sample(docs, aims, runs, percent, least):
    known = [(d, plain_buckets(t, runs), len(plain_buckets(t, 1))) for d, t in docs]
    s, t = Counter(b for _, f, _ in known for b in f), Counter(b for a in aims for b in plain_buckets(a, runs))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + BUCKETS) / ((s[b] + 1) * (total_t + BUCKETS)))) for b in s}
    rows = []
    for d, f, n in known:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = defaultdict(list)
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        rank[r[:4]].append(i + 1)
    return sorted(((*r[:4], rank[r[:4]].pop(0) if r[4] and rank[r[:4]] else None) for r in rows), key=str)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(3)
    gains = rng.integers(-40_000, 40_000, BUCKETS)
    gains[:50] = 0
    planes = GainPlanes(gains)
    for size in (0, 1, 7, 900, BUCKETS):
        buckets = rng.choice(BUCKETS, size, replace=False)
        counts = rng.integers(1, 1 << int(rng.integers(1, 30)), size)
        assert planes.total(buckets, counts) == int((gains[buckets] * counts).sum())
    assert bit_planes(np.zeros(BUCKETS, np.int64)).shape[0] == 0


def test_bucket_counts_of_odd_texts():
    assert bucket_counts(None) == (0, 0, {})
    assert bucket_counts(b" .,; ") == (0, 0, {})
    words, features, counts = bucket_counts("Ab aB é\x00x".encode(), 2)
    assert (words, features) == (4, 7)
    assert counts == Counter(plain_buckets("Ab aB é\x00x", 2))


@pytest.mark.parametrize("runs", [1, 2])
def test_sample_of_odd_rows(spark, runs):
    rng = random.Random(runs)
    said = ["alpha", "Beta", "gamma", "delta", "7", "éé"]
    docs = [(i, " ".join(rng.choices(said, k=rng.randint(0, 40)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "... !"), (503, "alpha " * 30_000), (None, "beta " * 25)] + [(9, "gamma " * 30)] * 7
    aims = ["alpha beta", None, "", "gamma gamma éé"]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, n_features int").repartition(5)
    targets = spark.createDataFrame([(a,) for a in aims], "text string")
    found = importance_sample(frame, targets, runs=runs, percent=30).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_sample(docs, aims, runs, 30, 20)


def test_sample_of_empty_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    nothing = spark.createDataFrame([], "text string")
    assert importance_sample(docs.limit(0), nothing).count() == 0
    drawn = importance_sample(docs, nothing).where("rank IS NOT NULL")
    assert drawn.agg(F.max("rank") == F.count("*")).first()[0]


# ---- SentencePiece -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as file:
        return PieceModel(file.read())


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = [None, "", " ", "   ", "x ", "  a  b ", "▁a▁ ▁", "<s> </s>", "\x00a\n\n\tb", "Ａﬁ中Ω\U0001f600", "z" * 20_000, "a " * 5000, "word  " * 3000]


def test_segments_equal_the_library(model, theirs):
    rng = random.Random(5)
    letters = "abcdefgtheiron  ▁é\n\t.,0123中Ωﬁ\U0001f600\x00<s>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + [t for t in ODD if t]
    for text in texts:
        ids = [i for c in chunks_of(text) for i in model.segment(c)]
        assert ids == theirs.encode(text)
        assert model.decode(ids) == theirs.decode(ids)


def test_decoding_of_any_ids_equals_the_library(model, theirs):
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == theirs.decode(ids)


def plain_pieces(theirs, text):
    return theirs.encode(text or "", add_bos=True, add_eos=True)


# The second run keeps few chunks in the broadcast table, the third has a set of repeated ones that is almost full.
@pytest.mark.parametrize("frequent, width, bits", [(1 << 20, 64, 20), (40, 8, 20), (3, 4, 6)])
def test_encoded_tables_equal_the_library(spark, sf, theirs, frequent, width, bits):
    texts = ODD + [r[0] for r in table(spark, sf, "documents").select("text").collect()] + ["twice the same"] * 20
    docs = spark.createDataFrame([(i, t, "c", 2) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, n int").repartition(6)
    pieces = Pieces(spark, MODEL, frequent, width, bits)
    out = pieces.encoded(docs)
    assert out.columns == [*docs.columns, "ids"]
    rows = out.withColumn("back", pieces.decode("ids")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == plain_pieces(theirs, r.text)
        assert r.back == theirs.decode(r.ids)


def test_pieces_query(spark, sf, theirs):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op12_pieces"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain_pieces(theirs, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()


def test_what_no_piece_joins_is_counted_apart(spark, theirs):
    """A word is one chunk whatever follows it, in the counts and in what is asked for."""
    rng = random.Random(9)
    words = ["zqa", "xwé", "the", "a,!", "b,", "c..", "(d)", "中文", "1.5", "€", "e\t"]
    ends = ["", ",", ".", "\n", ".\n", ",\n\n", "?", ",!", "\r\n", "  "]
    texts = [f"zqa{e} zqa{e}zqa" for e in ends] + [" ".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = Pieces(spark, MODEL, 0, 0)
    counts = {r.chunk: r.n for r in pieces.chunk_counts(docs.where(f"doc_id < {len(ends)}").select("text")).collect()}
    # Only the last character is cut off, so what stands before "!" is counted with its comma once.
    assert (counts[" zqa"], counts["\n"], counts["."], counts[","], counts[" zqa,"]) == (13, 10, 3, 3, 1)
    assert not {" zqa.", " zqa?", " zqa.\n", " zqa.\n\nzqa", " zqa\nzqa"} & counts.keys()
    for frequent, bits in ((0, 20), (5, 6), (1 << 12, 20)):
        out = Pieces(spark, MODEL, frequent, 64, bits).encoded(docs)
        assert {r.doc_id: r.ids for r in out.collect()} == {i: plain_pieces(theirs, t) for i, t in enumerate(texts)}


def test_short_and_long_chunks_merge_alike(model):
    rng = random.Random(7)
    for _ in range(3000):
        text = "▁" * rng.randint(0, 2) + "".join(rng.choices("aeinorst1é中", k=rng.randint(1, 30)))
        assert model._merged(text) == model._merged_by_heap(text)


def test_chunks_segmented_together_equal_single_ones(model):
    rng = random.Random(8)
    letters = "aeinorst1é中Ω\U0001f600\x00 "
    chunks = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(9000)] + ["a", " ", "  the", "\U0001f600", "x" * 500]
    assert model.segment_all(chunks) == [model.pack(model.segment(c)) for c in chunks]
    assert model.segment_all([]) == []


# With hashes of a few bits almost all chunks share theirs with another one.
@pytest.mark.parametrize("hash_bits", [3, 9, 14, 64])
def test_chunks_of_equal_hashes_are_told_apart(spark, sf, theirs, hash_bits):
    texts = ODD + [r[0] for r in table(spark, sf, "documents").select("text").limit(60).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = Pieces(spark, MODEL, 1 << 12, 64, 20, hash_bits=hash_bits).encoded(docs)
    assert {r.doc_id: r.ids for r in out.collect()} == {i: plain_pieces(theirs, t) for i, t in enumerate(texts)}


def test_the_broadcast_table_is_small():
    """A chunk in it takes its hash, the end of its ids and the ids themselves, no Python objects."""
    n = 100_000
    known = _Known(np.arange(n, dtype=np.uint64) << np.uint64(40), pa.array([b"abcd"] * n), np.zeros(16, np.uint64), 10, 64)
    assert len(pickle.dumps(known)) < 20 * n
    assert sys.getsizeof(known.data) + known.hashes.nbytes + known.ends.nbytes < 20 * n


def test_texts_are_not_carried_along_with_their_chunks(spark, theirs):
    """Keys are made once a text, not once a chunk: beside the generator the rows hold keys."""
    docs = spark.createDataFrame([(1, "zq zq xw xw"), (2, "zq xw")], "doc_id long, text string")
    out = Pieces(spark, MODEL, 0, 0).encoded(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Generate posexplode\(open#\d+\), \[(\w+)#\d+\]", plan) == ["key"]
    assert {r.doc_id: r.ids for r in out.collect()} == {1: plain_pieces(theirs, "zq zq xw xw"), 2: plain_pieces(theirs, "zq xw")}


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
        return {f for f in files if "shuffle_" in f}

    before = shuffles()
    kept = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before and kept.count() == 7


def test_pieces_of_an_empty_table(spark):
    assert Pieces(spark, MODEL).encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- Collocations --------------------------------------------------------------------------


def plain_collocations(docs, support, rows):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = set()
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        inner = Counter()
        for p, a in often.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inner[p[i : i + n]] = max(inner[p[i : i + n]], a)
        kept = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inner[p] < 80 * a:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:rows], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


# Many shards lower the local support to one, small blocks are many; a set of 64 bits is full of candidates.
@pytest.mark.parametrize("shards, block_words, bits", [(4, 1 << 20, 20), (100, 50, 20), (1, 500, 20), (3, 500, 6)])
def test_collocations_equal_plain_ones(spark, shards, block_words, bits):
    rng = random.Random(11)
    words = ["New", "york", "city", "hall", "the", "of", "a", "é", "'s", "x\x00y"]
    langs = ["en", "en", "fr", None]
    docs = []
    for _ in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30))).replace("city", "city,", rng.randint(0, 1))
        docs.append((rng.choice(langs), text + rng.choice(["", " new york city hall", ".\nof the\ta  ", "!"])))
    docs += [("fr", None), ("de", ""), ("de", "..;"), (None, "of the a " * 2000)] + [("en", "the same line of the city")] * 60
    frame = spark.createDataFrame([(a, b, 1, "p") for a, b in docs], "lang string, text string, shard int, phrase string").repartition(4)
    found = collocations(frame, rows=40, support=12, shards=shards, block_words=block_words, bits=bits).collect()
    assert {tuple(r) for r in found} == plain_collocations(docs, 12, 40)
    assert len(found) == len({(r.lang, r.rank) for r in found})


def test_phrases_are_counted_where_they_are_mined(spark):
    """No further pass hands out every frequent phrase of every block: its rows grew with the phrases times the blocks."""
    docs = spark.createDataFrame([("en", "new york city")] * 60, "lang string, text string").repartition(12)
    counts = phrase_counts(docs, block_words=6)
    assert "MapInArrow" not in counts._jdf.queryExecution().executedPlan().toString()
    phrases = {"new": 60, "york": 60, "city": 60, "new york": 60, "york city": 60, "new york city": 60, "": 180}
    assert {r.phrase: r.f for r in counts.collect()} == phrases


def test_phrases_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrase_counts(empty).count() == 0
    assert collocations(empty).count() == 0
