"""Encoding, secrets, quality rules, chat and quality scores against plain versions."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from check import _rows
from glyphlake.llm import chat
from glyphlake.llm.automaton import chars, compiled, either, many, maybe, seq, shortest, some, text
from glyphlake.llm.bpe import Bpe, Tokenizer, merge, parse_ranks
from glyphlake.llm.common import bound_arrow, table
from glyphlake.llm.quality_model import BINS, FEATURES, RIDGE, SEED, SIGMA, STATISTICS, isotonic, quality_scores, statistics
from glyphlake.llm.quality_rules import kept_rows, quality_rules
from glyphlake.llm.queries import CHECKS, QUERIES
from glyphlake.llm.secrets import RULES, Scanner, redact, secret_spans

ODD = [None, "", " ", "\n\n", "x", "Ünïcode ſ K", "a  b\t c", "word " * 5000, "\u2003em", "z" * 20000]


@pytest.fixture(scope="module", autouse=True)
def bounded(spark):
    bound_arrow(spark)


@pytest.fixture(scope="module")
def content():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def theirs(content):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def db(sf):
    connection = duckdb.connect()
    for name in ("documents", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    found = _rows(df.columns, df.collect())
    result = db(sf).execute(CHECKS[name])
    assert found == _rows([c[0] for c in result.description], result.fetchall())


# ---- encoding ------------------------------------------------------------------------------


def ids_of(tokenizer, value):
    return np.frombuffer(tokenizer.encode(value), np.int32).tolist()


def test_tokenizer_equals_tiktoken(content, theirs):
    tokenizer = Tokenizer(content, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aeinst hé\n\t  0%'sß漢\x1c\x85") for _ in range(rng.randint(0, 200))) for _ in range(600)]
    for value in [*texts, *filter(None, ODD), "<|endoftext|>", "ab" * 5000, " " * 3000, "don't  stop\n \n x"]:
        ids = ids_of(tokenizer, value)
        assert ids == theirs.encode_ordinary(value)
        assert tokenizer.decode(ids) == value.encode()


def test_merge_takes_leftmost_of_equal_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301}
    assert merge(b"aaaaa", ranks) == (300, 301)
    assert merge(b"x" * 40, ranks) == (120,) * 40


def test_parse_ranks_skips_blank_lines():
    assert parse_ranks(b"YQ== 0\nYg== 1\n") == {b"a": 0, b"b": 1}


def test_bpe_query(spark, sf, theirs):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op1_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = theirs.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_bpe_columns_with_odd_rows(spark):
    bpe = Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([(v, v) for v in ODD], "text string, ids string")
    back = df.select("text", bpe.encode("text").alias("n")).select("text", bpe.decode("n").cast("string").alias("back")).collect()
    assert [r.back for r in back] == [v or "" for v in ODD]
    assert df.limit(0).select(bpe.encode("text")).collect() == []


# ---- secrets -------------------------------------------------------------------------------

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def plain_spans(value):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(value) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", value) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", value) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


PARTS = (
    "password PassWd secret tOken apikey api_key \" ' : = abcdef12 x é AKIA ABCD1234 0123456789abcdef deadbeef - . ſecret /"
).split() + [" ", "  ", "\n"]


def random_text(rng):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))


def test_base_secrets_equal_regexes(spark):
    rng = random.Random(2)
    texts = [*ODD, *(random_text(rng) for _ in range(4000)), "token=secret: abcdefghij", "token=secret:xx.token=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in df.select("text", secret_spans("text").alias("s")).collect():
        base = [(s.kind, s.start, s.end) for s in row.s if s.kind in ("assign", "access", "hex")]
        assert base == plain_spans(row.text or "")


def test_secrets_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for row in QUERIES["op6_secrets"](spark, sf).collect():
        base = plain_spans(texts[row.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
        assert set(filter(None, told.split(","))) <= set(row.spans.split(","))


def test_more_kinds_and_redaction(spark):
    value = "é ghp_" + "A1b2" * 9 + " and https://me:pw@host/ password: hunter2hunter2!"
    df = spark.createDataFrame([(value,), (None,), ("plain",)], "text string")
    rows = df.select(secret_spans("text").alias("s"), redact("text").alias("clean")).collect()
    assert [s.kind for s in rows[0].s] == ["forge", "login", "assign"]
    assert rows[0].clean == "é [forge removed] and https[login removed]host/ [assign removed]!"
    assert (rows[1].clean, rows[2].clean) == (None, "plain")


def test_whole_private_keys_are_removed(spark):
    rng = random.Random(6)

    def lines(n, width=64):
        return ["".join(rng.choices("ABCXYZabcxyz0189+/", k=width)) for _ in range(n)]

    body = [*lines(24), "Qx9Zz+Aw=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    sealed = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,3F17F5316E2BAC89", "Comment: a.key (old)", ""]
    keys = [gap.join([begin, *inner, end]) for gap in ("\n", "\r\n", "\n    ", "\\n", " ", "\u00a0", '\\n" +\n  "', "\n> ") for inner in (body, lines(1, 5))]
    keys += ["\n".join([begin, *sealed, *body, end]), "\n".join([begin, *lines(3), "", *lines(2), end]), begin + end]
    unended = [gap.join([begin, *inner]) for gap in ("\n", "\r\n", "\\n") for inner in (body, lines(1, 5), [*lines(2), "Zq"])]
    unended += ["\n".join([begin, *sealed, *body]), begin + " " + " ".join(lines(4)), begin]
    texts = [(f"é before {k} (after) it", "é before [pem removed] (after) it") for k in [*keys, *unended]]
    texts += [(k, "[pem removed]") for k in [*keys, *unended]]
    two = f"{keys[0]}\n\nBetween, ünd.\n\n{unended[0]}\n\n(Some more prose.)\n{keys[2]}\nThe end"
    texts.append((two, "[pem removed]\n\nBetween, ünd.\n\n[pem removed]\n\n(Some more prose.)\n[pem removed]\nThe end"))
    told = f"The line {begin} starts a key. Its text is base64. The line {end} ends it."
    texts.append((told, told.replace(begin, "[pem removed]")))
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(texts)], "id int, text string")
    got = df.select("id", redact("text").alias("clean")).orderBy("id").collect()
    assert [r.clean for r in got] == [b for _, b in texts]


def test_one_pass_tells_the_ends_of_all_rules():
    data = b"://a:token=" + b"0123456789abcdef" * 2 + b"0@ " + b"f" * 40
    ends = {RULES[n].kind: places for n, places in Scanner().ends(data).items()}
    assert ends == {"login": [[45, 45]], "assign": [[12, 12]], "hex": [[43, 44], [78, 86]]}
    assert Scanner().spans(data) == [("login", 0, 45), ("assign", 5, 44), ("hex", 11, 44), ("hex", 46, 86)]


def test_shortest_keeps_first_ends():
    pattern = seq(text("a"), either(some(chars("bc"), 2), text("d")), many(chars("e")), maybe(text("f")))
    whole, cut = compiled([pattern], anywhere=False), compiled([shortest(pattern)], anywhere=False)
    for word in map("".join, product("abcdef", repeat=5)):
        first = []
        for dfa in (whole, cut):
            state, met = 0, []
            for i, c in enumerate(word.encode()):
                state = dfa.table[state][c]
                met += [i] if dfa.accepts[state] else []
            first.append(met[:1])
        assert first[0] == first[1]


def test_automaton_is_minimal_and_equals_regex():
    pattern = seq(either(text("ab"), text("cb")), many(chars("x-z")), maybe(chars("0")), some(chars("q"), 2))
    dfa = compiled([pattern], anywhere=False)
    expected = re.compile(r"(ab|cb)[x-z]*0?q{2,}")
    rng = random.Random(3)
    for _ in range(3000):
        value = "".join(rng.choice("abcxz0q") for _ in range(rng.randint(0, 7)))
        state = 0
        for b in value.encode():
            state = dfa.table[state][b]
        assert bool(dfa.accepts[state]) == bool(expected.fullmatch(value))
    assert len(dfa.table) == 7  # start, after a/c, x-loop, after 0, one q, accepting, dead
    assert Scanner().spans(b"nothing here") == []


# ---- quality rules -------------------------------------------------------------------------


def test_quality_measures_of_odd_rows(spark):
    rows = [(v, 1) for v in [*ODD, "one two three four five six seven eight nine " * 3, "a\nb\na\n\n \na"]]
    df = spark.createDataFrame(rows, "text string, n_words int")
    got = quality_rules(df).collect()
    assert len(got) == len(rows) and got[0].n_words == 0 and got[0].base_failed
    by_text = {r.text: r for r in got}
    assert by_text["word " * 5000].n_repeat_words == 5000 and not by_text["word " * 5000].kept
    assert by_text["one two three four five six seven eight nine " * 3].n_repeat_words == 27
    assert by_text["a\nb\na\n\n \na"].n_dup_lines == 2
    assert quality_rules(df.limit(0)).count() == 0


def test_kept_rows_are_the_kept_ones(spark, sf):
    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    found = kept_rows(docs)
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == kept
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    long_enough = {r.doc_id for r in quality_rules(docs).collect() if r.n_words >= 20}
    assert {d for d in long_enough if labels.get(d) == 1} <= kept


def test_length_alone_rejects_no_prose(spark):
    rng = random.Random(5)
    prose = " ".join("the" if i % 5 == 0 else "".join(rng.choices("abcdefgh", k=7)) for i in range(20000))
    bare = " ".join("".join(rng.choices("abcdefgh", k=7)) for i in range(20000))
    rows = [("prose", prose, "en"), ("bare", bare, "en"), ("unlisted", bare, "pl"), ("untold", bare, None)]
    df = spark.createDataFrame(rows, "name string, text string, lang string")
    judged = {r.name: r for r in quality_rules(df, lang="lang").drop("text").collect()}
    assert (judged["prose"].n_stop_word_uses, judged["prose"].n_stop_words) == (4000, 1)
    assert [r.broken_rules for r in judged.values()] == [[], ["stop_words"], [], []]
    assert {r.name for r in quality_rules(df).collect() if r.kept} == {"prose", "bare", "unlisted", "untold"}
    kept = {r.name for r in corpus_pipeline.reject_poor(spark, df, "").collect()}
    assert kept == {"prose", "unlisted", "untold"}


def test_pipeline_keeps_long_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents").where("doc_id in (1386, 1166)")
    assert {r.doc_id for r in corpus_pipeline.reject_poor(spark, docs, sf).collect()} == {1386, 1166}


# ---- chat ----------------------------------------------------------------------------------


def test_chat_round_trip_of_tricky_turns(spark):
    rng = random.Random(4)
    pieces = ["\\", "#", "### ", "</turn>", "\n", ": ", "\\h ", "\\t", "\\b", "é", "a", "<", "/turn>"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", None]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))))
            for c in range(60) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", None), (None, 1, "assistant", ""), (900, None, "assistant", "x"), (900, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.formatted(chat.table_turns(df))
    got = out.select(
        "conv_id", "turns", chat.read_back(F.col("formatted")).alias("back"),
        chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    ).collect()
    assert len(got) == 62
    for row in got:
        assert row.back == row.turns
        assert row.learned == "".join(t.text for t in row.turns if t.role == "assistant")
    assert [t.text for t in next(r for r in got if r.conv_id == 900).turns] == ["x", "y"]
    assert chat.formatted(chat.table_turns(df.limit(0))).count() == 0


def test_records_of_mixed_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"ho"}]}', [("user", "hi"), ("assistant", "ho")]),
        ('{"prompt":"p","completion":null}', [("user", "p")]),
        ('{"instruction":"i","input":"","output":"o"}', [("user", "i"), ("assistant", "o")]),
        ('{"output":"o","instruction":"i"}', [("user", "i"), ("assistant", "o")]),
        ('{"conversations":[{"from":"human","value":"x"},{"from":"gpt","value":"y"}]}', [("user", "x"), ("assistant", "y")]),
        ("nope", None),
        (None, None),
        ('{"odd":1}', None),
        ('{"id":7,"messages":[{"role":"user","content":"a"},{"content":"b","name":{"x":[1]}},{"role":"bot"},null]}',
         [("user", "a"), ("", "b"), ("assistant", ""), ("", "")]),
        ('{"messages":[],"source":"s"}', []),
        ('{"messages":null}', None),
        ('{"prompt":"p","completion":"c","meta":{"tags":[]},"odd key: `<":1.5}', [("user", "p"), ("assistant", "c")]),
        ('{"messages":[{"role":"user","content":[{"text":"parts"}]}]}', None),
        ("[1]", None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id int, record string")
    got = chat.record_turns(df, "record").orderBy("id").collect()
    assert [r.turns and [(t.role, t.text) for t in r.turns] for r in got] == [t for _, t in records]
    with pytest.raises(ValueError):
        chat.table_layout(df)
    odd = '{"a":{"b":[{"c":1},{"d":[[true]],"e f":null}],"g":{}},"h":[],"i":"OBJECT<x: >"}'
    paths = spark.createDataFrame([(odd,)], "record string").select(chat.record_paths(F.col("record"))).first()[0]
    assert paths == ["a.b[].c", "a.b[].d[][]", "a.b[].e f", "h[]", "i"]
    clash = chat.record_turns(df.withColumn("fingerprint", F.lit("x")).withColumn("turns", F.lit("y")), "record")
    assert clash.columns == ["id", "record", "fingerprint", "turns"] and clash.count() == len(records)
    assert chat.record_turns(df.limit(0), "record").count() == 0


# ---- quality scores ------------------------------------------------------------------------


def test_scores_separate_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = QUERIES["op9_quality_model"](spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id]])
    bad = np.array([r.score for r in held if not labels[r.doc_id]])
    assert (good[:, None] > bad).mean() > 0.95
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_scores_of_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(None if i == 3 else i, v) for i, v in enumerate(ODD)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_scores(docs, labels).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    assert not next(r for r in rows if r.doc_id is None).held_out
    one_class = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r.score for r in quality_scores(docs, one_class).collect()} == {1.0}
    assert quality_scores(docs.limit(0), one_class).count() == 0
    assert len(statistics(b"")) == len(STATISTICS)


def test_scores_beside_clashing_columns(spark):
    docs = [(i, f"{'word ' * (i % 9)}text {i}!" if i % 2 else "#" * (i % 7)) for i in range(60)]
    plain = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    names = ["stats", "label", "part", "score", "quality", "held_out", "predicted"]
    beside = plain.select("*", *(F.lit(9).alias(n) for n in names))
    beside_labels = labels.select("*", *(F.lit(9).alias(n) for n in ("text", "stats", "label", "part")))
    want = sorted((r.doc_id, r.held_out, r.predicted, round(r.score, 6)) for r in quality_scores(plain, labels).collect())
    assert sorted((r.doc_id, r.held_out, r.predicted, round(r.score, 6)) for r in quality_scores(beside, beside_labels).collect()) == want


def test_scores_equal_a_dense_solve(spark):
    """The sums of partitions and the binned calibration against one matrix, least squares and a plain isotonic fit."""
    rng = np.random.default_rng(3)
    words_, labels_ = [], []
    for i in range(600):
        good = bool(rng.random() < 0.5)
        n = int(rng.integers(5, 60))
        words_.append(" ".join(("word" if rng.random() < (0.8 if good else 0.4) else "#9") + str(rng.integers(9)) for _ in range(n)))
        labels_.append((i, int(good)))
    docs = spark.createDataFrame(list(enumerate(words_)), "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame(labels_, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}

    x = np.array([statistics(t.encode()) for t in words_])
    y = np.array([label for _, label in labels_], float)
    fold = np.array([zlib.crc32(str(i).encode()) % 3 for i in range(600)])
    fit, later = fold == 0, fold == 2
    mean, spread = x[fit].mean(0), x[fit].std(0)
    draw = np.random.default_rng(SEED)
    turn, shift = draw.normal(size=(len(STATISTICS), FEATURES)) / SIGMA, draw.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / np.where(spread > 1e-9, spread, 1), -8, 8)
    features = np.c_[np.cos(z @ turn + shift) * np.sqrt(2 / FEATURES), np.ones(600)]
    # Ridge as least squares with a row for each weight.
    much = np.sqrt(RIDGE * fit.sum() / FEATURES)
    weights = np.linalg.lstsq(np.r_[features[fit], much * np.eye(FEATURES + 1)], np.r_[y[fit], np.zeros(FEATURES + 1)], rcond=None)[0]
    raw = features @ weights
    bins = defaultdict(list)
    for value, label in zip(raw[later], y[later]):
        bins[np.floor(min(max(value, -1.0), 2.0) * BINS / 3)].append((value, label))
    at = np.array([np.mean([v for v, _ in bins[b]]) for b in sorted(bins)])
    mean_label = [np.mean([label for _, label in bins[b]]) for b in sorted(bins)]
    size = [len(bins[b]) for b in sorted(bins)]
    # The isotonic fit as the largest of all smallest averages.
    n = len(at)
    average = lambda i, j: np.average(mean_label[i : j + 1], weights=size[i : j + 1])
    steps = np.array([max(min(average(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)])
    # Bins of one step meet at their centre.
    centres = [np.average(at[steps == s], weights=np.array(size)[steps == s]) for s in np.unique(steps)]
    want = np.interp(raw, centres, np.unique(steps))
    assert len(got) == 600 and max(abs(got[i] - want[i]) for i in range(600)) < 1e-5


def test_isotonic_pools_neighbours():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.2, 0.6, 0.4, 0.9]), np.ones(4))
    assert np.allclose(x, [0, 1.5, 3]) and np.allclose(y, [0.2, 0.5, 0.9])
