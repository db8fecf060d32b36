"""SimHash, URL rules, repeats, mixing, nearest neighbours and the pipeline against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from glyphlake.llm import ann
from glyphlake.llm.ann import build_index, search_index, shards_of
from glyphlake.llm.common import bound_arrow, shared_folder, table
from glyphlake.llm.components import connected
from glyphlake.llm.mixing import BLOCK, Mix, permuted, targets
from glyphlake.llm.queries import QUERIES, URL_RULES
from glyphlake.llm.repeats import LENGTH, without_repeats
from glyphlake.llm.simhash import near_duplicates, one_of_each_group, trie_join
from glyphlake.llm.url_filter import Rule, Segmenter, bayes, fitting_rule, host_of, host_words, slot, url_verdicts, word_counts

GAP = r"[\x20\x09-\x0D]+"


@pytest.fixture(scope="module", autouse=True)
def bounded(spark):
    bound_arrow(spark)


def words(value):
    return [w for w in re.split(GAP, value or "") if w]


# ---- SimHash -------------------------------------------------------------------------------


def plain_fingerprint(value):
    found = words(re.sub("[A-Z]", lambda m: m[0].lower(), value or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 4]).encode(), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if found else 0


def plain_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            root[find(i)] = find(int(j))
    least = {}
    for i, doc in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_query(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op2_simhash"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    prints = [int(r.fingerprint, 16) for r in rows]
    assert prints == [plain_fingerprint(texts[r.doc_id]) for r in rows]
    assert [r.component_id for r in rows] == plain_components([r.doc_id for r in rows], prints)


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [base]
    for k in range(6):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
        near.append(x)
    values = np.unique(np.concatenate(near))
    for lead in (0, 13):
        apart = values[:, None] ^ values
        met = (np.bitwise_count(apart) <= 4) & ((apart >> np.uint64(1)) >> np.uint64(63 - lead) == 0)
        want = {(i, j) for i, j in zip(*np.nonzero(met)) if i < j}
        for leaf in (0, 48):
            got = set()
            trie_join(values, lead, 4, lambda i, j, got=got: got.update(zip(i.tolist(), j.tolist())), leaf)
            assert got == want


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, " \n"), (None, "solo text here"), (7, "solo text here"), (7, "solo text here"), (8, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = Counter((r.doc_id, r.component_id) for r in near_duplicates(df).collect())
    assert got == Counter([(5, 4), (4, 4), (9, 4), (None, 7), (7, 7), (7, 7), (8, 8)])
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, 7, 8, None]
    assert near_duplicates(df.limit(0)).count() == 0


def test_hot_groups_are_cut_without_losing_links(spark, monkeypatch):
    from glyphlake.llm import simhash

    rng = np.random.default_rng(8)
    values = np.unique(np.uint64(0xABCD) << np.uint64(48) ^ rng.integers(0, 1 << 12, 600).astype(np.uint64)).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")

    def classes():
        return {(r.node, r.root) for r in connected(simhash.near_links(df)).collect()}

    whole = classes()
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert classes() == whole


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[201] == 200
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- URL filters ---------------------------------------------------------------------------


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_url_query(spark, sf):
    urls = {r.page_id: r.url for r in table(spark, sf, "pages").collect()}
    rows = QUERIES["op3_url_filter"](spark, sf).collect()
    assert len(rows) == len(urls)
    for row in rows:
        host, path, rule = plain_url(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule and rule.host + rule.path)
        assert row.verdict == (rule.verdict if rule else "block" if row.score > 0 else "allow")


def test_first_of_equally_long_rules_wins(spark):
    rules = (Rule("block", "a.org", "/x"), Rule("allow", "org", "/x/abc"), Rule("allow", "a.org", "/x"))
    df = spark.createDataFrame([("a.org", "/x/1"), ("b.org", "/x/abc"), ("c.net", "/x")], "host string, path string")
    found = [r.f for r in df.select(fitting_rule(F.col("host"), F.col("path"), rules).alias("f")).collect()]
    assert found == [("a.org/x", "block"), ("org/x/abc", "allow"), None]


def test_urls_scored_like_plain_naive_bayes(spark):
    urls = ["http://badword.net/x/1", "http://badgood.net/y", "http://goodword.example.net/en/2", "http://good.org/fr/", "http://badbad.org/",
            None, "no scheme", "http://", "HTTP://ÄB.ORG/fr/é", "http://a.b?x://c/", "http://goodgood.com/"]
    pages = [(i, u, "bad good word <b>good</b>" if i else None) for i, u in enumerate(urls)] + [(0, urls[0], None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("host", F.lit(1))
    got = url_verdicts(df, URL_RULES).collect()
    assert len(got) == len(pages)
    for row in got:
        host, path, rule = plain_url(urls[row.page_id])
        assert (row.host, row.path) == (host, path) and row.rule == (rule and rule.host + rule.path)
    by_id = {r.page_id: r for r in got}
    assert by_id[4].score > by_id[10].score  # "bad" stands in blocked hosts, "good" rather in allowed ones
    assert by_id[5].verdict in ("allow", "block") and by_id[5].host == ""
    assert url_verdicts(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in url_verdicts(df.where("page_id in (4, 10)"), URL_RULES).collect()} == {"allow"}


def test_segments_are_the_most_likely_words():
    segmenter = Segmenter({"the": 50, "these": 5, "sea": 5, "a": 20, "shell": 5, "s": 3})
    assert segmenter.split("theseashells") == ("the", "sea", "shell", "s")
    assert "".join(segmenter.split("q" * 300)) == "q" * 300
    assert segmenter.tokens("the-sea42.net", "/A/7")[:4] == ["h:the", "h:sea", "h:2", *["h:" + w for w in segmenter.split("net")]][:4]


def test_hosts_are_split_with_all_words(spark):
    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    rare, long = "zyxwvu", "longword" * 4
    frequent = " ".join(name(i) for i in range(60_000))
    pages = [(0, "http://zyxwvuaaaa.org/", f"{frequent} {frequent}"), (1, f"http://{long}aaaa.com/", f"{rare} {long}"), (2, "http://1.2/", None), (3, None, None)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    counts = word_counts(df)
    assert counts.count() == 60_002
    hosts = df.select(host_of(F.col("url")).alias("host"))
    hosts = hosts.where("host is not null").union(hosts.where("host is not null"))
    found = {r.host: {w.word: w.n for w in r.found} for r in host_words(hosts, counts).collect()}
    assert set(found) == {"zyxwvuaaaa.org", f"{long}aaaa.com", "1.2", ""} and found["1.2"] == found[""] == {}
    assert (found["zyxwvuaaaa.org"][rare], found["zyxwvuaaaa.org"]["aaaa"], found[f"{long}aaaa.com"][long]) == (1, 2, 1)
    segmenters = {h: Segmenter(w, 120_002) for h, w in found.items()}
    whole = Segmenter({r.word: r.n for r in counts.collect()})
    for host, own in segmenters.items():
        assert own.host_tokens(host) == whole.host_tokens(host)
    assert segmenters["zyxwvuaaaa.org"].host_tokens("zyxwvuaaaa.org")[:2] == ["h:zyxwvu", "h:aaaa"]
    assert segmenters[f"{long}aaaa.com"].split(long + "aaaa") == (long, "aaaa")
    assert len(url_verdicts(df, URL_RULES).collect()) == len(pages)


def test_scores_use_the_words_beyond_a_frequent_vocabulary(spark):
    """The whole query against the plain splitter with every word."""
    rare = "zyxwvu"
    frequent = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000))
    urls = [f"http://{rare}aaaa.net/", f"http://aaaa{rare}.org/fr/", f"http://{rare}.com/x", "http://baaa.net/", "http://q.org/fr/a"]
    pages = [(i, u, f"{frequent} {frequent}" if i == 0 else rare) for i, u in enumerate(urls)]
    got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(pages, "page_id int, url string, html string"), URL_RULES).collect()}
    counts = Counter(w for _, _, html in pages for w in html.split())
    segmenter = Segmenter(counts)
    of_class, tokens = Counter(), Counter()
    for url in urls:
        host, path, rule = plain_url(url)
        if rule:
            of_class[rule.verdict] += 1
            tokens.update((rule.verdict, slot(t)) for t in segmenter.tokens(host, path))
    model = bayes(of_class, tokens)
    host, path, rule = plain_url(urls[2])
    assert rule is None
    expected = model.prior + float(sum(model.odds[slot(t)] for t in segmenter.tokens(host, path)))
    assert got[2].score == pytest.approx(expected, abs=1e-12)


# ---- repeats -------------------------------------------------------------------------------


def plain_repeats(texts):
    count = Counter(t[p : p + LENGTH] for t in texts for p in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1):
            if count[t[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_repeats_query(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, sf, "documents").collect()}
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op4_repeats"](spark, sf).collect()}
    ids = sorted(texts)
    assert [rows[i] for i in ids] == plain_repeats([texts[i] for i in ids])


def test_repeats_at_edges_runs_and_copies(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef gh\n") for _ in range(2500)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            source, at, n = rng.choice(base), rng.randint(0, 2000), rng.choice([380, 399, 400, 401, 450, 700, 1500])
            parts += [source[at : at + n], "".join(rng.choice("xyz 12") for _ in range(rng.choice([0, 1, 5, 50, 400])))]
        texts.append("".join(parts))
    texts += ["a" * 1000, "a" * 400, "a" * 399, "ab" * 300, "x" * 450 + "b" + "x" * 420, "é" * 300, "", None, "a" * 401]
    texts += [("q" * 50 + "r" * 50) * 8, ("q" * 50 + "r" * 50) * 5, base[0], base[0], base[1][:1200] + "!" + base[1][1200:]]
    # Periodic passages longer than a piece of windows, the second one of its own, the last two shared in part.
    texts += ["abcdefghij" * 900, "once 7 " * 58, base[2][:300] + "0123456 " * 60, "0123456 " * 55 + base[3][:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit(1))
    got = sorted(without_repeats(df).collect(), key=lambda r: r.doc_id)
    told = [(r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert told == plain_repeats([(t or "").encode() for t in texts])
    assert without_repeats(df.limit(0)).count() == 0


# ---- mixing --------------------------------------------------------------------------------


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_sources, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = {s for s in open_sources if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_sources}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_sources -= over
    return target


def test_mixing_query(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op5_mixing"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(words(docs[r.doc_id].text)) and 0 <= r.taken <= 2 * r.size
        sizes[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    want = plain_targets(sizes)
    for r in rows:
        source = docs[r.doc_id].source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert abs(taken[source] - r.target) <= max(BLOCK, 0.05 * r.target)
    again = {(r.doc_id, r.taken) for r in QUERIES["op5_mixing"](spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_targets_of_uneven_sources(spark):
    sizes = {"a": 1000, "b": 1, "c": 0, "é": 70, "z": 7, None: 300}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mixed_texts_hold_the_taken_words(spark):
    rng = random.Random(6)
    rows = [(i, "\n ".join(f"w{i}-{k}" for k in range(rng.choice([0, 1, 5, 63, 64, 65, 400]))), rng.choice(["a", "b", "c", None])) for i in range(90)]
    rows += [(500, "same row here", "a"), (500, "same row here", "a"), (None, " lead  and tail ", "b"), (501, None, "a"), (501, None, "a"), (502, " ", None), (502, " ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("clash"))
    mix = Mix(df)
    texts = mix.texts()
    assert texts.columns == df.columns
    found, parts = Counter(), defaultdict(list)
    for r in texts.collect():
        found[r.doc_id] += len(words(r.text))
        parts[r.doc_id].append(words(r.text))
    want = Counter()
    told = mix.documents().collect()
    assert Counter(r.doc_id for r in told) == Counter(i for i, _, _ in rows)
    for r in told:
        want[r.doc_id] += r.taken
    assert +found == +want
    original = {i: words(t) for i, t, _ in rows if i != 500}
    for doc, draws in parts.items():
        if doc in original:
            assert all(set(d) <= set(original[doc]) and len(set(d)) == len(d) for d in draws)
    assert Mix(df.limit(0)).documents().count() == 0 and Mix(df.limit(0)).blocks().count() == 0


def test_mixed_blocks_follow_the_drawn_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mix = Mix(docs, shard_slots=64)
    sources, counts = mix.sources.collect(), mix.counts.collect()
    taken, by_source, drawn = Counter(), defaultdict(Counter), Counter()
    places = defaultdict(list)
    for r in mix.blocks().collect():
        assert r.n_words == len(words(r.text)) <= BLOCK
        taken[r.source] += r.n_words
        drawn[r.source, r.shard] += 1
        places[r.shard].append(r.place)
        by_source[r.source][r.slot] += 1
    names = {r.sid: r.source for r in sources}
    assert drawn == {(names[r.sid], r.shard): r.slots for r in counts}
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert all(max(slots) + 1 == len(slots) and set(slots.values()) == {1} for slots in by_source.values())
    told = Counter()
    for r in mix.documents().join(docs.select("doc_id", "source"), "doc_id").collect():
        told[r.source] += r.taken
    assert +told == +taken
    # Every shard holds about the mix of the whole.
    every = sum(r.slots for r in counts)
    assert len(places) > 10
    for r in sources:
        mine = [c.slots for c in counts if c.sid == r.sid]
        share, per = sum(mine) / every, every / len(places)
        assert all(abs(n - share * per) <= 6 * (share * per) ** 0.5 + 3 for n in mine)


def test_permutations_are_one_to_one(spark):
    for size in (1, 2, 3, 64, 1000, 4099):
        df = spark.range(size).select("id", *(permuted(F.col("id"), F.lit(size), F.lit(key)).alias(f"p{key}") for key in (1, 2)))
        rows = df.orderBy("id").collect()
        one, two = [r.p1 for r in rows], [r.p2 for r in rows]
        assert sorted(one) == sorted(two) == list(range(size))
        if size >= 1000:
            assert one != two and sum(b - a == one[1] - one[0] for a, b in zip(one, one[1:])) < size / 10


def test_mixing_runs_no_python(spark, sf):
    df = QUERIES["op5_mixing"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ---- nearest neighbours --------------------------------------------------------------------


def plain_neighbours(ids, data, query, k=10):
    d = np.sqrt(((data - data[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[query]]
    return [(int(ids[i]), d[i]) for i in order[:k]]


def test_neighbours_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").collect()
    ids, data = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in sorted(QUERIES["op7_ann"](spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    hits, total = 0, 0
    place = {int(v): i for i, v in enumerate(ids)}
    for query in np.flatnonzero(ids % 100 == 0):
        want, found = plain_neighbours(ids, data, query), got[int(ids[query])]
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(abs(s - np.sqrt(((data[place[v]] - data[query]) ** 2).sum())) < 1e-12 for v, s in found)
        hits += len({v for v, _ in want} & {v for v, _ in found})
        total += 10
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100, 130)] + [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0])]
    rows += [(5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (200, [9.0, 9.0]), (200, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1))
    got = search_index(build_index(df, 10), df, 10).collect()
    hits = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        hits[r.query_id].append(r.vec_id)
    assert hits[0] == list(range(100, 110)) and hits[105] == [0, 100, 101, 102, 103, 104, 106, 107, 108, 109]
    assert hits[200] == [0, *range(100, 109)] and set(hits) == {0, 200, *range(100, 130)}  # 7 has no vector of its dimension
    assert search_index(build_index(df.limit(0), 10), df.limit(0), 10).count() == 0


def test_neighbours_in_many_shards_and_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3 if i % 3 else 4).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "NUMBERS", 300)
    index = build_index(df, 10)
    shards = index.select("shard", "dims", F.size("ids").alias("held")).collect()
    assert [sorted(r.dims for r in shards).count(d) for d in (3, 4)] == [4, 3] and sorted(r.shard for r in shards) == list(range(7))
    assert sum(r.held for r in shards) == 600
    asked = df.where("vec_id % 10 = 0")
    whole = sorted(map(tuple, search_index(index, asked, 10).collect()))
    monkeypatch.setattr(ann, "SLICE", 7)
    assert sorted(map(tuple, search_index(index, asked, 10).collect())) == whole
    for query in range(0, 600, 10):
        group = [(i, v) for i, v in rows if len(v) == len(rows[query][1])]
        ids = np.array([i for i, _ in group])
        want = plain_neighbours(ids, np.array([v for _, v in group]), int(np.flatnonzero(ids == query)[0]))
        assert [(v, pytest.approx(s)) for v, s in want] == [(v, s) for q, _, v, s in whole if q == query]


def test_shards_grow_with_the_table():
    assert [shards_of(n, 64) for n in (0, 1, 4096, 10_000, 1_000_000, 100_000_000)] == [0, 1, 1, 3, 32, 1526]
    assert shards_of(1000, 1 << 20) == 16


# ---- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        place = f"{shared_folder(spark)}/test-{name}-{random.random()}"
        out.write.parquet(place)
        seen.append(spark.read.parquet(place))
    assert all(x.columns == docs.columns for x in seen[:-1])
    raw, good, single, clean, mixed, ids = ({} for _ in range(6))
    for df, out in zip(seen, (raw, good, single, clean)):
        out.update({r.doc_id: r for r in df.collect()})
    # Secrets leave the text, all other rows stay as they are.
    assert set(clean) == set(single)
    for i, row in clean.items():
        assert row.n_chars == len(row.text) and ("removed]" in row.text or row.text == single[i].text)
    prints = [plain_fingerprint(good[i].text) for i in sorted(good)]
    assert set(single) == set(plain_components(sorted(good), prints))
    # Every mixed text is made of words of its document, at most twice.
    counts = Counter()
    for row in seen[4].collect():
        mixed.setdefault(row.doc_id, []).append(row.text)
        counts[row.doc_id] += len(words(row.text))
        assert Counter(words(row.text)) <= Counter(words(clean[row.doc_id].text))
    assert all(n <= 2 * len(words(clean[i].text)) for i, n in counts.items())
    sizes, taken = Counter(), Counter()
    for i, row in clean.items():
        sizes[row.source] += len(words(row.text))
        taken[row.source] += counts[i]
    for source, target in plain_targets(sizes).items():
        assert abs(taken[source] - target) <= max(BLOCK, 0.05 * target)
    assert seen[5].count() == seen[4].count() and seen[5].where("n_tokens <> size(ids)").count() == 0
    assert seen[5].agg(F.sum("n_tokens")).first()[0] > 0 and not ids


def test_pipeline_of_an_empty_table(spark, sf):
    out = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
    assert out.count() == 0
