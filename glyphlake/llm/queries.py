"""The registered queries of the operators, each over its whole table, with checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import chat
from glyphlake.llm.ann import build_index, search_index
from glyphlake.llm.bpe import Bpe
from glyphlake.llm.collocations import collocations
from glyphlake.llm.common import bound_arrow, table
from glyphlake.llm.importance import importance_sample
from glyphlake.llm.mixing import Mix
from glyphlake.llm.pieces import Pieces, packed
from glyphlake.llm.quality_model import quality_scores
from glyphlake.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from glyphlake.llm.repeats import without_repeats
from glyphlake.llm.secrets import BASE, secret_spans
from glyphlake.llm.simhash import near_duplicates
from glyphlake.llm.url_filter import Rule, url_verdicts
from glyphlake.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        @wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            bound_arrow(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = run
        if sql is not None:
            CHECKS[query.__name__] = sql
        return run

    return add


@register()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers

    bpe = Bpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = table(spark, sf_dir, "documents").select("doc_id", bpe.encode("text").alias("ids"))
    decoded = encoded.select("doc_id", "ids", bpe.decode("ids").alias("decoded"))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-copy component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The rules of the query.
URL_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@register()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES)


@register()
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that start anywhere else too."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@register()
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every row whose vec_id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search_index(build_index(vectors, 10), vectors.where("vec_id % 100 = 0"), 10)


@register()
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).documents()


@register()
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts, and all spans as text."""
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans("text").alias("found"))
    base = [r.kind for r in BASE]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(told(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("found")).alias("spans"),
    )


def _rules_sql() -> str:
    """The threshold table as a condition of DuckDB."""
    parts = []
    for r in RULES:
        per = "1" if r.per == "one" else r.per
        told = f"lang IN {r.langs} AND " if r.langs else ""
        sides = [f"{r.measure}::DOUBLE / greatest({per}, 1) < {r.low}"] if r.low is not None else []
        sides += [f"{r.measure}::DOUBLE / greatest({per}, 1) > {r.high}"] if r.high is not None else []
        parts.append(f"coalesce({told}{per} >= {r.least} AND ({' OR '.join(sides)}), FALSE)")
    return " OR ".join(parts)


# Fixed value: what both turns of the added conversation say.
TRICKY = "\\### Assistant: </turn> ok"

OP8_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
e AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '### ', '\\h '), '</turn>', '\\t') AS t,
         replace(replace(replace(replace(role, '\\', '\\b'), '### ', '\\h '), '</turn>', '\\t'), ':', '\\c') AS h
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), ''))
         AS loss_sha256,
       sum(length('### ' || h || ': ' || t || '</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@register(OP8_SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, as digests."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRICKY).alias("text"),
    )
    out = chat.formatted(chat.table_turns(said.unionByName(more))).drop("turns")
    back = out.select(
        "conv_id",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@register(
    """
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), ''
                         ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, ''))) AS turns_sha256
FROM conversations GROUP BY conv_id"""
)
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a JSON record, in one of four layouts with fields of their own, and back to turns."""
    told = chat.table_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    turns, about = F.col("turns"), F.struct(F.lit("chat").alias("kind"), F.array(F.lit(1)).alias("versions"))
    asked = (F.size("turns") == 2) & (turns[0]["role"] == "user") & (turns[1]["role"] == "assistant")
    told_by = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.transform(turns, lambda t, i: F.struct(t["text"].alias("content"), i.alias("n"), t["role"].alias("role")))
    exchanged = F.transform(turns, lambda t: F.struct(told_by(t["role"]).alias("from"), t["text"].alias("value")))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    record = (
        F.when(asked & (kind == 0), F.to_json(F.struct(turns[0]["text"].alias("prompt"), turns[1]["text"].alias("completion"), about.alias("about"))))
        .when(asked & (kind == 1), F.to_json(F.struct(about.alias("about"), turns[0]["text"].alias("instruction"), turns[1]["text"].alias("output"))))
        .when(kind == 2, F.to_json(F.struct("conv_id", exchanged.alias("conversations"))))
        .otherwise(F.to_json(F.struct(about.alias("about"), messages.alias("messages"))))
    )
    back = chat.record_turns(told.select("conv_id", record.alias("record")), "record")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"))


@register()
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


OP10_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, (SELECT unnest(range(8)) AS k)) GROUP BY r),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x IN {tuple(sorted(set(STOP_WORDS)))}))::BIGINT AS n_stop_word_uses
  FROM t LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_rules_sql()}) AS kept
FROM b"""


@register(OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, by the table that its SQL is made of."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), lang="lang")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# A word's crc32 by the table of its 256 one-byte remainders, which the polynomial gives.
OP11_SQL = """
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([b::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY b) AS t
  FROM range(256) r(b)),
seen AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, r, unnest(regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM seen),
bytes AS (
  SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM w)),
bucket AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
f AS (SELECT side, r, bucket FROM w JOIN bucket USING (word)),
n AS (
  SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM f GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n),
total AS (SELECT r, count(*) AS n_features, sum(gain)::HUGEINT AS g FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT r, doc_id, coalesce(n_features, 0)::BIGINT AS n_features,
         coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM seen LEFT JOIN total USING (r) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS p,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p END AS rank
FROM ranked"""


@register(OP11_SQL)
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark's texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_sample(docs, table(spark, sf_dir, "benchmark").select("text"))


@register()
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into pieces and decoded again, as digests."""
    import public_tokenizers

    pieces = Pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(packed("ids"), 256).alias("ids_sha256"),
        F.sha2(pieces.decode("ids").cast("binary"), 256).alias("decoded_sha256"),
    )


OP13_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, words, phrase, count(*) AS f
  FROM (SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS words) WHERE len(w) >= words)
  GROUP BY ALL HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.words, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT *, unnest(range(1, words - n + 2)) AS i
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, words)) AS n FROM f WHERE words > 2))
  GROUP BY ALL),
kept AS (
  SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN inner_part USING (lang, phrase) WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept JOIN total USING (lang) WHERE rank <= 2000"""


@register(OP13_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
