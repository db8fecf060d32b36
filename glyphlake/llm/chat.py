"""Chat formatting with built-in functions: fingerprinted schemas, declarative mappings, one reversible template.

A layout is named by its fingerprint: a hash of all nested field paths, sorted. Each known fingerprint selects a mapping
that says where role and text of the turns stand; the first in ``MAPPINGS`` counts whose own paths, as far as they are
there, have a known fingerprint, so further fields do no harm. A table of one layout (``table_turns``) is recognised by its
Spark schema; JSON records of mixed layouts (``record_turns``) are recognised row by row, by the paths of all levels and of
all items of their lists.

Template of a turn: ``### role: text</turn>`` and a line end. Backslash, ``### `` and ``</turn>`` inside texts and roles are
written as ``\\b``, ``\\h `` and ``\\t``, in roles also ``:`` as ``\\c``; nothing else changes, so the output can be read back.

Defined cases: a null text or role counts as empty; a conversation's turns are ordered by turn number (null first), then
role and text, repeated rows included; a null conv_id is a conversation of its own; an empty list of turns is a
conversation without turns, a null item in it an empty turn; records of no known layout, and texts that are no JSON object or
name a key twice, have a null result (their fingerprint is given, so that a mapping can be added); an empty table gives an
empty result. A
conversation is one output row and so has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "struct<role:string,text:string>"
TURNS = f"array<{TURN}>"
END = "</turn>\n"
LEARNED = "assistant"

# ---- schema fingerprints -------------------------------------------------------------------


def field_paths(kind: T.DataType, path: str = "") -> list[str]:
    """All nested paths of a schema; ``[]`` stands for an array's items."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, path + "[]")
    return [path]


class Mapping(NamedTuple):
    """Where the turns of a layout stand.

    ``turns``: path of the array of turns with the names of its role and text fields; or ``fields``: (role, field) in
    order, each a turn of its own; optional fields may be missing or null. ``rows``: one table row is one turn.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    paths: tuple[tuple[str, ...], ...] = ()


# Names other layouts use for the two roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text"), paths=(("conv_id", "role", "text", "turn"),)),
    Mapping("messages", turns=("messages", "role", "content"), paths=(("messages[].content", "messages[].role"),)),
    Mapping("from and value", turns=("conversations", "from", "value"), paths=(("conversations[].from", "conversations[].value"),)),
    Mapping(
        "instruction",
        fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
        paths=(("input", "instruction", "output"), ("instruction", "output")),
    ),
    Mapping("prompt", fields=(("user", "prompt"), ("assistant", "completion")), paths=(("completion", "prompt"),)),
    Mapping("question", fields=(("user", "question"), ("assistant", "answer")), paths=(("answer", "question"),)),
)


def fingerprint(paths: Column) -> Column:
    """Hash of a sorted array of paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def layout_hash(paths: Iterable[str]) -> int:
    """The same hash on the driver, as a signed number."""
    return int.from_bytes(xxhash.xxh64_digest("\n".join(sorted(paths)).encode(), 42), "big", signed=True)


LAYOUTS = {layout_hash(p): m for m in MAPPINGS for p in m.paths}


def table_layout(df: DataFrame) -> Mapping:
    """The mapping selected by the fingerprint of the table's nested field paths; columns no layout knows do not count."""
    there = set(field_paths(df.schema))
    seen = [layout_hash(there & set(p)) for m in MAPPINGS for p in sorted(m.paths, key=len, reverse=True)]
    found = next((LAYOUTS[h] for h in (layout_hash(there), *seen) if h in LAYOUTS), None)
    if found is None:
        raise ValueError(f"no mapping for the layout {sorted(there)}")
    return found


# A field's name, the begin or end of an object or a list, or a plain type.
SCHEMA_TOKEN = r"(`(?:[^`]|``)*`: |[^`<>, :]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9,]+\))?)"


def record_paths(record: Column) -> Column:
    """Nested field paths of a JSON text, sorted: of all levels and all items, ``[]`` for those of a list.

    An empty list has the path of its items; an empty object has none. Null where the text is no JSON object.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(schema, F.lit(SCHEMA_TOKEN), F.lit(1))
    none = F.array().cast("array<string>")

    def step(a: Column, token: Column) -> Column:
        """``at`` is the path being read, ``open`` those of the objects and lists around it, innermost last."""
        name = F.replace(F.regexp_replace(token, "^`|`?: $", ""), F.lit("``"), F.lit("`"))
        around = F.element_at(a["open"], -1)
        opened = lambda at: F.struct(at.alias("at"), F.concat(a["open"], F.array(at)).alias("open"), a["paths"].alias("paths"))
        return (
            F.when(token == "OBJECT<", opened(a["at"]))
            .when(token == "ARRAY<", opened(F.concat(a["at"], F.lit("[]"))))
            .when(token == ">", F.struct(a["at"].alias("at"), F.slice(a["open"], 1, F.size(a["open"]) - 1).alias("open"), a["paths"].alias("paths")))
            .when(
                token.endswith(": "),
                F.struct(
                    F.concat(around, F.when(around == "", "").otherwise("."), name).alias("at"),
                    a["open"].alias("open"),
                    a["paths"].alias("paths"),
                ),
            )
            .otherwise(F.struct(a["at"].alias("at"), a["open"].alias("open"), F.concat(a["paths"], F.array(a["at"])).alias("paths")))
        )

    start = F.struct(F.lit("").alias("at"), none.alias("open"), none.alias("paths"))
    paths = F.aggregate(tokens, start, step, lambda a: F.array_sort(F.array_distinct(a["paths"])))
    return F.when(schema.startswith("OBJECT<"), paths)


# ---- canonical turns -----------------------------------------------------------------------


def _turn(role: Column, text: Column) -> Column:
    named = F.coalesce(role, F.lit(""))
    for theirs, ours in ROLES.items():
        named = F.when(named == theirs, F.lit(ours)).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def table_turns(df: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` of a table whose rows are turns."""
    mapping = table_layout(df)
    if mapping.rows is None:
        raise ValueError(f"layout {mapping.name!r} has no turn rows; convert records with record_turns")
    conv, turn, role, text = (F.col(f"`{c}`") for c in mapping.rows)
    rows = df.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), F.struct(
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said")).alias("__row"))
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("__row")).alias("rows"))
    return told.select("conv_id", F.transform("rows", lambda r: r["said"]).alias("turns"))


def record_turns(df: DataFrame, record: str, out: str = "turns") -> DataFrame:
    """``df`` with canonical turns of its JSON records and their layout's fingerprint.

    Records in one column may have different layouts.
    """
    text = F.col(f"`{record}`")
    columns = [F.col(f"`{c}`") for c in df.columns if c not in ("fingerprint", out)]
    there = F.col("__paths")
    turns = F.lit(None).cast(TURNS)
    # The first mapping that fits is the outermost condition.
    for mapping in reversed(MAPPINGS):
        if mapping.rows:
            continue
        if mapping.turns:
            place, role, said = mapping.turns
            kind = f"array<struct<`{role}`:string,`{said}`:string>>"
            listed = F.from_json(F.get_json_object(text, f"$.{place}"), kind)
            found = F.transform(listed, lambda t: _turn(t[role], t[said]))
            turns = F.when(F.array_contains(there, f"{place}[]"), F.coalesce(found, F.array().cast(TURNS))).otherwise(turns)
        else:
            parts = []
            for role, field in mapping.fields:
                value = F.get_json_object(text, f"$.{field}")
                parts.append(F.when(value.isNotNull() & ((value != "") | (F.lit(field) != "input")), _turn(F.lit(role), value)))
            found = F.array_compact(F.array(*parts))
        for paths in sorted(mapping.paths, key=len):
            known = fingerprint(F.array_intersect(there, F.array(*map(F.lit, sorted(paths)))))
            turns = F.when(known == layout_hash(paths), found).otherwise(turns)
    marked = df.withColumn("__paths", record_paths(text))
    return marked.select(*columns, fingerprint(there).alias("fingerprint"), turns.cast(TURNS).alias(out))


# ---- template ------------------------------------------------------------------------------


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("### "), F.lit("\\h ")), F.lit("</turn>"), F.lit("\\t"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\t"), F.lit("</turn>")), F.lit("\\h "), F.lit("### "))
    return F.replace(F.replace(text, F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escaped(turn["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))


def formatted(df: DataFrame, turns: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``: code point ranges (start, end) of the texts to learn from."""
    pieces = F.transform(
        F.col(turns),
        lambda t: F.struct(
            F.length(_head(t)).alias("head"),
            F.concat(_head(t), escaped(t["text"]), F.lit(END)).alias("piece"),
            (t["role"] == LEARNED).alias("learned"),
        ),
    )
    step = df.withColumn("__pieces", pieces)
    sizes = F.transform("__pieces", lambda p: F.struct(p["head"].alias("head"), F.length(p["piece"]).alias("n"), p["learned"].alias("learned")))
    step = step.withColumn("__sizes", sizes)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "__sizes",
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda a, s: F.struct(
            (a["at"] + s["n"]).alias("at"),
            F.when(
                s["learned"],
                F.concat(
                    a["spans"],
                    F.array(F.struct((a["at"] + s["head"]).alias("start"), (a["at"] + s["n"] - len(END)).alias("end"))),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return step.select(
        *(F.col(f"`{c}`") for c in df.columns if c not in ("formatted", "loss_spans")),
        F.array_join(F.transform("__pieces", lambda p: p["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_back(formatted_text: Column) -> Column:
    """The turns that a formatted text stands for."""
    parts = F.split(formatted_text, F.lit(END), -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        colon = F.instr(part, ": ")
        return F.struct(
            unescaped(F.substring(part, F.lit(5), colon - 5)).alias("role"),
            unescaped(F.substring(part, colon + 2, F.length(part))).alias("text"),
        )

    return F.transform(parts, turn)


def learned_text(formatted_text: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss_spans, lambda s: unescaped(F.substring(formatted_text, s["start"] + 1, s["end"] - s["start"]))), ""
    )
