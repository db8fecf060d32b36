"""String rules of ids, paths, payloads, headers and report lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and formats of the document model.
DATA_URI = r"^data:image[^,]*,"
BASE64_HEAD = r"^[\p{L}\p{N}+/=]{100}"
TRACE_VERSION = "00"
TRACE_ID_LENGTH = 32
PARENT_ID_LENGTH = 16
API_KEY_PREFIX = "api_key:"
UNKNOWN_CLIENT = "unknown"
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits of the whole text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), F.lit(0))


def doc_id(icon: Column | str, tag: Column | str) -> Column:
    return F.concat(_col(icon), F.lit("_"), _col(tag))


def filename_stem(path: Column | str) -> Column:
    """Base name without its last extension; leading dots belong to the name."""
    base = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.regexp_replace(base, r"^(\.*[^.].*)\.[^.]*$", "$1")


def strip_data_uri(payload: Column | str) -> Column:
    return F.regexp_replace(_col(payload), DATA_URI, "")


def looks_base64(payload: Column | str) -> Column:
    return (F.length(_col(payload)) > 100) & _col(payload).rlike(BASE64_HEAD)


def image_payload_kind(payload: Column | str) -> Column:
    """How an image given as a string is to be read: data_uri, base64 or path."""
    return (
        F.when(_col(payload).startswith("data:image"), F.lit("data_uri"))
        .when(looks_base64(payload), F.lit("base64"))
        .otherwise(F.lit("path"))
    )


def parse_traceparent(header: Column | str) -> Column:
    """Struct of the four header parts, or null when the header is malformed."""
    parts = F.split(_col(header), "-", -1)
    part = [F.get(parts, F.lit(i)) for i in range(4)]
    valid = (
        (F.size(parts) == 4)
        & (part[0] == TRACE_VERSION)
        & (F.length(part[1]) == TRACE_ID_LENGTH)
        & (F.length(part[2]) == PARENT_ID_LENGTH)
    )
    names = ["version", "trace_id", "parent_id", "flags"]
    return F.when(valid, F.struct(*[p.alias(n) for p, n in zip(part, names, strict=True)]))


def forwarded_client(forwarded: Column | str, real_ip: Column | str, socket: Column | str) -> Column:
    """First forwarded address, else the proxy's, else the socket's, else a fixed word."""
    return F.coalesce(
        F.when(_col(forwarded) != "", F.trim(F.get(F.split(_col(forwarded), ","), F.lit(0)))),
        F.nullif(_col(real_ip), F.lit("")),
        F.nullif(_col(socket), F.lit("")),
        F.lit(UNKNOWN_CLIENT),
    )


def client_key(known_key: Column | str, forwarded: Column | str, real_ip: Column | str, socket: Column | str) -> Column:
    """Rate-limit key: the valid api key if there is one (null otherwise), else the address."""
    return F.coalesce(F.concat(F.lit(API_KEY_PREFIX), _col(known_key)), forwarded_client(forwarded, real_ip, socket))


def display_type(icon_type: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(icon_type), F.lit("")), F.lit("icon"))


def display_score(score: Column | str) -> Column:
    return F.format_string("%.3f", _col(score))


def parse_attributes(text: Column | str) -> Column:
    """MAP of ``k=v`` pairs split at commas; pairs without ``=`` are skipped, the last key wins."""
    pairs = F.transform(
        F.filter(F.split(_col(text), ","), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.trim(F.substring_index(p, "=", 1)).alias("key"),
            F.trim(F.substr(p, F.instr(p, "=") + F.lit(1))).alias("value"),
        ),
    )
    last = F.aggregate(
        pairs,
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda kept, p: F.concat(F.filter(kept, lambda k: k["key"] != p["key"]), F.array(p)),
    )
    return F.map_from_entries(last)


def format_hit(
    rank: Column | str,
    name: Column | str,
    score: Column | str,
    icon_type: Column | str,
    release_tag: Column | str,
    descriptions: Column | str,
) -> Column:
    """The text block of one hit: title, then type, release and descriptions where present."""
    listed = _col(descriptions)
    more = F.size(listed) - 3
    # Ties go to the even digit: 0.03125 is shown as 0.0312.
    four_decimals = F.call_function("format_number", _col(score).cast("double"), F.lit("0.0000"))
    described = F.concat(
        F.lit("   Descriptions: "),
        F.array_join(F.slice(listed, 1, 3), ", "),
        F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(F.lit("")),
    )
    return F.concat_ws(
        "\n",
        F.format_string("%d. %s (score: %s)", _col(rank), _col(name), four_decimals),
        F.when(_col(icon_type) != "", F.concat(F.lit("   Type: "), _col(icon_type))),
        F.when(_col(release_tag) != "", F.concat(F.lit("   Release: "), _col(release_tag))),
        F.when(F.size(listed) > 0, described),
    )


def report_title(total: Column | str, shown: Column | str) -> Column:
    """First line of a report, or the whole report when nothing matched."""
    return F.when(_col(shown) == 0, F.format_string("No results found (total: %d)", _col(total))).otherwise(
        F.format_string("Found %d total matches, showing top %d:", _col(total), _col(shown))
    )
