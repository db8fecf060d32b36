"""Secret scans: all rules compiled into one automaton that reads each text's bytes once.

The combined automaton starts a match at every byte, and its states tell which rules' matches end there. One pass over the
UTF-8 bytes so gives the ends of all rules' shortest matches; what may follow a shortest match is left out of the automaton,
which keeps it at a few thousand states. From an end, the rule is read back to the leftmost start and on to the longest end,
so only bytes in and around matches are read again.

Defined cases: a null text counts as empty; spans count code points, ends are exclusive; per kind, matches are leftmost,
longest and do not overlap, and a match shorter than its rule asks is dropped but still consumed; different kinds may
overlap; a private key reaches to its END line, or without one to the end of its base64, where a first word that begins
the next line is taken too, as it could be the key's; texts are read whole; repeated rows are scanned each on its own. Rows and all other columns stay untouched.
"""

from __future__ import annotations

from functools import cache, cached_property
from itertools import accumulate
from operator import getitem, itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphlake.llm.automaton import Dfa, but, chars, compiled, either, many, maybe, mirrored, seq, shortest, some, text

SPANS = "array<struct<kind:string,start:int,end:int>>"


class Rule(NamedTuple):
    kind: str
    pattern: tuple
    least: int = 1  # characters of the match
    valued: bool = False  # count those of the value alone: after the separator, spaces and a quote
    tails: tuple[tuple, ...] = (seq(),)  # a match runs on over the longest of these; one of them can be empty


_VALUE = "A-Za-z0-9+/_.=-"
_QUOTE = maybe(chars("\"'"))
_GAP = many(chars(" "))

# Private keys: all from the first line to the END line, if only what keys are written with lies between (base64, gaps,
# quotes, escapes, header lines). Without END: header lines, then base64 in long runs or at the start of lines.
_KEY = text("PRIVATE KEY-----")
_NAMED = many(chars("A-Z "))
_BASE64 = chars("A-Za-z0-9+/=")
_LINE_END = either(text("\r\n"), chars("\r\n"), text("\\r\\n"), text("\\n"))
_BLANK = either(*(("seq", tuple(chars(chr(b)) for b in c.encode())) for c in ("\u00a0", "\u200b", "\ufeff")))
_BESIDE = either(chars(" \t\r\n\x0b\x0c\\\"',>|#*"), _BLANK)


def _undashed(part: tuple) -> tuple:
    """Repeats of ``part`` with at most four dashes before each."""
    dash = text("-")
    return many(seq(*[maybe(dash)] * 4, part))


_HEADING = seq(_LINE_END, chars("A-Za-z"), many(chars("A-Za-z0-9-")), text(":"), _undashed(but("\r\n-")))
_LONG = seq(many(either(_BESIDE, text("\\n"), text("\\r"), text("\\t"))), some(_BASE64, 32))
_UNENDED = many(either(_LONG, seq(_LINE_END, many(chars(" \t")), some(_BASE64))))
_ENDED = seq(_undashed(either(_BASE64, _BESIDE, chars(":;<"), _HEADING)), text("-----END "), _NAMED, _KEY)

BASE = (
    Rule(
        "assign",
        seq(
            either(
                *(text(w, True) for w in ("password", "passwd", "secret", "token")),
                seq(text("api", True), maybe(chars("_")), text("key", True)),
            ),
            *(_QUOTE, _GAP, chars(":="), _GAP, _QUOTE),
            some(chars(_VALUE)),
        ),
        8,
        True,
    ),
    Rule("access", seq(text("AKIA"), some(chars("A-Z0-9"))), 16),
    Rule("hex", some(chars("0-9a-f"), 32), 32),
)
# Published forms of tokens and keys.
MORE = (
    Rule("forge", seq(text("gh"), chars("pousr"), text("_"), some(chars("A-Za-z0-9"))), 24),
    Rule("chat", seq(text("xox"), chars("abprs"), text("-"), some(chars("A-Za-z0-9-"))), 16),
    Rule("cloud", seq(text("AIza"), some(chars("A-Za-z0-9_-"))), 35),
    Rule("pay", seq(text("sk_"), either(text("live"), text("test")), text("_"), some(chars("A-Za-z0-9"))), 16),
    Rule("jwt", seq(text("eyJ"), *[some(chars("A-Za-z0-9_-")), text(".")] * 2, some(chars("A-Za-z0-9_-"))), 32),
    Rule("pem", seq(text("-----BEGIN "), _NAMED, _KEY), tails=(_ENDED, _UNENDED, seq(some(_HEADING), _LONG, _UNENDED))),
    Rule("login", seq(text("://"), some(but("\x00- /:@")), text(":"), some(but("\x00- /:@")), text("@"))),
)
RULES = BASE + MORE


def _rows(dfa: Dfa) -> list[list]:
    """Rows that hold the next rows themselves, so that a step is one subscript; item 256 is the accepted set."""
    rows: list[list] = [[] for _ in dfa.table]
    for row, targets, mark in zip(rows, dfa.table, dfa.accepts):
        row += [rows[t] for t in targets]
        row.append(mark)
    return rows


class _Locator:
    """The matches of a single rule around the ends it is given."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.back, self.back_dead = self._anchored(mirrored(rule.pattern))

    @staticmethod
    def _anchored(pattern: tuple) -> tuple[list, list | None]:
        dfa = compiled([pattern], anywhere=False)
        rows = _rows(dfa)
        return rows[0], None if dfa.dead is None else rows[dfa.dead]

    @cached_property
    def ahead(self) -> list[tuple[list, list | None]]:
        """Made when a match is met: those of long tails take seconds."""
        return [self._anchored(seq(self.rule.pattern, tail)) for tail in self.rule.tails]

    def all(self, data: bytes, ends: list[list[int]]) -> list[tuple[int, int]]:
        """Leftmost, longest matches that do not overlap; ``ends`` lists first and last of neighbouring ends of shortest matches."""
        found, at = [], 0
        for low, high in ends:
            place = max(low, at + 1)
            while place <= high:
                start = self._leftmost(data, at, place)
                if start < 0:  # the match begins inside the one before
                    place += 1
                    continue
                at = self._longest(data, start, place)
                if self._long_enough(data, start, at):
                    found.append((start, at))
                place = at + 1
        return found

    def _leftmost(self, data: bytes, least: int, end: int) -> int:
        row, start = self.back, -1
        for i in range(end - 1, least - 1, -1):
            row = row[data[i]]
            if row is self.back_dead:
                break
            if row[256]:
                start = i
        return start

    def _longest(self, data: bytes, start: int, end: int) -> int:
        for row, dead in self.ahead:
            for i in range(start, len(data)):
                row = row[data[i]]
                if row is dead:
                    break
                if row[256]:
                    end = max(end, i + 1)
        return end

    def _long_enough(self, data: bytes, start: int, end: int) -> bool:
        if self.rule.valued:
            while data[start] not in b":=":
                start += 1
            start += 1
            while data[start] == 32:
                start += 1
            start += data[start] in b"\"'"
        return end - start >= self.rule.least


class Scanner:
    """The compiled rules in a Python worker."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.start = _rows(compiled([shortest(r.pattern) for r in rules], anywhere=True))[0]
        self.locators = [_Locator(r) for r in rules]

    def ends(self, data: bytes) -> dict[int, list[list[int]]]:
        """Ends of shortest matches by number of the rule, neighbouring ones as one pair of first and last."""
        marks = map(itemgetter(256), accumulate(data, getitem, initial=self.start))
        found: dict[int, list[list[int]]] = {}
        for place, bits in filter(itemgetter(1), enumerate(marks)):
            while bits:
                runs = found.setdefault((bits & -bits).bit_length() - 1, [])
                bits &= bits - 1
                if runs and runs[-1][1] == place - 1:
                    runs[-1][1] = place
                else:
                    runs.append([place, place])
        return found

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """Kind, start and end in bytes, ordered by start, then by the rules' order."""
        found = sorted((start, number, end) for number, ends in self.ends(data).items() for start, end in self.locators[number].all(data, ends))
        return [(self.rules[number].kind, start, end) for start, number, end in found]


@cache
def _scanner() -> Scanner:
    return Scanner()


def _code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same spans counted in code points; spans begin and end between characters."""
    if data.isascii():
        return spans
    places, at, count = {}, 0, 0
    for place in sorted({p for _, a, b in spans for p in (a, b)}):
        count += len(data[at:place].decode(errors="replace"))
        at = place
        places[place] = count
    return [(kind, places[a], places[b]) for kind, a, b in spans]


def _spans_of(texts: pa.Array) -> pa.Array:
    scanner = _scanner()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = []
    for value in texts.cast(pa.binary()).to_pylist():
        found = scanner.spans(value) if value else []
        rows.append([{"kind": k, "start": a, "end": b} for k, a, b in _code_points(value, found)] if found else [])
    return pa.array(rows, kind)


def _redacted(texts: pa.Array) -> pa.Array:
    scanner = _scanner()
    rows = []
    for value in texts.cast(pa.binary()).to_pylist():
        found = scanner.spans(value) if value else []
        parts, at = [], 0
        for kind, start, end in found:
            if start >= at:
                parts += [value[at:start], b"[", kind.encode(), b" removed]"]
            at = max(at, end)
        rows.append(b"".join([*parts, value[at:]]).decode(errors="replace") if found else value)
    return pa.array([r.decode(errors="replace") if isinstance(r, bytes) else r for r in rows], pa.string())


def secret_spans(text: Column | str) -> Column:
    """All spans of secrets in a text, ordered by start, then as the rules are listed."""
    return F.arrow_udf(_spans_of, SPANS)(text)


def redact(text: Column | str) -> Column:
    """The text with a mark in place of every secret; overlapping spans become one mark of the first one's kind.

    A null text stays null.
    """
    return F.arrow_udf(_redacted, "string")(text)
