"""Regular expressions as transition arrays: combinators, subset construction, minimisation."""

from __future__ import annotations

from collections.abc import Iterable

# ---- expressions: nested tuples made by these functions ------------------------------------


def chars(spec: str) -> tuple:
    """One byte out of ranges like ``A-Z0-9_``; a last ``-`` stands for itself."""
    found, i = set(), 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            found |= set(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            found.add(ord(spec[i]))
            i += 1
    return ("set", frozenset(found))


def but(spec: str) -> tuple:
    """One byte outside of the ranges."""
    return ("set", frozenset(range(256)) - chars(spec)[1])


def text(value: str, either_case: bool = False) -> tuple:
    steps = [{ord(c.lower()), ord(c.upper())} if either_case else {ord(c)} for c in value]
    return ("seq", tuple(("set", frozenset(s)) for s in steps))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def either(*parts: tuple) -> tuple:
    return ("alt", parts)


def many(part: tuple) -> tuple:
    return ("star", part)


def maybe(part: tuple) -> tuple:
    return either(part, seq())


def some(part: tuple, least: int = 1) -> tuple:
    return seq(*[part] * least, many(part))


def mirrored(part: tuple) -> tuple:
    """The expression of all strings read backwards."""
    kind, inner = part
    if kind == "set":
        return part
    if kind == "star":
        return many(mirrored(inner))
    turned = tuple(map(mirrored, inner))
    return (kind, turned[::-1] if kind == "seq" else turned)


def _can_be_empty(part: tuple) -> bool:
    kind, inner = part
    return kind == "star" or (kind != "set" and (all if kind == "seq" else any)(map(_can_be_empty, inner)))


def shortest(part: tuple) -> tuple:
    """The expression without what may follow a match: it keeps every match that has no shorter one from the same start."""
    kind, inner = part
    if kind == "alt":
        return (kind, tuple(map(shortest, inner)))
    if kind != "seq":
        return part
    last = len(inner)
    while last and _can_be_empty(inner[last - 1]):
        last -= 1
    return (kind, (*inner[: last - 1], shortest(inner[last - 1]))) if last else (kind, ())


# ---- states --------------------------------------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.steps: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def add(self, part: tuple, start: int) -> int:
        """Append an expression after ``start``; the state where it ends."""
        kind, inner = part
        if kind == "set":
            here, after = self.state(), self.state()
            self.empty[start].append(here)
            self.steps[here] = (inner, after)
            return after
        if kind == "seq":
            for x in inner:
                start = self.add(x, start)
            return start
        if kind == "alt":
            after = self.state()
            for x in inner:
                self.empty[self.add(x, start)].append(after)
            return after
        hub = self.state()
        self.empty[start].append(hub)
        self.empty[self.add(inner, hub)].append(hub)
        after = self.state()
        self.empty[hub].append(after)
        return after

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        # States without a step matter only when they accept; they stay, being few.
        return frozenset(seen)


class Dfa:
    """``table[state][byte]`` is the next state, state 0 the start; ``accepts[state]`` a bit set of rules.

    ``dead`` is the state that no longer accepts, if there is one.
    """

    def __init__(self, table: list[list[int]], accepts: list[int], dead: int | None):
        self.table, self.accepts, self.dead = table, accepts, dead


def compiled(parts: list[tuple], anywhere: bool) -> Dfa:
    """The minimal automaton of several expressions at once; with ``anywhere``, matches may start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {nfa.add(part, start): number for number, part in enumerate(parts)}
    # Bytes that no expression tells apart share a class.
    sets = {step[0] for step in nfa.steps if step}
    signature: dict[tuple, int] = {}
    klass = [signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)]
    sample = [klass.index(k) for k in range(len(signature))]

    def bits(states: frozenset[int]) -> int:
        return sum(1 << ends[s] for s in states if s in ends)

    first = nfa.closed([start])
    number, order, table = {first: 0}, [first], []
    for states in order:
        row = []
        for byte in sample:
            moved = {nfa.steps[s][1] for s in states if nfa.steps[s] and byte in nfa.steps[s][0]}
            if anywhere:
                moved.add(start)
            after = nfa.closed(moved)
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        table.append(row)
    table, marks = _minimal(table, [bits(s) for s in order])
    dead = next((i for i, row in enumerate(table) if not marks[i] and all(x == i for x in row)), None)
    return Dfa([[row[klass[b]] for b in range(256)] for row in table], marks, dead)


def _minimal(table: list[list[int]], marks: list[int]) -> tuple[list[list[int]], list[int]]:
    """Merge states that no continuation tells apart: groups are split until they are stable."""
    numbers: dict = {}
    group = [numbers.setdefault(m, len(numbers)) for m in marks]
    count = len(numbers)
    while True:
        numbers = {}
        group = [numbers.setdefault((g, *[group[x] for x in row]), len(numbers)) for g, row in zip(group, table)]
        if len(numbers) == count:
            break
        count = len(numbers)
    # State 0 stays the start because groups are numbered as met.
    merged: list[list[int] | None] = [None] * count
    kept = [0] * count
    for g, row, mark in zip(group, table, marks):
        if merged[g] is None:
            merged[g], kept[g] = [group[x] for x in row], mark
    return merged, kept
