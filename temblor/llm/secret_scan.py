"""Secrets in texts, found by one deterministic automaton for all rules.

Rules are regular expressions over ASCII bytes: a head, then a run whose length
counts. Each becomes an automaton by subset construction; its states are the
places the expression may be at, by where a match began, oldest first, so that
the leftmost longest match wins and the search goes on behind it. The product of
all of them, minimised, is one transition array. One pass over the bytes of a
text tells where matches of any rule end; the rule read backwards from there
tells where the match begins. Matches whose run is too short are dropped after
they were found, as they hide what lies inside them.

A rule must be greedy in a plain way, checked when it is compiled: once a match
may end, each byte that keeps it alive must let it end too, and no later start
may be done before an earlier one. The array depends on the rules alone and is
sent to every task.

Defined cases: a null text has no secrets, like an empty one; rows are scanned
each for itself, so repeated rows and ids give repeated results; texts of any
length are scanned whole; matches of different kinds may overlap; an empty table
gives an empty one; further columns are carried along, one with the name of the result is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: No byte of UTF-8; stands behind every text and in no rule.
END = 0xFF
FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """What a secret looks like; ``least`` code points of the run make it one."""

    kind: str
    head: str
    run: str
    least: int
    any_case: bool = False  # letters of the head in either case


#: Assignments, access keys and long hexadecimal numbers.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 16),
    Rule("hex", r"", r"[0-9a-f]{8,}", 24),  # a run is taken whole, so that shorter ones need not be found first
)
#: Published forms of keys. Each rule multiplies the states; these end at some 9,000.
MORE = (
    Rule("github", r"gh[oprsu]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", r"AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("stripe", r"[rs]k_live_", r"[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 10),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY", r"-----", 5),
)


class _Parser:
    """Reads literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{m,n}`` into nested tuples."""

    def __init__(self, pattern: str, any_case: bool):
        self.left, self.any_case = list(pattern[::-1]), any_case

    def peek(self) -> str:
        return self.left[-1] if self.left else ""

    def byte(self) -> int:
        c = self.left.pop()
        if c == "\\":
            c = self.left.pop()
            if c == "x":
                return int(self.left.pop() + self.left.pop(), 16)
            if c.isalnum():
                raise ValueError(f"escape \\{c} is not known")
        return ord(c)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(found)

    def one_of(self) -> frozenset[int]:
        self.left.pop()
        negated, found = self.peek() == "^", set()
        if negated:
            self.left.pop()
        while self.peek() != "]":
            low = high = self.byte()
            if self.peek() == "-" and self.left[-2] != "]":
                self.left.pop()
                high = self.byte()
            found |= set(range(low, high + 1))
        self.left.pop()
        found = self.cased(found)
        return frozenset(range(128)) - found if negated else found  # characters beyond ASCII are in no class

    def either(self):
        ways = [self.sequence()]
        while self.peek() == "|":
            self.left.pop()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", *ways)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            if self.peek() == "(":
                self.left.pop()
                part = self.either()
                self.left.pop()
            elif self.peek() == "[":
                part = ("set", self.one_of())
            else:
                part = ("set", self.cased({self.byte()}))
            parts.append(self.repeated(part))
        return ("then", *parts)

    def repeated(self, part):
        mark = self.peek()
        if mark in ("?", "*", "+") and mark:
            self.left.pop()
            return ("times", part, int(mark == "+"), 1 if mark == "?" else None)
        if mark == "{":
            self.left.pop()
            text = ""
            while self.peek() != "}":
                text += self.left.pop()
            self.left.pop()
            low, comma, high = text.partition(",")
            return ("times", part, int(low), int(high) if high else None if comma else int(low))
        return part


class Places:
    """An expression as places (sets of bytes) with the places that may come first, last and next."""

    def __init__(self, pattern: str, any_case: bool = False):
        parser = _Parser(pattern, any_case)
        tree = parser.either()
        if parser.left:
            raise ValueError(f"the expression ends before {''.join(parser.left[::-1])!r}")
        self.sets: list[frozenset[int]] = []
        self.next: list[set[int]] = []
        self.empty, first, last = self._build(tree)
        self.first, self.last = frozenset(first), frozenset(last)

    def _build(self, node) -> tuple[bool, set[int], set[int]]:
        kind, *parts = node
        if kind == "set":
            self.sets.append(parts[0])
            self.next.append(set())
            return False, {len(self.sets) - 1}, {len(self.sets) - 1}
        if kind == "or":
            built = [self._build(x) for x in parts]
            return any(x[0] for x in built), set().union(*(x[1] for x in built)), set().union(*(x[2] for x in built))
        if kind == "then":
            return self._joined([self._build(x) for x in parts])
        part, low, high = parts
        copies = [self._build(part) for _ in range(max(low, 1) if high is None else high)]
        if high is None:
            for k in copies[-1][2]:
                self.next[k] |= copies[-1][1]
        return self._joined([(x[0] or k >= low, x[1], x[2]) for k, x in enumerate(copies)])

    def _joined(self, built) -> tuple[bool, set[int], set[int]]:
        empty, first, last = True, set(), set()
        for part_empty, part_first, part_last in built:
            for k in last:
                self.next[k] |= part_first
            first = first | part_first if empty else first
            last = last | part_last if part_empty else part_last
            empty = empty and part_empty
        return empty, first, last

    def then(self, run: Places) -> Places:
        """This expression followed by another."""
        out, shift = Places.__new__(Places), len(self.sets)
        first, last = {k + shift for k in run.first}, {k + shift for k in run.last}
        out.sets = self.sets + run.sets
        out.next = [x | first if k in self.last else set(x) for k, x in enumerate(self.next)]
        out.next += [{k + shift for k in x} for x in run.next]
        out.empty = self.empty and run.empty
        out.first = frozenset(self.first | first if self.empty else self.first)
        out.last = frozenset(last | self.last if run.empty else last)
        return out

    def backwards(self) -> Places:
        """The same expression for the bytes in reverse."""
        out = Places.__new__(Places)
        out.sets, out.empty, out.first, out.last = self.sets, self.empty, self.last, self.first
        out.next = [{k for k, after in enumerate(self.next) if x in after} for x in range(len(self.sets))]
        return out

    def step(self, at: frozenset[int] | None, byte: int) -> frozenset[int]:
        """Places after one more byte; None is the place before all of them."""
        return frozenset(x for x in (self.first if at is None else set().union(*(self.next[k] for k in at)))
                         if byte in self.sets[x])


def explored(begin, step, n_classes: int) -> tuple[list, list[list]]:
    """All states reached from ``begin`` and their rows of (state, extra) by class."""
    number, states, rows = {begin: 0}, [begin], []
    for state in states:
        row = []
        for c in range(n_classes):
            to, extra = step(state, c)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append((number[to], extra))
        rows.append(row)
    return states, rows


class Longest:
    """An automaton that tells how far an expression can match from one place on."""

    def __init__(self, places: Places, samples: list[int]):
        states, rows = explored(None, lambda s, c: (places.step(s, samples[c]), None), len(samples))
        self.rows = [[to for to, _ in row] for row in rows]
        self.dead = [s is not None and not s for s in states]
        self.done = [places.empty if s is None else bool(s & places.last) for s in states]

    def reach(self, codes) -> int:
        """Bytes of the longest match at the beginning of ``codes``, -1 if there is none."""
        state, best = 0, 0 if self.done[0] else -1
        for k, c in enumerate(codes):
            state = self.rows[state][c]
            if self.done[state]:
                best = k + 1
            elif self.dead[state]:
                break
        return best


def searcher(places: Places, samples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions by [state, class] of a rule's search, and which of them end a match."""
    if places.empty:
        raise ValueError("a rule must not match nothing")

    def step(groups: tuple, c: int):
        ended = False
        if groups and groups[0] & places.last:
            on = places.step(groups[0], samples[c])
            if on:
                if not on & places.last:
                    raise ValueError("a match that may end must stay so until it ends")
                return (on,), False
            groups, ended = (), True
        found, seen = [], frozenset()
        for group in (*groups, None):
            on = places.step(group, samples[c]) - seen
            if not on:
                continue
            found.append(on)
            seen |= on
            if on & places.last:
                if len(found) > 1:
                    raise ValueError("a later match must not end before an earlier one may")
                break
        return tuple(found), ended

    _, rows = explored((), step, len(samples))
    table = np.array(rows, dtype=np.int64)
    return table[:, :, 0], table[:, :, 1].astype(bool)


def combined(searches: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the product of all searches, and by state a bit for each rule whose match ended there."""
    sizes = [len(t) for t, _ in searches] + [1 << len(searches)]
    if np.prod([float(x) for x in sizes]) > 2 ** 62:
        raise ValueError("too many rules for one automaton")
    weights = np.cumprod([1, *sizes[:-1]])

    def after(states: np.ndarray) -> np.ndarray:
        keys = 0
        for k, (table, ended) in enumerate(searches):
            at = states // weights[k] % sizes[k]
            keys = keys + table[at] * weights[k] + (ended[at].astype(np.int64) << k) * weights[-1]
        return keys

    known = frontier = np.zeros(1, dtype=np.int64)
    while len(frontier):
        frontier = np.setdiff1d(after(frontier), known)
        known = np.union1d(known, frontier)
    return np.searchsorted(known, after(known)), known // weights[-1]


def minimised(table: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least automaton with the same ends; state 0 stays the first, states with ends come last."""
    block, count = np.unique(ends, return_inverse=True)[1], 0
    while block.max() + 1 > count:
        count = block.max() + 1
        block = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
    one = np.zeros(count, dtype=np.int64)
    one[block] = np.arange(len(block))
    order = np.lexsort((np.arange(count) != block[0], ends[one] != 0))
    place = np.empty(count, dtype=np.int64)
    place[order] = np.arange(count)
    return place[block[table[one[order]]]], ends[one[order]]


class Scanner:
    """The automaton of a set of rules, with what finds the beginning of a match."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = rules
        heads = [Places(r.head, r.any_case) for r in rules]
        whole = [head.then(Places(r.run)) for head, r in zip(heads, rules)]
        sets = {s for p in (*whole, *heads) for s in p.sets}
        kinds: dict[tuple, int] = {}
        classes = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        samples = [classes.index(k) for k in range(len(kinds))]
        table, ends = minimised(*combined([searcher(p, samples) for p in whole]))
        width = len(samples)
        self.states = len(table)
        self.classes, self.table = bytes(classes), (table * width).astype(np.int64).ravel().tolist()
        self.hot = int((ends == 0).sum()) * width
        self.ends = {k * width: [r for r in range(len(rules)) if int(e) >> r & 1] for k, e in enumerate(ends) if e}
        self.back = [Longest(p.backwards(), samples) for p in whole]
        self.heads = [Longest(p, samples) for p in heads]

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """``(kind, start, end)`` in code points, by start and then by rule."""
        if not text:
            return []
        data = text.encode("utf-8")
        codes = (data + b"\xff").translate(self.classes)
        table, hot, state, ended = self.table, self.hot, 0, []
        for at, code in enumerate(codes):
            state = table[state + code]
            if state >= hot:
                ended.append((at, state))
        found, done = [], [0] * len(self.rules)
        for at, state in ended:
            for r in self.ends[state]:
                start = at - self.back[r].reach(reversed(memoryview(codes)[done[r]:at]))
                done[r] = at
                run = start + self.heads[r].reach(memoryview(codes)[start:at])
                if len(data[run:at].decode("utf-8")) >= self.rules[r].least:
                    found.append((start, r, at))
        found.sort()
        if len(data) != len(text):
            places, last, count = {}, 0, 0
            for x in sorted({x for start, _, end in found for x in (start, end)}):
                count += len(data[last:x].decode("utf-8"))
                places[x], last = count, x
            found = [(places[start], r, places[end]) for start, r, end in found]
        return [(self.rules[r].kind, start, end) for start, r, end in found]


@cache
def packed(rules: tuple[Rule, ...]) -> bytes:
    """The scanner of the rules, compiled once per driver."""
    return pickle.dumps(Scanner(rules))


@cache
def _unpacked(data: bytes) -> Scanner:
    return pickle.loads(data)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array of ``kind, start, end`` (code points, end exclusive), by start and then by rule."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(tuple(rules)))

    @F.pandas_udf(FOUND)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _unpacked(shared.value)
        for part in texts:
            yield part.map(lambda body: [{"kind": k, "start": s, "end": e} for k, s, e in scanner.scan(body)])

    return docs.withColumn(out, run(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def redacted(text: str, spans) -> str:
    """The text with each span, or spans that touch each other, replaced by ``[kind]`` of the first."""
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """``docs`` with secrets replaced by their kind in brackets; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(tuple(rules)))

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _unpacked(shared.value)
        for part in texts:
            yield part.map(lambda body: None if body is None else redacted(body, scanner.scan(body)))

    return docs.withColumn(text, run(F.col(f"`{text}`")))
