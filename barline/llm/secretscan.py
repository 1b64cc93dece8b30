"""Secret scan by one combined deterministic automaton.

Every rule is a regular expression over ASCII bytes. All rules are compiled into a single
automaton (subset construction over byte classes, then minimisation) whose transition array
reads a text once, from its last byte to its first, and so knows at every byte which rules
have a match that starts there. Only at such places a rule's own automaton, compiled the
same way, looks for the longest end.

The pass runs over many lanes of a batch at once. A lane assumes that it is entered in the
resting state; lanes that were entered in another one are read again until their states meet
those of the first reading.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import cuts

STEPS = 512  # bytes of a lane
SEGMENT = 1 << 20  # bytes that are read together
BATCH = 1 << 20  # bytes of texts that are joined before they are read


@dataclass(frozen=True)
class Rule:
    """Matches of ``head`` then ``value``; those whose value is shorter than ``least`` are
    dropped after they were matched. ``fold``: letters of the head in either case."""

    kind: str
    head: str
    value: str
    least: int = 0
    fold: bool = False


# Kinds in the order in which spans of one start are listed. The first three are
# asked for by contract; the others are published formats of keys. A run of 32 hexadecimal
# digits or more is a whole run in either spelling, so the length is part of the expression.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 8, True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 12),
    Rule("hex", r"", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN\x20", r"([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
    Rule("forge", r"gh[opsur]_", r"[A-Za-z0-9]+", 36),
    Rule("chat", r"xox[abeoprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 16),
)
RULES = BASE + MORE


# ---- expressions ----
class _Reader:
    """Reads literals, ``\\xHH`` and other escapes, classes, groups, ``|`` and ``? * + {m,n}``
    into ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, most)."""

    def __init__(self, text: str, fold: bool):
        self.text, self.at, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        got = self.peek()
        if not got:
            raise ValueError(f"unfinished expression: {self.text}")
        self.at += 1
        return got

    def whole(self) -> tuple:
        node = self.either()
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r} in {self.text}")
        return node

    def either(self) -> tuple:
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def row(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.times(self.one()))
        return ("cat", parts)

    def one(self) -> tuple:
        c = self.take()
        if c == "(":
            node = self.either()
            if self.take() != ")":
                raise ValueError(f"open group in {self.text}")
            return node
        if c == "[":
            return self.members()
        if c in "*+?{" or c in ".^$":
            raise ValueError(f"{c!r} is not supported in {self.text}")
        return self.letters({self.code(c)})

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                c = chr(int(self.take() + self.take(), 16))
            elif c.isalnum():
                raise ValueError(f"\\{c} is not supported in {self.text}")
        if ord(c) > 127:
            raise ValueError(f"rules are ASCII: {self.text}")
        return ord(c)

    def members(self) -> tuple:
        found: set[int] = set()
        while self.peek() != "]":
            low = self.code(self.take())
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.code(self.take())
            found |= set(range(low, high + 1))
        self.take()
        return self.letters(found)

    def letters(self, found: set[int]) -> tuple:
        if self.fold:
            found = found | {b ^ 32 for b in found if chr(b).isalpha()}
        return ("set", frozenset(found))

    def times(self, node: tuple) -> tuple:
        while self.peek() and self.peek() in "*+?{":
            c = self.take()
            if c == "{":
                inner = ""
                while self.peek() != "}":
                    inner += self.take()
                self.take()
                low, comma, high = inner.partition(",")
                least, most = int(low), (int(high) if high else None) if comma else int(low)
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            node = ("rep", node, least, most)
        return node


def read(text: str, fold: bool = False) -> tuple:
    return _Reader(text, fold).whole()


def _backwards(node: tuple) -> tuple:
    if node[0] in ("cat", "alt"):
        parts = [_backwards(p) for p in node[1]]
        return (node[0], parts[::-1] if node[0] == "cat" else parts)
    return ("rep", _backwards(node[1]), *node[2:]) if node[0] == "rep" else node


class _Graph:
    """Nondeterministic automaton: ``free`` steps need no byte, ``steps`` one of a set."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def add(self, node: tuple, at: int) -> int:
        """Lay ``node`` from state ``at``; the state behind it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.steps[at].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                at = self.add(part, at)
            return at
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.free[at].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = node
        for _ in range(least):
            at = self.add(part, at)
        end = self.state()
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
        else:
            self.free[at].append(end)
            for _ in range(most - least):
                at = self.add(part, at)
                self.free[at].append(end)
        return end

    def closed(self, states: set[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``table[state + code]`` is the next state; states are multiples of ``width``, 0 is the
    first one and those from ``accept`` on accept ``marks[state // width]`` (bits of rules).
    ``codes`` maps bytes to codes; the last code leads back to state 0. ``dead``: a state that
    never accepts any more, -1 if there is none."""

    table: np.ndarray
    codes: np.ndarray
    width: int
    accept: int
    marks: np.ndarray
    dead: int


def compiled(nodes: Sequence[tuple], anywhere: bool) -> Automaton:
    """The minimal automaton of all expressions; ``anywhere``: matches may begin at any byte."""
    graph = _Graph()
    first = graph.state()
    ends = {}
    for i, node in enumerate(nodes):
        own = graph.state()
        graph.free[first].append(own)
        ends[graph.add(node, own)] = 1 << i
    sets = sorted({s for steps in graph.steps for s, _ in steps}, key=sorted)
    kinds: dict[tuple, int] = {}
    codes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(codes == k)[0]) for k in range(len(kinds))]
    begin = graph.closed({first})
    known, todo, table = {begin: 0}, [begin], []
    for now in todo:
        row = []
        for b in sample:
            then = {x for q in now for s, x in graph.steps[q] if b in s}
            then = graph.closed(then | {first} if anywhere else then)
            if then not in known:
                known[then] = len(known)
                todo.append(then)
            row.append(known[then])
        table.append(row)
    marks = np.array([sum({ends[q] for q in s if q in ends}) for s in todo], np.int64)
    return _minimal(np.array(table, np.int64), marks, codes)


def _minimal(table: np.ndarray, marks: np.ndarray, codes: np.ndarray) -> Automaton:
    """Merge states that no text tells apart: classes are refined until they are stable."""
    group = np.unique(marks, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    size = int(group.max()) + 1
    member = np.zeros(size, np.int64)
    member[group[::-1]] = np.arange(len(group))[::-1]
    if marks[0]:
        raise ValueError("a rule matches the empty text")
    order = sorted(range(size), key=lambda g: (bool(marks[member[g]]), g != group[0]))
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    width = table.shape[1] + 1
    out = np.zeros((size, width), np.int32)
    out[:, :-1] = place[group[table[member[order]]]] * width
    kept = marks[member[order]]
    stuck = [q for q in range(size) if not kept[q] and (out[q, :-1] == q * width).all()]
    return Automaton(out.reshape(-1), codes, width, int(np.count_nonzero(kept == 0)) * width, kept, stuck[0] * width if stuck else -1)


@dataclass(frozen=True)
class Scanner:
    """``every``: all rules backwards; ``rules``: per rule the automata of the match, its head
    and its value, read forwards from a given byte."""

    kinds: tuple[str, ...]
    least: tuple[int, ...]
    every: Automaton
    rules: tuple[tuple[Automaton, Automaton | None, Automaton], ...]


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if not 0 < len(rules) < 60 or len({r.kind for r in rules}) < len(rules):
        raise ValueError("from 1 to 59 rules of different kinds")
    heads, values = [read(r.head, r.fold) for r in rules], [read(r.value) for r in rules]
    both = [("cat", [h, v]) for h, v in zip(heads, values)]
    parts = tuple((compiled([x], False), compiled([h], False) if r.head else None, compiled([v], False)) for r, x, h, v in zip(rules, both, heads, values))
    return Scanner(tuple(r.kind for r in rules), tuple(r.least for r in rules), compiled([_backwards(x) for x in both], True), parts)


# ---- reading ----
def _pass(auto: Automaton, codes: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Read ``codes`` from state ``entry``: where the state accepts, the states there, and the
    last state. ``codes`` is in reading order."""
    lanes = -(-len(codes) // STEPS)
    rows = np.full(lanes * STEPS, auto.width - 1, np.uint8)
    rows[: len(codes)] = codes
    rows = np.ascontiguousarray(rows.reshape(lanes, STEPS).T)
    states = np.empty((STEPS, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    now[0] = entry
    for t in range(STEPS):
        now = np.take(auto.table, now + rows[t], out=states[t])
    wrong = np.flatnonzero(states[-1, :-1]) + 1
    while len(wrong):
        lane, now = wrong, states[-1, wrong - 1]
        for t in range(STEPS):
            now = auto.table[now + rows[t, lane]]
            differ = now != states[t, lane]
            lane, now = lane[differ], now[differ]
            if not len(lane):
                break
            states[t, lane] = now
        wrong = lane[lane + 1 < lanes] + 1
    t, lane = np.nonzero(states >= auto.accept)
    at = lane * STEPS + t
    last = len(codes) - 1
    return at, states[t, lane], int(states[last % STEPS, last // STEPS])


def begins(auto: Automaton, data: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending bytes at which matches start, and the bits of their rules; no match spans
    one of the bytes ``gaps``."""
    codes = auto.codes[data]
    codes[gaps] = auto.width - 1
    entry, at, marks = 0, [], []
    for stop in range(len(codes), 0, -SEGMENT):
        found, states, entry = _pass(auto, codes[max(0, stop - SEGMENT) : stop][::-1], entry)
        at.append(stop - 1 - found)
        marks.append(auto.marks[states // auto.width])
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, marks = np.concatenate(at), np.concatenate(marks)
    order = np.argsort(at)
    return at[order], marks[order]


def _ends(auto: Automaton, data: bytes, start: int, stop: int) -> list[int]:
    """Ends of the matches that start at ``start`` and end by ``stop``, ascending."""
    table, codes, state, out = auto.table, auto.codes, 0, []
    for i in range(start, stop):
        state = int(table[state + int(codes[data[i]])])
        if state >= auto.accept:
            out.append(i + 1)
        elif state == auto.dead:
            break
    return out


def _value_at(rule: tuple, data: bytes, start: int, end: int) -> int:
    """Where the value of the match begins: behind its longest head that leaves a value."""
    _, head, value = rule
    for at in reversed(_ends(head, data, start, end) if head else [start]):
        if end in _ends(value, data, at, end)[-1:]:
            return at
    return start


def spans(scan: Scanner, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(rule, start, stop) of every text, by start, then rule, in code points. A rule's matches
    are leftmost, longest and do not overlap; texts are whole."""
    data = b"\n".join(texts)
    edge = np.array(cuts(len(t) + 1 for t in texts), np.int64)
    raw = np.frombuffer(data, np.uint8)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at, marks = begins(scan.every, raw, edge[1:-1] - 1)
    if not len(at):
        return out
    doc = np.searchsorted(edge, at, side="right") - 1
    inner = np.flatnonzero((raw & 0xC0) == 0x80)
    before = lambda i: int(np.searchsorted(inner, i))
    for r, rule in enumerate(scan.rules):
        mine, done = np.flatnonzero(marks >> r & 1), 0
        for d, start in zip(doc[mine].tolist(), at[mine].tolist()):
            if start < done:
                continue
            end = _ends(rule[0], data, start, int(edge[d + 1]) - 1)[-1]
            done = end
            if scan.least[r] and end - _value_at(rule, data, start, end) < scan.least[r]:
                continue
            a = int(edge[d])
            out[d].append((r, start - a - before(start) + before(a), end - a - before(end) + before(a)))
    for found in out:
        found.sort(key=lambda x: (x[1], x[0]))
    return out


def _scan(scan: Scanner):
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo, held = batch.column("text").to_pylist(), 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= BATCH or i + 1 == len(texts):
                    found = spans(scan, texts[lo : i + 1])
                    named = [[{"kind": scan.kinds[r], "start": a, "stop": z} for r, a, z in x] for x in found]
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, i + 1 - lo), pa.array(named, pa.list_(kind))], names=["id", "spans"])
                    lo, held = i + 1, 0

    return run


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row: all matches of ``rules`` in the whole text, as (kind, start, stop)
    by start, then in the order of ``rules``; code points, stop exclusive.

    A rule's matches are leftmost, longest and never overlap each other; those of different
    rules may. No shuffle; memory is that of a batch of about ``BATCH`` bytes or of one longer
    text. Null and empty texts have no spans; repeated rows and null or equal ids are rows of
    their own; an empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(scanner(tuple(rules))), f"id {kind}, spans array<struct<kind: string, start: long, stop: long>>")
