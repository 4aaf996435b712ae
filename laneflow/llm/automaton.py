"""One deterministic automaton for many secret rules, scanned in one byte pass.

Compilation: a rule's regex becomes an NFA, the subset construction makes it a
DFA, and a second construction over ordered sets of live starts turns that into
a machine which finds leftmost-longest, non-overlapping matches.  The machines
of all rules run in lockstep: their reachable product is minimised by partition
refinement and laid out as one transition array over byte classes.

A transition may carry the rules whose match has just ended.  A match's start is
found by running the reversed rule backwards from its end.

Rules are byte regexes over literals, classes, groups, ``|``, ``? * + {m,n}``.
Once a rule has matched, every further byte must either extend the match or end
it; rules that would need to look back are refused at compile time.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np

END = 256  # the symbol behind the last byte


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  Matches whose ``group`` is shorter than ``least`` bytes are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# The kinds every caller can rely on, in the order that breaks ties.
# {24,} states the least length inside the rule: with one class only, a shorter match
# swallows nothing that could belong to a longer one, and the many short runs of such
# characters in prose end no match.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published token formats beyond those.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# ---------------------------------------------------------------- regex to NFA


class _Parser:
    """Recursive descent over the regex; builds NFA edges (state, byte set or None, state)."""

    def __init__(self, pattern: str, any_case: bool):
        self.text, self.at, self.any_case = pattern.encode(), 0, any_case
        self.edges: list[tuple[int, frozenset[int] | None, int]] = []
        self.states = 0

    def state(self) -> int:
        self.states += 1
        return self.states - 1

    def peek(self) -> str:
        return chr(self.text[self.at]) if self.at < len(self.text) else ""

    def take(self) -> str:
        self.at += 1
        return chr(self.text[self.at - 1])

    def either(self) -> tuple[int, int]:
        begin, end = self.state(), self.state()
        while True:
            first, last = self.chain()
            self.edges += [(begin, None, first), (last, None, end)]
            if self.peek() != "|":
                return begin, end
            self.take()

    def chain(self) -> tuple[int, int]:
        begin = last = self.state()
        while self.peek() and self.peek() not in "|)":
            first, after = self.repeated()
            self.edges.append((last, None, first))
            last = after
        return begin, last

    def repeated(self) -> tuple[int, int]:
        place = self.at
        part = self.atom()
        stop = self.at
        if self.peek() == "?":
            least, most = 0, 1
        elif self.peek() == "*":
            least, most = 0, None
        elif self.peek() == "+":
            least, most = 1, None
        elif counts := re.compile(rb"\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
            least = int(counts[1])
            most = (int(counts[3]) if counts[3] else None) if counts[2] else least
            self.at = counts.end() - 1
        else:
            return part
        after_operator = self.at + 1

        def copy() -> tuple[int, int]:
            self.at = place
            again = self.atom()
            assert self.at == stop
            return again

        begin = last = self.state()
        for _ in range(least):
            first, after = copy()
            self.edges.append((last, None, first))
            last = after
        if most is None:
            first, after = copy()
            self.edges += [(last, None, first), (after, None, last)]
        else:
            end = self.state()
            for _ in range(most - least):
                first, after = copy()
                self.edges += [(last, None, end), (last, None, first)]
                last = after
            self.edges.append((last, None, end))
            last = end
        self.at = after_operator
        return begin, last

    def atom(self) -> tuple[int, int]:
        char = self.take()
        if char == "(":
            part = self.either()
            if self.take() != ")":
                raise ValueError("unbalanced group")
            return part
        if char == "[":
            members = self.bracket()
        elif char == "\\":
            members = {self.escape()}
        elif char in "?*+{^$.":
            raise ValueError(f"{char!r} is not supported here")
        else:
            members = {ord(char)}
        if self.any_case:
            members = members | {b ^ 32 for b in members if chr(b & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        begin, end = self.state(), self.state()
        self.edges.append((begin, frozenset(members), end))
        return begin, end

    def escape(self) -> int:
        char = self.take()
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        if char.isalnum():
            raise ValueError(f"\\{char} is not supported")
        return ord(char)

    def bracket(self) -> set[int]:
        members, negated = set(), self.peek() == "^"
        if negated:
            self.take()
        first = True
        while self.peek() != "]" or first:
            first = False
            low = self.escape() if (char := self.take()) == "\\" else ord(char)
            high = low
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != b"]":
                self.take()
                high = self.escape() if (char := self.take()) == "\\" else ord(char)
            members |= set(range(low, high + 1))
        self.take()
        return set(range(256)) - members if negated else members


@dataclass
class Dfa:
    """Anchored automaton of one rule: rows of next states by byte, -1 for none."""

    steps: list[list[int]]
    accepts: list[bool]


def subset_construction(edges: list, begin: int, end: int) -> Dfa:
    silent: dict[int, list[int]] = {}
    loud: dict[int, list[tuple[frozenset[int], int]]] = {}
    for source, members, target in edges:
        if members is None:
            silent.setdefault(source, []).append(target)
        else:
            loud.setdefault(source, []).append((members, target))

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for target in silent.get(todo.pop(), ()):
                if target not in seen:
                    seen.add(target)
                    todo.append(target)
        return frozenset(seen)

    sets = [closure({begin})]
    number, steps = {sets[0]: 0}, []
    for states in sets:
        targets: list[set[int]] = [set() for _ in range(256)]
        for state in states:
            for members, target in loud.get(state, ()):
                for b in members:
                    targets[b].add(target)
        row = []
        for reached in targets:
            if not reached:
                row.append(-1)
                continue
            closed = closure(reached)
            if closed not in number:
                number[closed] = len(sets)
                sets.append(closed)
            row.append(number[closed])
        steps.append(row)
    return Dfa(steps, [end in states for states in sets])


def compile_rule(rule: Rule) -> tuple[Dfa, Dfa]:
    """The rule's automaton, and that of the reversed rule."""
    parser = _Parser(rule.pattern, rule.any_case)
    begin, end = parser.either()
    if parser.at != len(parser.text):
        raise ValueError(f"{rule.kind}: unbalanced group")
    forward = subset_construction(parser.edges, begin, end)
    if forward.accepts[0]:
        raise ValueError(f"{rule.kind}: matches the empty string")
    return forward, subset_construction([(t, m, s) for s, m, t in parser.edges], end, begin)


# ------------------------------------------------- machines and their product


def _searcher(rule: Rule, dfa: Dfa):
    """step(state, symbol) -> (state, ended) of the rule's leftmost-longest search.

    A state holds the automaton states of the live starts, the earliest first, and
    whether one of them has matched.  From a match on, later starts are dropped.
    """

    def begin_at(threads: list[int]) -> tuple[tuple[int, ...], bool]:
        kept = list(dict.fromkeys(threads))
        for i, thread in enumerate(kept):
            if dfa.accepts[thread]:
                if i:
                    raise ValueError(f"{rule.kind}: a match may lie inside a longer one that is still open")
                return (thread,), True
        return tuple(kept), False

    def step(state: tuple[tuple[int, ...], bool], symbol: int) -> tuple[tuple[tuple[int, ...], bool], bool]:
        threads, matched = state
        alive = [] if symbol == END else [n for t in threads if (n := dfa.steps[t][symbol]) >= 0]
        if matched and alive:
            if not dfa.accepts[alive[0]]:
                raise ValueError(f"{rule.kind}: needs to look back behind a match")
            return begin_at(alive), False
        if symbol != END and dfa.steps[0][symbol] >= 0:
            alive.append(dfa.steps[0][symbol])
        return begin_at(alive), matched

    return step


def _byte_classes(dfas: list[Dfa]) -> tuple[bytes, list[int]]:
    """Bytes that no rule tells apart share a class: the class of each byte, a byte of each class."""
    seen: dict[tuple, int] = {}
    classes, members = bytearray(256), []
    for b in range(256):
        signature = tuple(tuple(row[b] for row in d.steps) for d in dfas)
        if signature not in seen:
            seen[signature] = len(members)
            members.append(b)
        classes[b] = seen[signature]
    return bytes(classes), members


@dataclass
class Scanner:
    """The combined automaton.

    ``moves[state + class]`` is the next state (a multiple of the number of
    classes), or its complement where matches end; ``ended`` then has a bit for
    each rule.
    """

    rules: tuple[Rule, ...]
    classes: bytes
    width: int
    moves: array
    ended: array
    start: int
    backwards: list[Dfa]
    exact: list[re.Pattern] = field(default_factory=list)

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule number) of every match in bytes, by start, then rule."""
        found: list[tuple[int, int, int]] = []
        free = [0] * len(self.rules)
        moves, state = self.moves, self.start
        for at, symbol in enumerate(data.translate(self.classes)):
            after = moves[state + symbol]
            if after < 0:
                self._close(data, at, self.ended[state + symbol], free, found)
                after = ~after
            state = after
        self._close(data, len(data), self.ended[state + self.width - 1], free, found)
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _close(self, data: bytes, end: int, ended: int, free: list[int], found: list) -> None:
        for number, rule in enumerate(self.rules):
            if not ended >> number & 1:
                continue
            steps, accepts, state, start = self.backwards[number].steps, self.backwards[number].accepts, 0, end
            for at in range(end - 1, free[number] - 1, -1):
                state = steps[state][data[at]]
                if state < 0:
                    break
                if accepts[state]:
                    start = at
            free[number] = end
            if rule.least and len(self.exact[number].fullmatch(data, start, end)[rule.group]) < rule.least:
                continue
            found.append((start, end, number))


def compile_rules(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Scanner:
    pairs = [compile_rule(r) for r in rules]
    dfas = [forward for forward, _ in pairs]
    machines = [cache(_searcher(r, d)) for r, d in zip(rules, dfas, strict=True)]
    classes, members = _byte_classes(dfas)
    symbols = [*members, END]
    width = len(symbols)

    begin = tuple(((), False) for _ in rules)
    number, states = {begin: 0}, [begin]
    targets, marks = [], []
    for state in states:
        row, mark = [], []
        for symbol in symbols:
            moved = [m(s, symbol) for m, s in zip(machines, state, strict=True)]
            after = tuple(x for x, _ in moved)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
            mark.append(sum(1 << i for i, (_, e) in enumerate(moved) if e))
        targets.append(row)
        marks.append(mark)
    targets, marks = np.array(targets), np.array(marks)

    # Partition refinement: states are one if they emit alike and move to one another's kind.
    part, count = np.zeros(len(states), np.int64), 0
    while True:
        _, part = np.unique(np.hstack([part[:, None], marks, part[targets]]), axis=0, return_inverse=True)
        part = part.ravel()
        if part.max() + 1 == count:
            break
        count = int(part.max()) + 1
    first = np.zeros(count, np.int64)
    first[part[::-1]] = np.arange(len(states))[::-1]
    moves = part[targets[first]] * width
    mark = marks[first]
    moves = np.where(mark > 0, ~moves, moves)
    return Scanner(
        tuple(rules), classes, width, array("l", moves.ravel().tolist()), array("l", mark.ravel().tolist()), int(part[0]) * width,
        [backward for _, backward in pairs],
        [re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0) for r in rules],
    )
