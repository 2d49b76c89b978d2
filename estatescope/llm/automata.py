"""Deterministic automata of byte patterns, by subset construction and minimisation.

A pattern is a small regular expression over bytes: literals, ``\\xHH`` and escaped marks,
classes ``[a-z]``, groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``. Several patterns
make one automaton whose states tell which of them accept. Bytes that no pattern tells
apart share a column, so a transition array has a row per state and a column per kind of byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Marks that stand for themselves only behind a backslash.
MARKS = "\\[](){}|?*+."


class _Parser:
    """Pattern text to a tree of ("set", bytes), ("seq", parts), ("any", parts) and ("repeat", part, m, n)."""

    def __init__(self, pattern: str, any_case: bool) -> None:
        self.text, self.at, self.any_case = pattern, 0, any_case

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{why} at {self.at} in {self.text!r}")

    def next(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, mark: str) -> bool:
        found = self.text.startswith(mark, self.at)
        self.at += len(mark) * found
        return found

    def choices(self) -> tuple:
        parts = [self.sequence()]
        while self.take("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.next() and self.next() not in "|)":
            parts.append(self.repeated(self.one()))
        return "seq", parts

    def one(self) -> tuple:
        if self.take("("):
            self.take("?:")
            inner = self.choices()
            if not self.take(")"):
                raise self.fail("missing )")
            return inner
        if self.take("["):
            return "set", self.members()
        if self.next() in MARKS and self.next() != "\\":
            raise self.fail("unexpected mark")
        return "set", self.cased({self.byte()})

    def byte(self) -> int:
        if self.take("\\"):
            if self.take("x"):
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            if not self.next() or self.next().isalnum():
                raise self.fail("unknown escape")
        c = self.next()
        if not c or ord(c) > 127:
            raise self.fail("not an ASCII character")
        self.at += 1
        return ord(c)

    def members(self) -> frozenset:
        outside, found = self.take("^"), set()
        while not self.take("]"):
            low = self.byte()
            ranged = self.next() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", "")
            self.at += ranged
            found |= set(range(low, (self.byte() if ranged else low) + 1))
        found = self.cased(found)
        return frozenset(range(256)) - found if outside else found

    def cased(self, found: set) -> frozenset:
        if self.any_case:
            found |= {b ^ 32 for b in found if chr(b).isalpha() and b < 128}
        return frozenset(found)

    def repeated(self, part: tuple) -> tuple:
        while self.next() and self.next() in "?*+{":
            if self.take("{"):
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("repeat", part, int(least), int(most) if most else None if comma else int(least))
            else:
                mark = self.next()
                self.at += 1
                part = ("repeat", part, int(mark == "+"), 1 if mark == "?" else None)
        return part


def parsed(pattern: str, any_case: bool = False) -> tuple:
    parser = _Parser(pattern, any_case)
    tree = parser.choices()
    if parser.at < len(pattern):
        raise parser.fail("unexpected )")
    return tree


def turned(tree: tuple) -> tuple:
    """The tree of the same texts read backwards."""
    kind, inner, *rest = tree
    if kind == "set":
        return tree
    if kind == "repeat":
        return (kind, turned(inner), *rest)
    parts = [turned(p) for p in inner]
    return kind, parts[::-1] if kind == "seq" else parts


class _Nondeterministic:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree: tuple, start: int) -> int:
        """The state in which a text of ``tree``, begun in ``start``, ends."""
        kind, inner, *rest = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((inner, end))
            return end
        if kind == "seq":
            for part in inner:
                start = self.add(part, start)
            return start
        if kind == "any":
            end = self.state()
            for part in inner:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        least, most = rest
        for _ in range(least):
            start = self.add(inner, start)
        end = self.state()
        if most is None:
            again = self.state()
            self.empty[start].append(again)
            self.empty[self.add(inner, again)].append(again)
            self.empty[again].append(end)
            return end
        for _ in range(most - least):
            self.empty[start].append(end)
            first = self.state()
            self.empty[start].append(first)
            start = self.add(inner, first)
        self.empty[start].append(end)
        return end

    def reach(self, state: int) -> int:
        """The states that empty moves lead to, as bits."""
        found, left = 1 << state, [state]
        while left:
            for s in self.empty[left.pop()]:
                if not found >> s & 1:
                    found |= 1 << s
                    left.append(s)
        return found


@dataclass(frozen=True)
class Automaton:
    """``moves[state, kinds[byte]]`` is the next state; ``accepts[state]`` has bit i set if pattern
    i accepts. State 0 is the start; ``dead`` is the state that never accepts again, or -1."""

    kinds: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    dead: int


def automaton(trees: list[tuple], anywhere: bool = False) -> Automaton:
    """One minimal automaton for all ``trees``; with ``anywhere`` a text may begin at every byte."""
    graph = _Nondeterministic()
    start = graph.state()
    ends = []
    for tree in trees:
        first = graph.state()
        graph.empty[start].append(first)
        ends.append(graph.add(tree, first))
    kinds, n_kinds = _kinds({s for moves in graph.moves for s, _ in moves})
    reach = [graph.reach(s) for s in range(len(graph.moves))]
    steps = [[0] * n_kinds for _ in reach]
    for s, moves in enumerate(graph.moves):
        for members, end in moves:
            for kind in set(kinds[list(members)].tolist()):
                steps[s][kind] |= reach[end]
    begin = reach[start]
    numbers, order, moves = {begin: 0}, [begin], []
    for subset in order:
        row, bits = [begin if anywhere else 0] * n_kinds, subset
        while bits:
            s = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            row = [a | b for a, b in zip(row, steps[s])]
        for x in row:
            if x not in numbers:
                numbers[x] = len(order)
                order.append(x)
        moves.append([numbers[x] for x in row])
    accepts = np.array([sum(1 << i for i, e in enumerate(ends) if x >> e & 1) for x in order], np.int64)
    return _minimal(kinds, np.array(moves, np.int64), accepts)


def _kinds(sets: set[frozenset]) -> tuple[np.ndarray, int]:
    """The kind of each byte: bytes that are in the same sets are of one kind."""
    inside = np.array([[b in s for s in sets] for b in range(256)], bool).reshape(256, -1)
    distinct, kinds = np.unique(inside, axis=0, return_inverse=True)
    return kinds.ravel().astype(np.uint8), len(distinct)


def _minimal(kinds: np.ndarray, moves: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States that no text tells apart become one: classes are split until their moves agree."""
    classes, n = np.unique(accepts, return_inverse=True)[1].ravel(), 0
    while True:
        seen = np.concatenate([classes[:, None], classes[moves]], axis=1)
        distinct, classes = np.unique(seen, axis=0, return_inverse=True)
        classes = classes.ravel()
        if len(distinct) == n:
            break
        n = len(distinct)
    # The start's class comes first.
    number = np.where(np.arange(n) == classes[0], 0, np.arange(n) + (np.arange(n) < classes[0]))
    classes = number[classes]
    _, first = np.unique(classes, return_index=True)
    moves, accepts = classes[moves[first]], accepts[first]
    dead = np.flatnonzero((moves == np.arange(n)[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(kinds, moves, accepts, int(dead[0]) if len(dead) else -1)
