"""Regular expressions compiled to minimal deterministic automata over bytes.

A rule's pattern is parsed to a tree, turned into a nondeterministic automaton
(one fragment per node), and determinised by subset construction over byte
classes. Moore's partition refinement then minimises the result into a flat
transition array. Several rules share one automaton: an accepting state knows
the set of rules that end there.

The syntax is that of the common subset: literals, escapes, classes with
ranges and negation, groups, alternation, ?, *, + and {m,n}. Patterns are of
ASCII; other bytes are matched only by negated classes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

ALL = frozenset(range(256))


class Parser:
    """Nodes: ("set", bytes), ("cat", [...]), ("alt", [...]), ("rep", node, least, most or None)."""

    ESCAPES = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11}

    def __init__(self, pattern: str, fold: bool = False):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self):
        node = self._alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unbalanced ) at {self.i} in {self.p!r}")
        return node

    def _next(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _alternatives(self):
        parts = [self._sequence()]
        while self._next() == "|":
            self.i += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def _sequence(self):
        parts = []
        while self._next() not in ("", "|", ")"):
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _repeated(self, node):
        while (c := self._next()) and c in "?*+{":
            self.i += 1
            if c == "{":
                close = self.p.index("}", self.i)
                least, _, most = self.p[self.i : close].partition(",")
                self.i = close + 1
                bounds = (int(least), int(most) if most else None if "," in self.p[:close][-len(most) - 1 :] else int(least))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def _atom(self):
        c = self._next()
        self.i += 1
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            node = self._alternatives()
            if self._next() != ")":
                raise ValueError(f"missing ) in {self.p!r}")
            self.i += 1
            return node
        if c == "[":
            return ("set", self._class())
        if c == ".":
            return ("set", ALL - {10})
        return ("set", self._folded({self._escaped() if c == "\\" else ord(c)}))

    def _escaped(self) -> int:
        c = self._next()
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        if c.isalnum() and c not in self.ESCAPES:
            raise ValueError(f"escape \\{c} isn't supported")
        return self.ESCAPES.get(c, ord(c))

    def _class(self) -> frozenset:
        negated = self._next() == "^"
        self.i += negated
        chars, first = set(), True
        while first or self._next() != "]":
            low, first = self._one(), False
            if self._next() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.i += 1
                chars |= set(range(low, self._one() + 1))
            else:
                chars.add(low)
        self.i += 1
        chars = self._folded(chars)
        return ALL - chars if negated else chars

    def _one(self) -> int:
        c = self._next()
        self.i += 1
        return self._escaped() if c == "\\" else ord(c)

    def _folded(self, chars) -> frozenset:
        return frozenset(chars | {ord(x) for c in chars if chr(c).isascii() and chr(c).isalpha() for x in chr(c).swapcase()} if self.fold else chars)


def reverse(node):
    """The tree of the reversed language."""
    kind, *rest = node
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", reverse(rest[0]), *rest[1:])
    parts = [reverse(x) for x in rest[0]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def trimmed(node):
    """The tree without the open end of its last repetition: its matches end where the first ones did."""
    kind, *rest = node
    if kind == "rep":
        return ("rep", rest[0], rest[1], rest[1])
    if kind == "cat" and rest[0] and rest[0][-1][0] in ("rep", "cat"):
        return ("cat", [*rest[0][:-1], trimmed(rest[0][-1])])
    return node


class Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Wire node behind start; the state it ends in."""
        kind, *rest = node
        if kind == "set":
            inner, end = self.state(), self.state()
            self.empty[start].append(inner)
            self.moves[inner] = (rest[0], end)
            return end
        if kind == "cat":
            for part in rest[0]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in rest[0]:
                head = self.state()
                self.empty[start].append(head)
                self.empty[self.add(part, head)].append(end)
            return end
        inner, least, most = rest
        for _ in range(least):
            start = self.add(inner, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[self.add(inner, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(most - least):
            start = self.add(inner, start)
            self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if self.moves[s] or not self.empty[s])


class Dfa:
    """State 0 starts. table[256 * s + byte] is the next state, rules[s] the rules that end in s."""

    def __init__(self, table: list[int], rules: list[frozenset]):
        self.table, self.rules = table, rules

    def __len__(self) -> int:
        return len(self.rules)

    @classmethod
    def of(cls, trees: Sequence, search: bool) -> Dfa:
        """search: a match may begin anywhere; otherwise only at the first byte."""
        nfa = Nfa()
        start = nfa.state()
        ends = {}
        for k, tree in enumerate(trees):
            head = nfa.state()
            nfa.empty[start].append(head)
            tail, end = nfa.add(tree, head), nfa.state()
            nfa.empty[tail].append(end)
            ends[end] = k
        class_of, members = byte_classes([m[0] for m in nfa.moves if m])
        first = nfa.closure([start])
        again = first if search else frozenset()
        number, todo, rows = {first: 0}, deque([first]), []
        while todo:
            state = todo.popleft()
            row = []
            for some in members:
                target = nfa.closure({nfa.moves[s][1] for s in state if nfa.moves[s] and some in nfa.moves[s][0]}) | again
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append(row)
        rules = [frozenset(ends[s] for s in state if s in ends) for state in number]
        return cls._minimal(rows, rules, class_of)

    @classmethod
    def _minimal(cls, rows: list[list[int]], rules: list[frozenset], class_of: list[int]) -> Dfa:
        """Moore: split blocks by what they accept, then by the blocks they lead to, until nothing splits."""
        names: dict = {}
        block = [names.setdefault(r, len(names)) for r in rules]
        while True:
            names = {}
            split = [names.setdefault((b, *(block[t] for t in row)), len(names)) for b, row in zip(block, rows, strict=True)]
            if len(names) == len(set(block)):
                break
            block = split
        number: dict[int, int] = {}
        for b in block:
            number.setdefault(b, len(number))
        table, accepted = [0] * (256 * len(number)), [frozenset()] * len(number)
        for s, row in enumerate(rows):
            b = number[block[s]]
            accepted[b] = rules[s]
            table[256 * b : 256 * b + 256] = [number[block[row[c]]] for c in class_of]
        return cls(table, accepted)

    def linked(self, stop: bool = False) -> list[list]:
        """The transition array as rows that hold their successors; row[256] is the set of rules, row[257] whether nothing leaves the row.

        stop: accepting rows lead to themselves, so that a pass without any
        check on the way ends in a row that accepts if one was met.
        """
        rows: list[list] = [[] for _ in self.rules]
        for s, row in enumerate(rows):
            row += [row] * 256 if stop and self.rules[s] else [rows[t] for t in self.table[256 * s : 256 * s + 256]]
            row += [self.rules[s], all(t is row for t in row)]
        return rows


def byte_classes(sets: Sequence[frozenset]) -> tuple[list[int], list[int]]:
    """The class of each byte, and one byte of each class: no set tells bytes of a class apart."""
    names: dict = {}
    distinct = list(set(sets))
    class_of = [names.setdefault(tuple(b in s for s in distinct), len(names)) for b in range(256)]
    return class_of, [class_of.index(k) for k in range(len(names))]
