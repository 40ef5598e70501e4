"""Regular expressions to one deterministic automaton over bytes: Thompson construction, subset construction, minimisation.

The syntax is what rules here need: literals, ``.`` (any byte but newline), ``[...]`` classes with ranges and ``^``, ``\\xNN`` and escaped characters,
groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``, and ``(?i:...)`` for ASCII letters in either case.
"""

from __future__ import annotations

import numpy as np


class _Parser:
    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self) -> tuple[int, int]:
        out = self.choice()
        if self.i < len(self.s):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.s}")
        return out

    def choice(self) -> tuple[int, int]:
        a, z = self.state(), self.state()
        while True:
            x, y = self.sequence()
            self.edges[a].append((None, x))
            self.edges[y].append((None, z))
            if self.i < len(self.s) and self.s[self.i] == "|":
                self.i += 1
            else:
                return a, z

    def sequence(self) -> tuple[int, int]:
        a = z = self.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            begin = self.i
            x, y = self.atom()
            end = self.i
            low, high = self.times()
            after = self.i
            parts = [(x, y)]
            for _ in range(max(low, high or low, 1) - 1):  # the atom is read again for each further copy
                self.i = begin
                parts.append(self.atom())
                assert self.i == end
            self.i = after
            for n, (x, y) in enumerate(parts):
                self.edges[z].append((None, x))
                if n >= low:
                    self.edges[z].append((None, y))
                if high is None and n == len(parts) - 1:
                    self.edges[y].append((None, x))
                z = y
        return a, z

    def times(self) -> tuple[int, int | None]:
        c = self.s[self.i : self.i + 1]
        if c and c in "?*+":
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.s.index("}", self.i)
            low, _, high = self.s[self.i + 1 : end].partition(",")
            many = "," in self.s[self.i : end]
            self.i = end + 1
            return int(low), (int(high) if high else None) if many else int(low)
        return 1, 1

    def atom(self) -> tuple[int, int]:
        if self.s[self.i] == "(":
            folded = self.fold
            if self.s.startswith("(?i:", self.i):
                self.fold, self.i = True, self.i + 4
            else:
                self.i += 3 if self.s.startswith("(?:", self.i) else 1
            out = self.choice()
            assert self.s[self.i] == ")"
            self.i += 1
            self.fold = folded
            return out
        a, z = self.state(), self.state()
        self.edges[a].append((self.bytes_(), z))
        return a, z

    def bytes_(self) -> frozenset[int]:
        if self.s[self.i] == ".":
            self.i += 1
            return frozenset(range(256)) - {10}
        if self.s[self.i] != "[":
            return self.folded({self.character()})
        self.i += 1
        inverse = self.s[self.i] == "^"
        self.i += inverse
        out: set[int] = set()
        while self.s[self.i] != "]":
            low = high = self.character()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                high = self.character()
            out |= set(range(low, high + 1))
        self.i += 1
        return frozenset(range(256)) - self.folded(out) if inverse else self.folded(out)

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if c < 128 and chr(c).isalpha()}
        return frozenset(chars)

    def character(self) -> int:
        c = self.s[self.i]
        if c == "\\":
            if self.s[self.i + 1] == "x":
                self.i += 4
                return int(self.s[self.i - 2 : self.i], 16)
            self.i += 2
            return ord(self.s[self.i - 1])
        self.i += 1
        return ord(c)


class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state; ``accepts[state]`` is a bit set of rules; state 0 is the start.

    ``search`` automata may begin a match at any byte; others are anchored and have a dead state ``dead`` (-1 where none). ``reverse``
    automata read matches from their last byte to their first."""

    def __init__(self, patterns: list[str], search: bool, reverse: bool = False):
        parser_edges: list[list[tuple[frozenset[int] | None, int]]] = [[]]
        final: dict[int, int] = {}
        for rule, pattern in enumerate(patterns):
            p = _Parser(pattern)
            a, z = p.parse()
            shift = len(parser_edges)
            edges = p.edges
            if reverse:
                edges = [[] for _ in p.edges]
                for at, e in enumerate(p.edges):
                    for on, to in e:
                        edges[to].append((on, at))
                a, z = z, a
            parser_edges += [[(on, to + shift) for on, to in e] for e in edges]
            parser_edges[0].append((None, a + shift))
            final[z + shift] = 1 << rule
        sets = sorted({on for e in parser_edges for on, _ in e if on is not None}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        self.class_of = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.int32)
        one = [int(np.flatnonzero(self.class_of == c)[0]) for c in range(len(kinds))]
        moves = [[(frozenset(c for c, b in enumerate(one) if b in on), to) for on, to in e if on is not None] for e in parser_edges]
        empty = [[to for on, to in e if on is None] for e in parser_edges]

        def closure(states: frozenset[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for to in empty[todo.pop()]:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(s for s in seen if moves[s] or s in final)

        start = closure(frozenset([0]))
        numbers, rows, todo = {start: 0}, [], [start]
        for states in todo:
            row = []
            for c in range(len(one)):
                to = frozenset(t for s in states for on, t in moves[s] if c in on)
                to = closure(to | ({0} if search else set()))
                if to not in numbers:
                    numbers[to] = len(numbers)
                    todo.append(to)
                row.append(numbers[to])
            rows.append(row)
        accepts = np.array([sum({final[s] for s in states if s in final}) for states in todo], np.int64)
        self._minimise(np.array(rows, np.int64), accepts)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Moore's refinement: states are told apart by what they accept, then by where each class leads, until nothing changes."""
        block = np.unique(accepts, return_inverse=True)[1].ravel()
        while True:
            new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        order = {}
        for b in block.tolist():
            order.setdefault(b, len(order))
        block = np.array([order[b] for b in block.tolist()])
        first = np.array([int(np.argmax(block == b)) for b in range(len(order))])
        self.classes = table.shape[1]
        small = block[table[first]]
        self.accepts = accepts[first]
        self.dead = next((s for s in range(len(first)) if not self.accepts[s] and (small[s] == s).all()), -1)
        self.table = small.astype(np.int32).ravel()
        self.rows = small.tolist()

    def kills(self) -> np.ndarray:
        """Bytes that lead to the dead state from everywhere (anchored automata): no match holds them."""
        return (self.table.reshape(-1, self.classes) == self.dead).all(0)[self.class_of]

    def longest(self, data: bytes, at: int, end: int) -> int:
        """End of the longest match that begins at ``at``, or -1 (anchored automata)."""
        state, last, classes = 0, -1, self._list()
        for i in range(at, end):
            state = self.rows[state][classes[data[i]]]
            if state == self.dead:
                break
            if self.accepts[state]:
                last = i + 1
        return last

    def begins(self, data: bytes, begin: int, end: int) -> list[int]:
        """Places where some match begins, ascending (reverse search automata): one pass from the end."""
        state, classes, rows, accepts = 0, self._list(), self.rows, self.accepts.tolist()
        out = []
        for i in range(end - 1, begin - 1, -1):
            state = rows[state][classes[data[i]]]
            if accepts[state]:
                out.append(i)
        return out[::-1]

    def _list(self) -> list[int]:
        if not hasattr(self, "_classes"):
            self._classes = self.class_of.tolist()
        return self._classes


def _advance(dfa: Automaton, kinds: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End states and rules met (bit sets) of chunks that advance together, a byte a step."""
    order = np.argsort(-length, kind="stable")  # long chunks first, so that those not yet at their end stand in front
    begin, length, now = begin[order], length[order], state[order].astype(np.int32)
    met = np.zeros(len(order), np.int64)
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    for step, n in enumerate(live.tolist()):
        now[:n] = dfa.table[now[:n] * dfa.classes + kinds[begin[:n] + step]]
        hit = dfa.accepts[now[:n]]
        if hit.any():
            met[:n] |= hit
    end, out = np.empty_like(now), np.empty_like(met)
    end[order], out[order] = now, met
    return end, out


def scan_pieces(dfa: Automaton, data: np.ndarray, cut: np.ndarray, longest: int = 256) -> np.ndarray:
    """Rules (bit set) that match somewhere in each piece data[cut[i]:cut[i + 1]], for pieces that no match reaches over.

    Pieces are read in chunks side by side, each as if it began at a piece's start; where the chunk before ends in another state,
    the chunk is read again from that state, until all agree."""
    edge = np.zeros(len(data) + 1, bool)
    edge[1:][data == 0x20] = True
    edge[::longest] = True
    edge[-1] = True
    edge[cut] = True
    edge = np.flatnonzero(edge)
    begin, length = edge[:-1], np.diff(edge)
    if not len(begin):
        return np.zeros(len(cut) - 1, np.int64)
    kinds = dfa.class_of[data]
    first = np.isin(begin, cut)
    used = np.zeros(len(begin), np.int32)
    end, met = _advance(dfa, kinds, begin, length, used)
    for _ in range(16):
        want = np.where(first, 0, np.append(0, end[:-1])).astype(np.int32)
        again = np.flatnonzero(want != used)
        if not len(again):
            break
        used[again] = want[again]
        end[again], met[again] = _advance(dfa, kinds, begin[again], length[again], used[again])
    else:  # few long pieces are left, whose chunks wait for one another
        accepts = dfa.accepts.tolist()
        for c in np.flatnonzero(np.where(first, 0, np.append(0, end[:-1])) != used).tolist():
            while c < len(begin) and not first[c] and end[c - 1] != used[c]:
                state = used[c] = end[c - 1]
                bits = 0
                for kind in kinds[begin[c] : begin[c] + length[c]].tolist():
                    state = dfa.rows[state][kind]
                    bits |= accepts[state]
                end[c], met[c] = state, bits
                c += 1
    out = np.zeros(len(cut) - 1, np.int64)
    np.bitwise_or.at(out, np.searchsorted(cut, begin, side="right") - 1, met)
    return out
