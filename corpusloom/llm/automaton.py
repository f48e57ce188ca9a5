"""One minimal deterministic automaton over bytes for a set of regular expressions."""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass

_DIGITS = frozenset(b"0123456789")
_CLASSES = {ops.CATEGORY_DIGIT: _DIGITS, ops.CATEGORY_SPACE: frozenset(b" \t\n\r\f\v"),
            ops.CATEGORY_WORD: frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")}
_ALL = frozenset(range(256))


class _Nfa:
    """States with byte moves and empty moves; each regular expression adds its own fragment."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _cased(self, byte: int, flags: int) -> frozenset:
        if byte > 127:
            raise ValueError("rules are made of ASCII characters")
        text = chr(byte)
        return frozenset((ord(text.lower()), ord(text.upper()))) if flags & ops.SRE_FLAG_IGNORECASE else frozenset((byte,))

    def _set(self, items: list, flags: int) -> frozenset:
        found, negated = set(), False
        for op, arg in items:
            if op is ops.NEGATE:
                negated = True
            elif op is ops.LITERAL:
                found |= self._cased(arg, flags)
            elif op is ops.RANGE:
                for b in range(arg[0], arg[1] + 1):
                    found |= self._cased(b, flags)
            elif op is ops.CATEGORY and arg in _CLASSES:
                found |= _CLASSES[arg]
            else:
                raise ValueError(f"no set with {op} in rules")
        return _ALL - found if negated else frozenset(found)

    def add(self, tree, start: int, flags: int, backwards: bool) -> int:
        """The state in which a match of the tree that begins in `start` ends."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            if op is ops.LITERAL:
                end = self.state()
                self.moves[start].append((self._cased(arg, flags), end))
            elif op is ops.IN:
                end = self.state()
                self.moves[start].append((self._set(arg, flags), end))
            elif op is ops.SUBPATTERN:
                _, on, off, inner = arg
                end = self.add(inner, start, (flags | on) & ~off, backwards)
            elif op is ops.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    self.free[self.add(inner, start, flags, backwards)].append(end)
            elif op is ops.MAX_REPEAT:
                low, high, inner = arg
                end = start
                for _ in range(low):
                    end = self.add(inner, end, flags, backwards)
                if high is ops.MAXREPEAT:
                    loop = self.state()
                    self.free[end].append(loop)
                    self.free[self.add(inner, loop, flags, backwards)].append(loop)
                    end = loop
                else:
                    out = self.state()
                    for _ in range(high - low):
                        self.free[end].append(out)
                        end = self.add(inner, end, flags, backwards)
                    self.free[end].append(out)
                    end = out
            else:
                raise ValueError(f"no {op} in rules")
            start = end
        return start

    def closure(self, states: Iterable[int]) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """next[state | byte] is the next state, states being multiples of 256; accepts[state >> 8] is a bit per rule.

    State 0 is dead: nothing leads out of it. States from first_accepting on accept some rule.
    """

    next: list[int]
    accepts: list[int]
    start: int
    first_accepting: int


def compile_rules(patterns: list[str], anywhere: bool = False, backwards: bool = False) -> Automaton:
    """Subset construction over all patterns at once, then minimisation by refining a partition of the states.

    anywhere: a match may start at every byte. backwards: the automaton reads matches from their end.
    """
    nfa = _Nfa()
    begin = nfa.state()
    ends: dict[int, int] = {}
    for rule, pattern in enumerate(patterns):
        tree = parser.parse(pattern)
        ends[nfa.add(tree, begin_of(nfa, begin), tree.state.flags, backwards)] = rule
    # Bytes that no pattern tells apart share a class.
    sets = {s for moves in nfa.moves for s, _ in moves}
    kinds: dict[tuple, list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sorted(sets, key=sorted)), []).append(b)
    classes = list(kinds.values())

    first = nfa.closure([begin])
    numbers, todo, table = {frozenset(): 0, first: 1}, [first], {0: [0] * len(classes)}
    while todo:
        here = todo.pop()
        row = []
        for members in classes:
            b = members[0]
            there = nfa.closure([t for s in here for bytes_, t in nfa.moves[s] if b in bytes_])
            there = there | first if anywhere else there
            if there not in numbers:
                numbers[there] = len(numbers)
                todo.append(there)
            row.append(numbers[there])
        table[numbers[here]] = row
    masks = [0] * len(numbers)
    for states, i in numbers.items():
        for s in states:
            if s in ends:
                masks[i] |= 1 << ends[s]
    # States are alike while they accept the same rules and move to states that are alike.
    block = masks
    while True:
        signs: dict[tuple, int] = {}
        refined = [signs.setdefault((block[i], *(block[t] for t in table[i])), len(signs)) for i in range(len(numbers))]
        if len(signs) == len(set(block)):
            break
        block = refined
    one = {}
    for i in range(len(numbers)):
        one.setdefault(block[i], i)
    # The dead state comes first, accepting ones last.
    order = sorted(one.values(), key=lambda i: (masks[i] != 0, i != 0, i))
    new = {block[i]: k for k, i in enumerate(order)}
    flat = [0] * (256 * len(order))
    for k, i in enumerate(order):
        for members, t in zip(classes, table[i]):
            for b in members:
                flat[k << 8 | b] = new[block[t]] << 8
    accepts = [masks[i] for i in order]
    return Automaton(flat, accepts, new[block[1]] << 8, 256 * sum(m == 0 for m in accepts))


def begin_of(nfa: _Nfa, begin: int) -> int:
    """A state of its own for one pattern, reached freely from the common start."""
    own = nfa.state()
    nfa.free[begin].append(own)
    return own
