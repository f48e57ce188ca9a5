"""Secret scans: all rules in one automaton, one pass over the bytes of a text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.automaton import Automaton, compile_rules
from corpusloom.llm.rows import map_slices, octets


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost, do not overlap, and are dropped if the part behind `after` is short.

    least counts the whole match, or with `value` what follows the separator of an assignment.
    """

    kind: str
    pattern: str
    least: int = 0
    value: bool = False


# The three base kinds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
# Published prefixes of credentials. Lengths are tested after the match: a counter in a pattern that may
# begin again inside itself would multiply the states.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 25),
)


@dataclass
class Scanner:
    """Finds every rule in one forward pass of `search`, which tells where some match ends; only then the
    rule's own two automata find its leftmost start, backwards, and its longest end from there."""

    rules: tuple[Rule, ...]
    search: Automaton
    back: list[Automaton]
    ahead: list[Automaton]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, start, end) in bytes, by end of the first match of each."""
        step, accepting, masks = self.search.next, self.search.first_accepting, self.search.accepts
        state, found = self.search.start, []
        done = [0] * len(self.rules)
        for at, byte in enumerate(data):
            state = step[state | byte]
            if state >= accepting:
                mask = masks[state >> 8]
                for no in range(len(done)):
                    if mask >> no & 1 and done[no] <= at:
                        start = self._start(no, data, done[no], at + 1)
                        if start is not None:
                            done[no] = self._end(no, data, start)
                            found.append((no, start, done[no]))
        return [s for s in found if self._long_enough(self.rules[s[0]], data[s[1]:s[2]])]

    def _start(self, no: int, data: bytes, low: int, high: int) -> int | None:
        auto, found = self.back[no], None
        state = auto.start
        for at in range(high - 1, low - 1, -1):
            state = auto.next[state | data[at]]
            if state >= auto.first_accepting:
                found = at
            elif not state:
                break
        return found

    def _end(self, no: int, data: bytes, start: int) -> int:
        auto = self.ahead[no]
        state, found = auto.start, start
        for at in range(start, len(data)):
            state = auto.next[state | data[at]]
            if state >= auto.first_accepting:
                found = at + 1
            elif not state:
                break
        return found

    @staticmethod
    def _long_enough(rule: Rule, match: bytes) -> bool:
        if not rule.value:
            return len(match) >= rule.least
        sign = min(i for i in (match.find(b"="), match.find(b":")) if i >= 0)
        value = match[sign + 1:].lstrip(b" ")
        return len(value[1:] if value[:1] in (b"'", b'"') else value) >= rule.least


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once per worker."""
    each = [[r.pattern] for r in rules]
    return Scanner(rules, compile_rules([r.pattern for r in rules], anywhere=True),
                   [compile_rules(p, backwards=True) for p in each], [compile_rules(p) for p in each])


def find_secrets(text: bytes, rules: tuple[Rule, ...] = BASE + MORE) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start, then in the order of the rules."""
    spans = sorted(scanner(rules).spans(text), key=lambda s: (s[1], s[0]))
    found, at, chars = [], 0, 0
    for no, start, stop in spans:
        chars += len(text[at:start].decode(errors="replace"))
        at = start
        found.append((rules[no].kind, chars, chars + len(text[start:stop].decode(errors="replace"))))
    return found


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, secrets): per document an array of (kind, start, end) in code points.

    A null text is empty. Rows are independent: repeated rows come back repeated, ties between
    kinds at one place are ordered as the rules are listed, an empty table gives an empty result.
    """
    rules = base + more

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t, rules)]
                     for t in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "secrets"])
        return each

    schema = "doc_id long, secrets array<struct<kind string, start long, end long>>"
    return map_slices(docs.select("doc_id", octets().alias("text")), "text", schema, make)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    A null text is empty and has none; rows without an id and repeated rows come back as they are; other columns are not
    looked at; no documents give no rows.
    """
    base = [r.kind for r in BASE]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [find_secrets(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in row) for row in rows], pa.int64()) for k in base]
            shas = [hashlib.sha256(joined([s for s in row if s[0] in base]).encode()).hexdigest() for row in rows]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(shas, pa.string()), pa.array(list(map(joined, rows)), pa.string())],
                ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])
        return each

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_slices(docs.select("doc_id", octets().alias("text")), "text", schema, make)
