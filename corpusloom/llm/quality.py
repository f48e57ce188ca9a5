"""Quality rules: base tests, and a decision list learned by sequential covering from labelled statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.rows import map_slices, octets, unused
from corpusloom.staging import stage

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
# Labelled rows that the rules are learned from, at most; they are the same for every order of the rows.
SAMPLE = 20_000
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_upper", "n_digits", "n_marks", "n_lines", "n_distinct_words", "longest_word")
COUNTS = BASE_COUNTS + MORE_COUNTS
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"


def text_counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one text. Words end at ASCII white space.

    n_repeat_words counts the words that lie in a run of three words found twice or more;
    n_dup_lines the lines with a word that equal an earlier line.
    """
    words = text.split()
    inside = sum(map(len, words))
    n = len(words)
    runs = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(runs)) < len(runs):
        often, last = Counter(runs), 0
        for i, run in enumerate(runs):
            if often[run] > 1:
                repeated += i + 3 - max(last, i)
                last = i + 3
    lines = [line for line in text.split(b"\n") if line.strip()]

    def among(bytes_: bytes) -> int:
        return len(text) - len(text.translate(None, bytes_))

    return (n, len(text.decode(errors="replace")) - (len(text) - inside), among(SYMBOLS), len(lines) - len(set(lines)), repeated,
            among(_UPPER), among(_DIGITS), among(_MARKS), len(lines), len(set(words)), max(map(len, words), default=0))


def with_counts(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The documents with all their columns and COUNTS of a text (the column `text`); columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in COUNTS]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(probe).to_pylist()
            found = np.array(list(map(text_counts, texts)), np.int64).reshape(-1, len(COUNTS))
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], [*kept, *COUNTS])
        return each

    probe = unused("_octets", docs)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    schema = ", ".join([*fields, *(f"{c} long" for c in COUNTS)])
    return map_slices(docs.select(*kept, (octets() if text is None else text).alias(probe)), probe, schema, make)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


# What a threshold can be set on: (name, dividend, divisor).
STATISTICS = (
    ("symbols_per_word", "n_symbols", "n_words"), ("chars_per_word", "word_chars", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"), ("digit_share", "n_digits", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"), ("words_per_line", "n_words", "n_lines"),
    ("distinct_share", "n_distinct_words", "n_words"), ("longest_word", "longest_word", None),
)


def statistic(dividend: str, divisor: str | None) -> Column:
    if divisor is None:
        return F.col(dividend).cast("double")
    return F.when(F.col(divisor) > 0, F.col(dividend) / F.col(divisor)).otherwise(0.0)


@dataclass(frozen=True)
class Test:
    """statistic >= bound, or <= bound."""

    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = statistic(*next(s[1:] for s in STATISTICS if s[0] == self.statistic))
        return value >= self.bound if self.above else value <= self.bound

    def on(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.statistic] >= self.bound if self.above else table[self.statistic] <= self.bound

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<='} {self.bound:g}"


Rule = tuple[Test, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (t.on(table) for t in rule), np.ones(n, bool))


def _grow(table: dict[str, np.ndarray], bad: np.ndarray, most_tests: int, bounds: int) -> Rule:
    """Add the test of greatest information gain until no good row is covered or nothing is gained."""
    rule: Rule = ()
    rows = np.arange(len(bad))
    while len(rule) < most_tests:
        p = int(bad[rows].sum())
        if p == 0 or p == len(rows):
            break
        known = np.log2(p / len(rows))
        best, gain = None, 1e-9
        for name in table:
            values = table[name][rows]
            order = np.argsort(values, kind="stable")
            v, hits = values[order], np.concatenate([[0], np.cumsum(bad[rows][order])])
            steps = np.flatnonzero(np.diff(v) > 0) + 1
            if len(steps) > bounds:
                steps = steps[np.linspace(0, len(steps) - 1, bounds).astype(int)]
            for at in steps:
                bound = float((v[at - 1] + v[at]) / 2)
                for above, q, n in ((True, p - hits[at], len(v) - at), (False, hits[at], at)):
                    if q and (g := q * (np.log2(q / n) - known)) > gain:
                        best, gain = Test(name, above, bound), g
        if best is None:
            break
        rule += (best,)
        rows = rows[best.on({n: t[rows] for n, t in table.items()})]
    return rule


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    """(share of bad rows among those covered, number covered), by the Laplace estimate."""
    hit = _covered(rule, table, len(bad))
    n, p = int(hit.sum()), int(bad[hit].sum())
    return (p + 1) / (n + 2), n


def learn(table: dict[str, np.ndarray], bad: np.ndarray, order: np.ndarray, precision: float = 0.9, most_rules: int = 12,
          most_tests: int = 4, least_rows: int = 5, bounds: int = 200) -> list[Rule]:
    """Ordered rules for bad rows: grow one on two thirds of the rows, prune it on the rest, go on without the rows it covers.

    order is a fixed random number per row that splits them. A rule is pruned from its last test for as
    long as that does not lower its precision on the pruning rows, and the list ends with the
    first rule that covers too few of them or whose precision there is below `precision`.
    """
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = left & (order % 3 != 0), left & (order % 3 == 0)
        part = {n: t[grow] for n, t in table.items()}
        rule = _grow(part, bad[grow], most_tests, bounds)
        if not rule:
            break
        rest = {n: t[prune] for n, t in table.items()}
        while len(rule) > 1 and _worth(rule[:-1], rest, bad[prune])[0] >= _worth(rule, rest, bad[prune])[0]:
            rule = rule[:-1]
        share, n = _worth(rule, rest, bad[prune])
        if n < least_rows or share < precision * (n / (n + 2)):
            break
        rules.append(rule)
        left &= ~_covered(rule, table, len(bad))
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> list[Rule]:
    """Rules from labelled documents (quality 0 or 1) that pass the base tests; at most `sample` labels, chosen by a hash of
    their id, pass to the driver as a row of statistics each, the least of its document's rows. Labels without an id or a quality are left out."""
    chosen = (labels.where("quality is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # The sample bounds the broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    passed = with_counts(texts).where(~base_failed()).select("doc_id", "quality", F.struct(*(statistic(a, b).alias(n) for n, a, b in STATISTICS)).alias("_s"))
    # One row for each label, however many rows its document has.
    rows = passed.groupBy("doc_id", "quality").agg(F.min("_s").alias("_s")).select(
        "quality", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(3)).alias("turn"), "_s.*").toPandas()
    table = {n: rows[n].to_numpy(float) for n, _, _ in STATISTICS}
    # In an order that does not depend on the partitions.
    by = np.lexsort([rows["turn"], rows["quality"], *table.values()])
    return learn({n: t[by] for n, t in table.items()}, rows["quality"].to_numpy()[by] == 0, rows["turn"].to_numpy()[by], **options)


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        holds = reduce(lambda a, b: a & b, (t.column() for t in rule))
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(None).cast("int") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """The documents with all their columns, COUNTS, base_failed, rule (the first that rejects, or null) and kept.

    The rules are one ordered CASE expression. A null text has no words and fails the base tests, like
    an empty one. Without labels there are no rules and the base tests decide alone. Repeated rows are
    judged alike; columns that have a result's name are replaced.
    """
    rules = learn_rules(docs, labels, sample, **options)
    return (with_counts(docs).withColumn("base_failed", base_failed())
            .withColumn("rule", rejected_by(rules).cast("int"))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> DataFrame:
    """The documents that are kept, with their own columns; otherwise as judge()."""
    rules = learn_rules(docs, labels, sample, **options)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    counted = with_counts(rows, F.coalesce(F.col("_row.text").cast("binary"), F.lit(b"")))
    return counted.where(~base_failed() & rejected_by(rules).isNull()).select("_row.*")
