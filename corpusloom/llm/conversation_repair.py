"""Repair of conversations: the cheapest edits that give legal turns, decided by the least of scalar integer weights.

A weight is one big integer. Its high digits are the cost; below them stand octal digits, one place for each edit
in order (D 1, I 2, K 3, R 4, as in ASCII) and zeros after the last. So the least integer is the cheapest
list of edits and of equally cheap ones the least in ASCII, a prefix before what it begins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.llm.rows import BLANKS, present
from corpusloom.operators.ordering import in_chunks, numbered
from corpusloom.staging import stage

# Bits of the number of a row in its block: at most 64 rows are edited at once.
BLOCK = 6
BITS = 3
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TO_LETTERS = str.maketrans("1234", "DIKR")
# Kinds of a row: role s, u, a or another; plain, truncated, or to be deleted.
ROLES, FAULTS = "sua-", 3
KINDS = "abcdefghijkl"
LEGAL = {"su", "ua", "au"}
# States: nothing yet, after s, after u, after a. The state that an inserted or reroled turn leads to.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "-": (None,) * 4}
STATES = range(4)
# Rows that Python takes from Arrow at once.
_TOGETHER = 128


class Scale:
    """Weights with places for so many edits."""

    def __init__(self, places: int):
        self.places, self.low = places, BITS * places
        self.mask = (1 << self.low) - 1
        self.never = 1 << (self.low + 62)

    def before(self, weight: int, edit: int, more: int = 0) -> int:
        """The weight with an edit put before its edits."""
        low = weight & self.mask
        return weight - low + (low >> BITS) + (COST[edit] + more << self.low) + (edit << self.low - BITS)

    def read(self, weight: int) -> tuple[int, str]:
        """(cost, letters) of a weight."""
        digits = f"{weight & self.mask:o}".zfill(self.places).rstrip("0")
        return weight >> self.low, digits.translate(TO_LETTERS)

    def ends(self) -> list[int]:
        """Weights of the states at the end: turns are inserted until the last is the assistant's."""
        one = self.before(0, INSERT)
        return [0, self.before(one, INSERT), one, 0]


def weigh(kinds: str, after: list[int], scale: Scale) -> list[int]:
    """The least weight from each state before the rows, given those after them.

    The states between rows are the nodes of a graph without cycles: up to two inserts (a third only
    comes back to a state), then one edit of the row.
    """
    before = scale.before
    for kind in reversed(kinds):
        role, fault = ROLES[KINDS.index(kind) // FAULTS], KINDS.index(kind) % FAULTS
        edited = [before(w, DELETE) for w in after]
        if fault < 2:
            for q in STATES:
                edited[q] = min(edited[q], before(after[NEXT[q]], REROLE, fault))
                if KEPT[role][q] is not None:
                    edited[q] = min(edited[q], before(after[KEPT[role][q]], KEEP, fault))
        once = [min(edited[q], before(edited[NEXT[q]], INSERT)) for q in STATES]
        after = [min(edited[q], before(once[NEXT[q]], INSERT)) for q in STATES]
    return after


@lru_cache(maxsize=1 << 16)
def solve(kinds: str) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of a whole conversation."""
    scale = Scale(3 * len(kinds) + 2)
    return scale.read(weigh(kinds, scale.ends(), scale)[0])


def cells(kinds: str) -> list[int | None]:
    """Weights of a block from every state to every state, 4 * from + to; places for three edits a row."""
    scale = Scale(3 * len(kinds))
    found = [weigh(kinds, [0 if q == to else scale.never for q in STATES], scale) for to in STATES]
    return [None if found[to][q] >= scale.never else found[to][q] for q in STATES for to in STATES]


def compose(left: list[int | None], left_places: int, right: list[int | None], right_places: int) -> list[int | None]:
    """Weights of two neighbours as one: costs add up, the right edits follow the left ones without a gap.

    A least part belongs to a least whole: of two lists for the same rows between the same states neither
    can begin with the other at the same cost, so what follows does not change their order.
    """
    a_scale, b_scale, scale = Scale(left_places), Scale(right_places), Scale(left_places + right_places)
    out: list[int | None] = [None] * 16
    for q in STATES:
        for via in STATES:
            a = left[4 * q + via]
            if a is None:
                continue
            low = a & a_scale.mask
            free = (((low & -low).bit_length() - 1) // BITS if low else left_places) * BITS
            for to in STATES:
                b = right[4 * via + to]
                if b is not None:
                    w = ((a >> a_scale.low) + (b >> b_scale.low) << scale.low) + (low << b_scale.low) + ((b & b_scale.mask) << free)
                    if out[4 * q + to] is None or w < out[4 * q + to]:
                        out[4 * q + to] = w
    return out


def finish(cells_: list[int | None], places: int) -> tuple[int, str]:
    """(cost, letters) of a conversation from the weights of all its rows."""
    inner, scale = Scale(places), Scale(places + 2)
    found = []
    for to, tail in enumerate(("", "II", "I", "")):
        if (w := cells_[to]) is not None:
            cost, letters = inner.read(w)
            digits = (letters + tail).translate(str.maketrans("DIKR", "1234")).ljust(scale.places, "0")
            found.append((cost + COST[INSERT] * len(tail) << scale.low) + int(digits, 8))
    return scale.read(min(found))


def illegal_pairs(kinds: str) -> int:
    roles = [ROLES[KINDS.index(k) // FAULTS] for k in kinds]
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


def _role(kind: str) -> str:
    return ROLES[KINDS.index(kind) // FAULTS]


def edit(letters: str, seen: int, odd: bool, rows: list[dict]) -> list[dict]:
    """The turns that letters make of rows (role, text).

    seen counts the turns before. The whole repair has an odd number of turns if it begins with a
    system turn; from this and seen follows the role that comes next.
    """
    out, left = [], iter(rows)
    for letter in letters:
        role = "assistant" if seen > 0 and (seen - odd) % 2 else "user"
        if letter == "I":
            out.append({"role": role, "text": ""})
        else:
            row = next(left)
            if letter == "D":
                continue
            out.append({"role": role if letter == "R" else row["role"], "text": row["text"]})
        seen += 1
    return out


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes
    its stops away, 3 repeats it, 4 gives it to the user. Nulls are one space, but for conv_id and turn outside the checksum."""
    def said(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
                                F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).drop("_copy")


_NODE = "key string, idx long, rows long, illegal long, first string, last string, cells array<binary>"


def _packed(found: list[int | None]) -> list[bytes | None]:
    return [None if w is None else w.to_bytes(w.bit_length() // 8 + 1) for w in found]


def _unpacked(found: list[bytes | None]) -> list[int | None]:
    return [None if w is None else int.from_bytes(w) for w in found]


def _per_row(df: DataFrame, schema: str, make: Callable[[dict], list[dict]]) -> DataFrame:
    """mapInArrow by a function from a row to rows."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                found = [out for row in batch.slice(at, _TOGETHER).to_pylist() for out in make(row)]
                yield pa.RecordBatch.from_pylist(found, schema=kind)

    return df.mapInArrow(run, schema)


def _block_node(row: dict) -> list[dict]:
    kinds = row["kinds"]
    return [{"key": row["key"], "idx": row["idx"] - 1, "rows": len(kinds), "illegal": illegal_pairs(kinds),
             "first": _role(kinds[0]), "last": _role(kinds[-1]), "cells": _packed(cells(kinds))}]


def _joined_node(row: dict) -> list[dict]:
    a, *rest = row["pair"]
    if rest:
        b = rest[0]
        both = compose(_unpacked(a["cells"]), 3 * a["rows"], _unpacked(b["cells"]), 3 * b["rows"])
        a = {"rows": a["rows"] + b["rows"], "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in LEGAL),
             "first": a["first"], "last": b["last"], "cells": _packed(both)}
    return [{k: a[k] for k in ("rows", "illegal", "first", "last", "cells")} | {"key": row["key"], "idx": row["idx"]}]


_ANSWER = "key string, illegal long, cost long, audit string"


def _alone(row: dict) -> list[dict]:
    cost, audit = solve(row["kinds"])
    return [{"key": row["key"], "illegal": illegal_pairs(row["kinds"]), "cost": cost, "audit": audit}]


def _whole(row: dict) -> list[dict]:
    cost, audit = finish(_unpacked(row["cells"]), 3 * row["rows"])
    return [{"key": row["key"], "illegal": row["illegal"], "cost": cost, "audit": audit}]


def _pieces(row: dict) -> list[dict]:
    """The part of the audit that belongs to each block of a conversation; inserts go with the row behind them."""
    out, at, seen, audit = [], 0, 0, row["audit"]
    odd = (len(audit) - audit.count("D")) % 2 == 1
    for i, block in enumerate(row["blocks"], 1):
        end, left = at, block["rows"]
        while left:
            left -= audit[end] != "I"
            end += 1
        letters = audit[at:] if i == len(row["blocks"]) else audit[at:end]
        out.append({"key": row["key"], "block": block["block"], "letters": letters, "seen": seen, "odd": odd})
        seen += len(letters) - letters.count("D")
        at = end
    return out


def _edited(row: dict) -> list[dict]:
    turns = edit(row["letters"], row["seen"], row["odd"], row["rows"])
    return [{"key": row["key"], "block": row["block"], "turns": turns}] if turns else []


@dataclass
class Repair:
    """summary (key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row per conversation, and
    turns (key, block, turns array<struct<role, text>>): the repaired turns, by block in order."""

    summary: DataFrame
    turns: DataFrame


def repair(rows: DataFrame) -> Repair:
    """The cheapest repair of every conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn (nulls first); rows of one turn by role, then by the digest of role and text, so reruns
    agree. The first fault of a row counts: blank, duplicate (role and text seen earlier), truncated (does not
    end in . ! or ?). A null role or text is one space, and a row whose role has no initial s, u or a is never kept as it is; rows without a conv_id are one conversation; other columns are not
    looked at. Only conversations with a row are in the result; an empty table gives an empty one.

    Rows get their places by a range shuffle, so a conversation may hold any share of them. Blocks of up to 64
    rows are weighed from every state to every state, neighbours are composed pairwise, log n rounds, and
    the audit is dealt out to the blocks again. Only the audit, one value of the result, is as long as its conversation.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    bare = F.btrim(F.col("text"), F.lit(BLANKS))
    known = rows.select(present(F.col("conv_id")).alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    placed = in_chunks(known, ["key"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])
    block = F.shiftright("_seq", BLOCK).alias("block")
    narrow = placed.select(
        "key", "conv_id", "turn", "digest", "_seq", block, F.left("role", F.lit(1)).alias("initial"), (bare == "").alias("is_blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_open"))
    earliest = narrow.groupBy("key", "digest").agg(F.min("_seq").alias("_first"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("_first") < F.col("_seq"), "duplicate").when(F.col("is_open"), "truncated")
    number = (F.coalesce(F.when(F.col("initial").isin(*ROLES[:3]), F.instr(F.lit(ROLES), F.col("initial")) - 1), F.lit(3)) * FAULTS
              + F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0))
    # Digests alone meet; copies of one turn may be a third of all rows: a merge join, which Spark splits.
    marked = stage(narrow.join(earliest.hint("merge"), ["key", "digest"]).withColumn("fault", fault).select(
        "key", "conv_id", "turn", "_seq", "block", "fault", F.substr(F.lit(KINDS), number + 1, F.lit(1)).alias("kind")))

    def of(name: str) -> Column:
        return F.count_if(F.col("fault") == name).alias(name)

    sums = stage(marked.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), of("blank"), of("duplicate"), of("truncated"), F.max("turn").alias("_most"), F.min("turn").alias("_least"),
        F.count_distinct("turn").alias("_turns"), (F.min("block") == F.max("block")).alias("alone")).withColumn(
        "gaps", F.coalesce(F.col("_most") - F.col("_least") + 1 - F.col("_turns"), F.lit(0)).cast("long")).drop("_most", "_least", "_turns"))
    blocks = stage(marked.groupBy("key", "block").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_seq", "kind")))["kind"], "").alias("kinds"))
        .join(sums.select("key", "alone"), "key"))
    answers = _per_row(blocks.where("alone").select("key", "kinds"), _ANSWER, _alone)
    long = numbered(blocks.where(~F.col("alone")).select("key", "block", "kinds"), ["key"], [F.col("block")], "idx")
    nodes = stage(_per_row(long.select("key", "idx", "kinds"), _NODE, _block_node))
    while not nodes.where("idx > 0").isEmpty():
        pairs = nodes.groupBy("key", F.shiftright("idx", 1).alias("idx")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "rows", "illegal", "first", "last", "cells"))).alias("pair"))
        nodes = stage(_per_row(pairs, _NODE, _joined_node))
    answers = stage(answers.unionByName(_per_row(nodes, _ANSWER, _whole)))
    sizes = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", F.length("kinds").alias("rows")))).alias("blocks"))
    letters = _per_row(answers.select("key", "audit").join(sizes, "key"), "key string, block long, letters string, seen long, odd boolean", _pieces)
    texts = placed.groupBy("key", block).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_seq", "role", "text"))), lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))
    turns = _per_row(texts.join(letters, ["key", "block"]), "key string, block long, turns array<struct<role: string, text: string>>", _edited)
    summary = sums.drop("alone").join(answers, "key").select(
        "key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return Repair(summary, turns)


def text_digests(turns: DataFrame) -> DataFrame:
    """(key, sha256): SHA-256 of the lines role:text of each conversation, joined by line feeds.

    The digest of a conversation can only be taken in order, so its blocks, a row each, stream through one task in
    that order; no task holds more than a block.
    """
    lines = turns.select("key", "block", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n").alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("lines").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done))), ["key", "sha256"])
        if key is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "sha256": [state.hexdigest()]})

    return lines.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key string, sha256 string")


def repair_report(conversations: DataFrame) -> DataFrame:
    """Every conv_id of the table with what damage() and repair() make of it and repaired_sha256. A conversation that loses all
    rows has zeros, an empty audit and the digest of no text; an empty table gives an empty result."""
    done = repair(damage(conversations))
    every = conversations.select(present(F.col("conv_id")).alias("key"), "conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (every.join(done.summary.drop("conv_id"), "key", "left").join(text_digests(done.turns), "key", "left")
            .select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
