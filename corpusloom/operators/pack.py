"""Greedy packing of files into parts of a token budget, in file order.

A part is closed when the next file does not fit, so each decision hangs on the one
before. To keep a huge project out of one task the ordered files are cut into chunks.
How a chunk acts on the fill level of the part that is open at its start is a step
function with at most as many steps as files fit one budget. Such functions compose: the
chunks of a project are the leaves of a binary tree whose nodes are composed pairwise
from below, and the fill levels go down from the root. Then every chunk assigns its own files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import chunk_bases, in_chunks, positions
from corpusloom.staging import stage

_FUNCTION = ("total", "fits", "fill", "opened")
_TYPES = "total long, fits array<long>, fill array<long>, opened array<long>"


def _next_starts(ends: np.ndarray, budget: int) -> np.ndarray:
    """For a part that starts at file i, the file that starts the part after it."""
    starts = np.concatenate(([0], ends[:-1]))
    return np.maximum(np.searchsorted(ends, starts + budget, side="right"), np.arange(len(ends)) + 1)


def _first_start(ends: np.ndarray, fill: int, budget: int) -> int:
    """First file that does not fit a part already filled to this level (below 0: no open part)."""
    return 0 if fill < 0 else int(np.searchsorted(ends, budget - fill, side="right"))


def _merged(fits: np.ndarray, fill: np.ndarray, opened: np.ndarray, budget: int) -> tuple[np.ndarray, ...]:
    """Without the steps that no room reaches, and one row for each run of steps that end alike."""
    reached = int(np.searchsorted(fits, budget, side="right")) + 1
    fits, fill, opened = fits[:reached], fill[:reached], opened[:reached]
    run_end = np.append((np.diff(fill) != 0) | (np.diff(opened) != 0), True)
    return fits[run_end], fill[run_end], opened[run_end]


def _steps(tokens: np.ndarray, budget: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The function of a chunk: its total, and by the file e at which the first new part starts the fill level at the
    end and the parts opened.

    A part is started at or before e by every fill level whose free room is below fits, the
    tokens up to and with file e. With room for all of them the chunk only adds its total.
    """
    ends = tokens.cumsum()
    nxt = _next_starts(ends, budget)
    n, total = len(ends), int(ends[-1])
    entries = min(_first_start(ends, 0, budget), n - 1) + 1
    fill, opened = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for e in range(entries - 1, -1, -1):
        trail, at = [], e
        while at < n and opened[at] == 0:
            trail.append(at)
            at = nxt[at]
        for i in reversed(trail):
            if nxt[i] >= n:
                fill[i], opened[i] = total - (ends[i - 1] if i else 0), 1
            else:
                fill[i], opened[i] = fill[nxt[i]], opened[nxt[i]] + 1
    return total, *_merged(ends[:entries], fill[:entries], opened[:entries], budget)


def _then(left: tuple, right: tuple, budget: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The function of two neighbours: the steps of the left one go on through the right one; behind them, where all of
    the left one fits, come the steps of the right one."""
    l_total, l_fits, l_fill, l_opened = left
    r_total, r_fits, r_fill, r_opened = right
    at = np.searchsorted(r_fits, budget - l_fill, side="right")
    step = np.minimum(at, len(r_fits) - 1)
    on = at < len(r_fits)
    fill = np.where(on, r_fill[step], l_fill + r_total)
    opened = l_opened + np.where(on, r_opened[step], 0)
    return l_total + r_total, *_merged(np.concatenate([l_fits, l_total + r_fits]), np.concatenate([fill, r_fill]),
                                       np.concatenate([opened, r_opened]), budget)


def _chunk_function(chunk: pd.DataFrame, budget: int) -> pd.DataFrame:
    found = _steps(chunk.sort_values("_seq")["tokens"].to_numpy(), budget)
    return pd.DataFrame({"project": chunk["project"].iloc[:1], "_chunk": chunk["_chunk"].iloc[:1]}).assign(
        **{name: [value] for name, value in zip(_FUNCTION, found)})


def _paired(nodes: DataFrame) -> DataFrame:
    """(project, idx, left, right): two neighbours, of which one may be missing, in a row."""
    odd = F.col("idx").bitwiseAND(F.lit(1)) == 1
    function = F.struct(*_FUNCTION)
    return nodes.groupBy("project", F.shiftright("idx", 1).alias("idx")).agg(
        F.first(F.when(~odd, function), True).alias("left"), F.first(F.when(odd, function), True).alias("right"))


def _composed(pairs: DataFrame, budget: int) -> DataFrame:
    """(project, idx, function) of the pairs."""

    def run(batches):
        for rows in batches:
            found = []
            for row in rows.itertuples(index=False):
                sides = [(side["total"], *(np.asarray(side[c], np.int64) for c in _FUNCTION[1:])) for side in (row.left, row.right) if side is not None]
                found.append(sides[0] if len(sides) == 1 else _then(*sides, budget))
            yield pd.DataFrame({"project": rows["project"], "idx": rows["idx"], **{
                name: [f[i] for f in found] for i, name in enumerate(_FUNCTION)}})

    return pairs.mapInPandas(run, f"project string, idx int, {_TYPES}")


def _children(pairs: DataFrame, states: DataFrame, budget: int) -> DataFrame:
    """(project, idx, fill_in, part_in) one level down: what enters the pair enters its left node, what that makes of it the right one."""
    room = F.when(F.col("fill_in") < 0, -1).otherwise(F.lit(budget) - F.col("fill_in"))
    at = F.size(F.filter("left.fits", lambda f: f <= room))
    state = pairs.join(states, ["project", "idx"]).withColumn("_at", at)
    after_fill = F.coalesce(F.get("left.fill", F.col("_at")), F.col("fill_in") + F.col("left.total"), F.col("fill_in"))
    after_part = F.col("part_in") + F.coalesce(F.get("left.opened", F.col("_at")), F.lit(0))

    def node(idx: Column, fill: Column, part: Column) -> Column:
        return F.struct(idx.cast("int").alias("idx"), fill.alias("fill_in"), part.alias("part_in"))

    twice = F.col("idx") * 2
    both = F.array(F.when(F.col("left").isNotNull(), node(twice, F.col("fill_in"), F.col("part_in"))),
                   F.when(F.col("right").isNotNull(), node(twice + 1, after_fill, after_part)))
    return state.select("project", F.inline(F.array_compact(both)))


def chain(nodes: DataFrame, start: DataFrame, budget: int, chunks: int) -> DataFrame:
    """(project, idx, fill_in, part_in) of every chunk of nodes (project, idx, function), of which a project has at most
    `chunks`, from those of its first (project, fill_in, part_in). log2(chunks) rounds of pairs, no larger group."""
    levels = []
    while chunks > 1 << len(levels):
        levels.append(stage(_paired(nodes)))
        nodes = _composed(levels[-1], budget)
    states = start.withColumn("idx", F.lit(0))
    for pairs in reversed(levels):
        states = _children(pairs, states, budget)
    return states


def _assign(chunk: pd.DataFrame, budget: int) -> pd.DataFrame:
    chunk = chunk.sort_values("_seq")
    ends = chunk["tokens"].to_numpy().cumsum()
    nxt = _next_starts(ends, budget)
    opens = np.zeros(len(ends), dtype=np.int64)
    at = _first_start(ends, int(chunk["fill_in"].iloc[0]), budget)
    while at < len(ends):
        opens[at] = 1
        at = nxt[at]
    return pd.DataFrame({
        "project": chunk["project"], "path": chunk["path"], "ord": chunk["ord"], "tokens": chunk["tokens"],
        "part": chunk["part_in"].iloc[0] + opens.cumsum()})


def pack_chunks(chunked: DataFrame, budget: int, preamble: DataFrame | None = None) -> DataFrame:
    """(project, path, ord, tokens, part) for files in chunks and with their positions.

    preamble (project, tokens) opens part 1 of its project with that fill level.
    Files carry at least one token each, as wrapped texts do.
    """
    keys = ["project", "_chunk"]
    spans = chunk_bases(chunked, ["project"])
    if preamble is None:
        spans = spans.withColumn("start_fill", F.lit(-1).cast("long"))
    else:
        start = preamble.select("project", F.col("tokens").cast("long").alias("start_fill"))
        spans = spans.join(start, "project", "left").fillna({"start_fill": -1})
    states = firsts = spans.where("_before = 0").select(
        *keys, F.col("start_fill").alias("fill_in"),
        F.when(F.col("start_fill") < 0, 0).otherwise(1).cast("long").alias("part_in"))
    # A project crosses a chunk border only if the border falls into it, so there are
    # fewer such projects than chunks: this list has a proven bound.
    crossing = stage(chunked.groupBy("project").agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last")).where("_first < _last"))
    chunks = crossing.agg(F.max(F.col("_last") - F.col("_first") + 1)).first()[0]
    if chunks:
        crossing = F.broadcast(crossing)
        nodes = (
            chunked.select(*keys, "_seq", "tokens").join(crossing.select("project"), "project", "left_semi")
            .groupBy(*keys).applyInPandas(lambda pdf: _chunk_function(pdf, budget), f"project string, _chunk int, {_TYPES}")
            .join(crossing, "project").withColumn("idx", F.col("_chunk") - F.col("_first")).select("project", "idx", *_FUNCTION))
        chained = chain(nodes, firsts.join(crossing, "project", "left_semi").drop("_chunk"), budget, chunks)
        states = firsts.join(crossing, "project", "left_anti").unionByName(
            chained.join(crossing, "project").select("project", (F.col("idx") + F.col("_first")).alias("_chunk"), "fill_in", "part_in"))
    return (
        chunked.select(*keys, "_seq", "path", "ord", "tokens")
        .join(states, keys).groupBy(*keys)
        .applyInPandas(lambda pdf: _assign(pdf, budget),
                       "project string, path string, ord long, tokens long, part long")
    )


def pack_parts(files: DataFrame, budget: int, order: list[Column], preamble: DataFrame | None = None) -> DataFrame:
    """Parts for files (project, path, tokens, ...) in the given total order."""
    return pack_chunks(positions(in_chunks(files, ["project"], order), ["project"]), budget, preamble)


def part_file_name(template: str, stamp: str, part: Column) -> Column:
    """Part 1 keeps the base name; part n gets -part<n> before the extension."""
    base = F.replace(F.lit(template), F.lit("{timestamp}"), F.regexp_replace(F.lit(stamp), "[:.]", "-"))
    ext = F.regexp_extract(base, r"(?:\A|/)[^/]+?(\.[^/.]*)\z", 1)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(ext))
    return F.when(part == 1, base).otherwise(F.concat(stem, F.lit("-part"), part.cast("string"), ext))
