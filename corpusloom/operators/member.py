"""Exact membership in a large set for rows that should not be moved: a chain of blocked Bloom filters.

The rows that will be asked about are known, so the wrong answers of a filter can be listed and put into a filter of their
own, whose wrong answers go into a third, and so on: each is about a hundred times smaller than the one before. A row is
a member if the filters that it hits in a row, from the first, are odd in number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.staging import stage

# Members that are broadcast as they are.
BROADCAST_ROWS = 100_000
# A block is a row of 512 bits, of which a key sets four; 2 ** 18 blocks are 24 MB at most, which bounds the broadcast. More
# members than that is good for make the filters weaker and the chain longer, up to MOST_FILTERS.
WORDS = 8
KEYS_PER_BLOCK = 32
MOST_BLOCKS = 1 << 18
MOST_FILTERS = 8


def _blocks(n: int) -> int:
    return min(MOST_BLOCKS, 1 << max(0, (n // KEYS_PER_BLOCK).bit_length()))


def _block(on: list[str], seed: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *on), F.lit(blocks)).cast("int")


def _spots(on: list[str], seed: int) -> list[Column]:
    """Four places among the bits of a block."""
    number = F.xxhash64(F.lit(-1 - seed), *on)
    return [F.shiftrightunsigned(number, 9 * i).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for i in range(4)]


def build(keys: DataFrame, on: list[str], seed: int, blocks: int) -> DataFrame:
    """(block, words) of the blocks that have a key."""
    spots, one = _spots(on, seed), F.lit(1).cast("long")

    def word(i: int) -> Column:
        bits = [F.when(F.shiftright(s, 6) == i, F.call_function("shiftleft", one, s % 64)).otherwise(0) for s in spots]
        return F.bit_or(bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])).alias(f"w{i}")

    return keys.groupBy(_block(on, seed, blocks).alias("_block")).agg(*map(word, range(WORDS))).select(
        "_block", F.array(*(f"w{i}" for i in range(WORDS))).alias("_words"))


def with_hit(rows: DataFrame, bits: DataFrame, on: list[str], seed: int, blocks: int, name: str) -> DataFrame:
    """rows with a flag that holds for every key of the filter and few others. The filter is bounded, so it is broadcast."""
    set_ = [F.getbit(F.element_at("_words", F.shiftright(s, 6) + 1), s % 64) == 1 for s in _spots(on, seed)]
    met = rows.withColumn("_block", _block(on, seed, blocks)).join(F.broadcast(bits), "_block", "left")
    return met.withColumn(name, F.coalesce(set_[0] & set_[1] & set_[2] & set_[3], F.lit(False))).drop("_block", "_words")


def with_member(rows: DataFrame, members: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with the flag `name`: whether their columns `on`, never null, are in members (those columns, staged, different).

    Rows are not moved: members are broadcast if they are few, else a chain of filters is. Should the chain not end, which takes
    far more members than its blocks are made for, rows and members meet in a join.
    """
    n = members.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(members.withColumn(name, F.lit(True))), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    chain: list[tuple[DataFrame, int]] = []
    inside, outside = members, rows.select(*on).join(members, on, "left_anti").distinct()
    while len(chain) < MOST_FILTERS:
        seed, blocks = len(chain), _blocks(n)
        bits = stage(build(inside, on, seed, blocks))
        chain.append((bits, blocks))
        wrong = stage(with_hit(outside, bits, on, seed, blocks, "_hit").where("_hit").select(*on))
        n = wrong.count()
        if n == 0:
            break
        inside, outside = wrong, inside
    else:
        return rows.join(members.withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    answer = F.lit(len(chain) % 2 == 1)
    for seed, (bits, blocks) in enumerate(chain):
        rows = with_hit(rows, bits, on, seed, blocks, f"_hit{seed}")
    for seed in reversed(range(len(chain))):
        answer = F.when(~F.col(f"_hit{seed}"), F.lit(seed % 2 == 1)).otherwise(answer)
    return rows.withColumn(name, answer).drop(*(f"_hit{i}" for i in range(len(chain))))
