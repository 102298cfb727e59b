"""Sets of states as bits of a bigint; sets of wider alphabets as several of them, the lowest symbols first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SYMBOLS = 62


def is_wide(symbols: int) -> bool:
    return symbols > MOST_SYMBOLS


def packed(sets: Iterable[int], symbols: int) -> list[int]:
    """Sets as bigints: one each, or as many as the alphabet takes."""
    if not is_wide(symbols):
        return list(sets)
    part = (1 << MOST_SYMBOLS) - 1
    return [s >> at & part for s in sets for at in range(0, symbols, MOST_SYMBOLS)]


def unpacked(values: Iterable[int] | None, symbols: int) -> list[int] | None:
    """The sets that `packed` made bigints of."""
    if values is None:
        return None
    values = [int(v) for v in values]
    if not is_wide(symbols):
        return values
    step = -(-symbols // MOST_SYMBOLS)
    return [sum(v << k * MOST_SYMBOLS for k, v in enumerate(values[at : at + step])) for at in range(0, len(values), step)]


def full_mask(size: int | Column) -> Column:
    """The set of all symbols of an alphabet: what a missing value stands for."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1 if isinstance(size, Column) else F.lit((1 << size) - 1)


def encode(symbols: Column, alphabet: Column) -> Column:
    """Mask of an array of symbols under an ordered alphabet; null stays null, unknown symbols are ignored."""
    places = F.transform(symbols, lambda s: F.array_position(alphabet, s).cast("int"))
    bits = F.transform(F.filter(places, lambda p: p > 0), lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p - 1))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def decode(mask: Column, alphabet: Column) -> Column:
    """Symbols of a mask, in the order of the alphabet."""
    return F.filter(alphabet, lambda s, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def disjoint(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseAND(right)) == 0


def first_state(mask: Column) -> Column:
    """The lowest single state of a set; 0 of the empty set."""
    return mask.bitwiseAND(-mask)


def fitch(left: Column, right: Column) -> tuple[Column, Column]:
    """State and added cost of a parent: the common states, else all of them at one step."""
    common = left.bitwiseAND(right)
    return F.when(common != 0, common).otherwise(left.bitwiseOR(right)), F.when(common != 0, 0).otherwise(1).cast("long")


def discrete_three_way(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Median and cost of three sets under the 0/1 metric."""
    every = a.bitwiseAND(b).bitwiseAND(c)
    pairs = a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))
    median = F.when(every != 0, every).when(pairs != 0, pairs).otherwise(a.bitwiseOR(b).bitwiseOR(c))
    return median, F.when(every != 0, 0).when(pairs != 0, 1).otherwise(2)
