"""Draws that depend on keys alone: the same on any cluster and partitioning, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(key: Column, slot: str | Column, seed: int = 42) -> Column:
    """A number from 0 to 2**32 - 1 for a key and a slot."""
    slot = F.lit(slot) if isinstance(slot, str) else slot
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), slot.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")


def below(key: Column, slot: str, n: int | Column, seed: int = 42) -> Column:
    return F.pmod(u32(key, slot, seed), F.lit(n) if isinstance(n, int) else n)


def pick(key: Column, slot: str, values: list[str], seed: int = 42) -> Column:
    """One of the values, all equally likely."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (below(key, slot, len(values), seed) + 1).cast("int"))


def weighted(key: Column, slot: str, values: list[tuple[str, int]], seed: int = 42) -> Column:
    """One of the values by integer weights."""
    at, total, out = below(key, slot, sum(w for _, w in values), seed), 0, None
    for value, w in values[:-1]:
        total += w
        out = F.when(at < total, value) if out is None else out.when(at < total, value)
    return out.otherwise(values[-1][0]) if out is not None else F.lit(values[-1][0])


def digits(key: Column, slot: str, n: int, seed: int = 42) -> Column:
    """n decimal digits, at most 9."""
    return F.lpad(below(key, slot, 10**n, seed).cast("string"), n, "0")


def letter(key: Column, slot: str, of: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", seed: int = 42) -> Column:
    return F.substring(F.lit(of), (below(key, slot, len(of), seed) + 1).cast("int"), F.lit(1))
