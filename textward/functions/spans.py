"""Matches of a pattern with their places, in code points from 0, the end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes and word borders, as Python's patterns have them.
UNICODE = "(?U)"
SPAN = "struct<value:string,start:int,end:int>"


#: Numbers that are added up at a time. A fold copies what it has at each step, so one over all numbers would take the square of their count.
BLOCK = 128


def running_sums(numbers: Column) -> Column:
    """The sums of the first, the first two, ... of an array of numbers that is not empty: within blocks, and then moved by the sums of the blocks before."""
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    none = F.array().cast("array<int>")

    def moved(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: add(acc, F.element_at(b, -1)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o)))

    def in_blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        return F.transform(F.array(F.transform(starts, lambda k: F.aggregate(F.slice(all_, k, F.lit(BLOCK)), none, add))), moved)[0]

    return F.transform(F.array(numbers), in_blocks)[0]


def find_all(text: Column, pattern: str) -> Column:
    """Non-overlapping matches from the left: an array of (value, start, end). What lies between matches gives the places, which are running sums of lengths."""
    p = F.lit(UNICODE + pattern)

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, UNICODE + pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda gap, value: F.length(gap) + F.length(value))
        return F.zip_with(found, running_sums(steps), lambda value, end: F.struct(value.alias("value"), (end - F.length(value)).alias("start"), end.alias("end")))

    # found is computed once; texts without a match, most of them, are scanned once
    return F.transform(F.array(F.regexp_extract_all(text, p, F.lit(0))), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(f"array<{SPAN}>")))[0]


def first_place(text: Column, value: Column) -> Column:
    """Where the value first occurs, -1 if nowhere."""
    return F.call_function("locate", value, text) - 1


def all_places(text: Column, value: Column) -> Column:
    """Every start of the value, overlapping ones too."""
    n, m = F.length(text), F.length(value)
    starts = F.when((m > 0) & (n >= m), F.sequence(F.lit(0), n - m)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.substring(text, i + 1, m) == value)
