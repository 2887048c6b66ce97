"""Contiguous minimax sharding of ordered atomic groups, with DataFrame operations only.

A group is the set of rows with equal texts. Groups stand in the order of their texts' SHA-256, which mixes the sources, and a shard
is a run of that order. The cuts are those of a greedy pass at the smallest capacity with which it needs no more shards than there
are, found by binary search.

The search runs on a digest of bounded size. The order is divided into runs by hexadecimal prefixes, of which only sums and largest
groups reach the driver. On runs, a greedy pass is known up to an earliest and a latest cut; the runs between the two are divided
again, level by level, until each of them is a single group and the cuts are exact. No step sees all groups at once.

Defined results: a null text is a group of its own with size 1, first in the order; an empty text has size 1 too; rows that are
repeated stay together and get slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import written


class Run(NamedTuple):
    """Neighbouring groups whose keys begin with `prefix`."""

    prefix: str
    size: int
    largest: int
    groups: int


def group_key(text: Column) -> Column:
    """Equal texts have equal keys; null comes first."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit(""))


def cut_bounds(runs: list[Run], ends: list[int], capacity: int, shards: int) -> list[tuple[int, int, int]]:
    """For each greedy step: the earliest and the latest byte at which its shard can end, and the byte it may not pass.

    The pass is monotone in its start, so bounds on one cut give bounds on the next. In a run of several groups, the group that
    doesn't fit begins less than the run's largest group before the goal.
    """
    total, early, late, steps = ends[-1], 0, 0, []
    for _ in range(shards):
        goals = [early + capacity, late + capacity]
        cuts = []
        for goal, sure in zip(goals, (True, False), strict=True):
            if goal >= total:
                cuts.append(total)
                continue
            k = bisect_right(ends, goal)
            start = ends[k] - runs[k].size
            if runs[k].groups == 1:
                cuts.append(start)
            else:
                cuts.append(max(start, goal - runs[k].largest + 1) if sure else goal)
        early, late = cuts
        steps.append((early, late, min(goals[1], total)))
    return steps


def capacity_range(runs: list[Run], ends: list[int], shards: int) -> tuple[int, int]:
    """Binary searches: the least capacity that may do, and the least that surely does."""

    def least(low: int, high: int, which: int) -> int:
        while low < high:
            middle = (low + high) // 2
            if cut_bounds(runs, ends, middle, shards)[-1][which] >= ends[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    largest = max(r.largest for r in runs)
    floor = max(largest, -(-ends[-1] // shards))
    surely = least(floor, floor + largest, 0)
    return least(floor, surely, 1), surely


def _digest(groups: DataFrame, digits: int) -> list[Run]:
    rows = (
        groups.groupBy(F.substring("group_key", 1, digits).alias("prefix"))
        .agg(F.sum("size"), F.max("size"), F.count(F.lit(1)))
        .collect()
    )
    return sorted(Run(*r) for r in rows)


def minimax_cuts(groups: DataFrame, shards: int, digits: int = 3) -> tuple[list[str], int]:
    """Prefixes with which the 2nd, 3rd, ... shard begins, and the capacity, for (group_key, size) rows.

    At most 16 ** digits runs reach the driver at first, then as many for each run in doubt; runs in doubt are those near a cut, and
    of these at most 64 are divided by `digits` more digits, else all by one.
    """
    runs, depth = _digest(groups, digits), digits
    if not runs:
        return [], 0
    while True:
        ends = list(accumulate(r.size for r in runs))
        low, high = capacity_range(runs, ends, shards)
        doubt: set[int] = set()
        for (early, _, _), (_, _, goal) in zip(cut_bounds(runs, ends, low, shards), cut_bounds(runs, ends, high, shards), strict=True):
            doubt.update(k for k in range(bisect_right(ends, early), min(bisect_right(ends, goal) + 1, len(runs))) if runs[k].groups > 1)
        if not doubt:
            break
        depth += digits if len(doubt) <= 64 else 1
        inside = groups.where(F.substring("group_key", 1, len(runs[min(doubt)].prefix)).isin([runs[k].prefix for k in doubt])) if len({len(runs[k].prefix) for k in doubt}) == 1 else groups.where(_any_prefix(runs, doubt))
        runs = sorted([r for k, r in enumerate(runs) if k not in doubt] + _digest(inside, depth))
    firsts = []
    for _, late, _ in cut_bounds(runs, ends, high, shards)[:-1]:
        if late < ends[-1]:
            firsts.append(runs[bisect_right(ends, late)].prefix)
    return firsts, high


def _any_prefix(runs: list[Run], doubt: set[int]) -> Column:
    """Whether a key lies in a run in doubt, for runs of several depths."""
    by_depth: dict[int, list[str]] = {}
    for k in doubt:
        by_depth.setdefault(len(runs[k].prefix), []).append(runs[k].prefix)
    tests = [F.substring("group_key", 1, n).isin(prefixes) for n, prefixes in by_depth.items()]
    return F.greatest(*tests) if len(tests) > 1 else tests[0]


def minimax_shards(docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", rows_per_task: int = 100_000) -> DataFrame:
    """Assign every row to a shard 0 to shards - 1 and to a slot, gapless from 0 in its shard.

    Returns (key, size, text_crc32, group_key, shard, slot). The texts are read once; what follows works on a narrow table.
    """
    body = F.col(text).cast("binary")
    rows = written(
        docs.select(
            F.col(key),
            (F.coalesce(F.octet_length(body), F.lit(0)) + F.lit(1)).cast("long").alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
            group_key(F.col(text)).alias("group_key"),
        )
    )
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    firsts, _ = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("group_key") >= F.lit(first)).cast("int")
    # A shard's rows are numbered in parts of bounded size, spread by doc_id and text length alike, so that no group lands in one task.
    parts = max(64, -(-(groups.agg(F.sum("n")).first()[0] or 0) // (shards * rows_per_task)))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "part").orderBy(key, "group_key")
    numbered = placed.withColumn("within", F.row_number().over(within))
    return numbered.join(starts, ["shard", "part"]).select(
        key, "size", "text_crc32", "group_key", "shard", (F.col("start") + F.col("within") - 1).cast("long").alias("slot")
    )
