"""Size-weighted key samples, quantile splitters and exact range totals.

Used by sharding (ranges of equal bytes) and packing (ranges of equal tokens). DataFrame functions only. What reaches the
driver is the sample and one total for each range: both are bounded by MAX_RANGES, whatever the input.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed bounds of what the driver holds.
MAX_RANGES = 65536
SAMPLES_PER_RANGE = 8
#: Splitter intervals are looked up through this many equal slices of the first key.
SLICE_BITS = 12


@dataclass(frozen=True)
class Ranges:
    """rows: the input with range_id; before: rows and weight that lie in front of each range."""

    rows: DataFrame
    before: DataFrame
    total: int
    count: int


def _sample(df: DataFrame, every: float, seed: int) -> list[tuple[int, int, float]]:
    """Draw keys with probability weight / every (certain above 1); each draw stands for max(weight, every)."""
    u = F.pmod(F.xxhash64(F.col("k1"), F.col("k2"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = df.filter(u < F.col("w") / F.lit(every)).select("k1", "k2", F.greatest("w", F.lit(every)).alias("m"))
    return sorted((r[0], r[1], r[2]) for r in drawn.collect())


def _quantiles(drawn: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    mass = sum(m for *_, m in drawn)
    cuts, seen = [], 0.0
    for a, b, m in drawn:
        if seen >= (len(cuts) + 1) * mass / parts and (not cuts or (a, b) > cuts[-1]):
            cuts.append((a, b))
        seen += m
    return cuts


def _intervals(df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """df with range_id = number of cuts at or below (k1, k2), by a broadcast join of at most 2**SLICE_BITS + cuts rows."""
    shift = 64 - SLICE_BITS
    lo, hi = -(1 << 63), (1 << 63) - 1
    edges = [(lo, lo), *cuts, (hi, hi)]
    rows = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        for s in range(a[0] >> shift, (b[0] >> shift) + 1):
            rows.append((s, a[0], a[1], b[0], b[1], i))
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "slice long, lo1 long, lo2 long, hi1 long, hi2 long, range_id int")
    last = len(edges) - 2
    above = (F.col("k1") > F.col("lo1")) | ((F.col("k1") == F.col("lo1")) & (F.col("k2") >= F.col("lo2")))
    below = (F.col("k1") < F.col("hi1")) | ((F.col("k1") == F.col("hi1")) & (F.col("k2") < F.col("hi2"))) | (F.col("range_id") == last)
    keyed = df.withColumn("slice", F.shiftright("k1", shift))
    return keyed.join(F.broadcast(table), (keyed["slice"] == table["slice"]) & above & below).drop(keyed["slice"]).drop("slice", "lo1", "lo2", "hi1", "hi2")


def sampled_ranges(df: DataFrame, n_ranges: int, seed: int = 17, overfull: float = 2.0, rounds: int = 3) -> Ranges:
    """Cut (k1 long, k2 long, w long > 0, ...) into about n_ranges key ranges of near equal weight.

    Splitters are quantiles of a sample drawn in proportion to w. Exact range totals follow; a range heavier than overfull
    times the mean is sampled anew and subdivided, up to `rounds` times (a single heavy row can't be cut). Rows with equal
    keys stay in one range, so keys should end in a unique id. df should be a stored table: it is read a few times.
    An empty input gives no ranges.
    """
    n_ranges = max(1, min(n_ranges, MAX_RANGES))
    total, count = df.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count("*")).first()
    spark = df.sparkSession
    if not count:
        empty = spark.createDataFrame([], "range_id int, rows_before long, weight_before long")
        return Ranges(df.withColumn("range_id", F.lit(0)), empty, 0, 0)
    mean = total / n_ranges
    cuts = _quantiles(_sample(df, max(1.0, mean / SAMPLES_PER_RANGE), seed), n_ranges)
    for again in range(rounds + 1):
        ranged = _intervals(df, cuts)
        totals = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range_id").agg(F.count("*"), F.sum("w")).collect()}
        heavy = [i for i, (n, w) in totals.items() if w > overfull * mean and n > 1]
        if again == rounds or not heavy or len(cuts) + len(heavy) >= MAX_RANGES:
            break
        drawn = _sample(ranged.filter(F.col("range_id").isin(heavy)), max(1.0, mean / SAMPLES_PER_RANGE), seed + again + 1)
        more = set(cuts)
        for i in heavy:
            own = [x for x in drawn if bisect.bisect_right(cuts, x[:2]) == i]
            more |= set(_quantiles(own, max(2, math.ceil(totals[i][1] / mean))))
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    rows, seen_n, seen_w = [], 0, 0
    for i in sorted(totals):
        rows.append((i, seen_n, seen_w))
        seen_n, seen_w = seen_n + totals[i][0], seen_w + totals[i][1]
    return Ranges(ranged, spark.createDataFrame(rows, "range_id int, rows_before long, weight_before long"), total, count)
