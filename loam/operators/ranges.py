"""Joins of keys with the key ranges that hold them, as equi-joins on bins of keys (no nested loop over ranges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bins of keys, at most. Cuts come from at most SAMPLE ranges; only these reach the driver.
BINS, SAMPLE = 256, 4096


def cut_points(ranges: DataFrame, bins: int = BINS, sample: int = SAMPLE) -> list:
    """At most bins - 1 keys, evenly spread over the smallest keys of a uniform sample of the ranges."""
    some = ranges.select("smallest").where(F.col("smallest").isNotNull()).orderBy(F.xxhash64("smallest")).limit(sample)
    found = sorted({bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in some.collect()})
    return sorted({found[len(found) * k // bins] for k in range(1, bins)}) if found else []


def bin_of(key: Column, cuts: list) -> Column:
    """How many cuts are at or below the key, by binary search; 0 for a null key."""
    if not cuts:
        return F.lit(0)
    held = F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def held_by(keys: DataFrame, ranges: DataFrame, how: str = "inner", bins: int = BINS) -> DataFrame:
    """keys (user_key, ...) joined (inner or left_semi) with the ranges (smallest, largest, ..., both ends included) that hold the key.

    A key lies in one bin, a range in every bin that it touches: disjoint ranges make at most one row each and one a
    bin, and a key meets only the ranges of its bin. Spark broadcasts the ranges where they are below its threshold and
    shuffles by bin otherwise. Null keys and ranges with a null end or with their ends reversed hold nothing.
    """
    cuts = cut_points(ranges, bins)
    dealt = ranges.where("smallest <= largest").withColumn("_range_bin", F.explode(F.sequence(bin_of(F.col("smallest"), cuts), bin_of(F.col("largest"), cuts))))
    binned = keys.withColumn("_bin", bin_of(F.col("user_key"), cuts))
    near = F.col("_bin") == F.col("_range_bin")
    return binned.join(dealt, near & (F.col("user_key") >= F.col("smallest")) & (F.col("user_key") <= F.col("largest")), how).drop("_bin", "_range_bin")
