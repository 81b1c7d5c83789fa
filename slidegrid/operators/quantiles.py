"""Exact quantiles of groups of any size, by narrowing histograms.

Spark's percentile holds all different values of a group in one task. Here each pass counts the values of the range in
which a wanted rank lies by bins, adds the counts up and goes on with the bin that holds the rank. A bin is a pair of a
linear and a logarithmic part of the range; both rise with the value, so bins are in order, and both regular values and
such that span many powers of ten are cut down in a few passes. Ranges with at most `direct` rows are counted value by
value. What a task holds is bounded by the bins and by `direct`, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import finite
from ..sources.shared import stored

DIRECT, BINS = 1_000_000, 128


def _bin(v: Column, low: Column, high: Column) -> Column:
    """A number that rises with v from low to high: BINS equal parts of the values, and in them BINS equal parts of their signed logarithms."""
    signed = lambda x: F.signum(x) * F.coalesce(F.ln(F.abs(x)) + 745, F.lit(0.0))  # noqa: E731  the least positive double has -744.4; the logarithm of 0 is null
    part = lambda x, a, b: F.coalesce(F.least(F.floor(F.try_divide(x - a, b - a) * BINS), F.lit(BINS - 1)), F.lit(0))
    return (part(v / 2, low / 2, high / 2) * BINS + part(signed(v), signed(low), signed(high))).cast("long")  # halves, as differences of large doubles overflow


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str] = (), probabilities: Sequence[float] = (0.25, 0.5, 0.75), *, direct: int = DIRECT, passes: list | None = None) -> DataFrame:
    """by..., n, and for each probability a column q0, q1, ...: linear between the two nearest ranks, as numpy's default and SQL's quantile_cont.

    Only finite values count; groups without any are left out; null is a group. `passes` gets the number of open ranges of each pass.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    base = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).where(finite(F.col("_v")))
    groups = stored(base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).where("n > 0"))
    spots = F.array(*[F.lit(float(p)) for p in probabilities])
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda p: F.array(F.floor(p * (F.col("n") - 1)), F.ceil(p * (F.col("n") - 1))))))
    open_ = groups.select(*keys, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    done = [open_.where("low = high").select(*keys, "rank", F.col("low").alias("v"))]
    open_ = open_.where("low < high")
    while True:
        wide = open_.where(F.col("inside") > direct)
        ranges = wide.select(*keys, "low", "high").distinct()
        many = ranges.count()
        if passes is not None:
            passes.append(many)
        if not many:
            break
        small = open_.where(F.col("inside") <= direct)
        counted = _meet(base, ranges, keys).withColumn("_bin", _bin(F.col("_v"), F.col("low"), F.col("high")))
        counted = counted.groupBy(*keys, "low", "high", "_bin").agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        found = _holding(stored(counted), wide, keys, "_bin")
        found = found.select(*keys, "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside"))
        open_ = stored(small.unionByName(found))
        done.append(open_.where("low = high").select(*keys, "rank", F.col("low").alias("v")))
        open_ = open_.where("low < high")
    counted = _meet(base, open_.select(*keys, "low", "high").distinct(), keys).groupBy(*keys, "low", "high", "_v").agg(F.count("*").alias("c"))
    done.append(_holding(counted, open_, keys, "_v").select(*keys, "rank", F.col("_v").alias("v")))
    values = reduce(lambda a, b: a.unionByName(b), done).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = groups.select(*[F.col(k).alias(f"{k}g") for k in keys], "n").join(values, _same(keys, "g"))

    def between(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return a + (b - a) * (place - F.floor(place))

    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *[between(p).alias(f"q{i}") for i, p in enumerate(probabilities)])


def _same(keys: Sequence[str], end: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}{end}")) for k in keys], F.lit(True))


def _meet(base: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values with the ranges (few for each group) that hold them."""
    ranges = ranges.select(*[F.col(k).alias(f"{k}r") for k in keys], "low", "high")
    if not keys:
        ranges = F.broadcast(ranges)  # at most two ranges for each probability
    return base.join(ranges, _same(keys, "r") & F.col("_v").between(F.col("low"), F.col("high"))).select(*base.columns, "low", "high")


def _holding(counted: DataFrame, wanted: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the counts of a range's bins or values, those that hold a wanted rank, with the count `before` them."""
    before = F.coalesce(F.sum("c").over(W.partitionBy(*keys, "low", "high").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    have = counted.withColumn("before", before).withColumnsRenamed({k: f"{k}h" for k in keys} | {"low": "lowh", "high": "highh"})
    asked = wanted.select(*keys, "rank", "low", "high", "below")
    at = F.col("rank") - F.col("below")
    inside = (at >= F.col("before")) & (at < F.col("before") + F.col("c"))
    return asked.join(have, _same([*keys, "low", "high"], "h") & inside).drop("low", "high")
