"""Regression metrics, fold merging, ranking and distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import finite, nan_to_null, ratio
from ..sources.shared import stored
from .quantiles import exact_quantiles


def gene_metrics(pairs: DataFrame, by=("gene",), *, pred: str = "pred", target: str = "target") -> DataFrame:
    """n, mse, r2, pearson per group; null where undefined. One hash aggregate: Spark's moments are centred as they are added up."""
    p, t = F.col(pred).cast("double"), F.col(target).cast("double")
    p, t = F.when(t.isNotNull(), p), F.when(p.isNotNull(), t)
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.sum((p - t) * (p - t)).alias("see"), (F.var_pop(t) * F.count(t)).alias("stt"), F.covar_pop(p, t).alias("both"), F.sqrt(F.var_pop(p)).alias("sp"), F.sqrt(F.var_pop(t)).alias("st"))
    return sums.select(*by, "n", ratio(F.col("see"), F.col("n")).alias("mse"), (1 - ratio(F.col("see"), F.col("stt"))).alias("r2"), ratio(F.col("both"), F.col("sp") * F.col("st")).alias("pearson"))


def pair_correlation(pairs: DataFrame, by=("sample_id", "gene"), *, pred: str = "pred", target: str = "target") -> DataFrame:
    """n and Pearson over pairs of finite values; null for fewer than two."""
    good = pairs.where(finite(F.col(pred)) & finite(F.col(target)))
    return gene_metrics(good, by, pred=pred, target=target).select(*by, "n", F.when(F.col("n") >= 2, F.col("pearson")).alias("pearson"))


def summarise_metrics(metrics: DataFrame, by=()) -> DataFrame:
    quartiles = [F.percentile(c, q).alias(f"{a}_q{i}") for c, a in (("mse", "l2_error"), ("r2", "r2_score")) for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))]
    return metrics.groupBy(*by).agg(F.avg("pearson").alias("pearson_mean"), F.stddev_pop("pearson").alias("pearson_std"), *quartiles)


def merge_folds(folds: DataFrame, by=("gene",), *, nan: str = "propagate", value: str = "corr", fold: str = "fold") -> DataFrame:
    """The list of values in fold order, mean and population deviation. nan: "propagate" makes a group with an undefined value undefined, "skip" leaves it out."""
    if nan not in ("propagate", "skip"):
        raise ValueError(f"nan is {nan!r}; propagate and skip are known")
    clean = folds.withColumn(value, nan_to_null(F.col(value)))
    whole = F.lit(True) if nan == "skip" else F.count(value) == F.count("*")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(fold, value))), lambda x: x[value])
    return clean.groupBy(*by).agg(listed.alias("values"), F.when(whole, F.avg(value)).alias("mean"), F.when(whole, F.stddev_pop(value)).alias("std"))


def repair_encoders(merged: DataFrame, by=("encoder",), *, mean: str = "mean") -> DataFrame:
    """Encoder statistics over the genes' means, nulls skipped."""
    return merged.groupBy(*by).agg(F.avg(nan_to_null(F.col(mean))).alias("pearson_mean"), F.stddev_pop(nan_to_null(F.col(mean))).alias("pearson_std"))


def rank_encoders(enc: DataFrame, by=("dataset",), *, mean: str = "pearson_mean", encoder: str = "encoder") -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last(nan_to_null(F.col(mean))), encoder)
    return enc.withColumn("rank", F.row_number().over(order))


def best_row(df: DataFrame, by, value: str, tie: str) -> DataFrame:
    """The row with the largest value in each group, the first by `tie` among equals; groups with nulls in their keys are dropped."""
    order = W.partitionBy(*by).orderBy(F.desc_nulls_last(nan_to_null(F.col(value))), tie)
    return df.dropna(subset=list(by)).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def average_encoders(enc: DataFrame, *, mean: str = "pearson_mean", encoder: str = "encoder") -> DataFrame:
    return enc.groupBy(encoder).agg(F.avg(nan_to_null(F.col(mean))).alias("average"))


def wide_results(enc: DataFrame, encoders: list[str], *, dataset: str = "dataset", encoder: str = "encoder", mean: str = "pearson_mean", std: str = "pearson_std") -> DataFrame:
    """A row for each dataset with <encoder>_mean and <encoder>_std columns in the given order."""
    pick = lambda e, c: F.max(F.when(F.col(encoder) == e, F.col(c)))
    return enc.groupBy(dataset).agg(*[pick(e, c).alias(f"{e}_{name}") for e in encoders for c, name in ((mean, "mean"), (std, "std"))])


def box_stats(df: DataFrame, value: str, by=()) -> DataFrame:
    """n, q1, median, q3 and whiskers: the extreme values within 1.5 interquartile ranges. Finite values count; null is a group.

    Quartiles are exact and no task holds a group (see quantiles): fences are written before rows meet them, so that Spark
    knows their size, and rows stay where they are or a frequent group can be split.
    """
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    named = [F.col(a).alias(b) for a, b in (("q0", "q1"), ("q1", "median"), ("q2", "q3"))]
    fences = exact_quantiles(df, value, by).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], "n", *named, (F.col("q0") - reach).alias("_low"), (F.col("q2") + reach).alias("_high"))
    fences = stored(fences) if by else F.broadcast(fences)  # one row
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)], F.lit(True))
    inside = F.when(F.col(value).between(F.col("_low"), F.col("_high")), F.col(value))
    joined = df.where(finite(F.col(value).cast("double"))).select(*by, value).join(fences, same)
    return joined.groupBy(*by, "n", "q1", "median", "q3").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def histogram(df: DataFrame, value: str, bins: int, by=()) -> DataFrame:
    """bin (from 0), low, high, n of equal-width bins between the extremes; the last bin is closed. Bins without rows are left out."""
    edges = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.select(*by, value).join(edges, list(by)) if by else df.select(value).crossJoin(F.broadcast(edges))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    counted = joined.where(F.col(value).isNotNull()).withColumn("bin", place).groupBy(*by, "lo", "hi", "bin").agg(F.count("*").alias("n"))
    return counted.select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def layer_stats(df: DataFrame, value: str, by=()) -> DataFrame:
    """Mean, population deviation, extremes without NaN, and the share of NaN or null."""
    v = nan_to_null(F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), ratio(F.count_if(v.isNull()), F.count("*")).alias("nan_share"))
