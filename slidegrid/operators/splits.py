"""Leakage-free splits by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shuffled(meta: DataFrame, by, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """position inside each group, in an order that depends on the seed only."""
    return meta.withColumn("position", F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)))


def group_kfold(meta: DataFrame, k: int | str, group=("dataset_title", "patient"), key: str = "sample_id") -> DataFrame:
    """split, part, sample_id: each group is in the test part of exactly one split and in the train part of the others.

    Sorted groups are cut into k runs whose lengths differ by one at most; k is reduced to the number of groups, and
    "loocv" leaves one group out at a time.
    """
    groups = meta.select(*group).distinct()
    n = groups.count()
    folds = n if k == "loocv" else min(int(k), n)
    if folds < 1:
        raise ValueError("at least one fold and one group are needed")
    fold = groups.withColumn("fold", F.ntile(folds).over(W.orderBy(*group)) - 1)  # one row a group
    same = [meta[g].eqNullSafe(fold[g]) for g in group]
    each = meta.join(fold, same).select(meta[key].alias("sample_id"), "fold")
    rows = each.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return rows.select("split", F.when(F.col("split") == F.col("fold"), "test").otherwise("train").alias("part"), "sample_id")


def cohort_splits(meta: DataFrame, cohort: Column, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(splits 0 and 1, which train on one cohort and test on the other; ids without a cohort). cohort: 0, 1 or null."""
    marked = meta.select(F.col(key).alias("sample_id"), cohort.cast("int").alias("cohort"))
    rows = marked.where("cohort in (0, 1)").withColumn("split", F.explode(F.array(F.lit(0), F.lit(1))))
    part = F.when(F.col("cohort") == F.col("split"), "train").otherwise("test")
    return rows.select("split", part.alias("part"), "sample_id"), marked.where("cohort is null or cohort not in (0, 1)").select("sample_id")


def group_members(meta: DataFrame, group: str, key: str = "sample_id") -> DataFrame:
    return meta.groupBy(group).agg(F.array_sort(F.collect_list(key)).alias("members"), F.count("*").alias("n"))


def split_assets(splits: DataFrame, folder: str = ".") -> DataFrame:
    """The rows of the split files: sample_id, patches_path, expr_path."""
    at = lambda sub, end: F.concat(F.lit(f"{folder}/{sub}/"), F.col("sample_id").cast("string"), F.lit(end))
    return splits.withColumns({"patches_path": at("patches", ".parquet"), "expr_path": at("adata", ".parquet")})
