"""The tables behind the usual figures: run summaries, comparisons, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .metrics import best_row, box_stats, histogram
from .quantiles import exact_quantiles


def run_summary(encoders: DataFrame, *, by=("run", "dataset"), mean: str = "pearson_mean", std: str = "pearson_std") -> DataFrame:
    """Best encoder, its mean and deviation, and all encoder names of each run and dataset."""
    names = encoders.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set("encoder")), ", ").alias("encoders"))
    best = best_row(encoders, by, mean, "encoder").select(*by, F.col("encoder").alias("best_model"), F.col(mean).alias("highest_pearson_mean"), F.col(std).alias("highest_pearson_std"))
    return best.join(names, list(by))


def ordered_summary(summary: DataFrame) -> DataFrame:
    """dataset and gene list ascending, mean descending, undefined last; missing deviations and gene counts as 0."""
    filled = summary.fillna(0, subset=[c for c in ("highest_pearson_std", "num_genes") if c in summary.columns])
    keys = [F.asc(c) for c in ("dataset", "gene_list") if c in summary.columns]
    return filled.orderBy(*keys, F.desc_nulls_last("highest_pearson_mean"))


def points_of_runs(summary: DataFrame, size_by: str, *, scale: float = 1.0, min_size: float = 20.0) -> DataFrame:
    return summary.where(F.col("highest_pearson_mean").isNotNull() & F.col(size_by).isNotNull()).withColumn("size", F.greatest(F.lit(min_size), F.col(size_by) * scale))


def mean_by(results: DataFrame, sets: list[list[str]], value: str = "corr") -> DataFrame:
    """Means for several groupings in one job; the columns of a row's own grouping are filled, `grouping` numbers it."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().cast("long").alias("grouping"))


def ordered_groups(results: DataFrame, group: str, member: str, value: str = "corr") -> DataFrame:
    """group_rank by group mean and member_rank by the member's own mean inside it, largest first."""
    members = results.groupBy(group, member).agg(F.avg(value).alias("member_mean"))
    groups = results.groupBy(group).agg(F.avg(value).alias("group_mean"))
    groups = groups.withColumn("group_rank", F.dense_rank().over(W.orderBy(F.desc_nulls_last("group_mean"), group)))  # as many rows as groups
    out = members.join(groups, group)
    return out.withColumn("member_rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc_nulls_last("member_mean"), member)))


def top_genes(results: DataFrame, n: int, value: str = "mean") -> DataFrame:
    return results.orderBy(F.desc_nulls_last(value), "gene").limit(n)


def compare_runs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), key: str = "gene", value: str = "mean") -> DataFrame:
    """Both runs' values of the keys that both have, and their difference."""
    left, right = (d.select(key, F.col(value).alias(n)) for d, n in zip((a, b), names, strict=True))
    return left.join(right, key).withColumn("difference", F.col(names[1]) - F.col(names[0]))


def melt_runs(compared: DataFrame, names: tuple[str, str] = ("a", "b"), key: str = "gene") -> DataFrame:
    return compared.unpivot([key], list(names), "run", "value")


def sample_boxes(results: DataFrame, group: str | None = None, value: str = "corr") -> DataFrame:
    """Box statistics by sample, with the sample's group and the order of groups and samples."""
    boxes = box_stats(results, value, ("sample_id",))
    if group is None:
        return boxes
    ranks = ordered_groups(results, group, "sample_id", value).select("sample_id", group, "group_rank", "member_rank")
    return boxes.join(ranks, "sample_id")


def report_tables(genes: DataFrame, by_sample: DataFrame, groups: list[str], *, bins: int = 20, n: int = 20) -> dict[str, DataFrame]:
    """All tables of a run; groups that are absent or empty are left out."""
    out = {"top_genes": top_genes(genes, n), "histogram": histogram(genes, "mean", bins), "boxes": sample_boxes(by_sample)}
    for g in groups:
        if g in by_sample.columns and not by_sample.where(F.col(g).isNotNull()).isEmpty():
            out[f"boxes_{g}"] = sample_boxes(by_sample.where(F.col(g).isNotNull()), g)
    return out


def overlay_points(points: DataFrame, category: str) -> DataFrame:
    """color_index: the category's place in alphabetical order, from 0."""
    order = points.select(category).distinct().withColumn("color_index", F.dense_rank().over(W.orderBy(category)) - 1)  # one row a category
    return points.join(order, category)


def size_legend(points: DataFrame, size_by: str) -> DataFrame:
    """Smallest, median and largest value for a legend of sizes."""
    q = exact_quantiles(points, size_by, (), (0.0, 0.5, 1.0))
    return q.select(F.col("q0").alias("low"), F.col("q1").alias("middle"), F.col("q2").alias("high"))


def compare_encoders(encoders: DataFrame, gene_lists: DataFrame, *, mean: str = "pearson_mean", std: str = "pearson_std") -> DataFrame:
    """Mean, deviation and number of genes by run, dataset and encoder; gene_lists: run, gene."""
    counts = gene_lists.groupBy("run").agg(F.countDistinct("gene").alias("num_genes"))
    return encoders.join(counts, "run", "left").select("run", "dataset", "encoder", mean, std, "num_genes").orderBy("run", "dataset", F.desc_nulls_last(mean), "encoder")


def prediction_boxes(predictions: DataFrame, *, by=("split",)) -> DataFrame:
    """Box statistics of predictions and targets by split."""
    long = predictions.unpivot([*by], ["pred", "target"], "layer", "value")
    return box_stats(long, "value", (*by, "layer"))


def spot_table(written: DataFrame, layers: DataFrame, obs: DataFrame, gene: str) -> DataFrame:
    """Prediction, target and measured value of one gene by spot. layers: sample_id, obs_id, gene, raw, value; raw counts where both are there."""
    measured = layers.where(F.col("gene") == gene).select("sample_id", "obs_id", F.coalesce("raw", "value").alias("measured"))
    own = written.where(F.col("gene") == gene).select("sample_id", "obs_id", "pred", "target")
    return obs.select("sample_id", "obs_id", "x", "y").join(own, ["sample_id", "obs_id"], "left").join(measured, ["sample_id", "obs_id"], "left")
