"""Sample catalogues: counts merged in, ids filtered, annotations, packages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import find_column, nan_to_null, numeric_column, require_columns


def count_patches(patches: DataFrame, *, total: bool = False) -> DataFrame:
    """sample_id, num_patches; with `total`, also a row without an id that holds the sum."""
    grouped = patches.rollup("sample_id") if total else patches.groupBy("sample_id")
    return grouped.agg(F.count("*").alias("num_patches"))


def merge_counts(metadata: DataFrame, specs: dict[str, str], count_func: Callable[[str], DataFrame]) -> DataFrame:
    """A count column for each spec name -> path; count_func(path) gives sample_id and a number. Empty paths are skipped."""
    out = require_columns(metadata, "sample_id")
    for name, path in specs.items():
        if not path:
            continue
        counts = require_columns(count_func(path), "sample_id")
        out = out.drop(name).join(counts.select("sample_id", F.col(numeric_column(counts)).alias(name)), "sample_id", "left")
    return out


def update_column(df: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Values of `new` where its key matches and isn't null, else the old ones."""
    fresh = new.select(key, F.col(column).alias("_new"))
    return df.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def attach_right(counts: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    return counts.join(samples, key, "right")


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ids that the table does not have)."""
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return df.join(wanted, key, "left_anti"), wanted.join(df.select(key).distinct(), key, "left_anti")


def select_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def annotate_genes(genes: DataFrame, annotations: dict[str, DataFrame], *, case_insensitive: bool = True, strict: bool = False) -> DataFrame:
    """A label column for each annotation (gene, label). Keys are trimmed and upper-cased; lists are made distinct on the raw gene, so spellings that differ in case give more rows, unless `strict`."""
    norm = (lambda c: F.upper(F.trim(c))) if case_insensitive else (lambda c: F.trim(c))
    out = genes.withColumn("_k", norm(F.col("gene")))
    for name, table in annotations.items():
        side = table.dropDuplicates(["gene"]).select(norm(F.col("gene")).alias("_k"), F.col("label").alias(name))
        if strict:
            side = side.groupBy("_k").agg(F.min(name).alias(name))
        out = out.join(side, "_k", "left")
    return out.drop("_k")


def attach_metadata(splits: DataFrame, metadata: DataFrame, *, skip: bool = False) -> DataFrame:
    """Splits with the metadata of their test sample; left as they are for datasets that have none."""
    return splits if skip else splits.join(metadata.withColumnRenamed("sample_id", "test_sample"), "test_sample", "left")


def attach_splits(results: DataFrame, splits: DataFrame) -> DataFrame:
    """gene, values per split -> a row for each gene, split and test sample of it."""
    rows = results.select("*", F.posexplode_outer("values").alias("split", "corr")).drop("values")
    return rows.join(splits, "split", "left")


def column_mean_ci(df: DataFrame, *candidates: str) -> Column:
    """Mean of the first column found in whatever case, non-numbers left out."""
    name = find_column(df, *candidates)
    return F.avg(F.col(name).try_cast("double")) if name else F.lit(None).cast("double")


def training_patches(runs: DataFrame, rules: DataFrame, means: DataFrame) -> DataFrame:
    """num_training_patches_mean by rule rows (dataset, source, factor) and means (source, mean).

    A dataset with two rules is the mean of both products; if only the one of lower rank (`part` 1) is missing, half
    of the other is meant, and null if the first is.
    """
    valued = rules.join(means, "source", "left").withColumn("v", F.col("mean") * F.col("factor"))
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("v")))
    a, b, n = part(0), part(1), F.count("*")
    value = F.when(n == 1, a).when(a.isNull(), F.lit(None)).otherwise((a + F.coalesce(b, F.lit(0.0))) / 2)
    per = valued.groupBy("dataset").agg(value.alias("num_training_patches_mean"))
    return runs.withColumn("dataset", F.trim("dataset")).join(per, "dataset", "left")


def collision_merge(first: DataFrame, second: DataFrame, prefix: str, key: str = "sample_id") -> DataFrame:
    """Both tables; an id of the second that the first has too gets the prefix."""
    have = first.select(F.col(key).alias("_have")).distinct()
    renamed = second.join(have, second[key] == have["_have"], "left").withColumn(key, F.when(F.col("_have").isNotNull(), F.concat(F.lit(prefix), F.col(key))).otherwise(F.col(key))).drop("_have")
    return first.unionByName(renamed, allowMissingColumns=True)


def refresh_meta(cells: DataFrame) -> DataFrame:
    """Cells, mean transcripts a cell and total area of each sample; null for columns that are missing."""
    column = lambda name, f: f(name) if name in cells.columns else F.lit(None).cast("double")
    return cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"), column("transcript_counts", F.avg).alias("mean_transcripts"), column("cell_area", F.sum).alias("total_area"))


def suffix_match(ids: DataFrame, metadata: DataFrame, key: str = "sample_id", full: str = "id", patient: str = "patient") -> DataFrame:
    """key, full, patient, how of each id: the patient of the equal metadata id, else of the first one (by pos) that
    ends with the id, else the id's own part before `_`, with no metadata id. Of repeated metadata ids the last patient counts.

    An id can only end with another if it ends with its last characters: both sides meet in an equi-join on the ids'
    suffixes as long as some id, instead of a nested loop.
    """
    asked = ids.select(key).distinct()
    known = metadata.groupBy(full).agg(F.min("pos").alias("pos"), F.max_by(patient, "pos").alias("patient"))
    exact = asked.join(known.where("patient is not null"), F.col(key) == F.col(full)).select(key, full, "patient", F.lit("exact").alias("how"))
    rest = asked.join(exact, key, "left_anti")
    lengths = rest.select(F.length(key).alias("_n")).distinct()
    tails = known.crossJoin(F.broadcast(lengths)).where(F.length(full) >= F.col("_n")).withColumn("_tail", F.expr(f"right(`{full}`, _n)"))  # as many rows as ids have lengths
    ended = rest.join(tails, F.col(key) == F.col("_tail")).groupBy(key).agg(F.min_by(F.struct(full, "patient"), "pos").alias("_m"))
    ended = ended.select(key, "_m.*", F.lit("suffix").alias("how")).where("patient is not null")
    own = rest.join(ended, key, "left_anti").select(key, F.lit(None).cast("string").alias(full), F.split(key, "_")[0].alias("patient"), F.lit("own").alias("how"))
    return exact.unionByName(ended).unionByName(own)


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows for each combination of values, null included, the most frequent first."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def numeric_summary(df: DataFrame, *columns: str, quantiles=(), accuracy: int = 10_000) -> DataFrame:
    """column, n, mean, std, min, max of each column in one aggregate; NaN counts as null. Quantiles (q_<percent>) are approximate, to 1/accuracy of the rows."""
    value = {c: nan_to_null(F.col(c).cast("double")) for c in columns}
    names = ["n", "mean", "std", "min", "max", *[f"q_{round(100 * q)}" for q in quantiles]]
    of = lambda x: [F.count(x).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x), *[F.percentile_approx(x, q, accuracy) for q in quantiles]]
    rows = df.agg(*[F.struct(*[e.alias(n) for e, n in zip(of(x), names, strict=True)]).alias(f"_{i}") for i, x in enumerate(value.values())])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("v")) for i, c in enumerate(columns)])
    return rows.select(F.inline(listed)).select("column", "v.*").withColumn("n", F.col("n").cast("long"))


def first_patches(patches: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The patches of each sample with a place below n."""
    return patches.where(F.col(order) < n)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ordered_distinct(df: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    return df.groupBy(key).agg(F.min(pos).alias(pos)).orderBy(pos)


def cap_per_sample(df: DataFrame, per_sample: int, total: int | None = None, order: str = "seq") -> DataFrame:
    out = df.withColumn("_rn", F.row_number().over(W.partitionBy("sample_id").orderBy(order))).where(F.col("_rn") <= per_sample).drop("_rn")
    return out.orderBy("sample_id", order).limit(total) if total is not None else out
