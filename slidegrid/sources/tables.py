"""Readers and writers: Parquet, CSV, JSON and folder listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import clean_barcode, extracted, nan_to_null

KFOLD = "pearson_corrs array<struct<name:string,pearson_corrs:array<double>,mean:double,std:double>>, pearson_mean double, pearson_std double, mean_per_split array<double>"
ENCODERS = "results array<struct<encoder_name:string,name:string,pearson_mean:double,pearson_std:double>>"
CONFIG = "gene_list string, datasets array<string>, encoders array<string>, alpha double, batch_size int, dimreduce string, normalize boolean, library_size_normalize boolean, latent_dim int, method string, seed int"


def read_points(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_expression(spark: SparkSession, path: str, *, genes: DataFrame | None = None, barcodes: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Rows of the listed barcodes and genes with the places of both in their lists."""
    out = spark.read.parquet(path)
    if barcodes is not None:
        out = out.join(barcodes.select(F.col("pos").alias("row_pos"), F.col("barcode").alias("obs_id")), "obs_id")
    if genes is not None:
        out = out.join(genes.select(F.col("pos").alias("gene_pos"), "gene"), "gene")
    return out.withColumn("value", F.log1p(F.col("value").cast("double"))) if normalize else out


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """split, part, sample_id, patches_path, expr_path from train_<n>.csv and test_<n>.csv, or from what write_splits wrote."""
    reader = spark.read.schema("sample_id string, patches_path string, expr_path string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    rows = reader.csv(folder, header=True)
    found = lambda k: F.coalesce(*[F.nullif(F.regexp_extract("_metadata.file_path", p, k), F.lit("")) for p in (r"/(train|test)_(\d+)\.csv$", r"/part=(train|test)/split=(\d+)/[^/]*$")])
    rows = rows.select(found(2).cast("int").alias("split"), found(1).alias("part"), "sample_id", "patches_path", "expr_path")
    return rows.where("part is not null")


def write_splits(splits: DataFrame, folder: str) -> None:
    columns = splits.select("split", "part", "sample_id", "patches_path", "expr_path")
    columns.write.partitionBy("part", "split").csv(folder, header=True, mode="overwrite")


def _json(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON documents with their path; bare NaN is accepted."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(pattern).select("*", F.col("_metadata.file_path").alias("path"))


def read_kfold(spark: SparkSession, pattern: str) -> DataFrame:
    """path, gene, values, mean, std."""
    return _json(spark, pattern, KFOLD).select("path", F.inline("pearson_corrs")).select("path", F.col("name").alias("gene"), F.transform("pearson_corrs", nan_to_null).alias("values"), nan_to_null(F.col("mean")).alias("mean"), nan_to_null(F.col("std")).alias("std"))


def read_encoder_results(spark: SparkSession, root: str) -> DataFrame:
    """run, dataset, encoder, pearson_mean, pearson_std from <root>/<run>/<dataset>/enc_results.json."""
    rows = _json(spark, f"{root}/*/*/enc_results.json", ENCODERS).select("path", F.inline_outer("results"))
    at = lambda k: F.element_at(F.split("path", "/"), k)
    return rows.select(at(-3).alias("run"), at(-2).alias("dataset"), F.coalesce("encoder_name", "name").alias("encoder"), nan_to_null(F.col("pearson_mean")).alias("pearson_mean"), nan_to_null(F.col("pearson_std")).alias("pearson_std"))


def read_run_configs(spark: SparkSession, root: str) -> DataFrame:
    rows = _json(spark, f"{root}/*/config.json", CONFIG).withColumn("run", F.element_at(F.split("path", "/"), -2)).drop("path")
    return rows.fillna(False, subset=["normalize", "library_size_normalize"])


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, gene from {"genes": [...]} or a bare list; no rows for a file that is neither."""
    text = spark.read.text(path, wholetext=True)
    genes = F.coalesce(F.from_json("value", "genes array<string>").getField("genes"), F.from_json("value", "array<string>"))
    return text.select(F.posexplode(genes).alias("pos", "gene"))


def write_gene_list(genes: DataFrame, path: str, **extra: float) -> None:
    """One JSON document {"genes": [sorted]} and further numbers."""
    listed = genes.agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    listed.withColumns({k: F.lit(v) for k, v in extra.items()}).coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str, schema: str = "sample_id string") -> DataFrame:
    """A CSV of strings, trimmed; an empty table with the schema where there is no such file."""
    try:
        rows = spark.read.csv(path, header=True, inferSchema=False)
    except Exception as e:  # noqa: BLE001 - only a missing path is taken as no rows
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of barcodes and coordinates from documents of two arrays; unequal lengths raise."""
    rows = spark.read.parquet(path)
    sized = rows.withColumn("coords", F.when(F.size("coords") == F.size("barcodes"), F.col("coords")).otherwise(F.raise_error(F.lit("coords and barcodes differ in length"))))
    out = sized.select("sample_id", F.posexplode(F.arrays_zip("barcodes", "coords")).alias("seq", "v"))
    return out.select("sample_id", F.col("seq").cast("long").alias("seq"), clean_barcode(F.col("v.barcodes")).alias("barcode"), F.element_at("v.coords", 1).cast("int").alias("coord_x"), F.element_at("v.coords", 2).cast("int").alias("coord_y"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, length, modified of the files below a root; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return files.select("path", part(-1).alias("name"), part(-2).alias("folder"), "length", F.col("modificationTime").alias("modified"))


def discover_samples(files: DataFrame, *, matrix: str = "adata", run_pattern: str = r"[Rr](\d+)", run_prefix: str = "R{}") -> DataFrame:
    """sample_id, matrix path, patch path of folders that hold the matrix file; a file with the folder's own name is preferred. Ids that occur twice raise."""
    has = files.where(F.startswith("name", F.lit(matrix))).groupBy("folder").agg(F.min("path").alias("matrix_path"))
    patches = files.where(F.contains(F.lower("name"), F.lit("patch")) & ~F.contains(F.lower("name"), F.lit("vis")))
    exact = F.startswith("name", F.col("folder"))
    best = patches.withColumn("_rn", F.row_number().over(W.partitionBy("folder").orderBy(F.desc(exact), "name"))).where("_rn = 1").select("folder", F.col("path").alias("patch_path"))
    found = has.join(best, "folder", "left")
    number = extracted(F.col("matrix_path"), run_pattern)
    head, tail = run_prefix.split("{}")
    named = found.withColumn("sample_id", F.concat(F.coalesce(F.concat(F.lit(head), number, F.lit(tail)), F.lit("")), F.col("folder")))
    n = F.count("*").over(W.partitionBy("sample_id"))
    return named.withColumn("sample_id", F.when(n == 1, F.col("sample_id")).otherwise(F.raise_error(F.concat(F.lit("duplicate sample "), "sample_id")))).select("sample_id", "matrix_path", "patch_path")


def discover_assets(files: DataFrame) -> DataFrame:
    """sample_id, kind, path, asset: files by stem, `_patch_vis` endings off; the first matrix and patch of a sample count, more pictures get _2, _3 ..."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    sample = F.regexp_replace(stem, "(?i)_?patch_vis$", "")
    kind = F.when(stem.rlike("(?i)patch_vis$"), "vis").when(F.col("folder") == "patches", "patch").otherwise("matrix")
    rows = files.select(sample.alias("sample_id"), kind.alias("kind"), "path").withColumn("n", F.row_number().over(W.partitionBy("sample_id", "kind").orderBy("path")))
    asset = F.when(F.col("n") == 1, F.col("kind")).otherwise(F.concat_ws("_", "kind", F.col("n").cast("string")))
    return rows.where("kind = 'vis' or n = 1").select("sample_id", "kind", "path", asset.alias("asset"))


def asset_manifest(samples: DataFrame, kinds: list[str], found: DataFrame) -> DataFrame:
    """sample_id, kind pairs that are expected and not found."""
    expected = samples.select("sample_id").withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return expected.join(found, ["sample_id", "kind"], "left_anti")


def pending_work(inputs: DataFrame, outputs: DataFrame, key: str = "sample_id") -> DataFrame:
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def stale_runs(files: DataFrame, marker: str, hours: float = 24.0, now=None) -> DataFrame:
    """Folders without the marker file in which nothing changed for that long; a report, nothing is deleted."""
    moment = now if now is not None else F.current_timestamp()
    runs = files.groupBy("folder").agg(F.max("modified").alias("modified"), F.bool_or(F.col("name") == marker).alias("finished"))
    return runs.where(~F.col("finished") & ((F.unix_micros(moment) - F.unix_micros("modified")) / 3.6e9 > hours)).select("folder", "modified")


def write_predictions(df: DataFrame, path: str, *, force: bool = False) -> None:
    """One partition a sample. Samples that are there are skipped, or replaced with `force`."""
    spark = df.sparkSession
    if not force:
        try:
            df = pending_work(df, spark.read.parquet(path).select("sample_id"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        df.write.mode("append").partitionBy("sample_id").parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_id").parquet(path)


def write_ranked(ranked: DataFrame, path: str, *, encoder: str = "encoder", mean: str = "pearson_mean", std: str = "pearson_std") -> None:
    """{"results": [...]} in rank order; NaN is written as null."""
    entry = F.struct("rank", F.col(encoder).alias("encoder_name"), nan_to_null(F.col(mean)).alias("pearson_mean"), nan_to_null(F.col(std)).alias("pearson_std"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("rank"))
    ranked.agg(listed.alias("results")).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_wide_csv(wide: DataFrame, path: str) -> None:
    """Doubles with 17 digits, in the frame's column order."""
    cells = [F.format_string("%.17f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in wide.dtypes]
    wide.select(*cells).coalesce(1).write.mode("overwrite").csv(path, header=True)


def parse_rules(text) -> object:
    """array<map<string,string>> from rule text: a list, an object, or several {...} blocks; single quotes are fine. Text that holds none raises."""
    blocks = F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1)
    parsed = F.transform(blocks, lambda b: F.from_json(b, "map<string,string>"))
    bad = (F.size(parsed) == 0) | F.exists(parsed, lambda m: m.isNull())
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<map<string,string>>")).when(bad, F.raise_error(F.concat(F.lit("no rules in: "), text))).otherwise(parsed)


def write_split_predictions(predictions: DataFrame, path: str) -> None:
    """split, seq, gene, pred, target, a partition for each split."""
    predictions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def read_split_predictions(spark: SparkSession, path: str, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predictions of the wanted splits, splits that have none)."""
    rows, wanted = spark.read.parquet(path), splits.select("split").distinct()
    return rows.join(wanted, "split", "left_semi"), wanted.join(rows.select("split").distinct(), "split", "left_anti")


def write_run_log(splits: DataFrame, results: DataFrame, path: str, **config: object) -> None:
    """One JSON line for each split: numbers of train and test samples, its mean metrics, and the run's settings."""
    sizes = splits.groupBy("split").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))
    scores = results.groupBy("split").agg(F.avg(nan_to_null(F.col("pearson"))).alias("pearson_mean"), F.avg(nan_to_null(F.col("mse"))).alias("mse_mean"))
    sizes.join(scores, "split", "left").withColumns({k: F.lit(v) for k, v in config.items()}).coalesce(1).write.mode("append").json(path)
