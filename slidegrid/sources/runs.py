"""Documents of runs: settings, encoder results, dataset results and gene lists, as they drift from run to run.

Documents are read whole and parsed as VARIANT, so a field that is missing, of another type or in another place gives null instead
of an error, and a document that is no JSON gives a row of nulls. Names of encoders are keys of a map, not columns. Writers
put one file at each run's own path, from the tasks that hold the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import nan_to_null
from ..operators.catalog import training_patches
from ..operators.metrics import best_row

RUN_FOLDER = "run_%"


def whole_uri(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString().rstrip("/")


def _below(root: str, path: Column) -> Column:
    """The path's folders and name below the root, as an array."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    plain = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))  # Spark gives paths percent-encoded
    depth = len([p for p in root.split("://")[-1].removeprefix("file:").split("/") if p]) - ("://" in root and not root.startswith("file:"))
    return F.slice(F.filter(F.split(plain, "/"), lambda p: p != ""), depth + 1, 1000)


def read_documents(spark: SparkSession, root: str, name: str) -> DataFrame:
    """folders (below root), name and `doc` (VARIANT, null if it is no JSON) of all files of that name or pattern below root; bare NaN and Infinity are null."""
    root = whole_uri(spark, root)
    try:
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    except Exception as e:  # noqa: BLE001 - only a missing root is taken as no documents
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "folders array<string>, name string, text string").select("folders", "name", F.try_parse_json("text").alias("doc"))
    parts = files.select("value", _below(root, F.col("_metadata.file_path")).alias("p"))
    bare = F.regexp_replace("value", r"(?<=[:,\[\s])-?(NaN|Infinity)(?=\s*[,\]}])", "null")
    return parts.select(F.slice("p", 1, F.size("p") - 1).alias("folders"), F.element_at("p", -1).alias("name"), F.try_parse_json(bare).alias("doc"))


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _number(doc: Column, path: str) -> Column:
    return nan_to_null(F.try_variant_get(doc, path, "double"))


def _list(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def _runs_only(docs: DataFrame) -> DataFrame:
    return docs.withColumn("run", F.get("folders", F.lit(0))).where(F.like("run", F.lit(RUN_FOLDER.replace("_", r"\_"))))


def read_settings(spark: SparkSession, root: str) -> DataFrame:
    """run and its settings, from the first config.json (least deep, then by path) of each run folder. `datasets` may be a list, of which the first counts, or one name."""
    docs = _runs_only(read_documents(spark, root, "config.json"))
    first = F.row_number().over(W.partitionBy("run").orderBy(F.size("folders"), "folders"))
    docs = docs.withColumn("n", first).where("n = 1")
    doc = F.col("doc")
    return docs.select(
        "run", F.coalesce(_text(doc, "$.gene_list"), F.lit("")).alias("gene_list"), F.coalesce(_text(doc, "$.datasets[0]"), _text(doc, "$.datasets")).alias("dataset"),
        _number(doc, "$.alpha").alias("alpha"), F.try_variant_get(doc, "$.batch_size", "int").alias("batch_size"), _text(doc, "$.dimreduce").alias("dimreduce"),
        F.try_variant_get(doc, "$.normalize", "boolean").alias("normalize"), F.coalesce(F.try_variant_get(doc, "$.library_size_normalize", "boolean"), F.lit(False)).alias("library_size_normalize"),
        F.try_variant_get(doc, "$.latent_dim", "int").alias("latent_dim"), _text(doc, "$.method").alias("method"),
    )


def read_dataset_results(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(run, pos, dataset, place, encoder, pearson_mean, pearson_std; run, encoder, average) of <root>/<run>/dataset_results.json."""
    docs = _runs_only(read_documents(spark, root, "dataset_results.json")).where("size(folders) = 1")
    sets = docs.select("run", F.posexplode(_list(F.col("doc"), "$.results")).alias("pos", "d"))
    rows = sets.select("run", "pos", _text(F.col("d"), "$.dataset_name").alias("dataset"), F.posexplode(_list(F.col("d"), "$.results")).alias("place", "e"))
    e = F.col("e")
    results = rows.select("run", "pos", "dataset", "place", F.coalesce(_text(e, "$.encoder_name"), _text(e, "$.name")).alias("encoder"), _number(e, "$.pearson_mean").alias("pearson_mean"), _number(e, "$.pearson_std").alias("pearson_std"))
    averages = docs.select("run", F.explode(F.try_variant_get("doc", "$.average", "map<string,double>")).alias("encoder", "average"))
    return results, averages.withColumn("average", nan_to_null(F.col("average")))


def read_encoder_names(spark: SparkSession, root: str) -> DataFrame:
    """run, encoders: the names in all enc_results.json below a run, sorted and joined. An entry is an object with encoder_name or name, or the name itself."""
    docs = _runs_only(read_documents(spark, root, "enc_results.json"))
    entries = docs.select("run", F.explode(_list(F.col("doc"), "$.results")).alias("e"))
    e = F.col("e")
    name = F.coalesce(F.nullif(_text(e, "$.encoder_name"), F.lit("")), F.nullif(_text(e, "$.name"), F.lit("")), F.when(F.schema_of_variant(e) == "STRING", _text(e, "$")))
    return entries.select("run", name.alias("name")).where("name is not null").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("encoders"))


def count_genes(spark: SparkSession, data_root: str) -> DataFrame:
    """dataset, gene_list, num_genes of the lists at <data_root>/<dataset>/<gene_list>: {"genes": [...]} or a bare list; documents that are neither are left out."""
    docs = read_documents(spark, data_root, "*.json").where("size(folders) > 0")
    listed = F.coalesce(_list(F.col("doc"), "$.genes"), _list(F.col("doc"), "$"))
    name = F.array_join(F.concat(F.slice("folders", 2, 1000), F.array("name")), "/")
    return docs.select(F.get("folders", F.lit(0)).alias("dataset"), name.alias("gene_list"), F.size(listed).cast("long").alias("num_genes")).where("num_genes >= 0")


def summarise_runs(spark: SparkSession, root: str, data_root: str, rules: DataFrame, means: DataFrame) -> DataFrame:
    """A row for each run folder below root that holds a document: settings, number of genes (null without the list), encoders, the best
    encoder of the first dataset of dataset_results.json, and num_training_patches_mean by `rules` and `means` (training_patches). Ordered by
    dataset, gene list and, downwards, the best mean."""
    runs = _runs_only(read_documents(spark, root, "*.json")).select("run").distinct()
    results, _ = read_dataset_results(spark, root)
    # of equal means the first in the document
    best = best_row(results.where("pos = 0"), ("run",), "pearson_mean", "place").where("pearson_mean is not null").select("run", F.col("encoder").alias("best_model"), F.col("pearson_mean").alias("highest_pearson_mean"), F.col("pearson_std").alias("highest_pearson_std"))
    out = runs.join(read_settings(spark, root), "run", "left").join(count_genes(spark, data_root), ["dataset", "gene_list"], "left").join(read_encoder_names(spark, root), "run", "left").join(best, "run", "left")
    out = training_patches(out.withColumn("gene_list", F.coalesce("gene_list", F.lit(""))).withColumn("library_size_normalize", F.coalesce("library_size_normalize", F.lit(False))), rules, means)
    names = "run gene_list num_genes alpha batch_size dimreduce encoders normalize library_size_normalize latent_dim method dataset best_model highest_pearson_mean highest_pearson_std num_training_patches_mean".split()
    return out.select(*names).orderBy(F.asc_nulls_last("dataset"), "gene_list", F.desc_nulls_last("highest_pearson_mean"), "run")


def write_documents(documents: DataFrame, root: str) -> int:
    """Write each `text` to the file `path` below root, from the tasks; returns their number."""
    root = whole_uri(documents.sparkSession, root)
    base = f"file://{root[5:]}" if root.startswith("file:/") and not root.startswith("file://") else root

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(base)
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                store.create_dir(f"{folder}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{folder}/{path}", compression=None) as out:
                    out.write(text.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return documents.select("path", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _entries(place: str) -> Column:
    entry = F.struct(place, F.col("encoder").alias("encoder_name"), nan_to_null(F.col("pearson_mean")).alias("pearson_mean"), nan_to_null(F.col("pearson_std")).alias("pearson_std"))
    return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields(place))


def dataset_documents(encoders: DataFrame) -> DataFrame:
    """path, text of <run>/dataset_results.json from (run, dataset, encoder, pearson_mean, pearson_std): datasets by name, encoders from the best on, and the mean of each encoder over the datasets, largest first; undefined ones last, as null."""
    value = F.coalesce(-nan_to_null(F.col("pearson_mean")), F.lit(float("inf")))
    sets = encoders.withColumn("_place", value).groupBy("run", "dataset").agg(_entries("_place").alias("results"))
    sets = sets.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("dataset").alias("dataset_name"), "results"))).alias("results"))
    means = encoders.groupBy("run", "encoder").agg(F.avg(nan_to_null(F.col("pearson_mean"))).alias("m"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(-F.col("m"), F.lit(float("inf"))).alias("o"), F.col("encoder").alias("key"), F.col("m").alias("value"))))
    means = means.groupBy("run").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["key"], x["value"]))).alias("average"))
    return sets.join(means, "run").select(F.concat("run", F.lit("/dataset_results.json")).alias("path"), F.to_json(F.struct("results", "average"), {"ignoreNullFields": "false"}).alias("text"))


def encoder_documents(encoders: DataFrame) -> DataFrame:
    """path, text of <run>/<dataset>/enc_results.json."""
    value = F.coalesce(-nan_to_null(F.col("pearson_mean")), F.lit(float("inf")))
    sets = encoders.withColumn("_place", value).groupBy("run", "dataset").agg(_entries("_place").alias("results"))
    return sets.select(F.concat_ws("/", "run", "dataset", F.lit("enc_results.json")).alias("path"), F.to_json(F.struct("results"), {"ignoreNullFields": "false"}).alias("text"))
