"""Linear and tree probes from embeddings to expression, and batched embedding by a user's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_name, stored
from . import trees
from .metrics import gene_metrics

METHODS = ("ridge", "random-forest", "rf", "gbt", "xgboost")


def embed(images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], *, column: str = "img", keep=("sample_id", "seq", "barcode"), batch_size: int = 128) -> DataFrame:
    """embedding (array<float>) of each image (an array of numbers) by a user's model, which each worker makes once."""
    types = dict(images.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                out = part[list(keep)].copy()
                out["embedding"] = list(np.asarray(model(np.stack(part[column].to_numpy())), np.float32))
                yield out

    return images.select(*keep, column).mapInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in keep), "embedding array<float>"]))


def pool_tokens(tokens: Column, registers: int | None = None) -> Column:
    """The first token; with `registers`, followed by the mean of the tokens after it and that many registers."""
    first = F.element_at(tokens, 1)
    if registers is None:
        return first
    rest = F.slice(tokens, registers + 2, F.greatest(F.size(tokens) - registers - 1, F.lit(0)))
    n = F.size(rest)
    mean = F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: F.aggregate(rest, F.lit(0.0).cast("double"), lambda a, t: a + F.element_at(t, i).cast("double")) / n)
    return F.concat(F.transform(first, lambda v: v.cast("double")), F.when(n > 0, mean).otherwise(F.array().cast("array<double>")))


def _sums(df: DataFrame, x: str, y: str | None = None) -> tuple[int, np.ndarray]:
    """(rows, Z'Z) for Z = [1, x, y]: partial sums in tasks, added up row by row of the matrix, which then is p x p."""
    columns = [x] + ([y] if y else [])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                z = np.hstack([np.ones((len(frame), 1)), *(np.array(frame[c].tolist(), float) for c in columns)])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(frame["v"].tolist(), axis=0)]})

    schema = "i int, v array<double>"
    rows = df.select(*columns).mapInPandas(partial, schema).groupBy("i").applyInPandas(add, schema).toPandas().sort_values("i")
    gram = np.array(rows["v"].tolist())
    return (int(gram[0, 0]), gram) if len(gram) else (0, np.zeros((1, 1)))


@dataclass
class Projection:
    """Standardise, then project: z = (x - mean) / scale @ components."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray | None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return z if self.components is None else z @ self.components


def fit_scaler_pca(train: DataFrame, k: int | None = 256, *, column: str = "embedding") -> Projection:
    """Population standard deviation and, with k, the first k principal components, from the training rows only."""
    n, gram = _sums(train, column)
    if not n:
        raise ValueError("no training rows")
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.where(std > 0, std, 1.0)
    if not k:
        return Projection(mean, scale, None)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    first = vectors[:, np.argsort(-values)[: min(k, len(values))]]
    return Projection(mean, scale, first * np.sign(first[np.abs(first).argmax(0), np.arange(first.shape[1])]))


def apply_matrix(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], column: str, out: str) -> DataFrame:
    """A column of arrays through a function of a batch's matrix."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.array(values.tolist(), float)))) if len(values) else pd.Series([], dtype=object)

    return df.withColumn(out, run(column))


def ridge_fit(train: DataFrame, alpha: float | None = None, *, targets: int, x: str = "features", y: str = "targets") -> np.ndarray:
    """Weights (features x targets) without intercept; alpha is 100 / (features * targets) by default."""
    _, gram = _sums(train, x, y)
    p = len(gram) - 1 - targets
    xx, xy = gram[1 : p + 1, 1 : p + 1], gram[1 : p + 1, p + 1 :]
    if alpha is None:
        alpha = 100 / (p * xy.shape[1])
    return np.linalg.solve(xx + alpha * np.eye(p), xy)


def ridge_predict(weights: np.ndarray, df: DataFrame, *, x: str = "features", out: str = "preds") -> DataFrame:
    return apply_matrix(df, lambda z: z @ weights, x, out)


def tree_fit(train: DataFrame, method: str = "rf", *, seed: int = 1, key: tuple[str, ...] = (), **growth) -> trees.Trees:
    """A forest, or boosted trees with a ridge on leaf values, for all targets at once; `growth` changes fields of trees.Growth."""
    base = trees.FOREST if method in ("random-forest", "rf") else trees.BOOSTED
    return trees.fit(train, replace(base, seed=seed, **growth), key=key)


def tree_predict(model: trees.Trees, df: DataFrame, *, x: str = "features", out: str = "preds") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(model)
    return apply_matrix(df, lambda z: sent.value(z), x, out)


def probe_split(train: DataFrame, test: DataFrame, genes: list[str], method: str = "ridge", *, dimreduce: str | None = "PCA", latent_dim: int = 256, alpha: float | None = None, seed: int = 1, **growth) -> DataFrame:
    """seq, gene, pred, target of the test rows. Both frames: seq, embedding, targets (in the genes' order). `growth` is for trees."""
    if method not in METHODS:
        raise ValueError(f"method is {method!r}; {METHODS} are known")
    project = fit_scaler_pca(train, latent_dim if dimreduce == "PCA" else None) if dimreduce else (lambda z: z)
    train, test = (apply_matrix(d, project, "embedding", "features") for d in (train, test))
    rows = ridge_predict(ridge_fit(train, alpha, targets=len(genes)), test) if method == "ridge" else tree_predict(tree_fit(train, method, seed=seed, key=("seq",), **growth), test)
    zipped = rows.select("seq", F.posexplode(F.arrays_zip("preds", "targets")).alias("pos", "v")).select("seq", "pos", F.col("v.preds").alias("pred"), F.col("v.targets").cast("double").alias("target"))
    names = F.array(*[F.lit(g) for g in genes])
    return zipped.select("seq", F.element_at(names, F.col("pos") + 1).alias("gene"), "pred", "target")


def probe_one(features: DataFrame, splits: DataFrame, split: int, genes: list[str], method: str = "ridge", **options) -> DataFrame:
    """probe_split of one split's samples."""
    part = lambda name: features.join(splits.where((F.col("split") == split) & (F.col("part") == name)).select("sample_id"), "sample_id", "left_semi")
    return probe_split(part("train"), part("test"), genes, method, **options)


def probe(features: DataFrame, splits: DataFrame, genes: list[str], method: str = "ridge", **options) -> DataFrame:
    """split, gene, n, mse, r2, pearson. features: sample_id, seq, embedding, targets; splits: split, part, sample_id."""
    out = None
    for (split,) in sorted(splits.select("split").distinct().collect()):  # folds are few and each is a distributed job
        scored = gene_metrics(probe_one(features, splits, split, genes, method, **options)).withColumn("split", F.lit(split))
        out = scored if out is None else out.unionByName(scored)
    return out


RESULTS = "dataset string, encoder string, split int, gene string, n long, mse double, r2 double, pearson double"


def _folder(root: str, dataset: str, encoder: str, split: int) -> str:
    return f"{root}/dataset={quote(dataset, safe='')}/encoder={quote(encoder, safe='')}/split={split}"


def finished(spark: SparkSession, root: str) -> DataFrame:
    """dataset, encoder, split of the tasks whose results are whole: their folders hold the mark that Spark writes last."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dataset=*/encoder=*/split=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    keys = [[unquote(part.split("=", 1)[1]) for part in str(f.getPath()).split("/")[-4:-1]] for f in found]  # a row for each task
    return spark.createDataFrame([(d, e, int(k)) for d, e, k in keys], "dataset string, encoder string, split int")


def grid(spark: SparkSession, datasets: dict[str, tuple[DataFrame, list[str]]], features: Callable[[str, str], DataFrame], encoders: list[str], method: str = "ridge", *, results: str | None = None, threads: int = 4, **options) -> DataFrame:
    """RESULTS for every dataset -> (splits, genes), encoder and split.

    Each split is a task whose metrics are a partition of the table `results`; tasks that are whole there are left out, so a grid that
    was stopped goes on where it ended, and a larger one adds to it. `threads` tasks run at once, each in a scheduler pool of
    its own (fair ones if spark.scheduler.mode is FAIR). Features of a dataset and encoder are computed and stored once, by
    the first of their tasks. If a task fails, those that run are ended, what is whole stays, and the error is raised.
    """
    root = (results or shared_name(spark)).rstrip("/")
    planned = [(d, e, int(r["split"])) for d, (splits, _) in datasets.items() for r in splits.select("split").distinct().collect() for e in encoders]
    todo = spark.createDataFrame(planned, "dataset string, encoder string, split int").join(finished(spark, root), ["dataset", "encoder", "split"], "left_anti")
    todo = sorted(map(tuple, todo.collect()))  # a row for each task
    held, locks = {}, {(d, e): Lock() for d, e, _ in todo}

    def run(number: int, dataset: str, encoder: str, split: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"probe-{number % threads}")
        with locks[dataset, encoder]:
            if (dataset, encoder) not in held:
                held[dataset, encoder] = stored(features(dataset, encoder))
        splits, genes = datasets[dataset]
        scored = gene_metrics(probe_one(held[dataset, encoder], splits, split, genes, method, **options))
        scored.write.mode("overwrite").parquet(_folder(root, dataset, encoder, split))

    with ThreadPoolExecutor(max(1, threads)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(run), i, *task) for i, task in enumerate(todo)]
        try:
            for job in jobs:
                job.result()
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise
    if not planned and not finished(spark, root).count():
        return spark.createDataFrame([], RESULTS)
    table = spark.read.schema(RESULTS).option("basePath", root).parquet(root)
    return table.join(F.broadcast(spark.createDataFrame(planned, "dataset string, encoder string, split int")), ["dataset", "encoder", "split"], "left_semi")  # a row for each task


def join_embeddings(embeddings: DataFrame, expression: DataFrame, genes: DataFrame) -> DataFrame:
    """sample_id, seq, embedding, targets: embeddings with log1p expression of the listed genes, in list order, 0 where none is."""
    n = genes.count()
    values = expression.join(genes.select("pos", "gene"), "gene").groupBy("sample_id", "barcode").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.log1p(F.col("value").cast("double"))))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("int")), F.lit(0.0)))
    return embeddings.join(values, ["sample_id", "barcode"]).select("sample_id", "seq", "barcode", "embedding", filled.alias("targets"))
