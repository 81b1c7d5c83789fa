"""Centroid clustering of integer vectors with an incremental distance matrix.

Every vector keeps its exact integer inner products with all centroids, in a table of the shared folder. A round doesn't
multiply anew: for each centroid only the components that have changed count, and product += x[changed] * change. With
the norms this gives all squared distances, the smallest of which names the cluster. New centroids are the floors of
exact sums over exact counts; each task adds up its vectors before the shuffle, so a cluster that holds most vectors
sends no more rows than others. Only centroids come to the driver: `centroids` times `components` integers. The table of
a round is deleted once the next one is written.

Cases: vectors of another length than `components`, null ones and ones with null or non-finite components are left out;
repeated rows and ids count each; a row without an id takes part, but is no first centroid; ties of distance go to the
smaller number, equal hashes of first centroids are taken in the order of their components; fewer vectors than
`centroids` give as many centroids; an empty table gives no rows; vectors too large for exact 64-bit sums raise; other
columns, also of clashing names, don't matter. Texts are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, exact_product, integer_vectors, matrix, scratch

COMPONENTS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
STATE = "vec_id long, vector array<int>, norm long, products array<long>, cluster int, distance long"
SUMS = "cluster int, place int, total decimal(38,0), n long"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
NAMES = [x.split()[0] for x in STATE.split(", ")]


def first_centroids(vectors: DataFrame, centroids: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of these."""
    hashed = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    return np.array([r["vector"] for r in hashed.orderBy("h", "vector").limit(centroids).collect()], np.int64)


def _rows(vec_id: pa.Array, vector: pa.Array, norm: pa.Array, products: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
    """A batch of STATE; the nearest centre is the first among equals."""
    n, k = products.shape
    distances = norm.to_numpy()[:, None] + (centres * centres).sum(1) - 2 * products
    cluster = distances.argmin(1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(products.ravel()))
    return pa.RecordBatch.from_arrays([vec_id, vector, norm, lists, pa.array(cluster, pa.int32()), pa.array(distances[np.arange(n), cluster])], NAMES)


def measured(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """STATE with whole inner products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(*b.columns, exact_product(matrix(b.column(1)), centres.T), centres)

    return vectors.select("vec_id", "vector", "norm").mapInArrow(run, STATE)


def moved(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """STATE after the centres have moved: products change by the components that differ only."""
    change = after - before
    steps = [(k, places, change[k, places]) for k in range(len(change)) if len(places := np.flatnonzero(change[k]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, products = matrix(b.column(1)), matrix(b.column(3)).copy()
                for k, places, by in steps:
                    products[:, k] += exact_product(x[:, places], by)
                yield _rows(b.column(0), b.column(1), b.column(2), products, after)

    return state.mapInArrow(run, STATE)


def mean_centres(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, componentwise; centres of empty clusters stay."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for b in batches:
            if b.num_rows:
                cluster = b.column(0).to_numpy()
                sums = np.zeros((k, width), np.int64)
                np.add.at(sums, cluster, matrix(b.column(1)))
                totals, counts = totals + sums, counts + np.bincount(cluster, minlength=k)
        there = np.flatnonzero(counts)
        total = pa.array([int(x) for x in totals[there].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(there, width), pa.int32()), pa.array(np.tile(np.arange(width), len(there)), pa.int32()), total, pa.array(np.repeat(counts[there], width))], [x.split()[0] for x in SUMS.split(", ")])

    out = centres.copy()
    added = state.select("cluster", "vector").mapInArrow(run, SUMS).groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in added.collect():  # at most centroids times components
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, each_round: list | None = None) -> DataFrame:
    """OUT for each vector that is kept; each_round gets the number of centroids' components that changed."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, scale).where(F.size("vector") == components).withColumn("vec_id", F.col("vec_id").cast("long"))
    centres = first_centroids(vectors, centroids, seed)
    if not len(centres):
        return spark.createDataFrame([], OUT)

    def written(state: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark)
        state.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    state, path = written(measured(vectors, centres))
    for _ in range(rounds):
        after = mean_centres(state, centres)
        if each_round is not None:
            each_round.append(int((after != centres).sum()))
        if (after == centres).all():
            break  # what follows would change nothing
        (state, new), old = written(moved(state, centres, after)), path
        discard(spark, old)
        centres, path = after, new
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    about = spark.createDataFrame([(k, inertia[k], sum(inertia.values()), names[k]) for k in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select(*[x.split()[0] for x in OUT.split(", ")])  # one row a centroid
