"""Exact top-k search by inner product with a table of distances to pivots.

Equal vectors are one node, which lists the smallest ids that have it. The pivot table holds each node's vector and its
distances to PIVOTS pivots: the origin and vectors chosen far from each other among SAMPLE drawn ones (the sample only
decides how well bounds work, never what is found). As |q - v|^2 = |q|^2 + |v|^2 - 2 qv and the largest difference of
distances to a pivot is at most |q - v|, the table gives each pair an upper bound of its inner product. With the origin
among the pivots no bound is above |q| |v|.

The table is ordered by length, nearest pivot and distance to it, and cut into blocks of BLOCK nodes with the ranges of
their distances; queries are cut into groups in the same order. Each query first looks into the FIRST blocks of the highest
bounds, which gives it a floor: the score of its k-th node so far. Then it looks into the other blocks whose bound isn't
below that floor. In a block, its candidates are evaluated in the order of their bounds, and it stops at the first
bound strictly below its k-th score. Bounds of nodes cost more than their products; a query whose bounds leave over the share
WEAK of about PROBE nodes of a block gets the products of the whole block, by one matrix product with the other such queries
of its group. Then the work is still that of all pairs, which grows with the square of the input. Blocks meet groups of queries by joins; nothing but the pivots comes to the driver.

Cases: null vectors and ones with null or non-finite components take no part, nor do rows without an id; vectors of
different lengths are not each other's candidates (distances are those of vectors filled up with zeros, so bounds hold); zero
vectors take part; repeated rows count once, and of different vectors with one id the smallest counts; ties go to the
smaller id; a query with fewer candidates gets all of them; an empty table gives no rows; vectors too large for exact 64-bit
sums raise; other columns, also of clashing names, don't matter. Texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import exact_product, integer_vectors, matrix, stored

NEAREST, EVERY, SCALE, PIVOTS, SAMPLE, BLOCK, GROUP, CHUNK, FIRST = 20, 20, 64, 32, 2048, 4096, 512, 4096, 2
TABLE = "key binary, first_id long, size int, vector array<int>, norm long, home int, near double, distances array<double>"
BOUNDS = "team long, key binary, block long, bound double"
FOUND = "key binary, other binary, first_id long, score long"
#: How many nodes of a block show whether bounds eliminate, and the share left of them from which all are evaluated at once.
PROBE, WEAK = 256, 0.25
#: Distances are doubles; bounds are widened by this share of the norms, far above what rounding can do.
SLACK = 1e-12


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, key, vector, norm: one row for each id."""
    one = integer_vectors(rows, scale).where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("vector", "norm")).alias("x"))
    return one.select("vec_id", F.unhex(F.md5(F.concat_ws(",", F.transform("x.vector", lambda x: x.cast("string"))))).alias("key"), "x.vector", "x.norm")


def nodes_of(known: DataFrame, ids: int) -> DataFrame:
    """key, ids, first_id, vector, norm: distinct vectors with their smallest ids. The window is cut to `ids` rows a vector in each task first."""
    smallest = known.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= ids)
    merged = smallest.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"), F.first("norm").alias("norm"))
    return merged.select("key", "ids", F.element_at("ids", 1).alias("first_id"), "vector", "norm")


def choose_pivots(nodes: DataFrame, pivots: int, sample: int) -> list[np.ndarray]:
    """The origin, and drawn vectors each of which is as far as possible from those before."""
    drawn = [np.array(r["vector"], np.int64) for r in nodes.orderBy(F.xxhash64("key"), "key").limit(sample).select("vector").collect()]
    wide = max([len(v) for v in drawn], default=0)
    x = np.array([np.pad(v, (0, wide - len(v))) for v in drawn], np.float64).reshape(len(drawn), wide)
    out, far = [np.zeros(0, np.int64)], np.sqrt((x * x).sum(1))
    for _ in range(min(pivots, len(drawn)) - 1):
        k = int(far.argmax())
        if far[k] == 0:
            break
        out.append(drawn[k])
        far = np.minimum(far, np.sqrt(((x - x[k]) ** 2).sum(1)))
    return out


def pivot_table(nodes: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """TABLE rows: the distances of each node's vector to all pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                x, norm = matrix(own.column("vector")), own.column("norm").to_numpy()
                table = np.zeros((size, len(pivots)), np.int64)
                for k, p in enumerate(pivots):
                    table[: min(size, len(p)), k] = p[:size]
                squares = norm[:, None] + np.array([int((p * p).sum()) for p in pivots]) - 2 * exact_product(x.reshape(len(norm), size), table)
                distances = np.sqrt(squares.astype(np.float64))
                home = distances.argmin(1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, distances.size + 1, len(pivots), dtype=np.int32)), pa.array(distances.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("first_id"), pa.array(np.full(len(norm), size), pa.int32()), own.column("vector"), own.column("norm"), pa.array(home, pa.int32()), pa.array(distances.min(1)), lists], _names(TABLE))

    return stored(nodes.select("key", "first_id", "vector", "norm").mapInArrow(run, TABLE))


def cut(table: DataFrame, rows: int, name: str) -> DataFrame:
    """The table in the order of length, nearest pivot and distance, with a number for each `rows` rows that follow each other and have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, size in enumerate(batch.column("size").to_pylist()):
                if size != last or held == rows:
                    number, last, held = number + 1, size, 0
                held += 1
                out[i] = number
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], [name, *_names(TABLE)])

    order = ["size", "home", "near", "key"]
    return stored(table.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{name} long, {TABLE}"))


def summaries(blocks: DataFrame, pivots: int) -> DataFrame:
    """block, size, top (the largest norm), low and high (the range of distances to each pivot), chunk (0, 1, ... of about CHUNK blocks)."""
    least, most = ([f(F.get("distances", F.lit(i))) for i in range(pivots)] for f in (F.min, F.max))
    out = stored(blocks.groupBy("block").agg(F.min("size").alias("size"), F.max("norm").alias("top"), F.array(*least).alias("low"), F.array(*most).alias("high")))
    return out.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-out.count() // CHUNK)))).cast("int"))


def bounds(queries: DataFrame, about: DataFrame, *, first: int | None) -> DataFrame:
    """BOUNDS of queries (team, key, size, norm, distances, floor, done): the `first` best blocks of each chunk, or all whose bound isn't below the floor, without those in `done`."""
    chunks = (about.agg(F.max("chunk")).first()[0] or 0) + 1
    salts = max(1, -(-queries.count() // GROUP))
    left = queries.withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "salt": F.pmod(F.xxhash64("team"), F.lit(salts)).cast("int")})
    right = about.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        low, high, top, size, block = matrix(right.column("low"), float), matrix(right.column("high"), float), *(right.column(c).to_numpy() for c in ("top", "size", "block"))
        out = []
        for at in range(0, left.num_rows, GROUP):
            own = left.slice(at, GROUP)
            far, norm = matrix(own.column("distances"), float), own.column("norm").to_numpy()
            gap = np.zeros((own.num_rows, len(block)))
            for k in range(far.shape[1] if len(block) else 0):
                d = far[:, k, None]
                np.maximum(gap, np.maximum(low[:, k] - d, d - high[:, k]), out=gap)
            bound = upper(norm[:, None], top, gap)
            bound[own.column("size").to_numpy()[:, None] != size] = -np.inf
            if first is None:
                bound[bound < own.column("floor").to_numpy()[:, None]] = -np.inf
                for i, done in enumerate(own.column("done").to_pylist()):
                    bound[i, np.isin(block, done)] = -np.inf
            elif len(block) > first:
                bound[bound < -np.sort(-bound, 1)[:, first - 1 : first]] = -np.inf
            i, j = np.nonzero(bound > -np.inf)
            rows = pa.array(i)
            out.append(pa.Table.from_arrays([own.column("team").combine_chunks().take(rows), own.column("key").combine_chunks().take(rows), pa.array(block[j], pa.int64()), pa.array(bound[i, j], pa.float64())], _names(BOUNDS)))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.float64())], _names(BOUNDS))

    return left.groupBy("chunk", "salt").cogroup(right.groupBy("chunk", "salt")).applyInArrow(run, BOUNDS)


def upper(norm: np.ndarray, other: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The largest inner product of vectors with these square norms whose distance is at least gap."""
    both = norm.astype(np.float64) + other
    return (both - gap * gap) / 2 + both * SLACK


def eliminate(query: np.ndarray, vectors: np.ndarray, bound: np.ndarray, nearest: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, number evaluated): the `nearest` best rows and all that equal the last, of those that reach the floor."""
    order = np.flatnonzero(bound >= floor)
    order = order[np.argsort(-bound[order], kind="stable")]
    scores, at, step = np.zeros(0, np.int64), 0, 2 * nearest
    while at < len(order) and bound[order[at]] >= floor:
        scores = np.append(scores, exact_product(vectors[order[at : at + step]], query))
        at, step = at + step, step * 2
        if len(scores) >= nearest:
            floor = max(floor, np.partition(scores, -nearest)[-nearest])
    keep = scores >= floor
    return order[: len(scores)][keep], scores[keep], len(scores)


def reaching(x: np.ndarray, y: np.ndarray, norm: np.ndarray, other: np.ndarray, far: np.ndarray, near: np.ndarray, floor: np.ndarray, nearest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) for each row of x: of those of y that reach its floor, the `nearest` best and all that equal the last. far: pivots in columns; near: in rows."""
    some = np.arange(0, len(y), max(1, len(y) // PROBE))
    sample = np.sort(exact_product(x, y[some].T), 1)
    if len(some) >= nearest:  # the scores of some nodes give a first floor
        floor = np.maximum(floor, sample[:, -nearest])
    likely = np.maximum(floor, sample[:, -min(len(some), 1 + -(-nearest * len(some) // len(y)))])  # about what the block's floor will be; it only decides the way
    gap = np.zeros((len(x), len(some)))
    for k in range(len(near)):
        np.maximum(gap, np.abs(near[k, some] - far[:, k, None]), out=gap)
    weak = (upper(norm[:, None], other[some], gap) >= likely[:, None]).mean(1) > WEAK
    for at in range(0, len(x), GROUP):
        own = at + np.flatnonzero(weak[at : at + GROUP])
        for i, scores in zip(own, exact_product(x[own], y.T), strict=True):
            row = np.flatnonzero(scores >= floor[i])
            if len(row) > nearest:
                row = row[scores[row] >= np.partition(scores[row], -nearest)[-nearest]]
            yield i, row, scores[row]
    for i in np.flatnonzero(~weak):
        gap = np.zeros(len(y))
        for k in range(len(near)):
            np.maximum(gap, np.abs(near[k] - far[i, k]), out=gap)
        yield i, *eliminate(x[i], y, upper(norm[i], other, gap), nearest, floor[i])[:2]


def evaluate(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, nearest: int) -> DataFrame:
    """FOUND: for pairs (team, key, block), the best nodes of the block for each query."""
    left = pairs.select("key", "block").join(queries.select("key", "team", "vector", "norm", "distances", "floor"), "key")
    right = blocks.select("block", F.col("key").alias("other"), "first_id", "vector", "norm", "distances").join(pairs.select("team", "block").distinct(), "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())], _names(FOUND))
        x, y = matrix(left.column("vector")).reshape(left.num_rows, -1), matrix(right.column("vector")).reshape(right.num_rows, -1)
        far, near = matrix(left.column("distances"), float), np.ascontiguousarray(matrix(right.column("distances"), float).T)
        norm, other, floor, ids = left.column("norm").to_numpy(), right.column("norm").to_numpy(), left.column("floor").to_numpy(), right.column("first_id").to_numpy()
        who, which, values = [], [], []
        for i, row, score in reaching(x, y, norm, other, far, near, floor, nearest):
            order = np.lexsort((ids[row], -score))[:nearest]
            who.append(np.full(len(order), i))
            which.append(row[order])
            values.append(score[order])
        who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
        return pa.Table.from_arrays([left.column("key").combine_chunks().take(who), right.column("other").combine_chunks().take(which), right.column("first_id").combine_chunks().take(which), pa.array(np.concatenate(values))], _names(FOUND))

    return left.groupBy("team", "block").cogroup(right.groupBy("team", "block")).applyInArrow(run, FOUND)


def best_of(found: DataFrame, nearest: int) -> DataFrame:
    """The best `nearest` rows of FOUND for each query; each task cuts its own rows first."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "first_id"))
    return found.withColumn("place", place).where(F.col("place") <= nearest).drop("place")


def nearest_exact(rows: DataFrame, *, nearest: int = NEAREST, every: int = EVERY, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP, first: int = FIRST) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all rows."""
    known = stored(usable(rows, scale))
    nodes = stored(nodes_of(known, nearest + 1))
    chosen = choose_pivots(nodes, pivots, SAMPLE)
    table = pivot_table(nodes, chosen)
    asked = known.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    blocks = cut(table, block, "block")
    about = stored(summaries(blocks, len(chosen)))
    teams = cut(table.join(asked.select("key").distinct(), "key", "left_semi"), group, "team")
    # one node more than asked for, as a query's own node may hold no other id
    open_ = teams.withColumns({"floor": F.lit(float("-inf")), "done": F.lit(None).cast("array<long>")})
    best_bounds = F.row_number().over(W.partitionBy("key").orderBy(F.desc("bound"), "block"))
    pairs = stored(bounds(open_, about, first=first).withColumn("place", best_bounds).where(F.col("place") <= first).drop("place"))
    found = stored(best_of(evaluate(pairs, open_, blocks, nearest + 1), nearest + 1))
    reached = found.groupBy("key").agg(F.when(F.count("*") > nearest, F.min("score").cast("double")).otherwise(float("-inf")).alias("floor"))
    done = pairs.groupBy("key").agg(F.collect_list("block").alias("done"))
    open_ = stored(teams.join(reached, "key").join(done, "key"))
    rest = stored(bounds(open_, about, first=None))
    found = stored(best_of(found.unionByName(evaluate(rest, open_, blocks, nearest + 1)), nearest + 1))
    each = found.join(nodes.select(F.col("key").alias("other"), "ids"), "other").select("key", "score", F.explode("ids").alias("vec_id"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, nearest + 1)
    lists = stored(each.groupBy("key").agg(ranked.alias("found")))  # written first, so that the join can split a frequent vector
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    out = asked.join(lists, "key").select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
