"""Approximate nearest neighbours by inner product: one NN-descent graph and greedy search, both by joins.

Equal vectors are one node, which lists the smallest ids that have it. NN-descent builds each node's list of its DEGREE
best neighbours, by the inner product of directions: by that of the vectors themselves, all lists would hold the few
longest vectors, and the graph would fall apart. As the best by inner product may be longer vectors in another direction
than the query's neighbours, the graph has a part for each shell of nearly equal lengths (a factor of RATIO, the last shell holds all
that are shorter), in which the order by direction is nearly that by inner product, and a query walks all parts at once. Lists begin with the best of DEALS groups of GROUP nodes: a node's code
says on which sides of BITS planes its direction lies, each halfway between two nodes drawn at random (at most
2 * BITS * DEALS of them come to the driver), and in the order of shells and codes each GROUP nodes that follow each other are a
group, however many have one code. In every round the ends of edges meet
at the node between them: the vectors of a node's neighbours, in both directions, are joined to it, and of two that
meet, where one of the edges is new, each is proposed to the other if it beats the worst of its list. Edges of nodes
that very many lists hold are sampled down to about 2 * SAMPLE a node, so no node is a hot key and each round sends
about DEGREE + 2 * SAMPLE vectors a node, whatever the number of nodes. It ends when few lists change.

A query walks the graph greedily by the inner product of the vectors, all queries at once: it begins at its own node and ENTRIES random ones of each shell, and in
every step expands the STEP best nodes of its beam that are not expanded yet, by a join with their lists and one with
the vectors of the neighbours it hasn't seen. It ends when its beam of BEAM nodes is expanded. What a query visits
depends on beam and degree, not on the number of nodes.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id;
vectors of different lengths are not neighbours; repeated rows count once, and of different vectors with one id that
with the smallest hash counts; ties go to the smaller id; a query with fewer candidates gets all of them; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cleared, pick, stored

NEAREST, DEGREE, SAMPLE, GROUP, DEALS, BITS, ROUNDS, LEAST_CHANGE, BEAM, STEP, ENTRIES, RATIO, SHELLS = 20, 24, 12, 64, 4, 16, 4, 0.05, 96, 64, 32, 1.25, 24
CODES = "deal int, length int, shell int, code long, node long, vector array<double>"
LISTS = "node long, near array<long>, scores array<double>, fresh array<boolean>, changed int"
OFFERS = "node long, near array<long>, scores array<double>, old boolean"
STATE = "node long, key binary, vector array<double>, found array<long>, scores array<double>, done array<boolean>, seen array<long>, expand array<long>"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, key, vector (doubles) of the rows that take part, one for each id."""
    out = pick(rows, vec_id="vec_id", v="embedding").select("vec_id", F.col("v").cast("array<double>").alias("vector"))
    sound = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    out = out.where(F.col("vec_id").isNotNull() & sound).withColumn("key", _key("vector"))
    return out.groupBy("vec_id").agg(F.min(F.struct("key", "vector")).alias("x")).select("vec_id", "x.key", "x.vector")


def _key(column: str):
    bits = F.concat_ws(",", F.transform(column, lambda x: F.hex(F.xxhash64(x))))
    return F.unhex(F.md5(bits))


def nodes_of(rows: DataFrame, ids: int) -> DataFrame:
    """node, key, vector, ids: distinct vectors with their smallest ids."""

    def some(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:  # fewer rows before the shuffle: of each batch, a vector's smallest ids only
            frame = frame.sort_values("vec_id")
            first = frame.groupby("key")
            yield frame[first.cumcount() < ids].groupby("key", sort=False).agg(vector=("vector", "first"), ids=("vec_id", list)).reset_index()

    merged = rows.select("key", "vector", "vec_id").mapInPandas(some, "key binary, vector array<double>, ids array<long>")
    merged = merged.groupBy("key").agg(F.first("vector").alias("vector"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, ids).alias("ids"))
    return stored(merged.select(F.monotonically_increasing_id().alias("node"), "key", "vector", "ids"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(a table of whole groups, where each begins and the last ends); rows of a group follow each other, named by column 0."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        name = table.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        if cuts[-1]:
            yield table.slice(0, cuts[-1]).combine_chunks(), cuts
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each row's begin and the last end)."""
    own = column.combine_chunks()
    own = own if isinstance(own, pa.ListArray) else own.chunk(0)
    return own.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(own.value_lengths().to_numpy()))


def _as_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = pa.array(np.concatenate(values) if values else np.zeros(0), kind)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)), flat)


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares may overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _best(scores: np.ndarray, degree: int) -> np.ndarray:
    return np.argsort(-scores, kind="stable")[:degree]


def _drawn(nodes: DataFrame, about: int, seed: int) -> list[tuple[int, list[float]]]:
    """(node, vector) of about so many nodes, the same ones each time."""
    share = min(1.0, about / max(1, nodes.count()))
    rows = nodes.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < share).select("node", "vector").limit(2 * about)
    return [(r["node"], r["vector"]) for r in rows.collect()]


def shelled(nodes: DataFrame) -> DataFrame:
    """nodes with `shell`: 0 for the longest vectors, one more for each factor of RATIO by which they are shorter, SHELLS - 1 at most."""
    size = F.ln(F.aggregate("vector", F.lit(0.0), F.hypot))  # squares of large components would overflow
    top = nodes.agg(F.max(size)).first()[0]
    # a tenth beyond the longest, so that vectors of one length don't fall on a border
    return nodes.withColumn("shell", F.least(F.floor((F.lit(top) + F.ln(F.lit(1.1)) - size) / F.ln(F.lit(RATIO))), F.lit(SHELLS - 1)).cast("int"))


def _entries(nodes: DataFrame, entries: int) -> dict[int, list[tuple[int, list[float]]]]:
    """By length of vectors, (node, vector) of `entries` nodes of each shell; 2 * entries * SHELLS in all at most."""
    order = F.row_number().over(W.partitionBy("length", "shell").orderBy(F.xxhash64("key", F.lit(3)), "node"))
    ranked = nodes.select("node", "key", "shell", F.size("vector").alias("length")).withColumn("n", order).where(F.col("n") <= entries)
    drawn = ranked.orderBy("n", "shell", "node").limit(2 * entries * SHELLS).select("node")
    out: dict[int, list] = {}
    for r in nodes.join(drawn, "node", "left_semi").select("node", "vector").collect():
        out.setdefault(len(r["vector"]), []).append((r["node"], r["vector"]))
    return out


def _start(nodes: DataFrame, degree: int, group: int) -> DataFrame:
    ends: dict[int, list] = {}
    for _, vector in sorted(_drawn(nodes, 2 * BITS * DEALS, 5)):
        ends.setdefault(len(vector), []).append(vector)
    planes = {}
    for length, rows in ends.items():
        x, rng = _directions(np.array(rows, float)), np.random.default_rng(length)
        a, b = (x[rng.integers(len(x), size=BITS * DEALS)] for _ in range(2))
        planes[length] = (a - b, ((a - b) * (a + b)).sum(1) / 2)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths):
                own = batch.filter(pa.array(lengths == length))
                shell = own.column("shell")
                sides = np.zeros((own.num_rows, BITS * DEALS), bool)
                if int(length) in planes:
                    normal, offset = planes[int(length)]
                    sides = _directions(own.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)) @ normal.T > offset
                for deal in range(DEALS):
                    codes = sides[:, deal * BITS : (deal + 1) * BITS] @ weights
                    alike = [pa.array(np.full(own.num_rows, v, np.int32)) for v in (deal, length)]
                    yield pa.RecordBatch.from_arrays([*alike, shell, pa.array(codes.astype(np.int64)), own.column("node"), own.column("vector")], [x.split()[0] for x in CODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches):
            name, near, scores = table.column("node").to_numpy(), [], []
            flat, ends = _lists(table.column("vector"))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x = _directions(flat[ends[a] : ends[b]].reshape(b - a, -1))
                product = x @ x.T
                np.fill_diagonal(product, -np.inf)
                for k in range(b - a):
                    keep = _best(product[k], min(degree, b - a - 1))
                    near.append(name[a:b][keep])
                    scores.append(product[k][keep])
            yield pa.RecordBatch.from_arrays([pa.array(name), _as_lists(near, pa.int64()), _as_lists(scores, pa.float64()), pa.array([False] * len(name), pa.bool_())], [x.split()[0] for x in OFFERS.split(", ")])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers each `group` rows that follow each other, from a new one where deal, length or shell change."""
        last, held, number = None, 0, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, kind in enumerate(zip(*(batch.column(c).to_pylist() for c in ("deal", "length", "shell")), strict=True)):
                if kind != last or held == group:
                    last, held, number = kind, 0, number + 1
                held += 1
                out[i] = number
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column("node"), batch.column("vector")], ["group", "node", "vector"])

    # the node ends the key, so that also equal codes are dealt over partitions
    order = ["deal", "length", "shell", "code", "node"]
    coded = stored(nodes.select("node", "vector", "shell").mapInArrow(code, CODES))
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return _merged(ranged.mapInArrow(lambda batches: run(groups(batches)), OFFERS), degree)


def _sampled(edges: DataFrame, sample: int, turn: int) -> DataFrame:
    """Of the edges (node, other, ...) those that stay if a node that more than 2 * sample lists hold keeps about so many."""
    most = 2 * sample
    often = stored(edges.groupBy("other").agg(F.count("*").alias("lists")).where(F.col("lists") > most))
    chance = F.pmod(F.xxhash64("node", "other", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    return edges.join(often, "other", "left").where(F.col("lists").isNull() | (chance < most / F.col("lists"))).drop("lists")


def build_graph(nodes: DataFrame, *, degree: int = DEGREE, sample: int = SAMPLE, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """LISTS: the NN-descent lists, best first."""
    lists = stored(_start(nodes, degree, group))
    for turn in range(rounds):
        lists = stored(_round(nodes, lists, degree, sample, turn))
        cleared(nodes.sparkSession)
        changed, size = lists.agg(F.sum("changed"), F.sum(F.size("near"))).first()
        if not size or changed <= LEAST_CHANGE * size:
            break
    return lists


def _round(nodes: DataFrame, lists: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    edges = lists.select("node", F.explode(F.arrays_zip("near", "fresh")).alias("x")).select("node", F.col("x.near").alias("other"), F.col("x.fresh").alias("fresh"))
    edges = stored(_sampled(edges, sample, turn))
    meet = edges.select(F.col("node").alias("middle"), F.col("other").alias("node"), "fresh").unionByName(edges.select(F.col("other").alias("middle"), "node", "fresh"))
    meet = meet.groupBy("middle", "node").agg(F.max("fresh").alias("fresh"))
    worst = F.when(F.size("near") >= degree, F.element_at("scores", -1)).otherwise(F.lit(float("-inf")))
    held = nodes.select("node", "vector").join(lists.select("node", worst.alias("worst")), "node")
    dealt = meet.join(held, "node").select("middle", "node", "fresh", "worst", "vector").repartition("middle").sortWithinPartitions("middle")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches):
            name, fresh, worst = (table.column(c).to_numpy() for c in ("node", "fresh", "worst"))
            flat, ends = _lists(table.column("vector"))
            out, near, scores = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, new = _directions(flat[ends[a] : ends[b]].reshape(b - a, -1)), fresh[a:b]
                product = x @ x.T
                fits = (product > worst[a:b, None]) & (new[:, None] | new)
                np.fill_diagonal(fits, False)
                for k in np.flatnonzero(fits.any(1)):
                    out.append(name[a + k])
                    near.append(name[a:b][fits[k]])
                    scores.append(product[k][fits[k]])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), _as_lists(near, pa.int64()), _as_lists(scores, pa.float64()), pa.array([False] * len(out), pa.bool_())], [x.split()[0] for x in OFFERS.split(", ")])

    return _merged(dealt.mapInArrow(propose, OFFERS).unionByName(lists.select("node", "near", "scores", F.lit(True).alias("old"))), degree)


def _merged(offers: DataFrame, degree: int) -> DataFrame:
    """LISTS: the best of each node's old list and what was offered."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches):
            old = table.column("old").to_numpy()
            ids, ends = _lists(table.column("near"))
            values, _ = _lists(table.column("scores"))
            near, scores, fresh = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # the old list comes first
                known = ends[a + 1] - ends[a] if old[a] else 0
                own, first = np.unique(ids[ends[a] : ends[b]], return_index=True)
                keep = _best(values[ends[a] : ends[b]][first], degree)
                near.append(own[keep])
                scores.append(values[ends[a] : ends[b]][first][keep])
                fresh.append(first[keep] >= known)
            node = table.column("node").to_numpy()[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(node), _as_lists(near, pa.int64()), _as_lists(scores, pa.float64()), _as_lists(fresh, pa.bool_()), pa.array([int(f.sum()) for f in fresh], pa.int32())], [x.split()[0] for x in LISTS.split(", ")])

    return offers.repartition("node").sortWithinPartitions("node", F.col("old").desc()).mapInArrow(merge, LISTS)


def _products(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products row by row, each by the same sum whatever rows stand beside it."""
    return (x * query).sum(1)


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, *, nearest: int = NEAREST, beam: int = BEAM, step: int = STEP, entries: int = ENTRIES) -> DataFrame:
    """STATE after the walks of queries (node, key, vector); seen has the nodes that a query has visited."""
    beam = max(beam, nearest + 1)
    first = _entries(nodes, entries)
    forward = graph.select("node", F.explode("near").alias("other"))
    back = _sampled(forward, SAMPLE, -1).select(F.col("other").alias("node"), F.col("node").alias("other"))
    around = stored(forward.unionByName(back).groupBy("node").agg(F.collect_set("other").alias("around")))

    def advance(found: np.ndarray, scores: np.ndarray, done: np.ndarray) -> tuple:
        keep = np.lexsort((found, -scores))[:beam]
        found, scores, done = found[keep], scores[keep], done[keep].copy()
        ahead = np.flatnonzero(~done)[:step]
        done[ahead] = True
        return found, scores, done, found[ahead]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, key, vector in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                start = {node: vector} | dict(first.get(len(vector), []))
                found = np.array(list(start), np.int64)
                state = advance(found, _products(np.array(list(start.values()), float), np.array(vector)), np.zeros(len(found), bool))
                out.append((node, key, vector, *state[:3], found, state[3]))
            yield _state(out)

    def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            query, ids = np.array(r["vector"]), right.column("other").to_numpy()
            flat, _ = _lists(right.column("near")) if len(ids) else (np.zeros(0), None)
            new = _products(flat.reshape(len(ids), -1), query) if len(ids) else np.zeros(0)
            state = advance(np.append(np.array(r["found"], np.int64), ids), np.append(r["scores"], new), np.append(np.array(r["done"], bool), np.zeros(len(ids), bool)))
            out.append((r["node"], r["key"], r["vector"], *state[:3], np.append(np.array(r["seen"], np.int64), ids), state[3]))
        return pa.Table.from_batches([_state(out)])

    ended, state = [], stored(queries.select("node", "key", "vector").mapInArrow(begin, STATE))
    while True:
        open_ = state.where("size(expand) > 0")
        ended.append(state.where("size(expand) = 0"))
        if open_.isEmpty():
            break
        asked = open_.select(F.col("node").alias("query"), F.explode("expand").alias("node")).join(around, "node")
        met = asked.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("around"))).alias("met"))
        new = met.join(open_.select(F.col("node").alias("query"), "seen"), "query").select("query", F.explode(F.array_except("met", "seen")).alias("other"))
        near = new.join(nodes.select(F.col("node").alias("other"), F.col("vector").alias("near")), "other").select(F.col("query").alias("node"), "other", "near")
        state = stored(open_.groupBy("node").cogroup(near.groupBy("node")).applyInArrow(go_on, STATE))
        cleared(nodes.sparkSession)
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def _state(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)], [x.split()[0] for x in STATE.split(", ")])


def visited(state: DataFrame, nodes: DataFrame) -> float:
    """The mean share of all nodes that a query has visited."""
    return (state.agg(F.avg(F.size("seen"))).first()[0] or 0.0) / max(1, nodes.count())


def nearest_neighbours(rows: DataFrame, *, nearest: int = NEAREST, every: int = 20, beam: int = BEAM, shares: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by `every`, against all rows; shares gets the share visited."""
    known = stored(usable(rows))
    nodes = shelled(nodes_of(known, nearest + 1))
    graph = build_graph(nodes)
    asked = known.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    queries = nodes.select("node", "key", "vector").join(asked.select("key").distinct(), "key", "left_semi")
    state = search(nodes, graph, queries, nearest=nearest, beam=beam)
    if shares is not None:
        shares.append(visited(state, nodes))
    best = state.select("key", F.explode(F.slice(F.arrays_zip("found", "scores"), 1, nearest + 1)).alias("x")).select("key", F.col("x.found").alias("node"), F.col("x.scores").alias("score"))
    each = best.join(nodes.select("node", "ids"), "node").select("key", "score", F.explode("ids").alias("vec_id"))
    pairs = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, nearest + 1)
    found = stored(each.groupBy("key").agg(pairs.alias("found")))  # written first, so that the join can split a frequent vector
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    out = asked.join(found, "key").select("query_id", F.posexplode(own).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
