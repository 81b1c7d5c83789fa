"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Each of TREES independent trees sends every set along a path of minwise
tokens: the token with the smallest value under the tree's first function names the first node, and so on down to
LEVELS. Two sets share the first node of a tree with the probability of their similarity, so at 0.85 a pair misses
all 12 first nodes once in 10^10. Work on the nodes:

1. Documents with equal sets are one class; only classes go on.
2. Stars: in each node, every class is paired with the node's smallest class. Pairs whose sketches (64 minwise bytes)
   agree on fewer than SKETCH_LEAST places are dropped: at similarity 0.85 once in 10^6. The others are confirmed on
   full sets, made from the whole texts, and confirmed links give components.
3. A node whose classes are all in one component is done. Another one of at most NODE classes is small; a larger one
   branches by its tree's next token, and what is still large at the last level is cut into parts of two blocks each,
   in which every two classes meet. Classes of a node whose sketches link components are compared exhaustively in one
   task, on full sets made from whole texts, and only links that join components are written.

Links inside a component that the stars have not tested are not needed, so no group's pairs are written out.

Cases: null and empty texts have an empty set and are linked with nothing; a text with fewer words than a shingle is
one shingle; repeated rows are judged each and are linked; a null id never names a component unless all ids of it are
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import LOWER, WordIds, mix, pick, rolling, small_batches, stored, word_hashes
from .components import components

SHINGLE, PERCENT, TREES, LEVELS, NODE, SKETCH_LEAST = 5, 85, 12, 5, 128, 40
FUNCTIONS = 64
SKETCHES = "row long, doc_id long, text_key binary, n_shingles long, set_key binary, sketch binary, paths array<long>"
_SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: list[bytes], ids: WordIds, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of lower-cased words."""
    return shingles_of(ids(words) if words else np.zeros(0, np.uint64), shingle)


def shingles_of(ids: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingles of words given by their ids."""
    size = min(shingle, len(ids))
    return np.unique(rolling(ids, size) + np.uint64(size)) if size else np.zeros(0, np.uint64)


def minwise(own: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each function."""
    out = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        out = np.minimum(out, ((own[at : at + 2048, None] ^ (own[at : at + 2048, None] >> np.uint64(29))) * _SEEDS).min(0))
    return mix(out)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def sketch(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = TaskContext.get().partitionId() << 33
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        names = [x.split()[0] for x in SKETCHES.split(", ")]
        for part in small_batches(batches, 2):
            out = []
            ids, _, _, sizes = word_hashes(part.column(2), lower=True)
            for doc_id, key, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                own = shingles_of(words, shingle)
                least = minwise(own)
                out.append((number, doc_id, key, len(own), xxhash.xxh3_128_digest(own.tobytes()), (least & np.uint64(255)).astype(np.uint8).tobytes(), least[: TREES * LEVELS].view(np.int64)))
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return stored(keyed(docs).mapInArrow(run, SKETCHES), "zstd")


@F.pandas_udf(BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    left, right = (np.frombuffer(b"".join(x), np.uint8).reshape(-1, FUNCTIONS) for x in (a, b))
    return pd.Series((left == right).sum(1) >= SKETCH_LEAST)


def _sizes_fit(a, b, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    @F.pandas_udf(BooleanType())
    def similar(left: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids, last, kept = WordIds(), None, None
        for xs, ys in left:
            out = []
            for x, y in zip(xs, ys, strict=True):
                if y != last:
                    last, kept = y, shingle_set(y.encode().translate(LOWER).split(), ids, shingle)
                own = shingle_set(x.encode().translate(LOWER).split(), ids, shingle)
                both = len(np.intersect1d(own, kept, assume_unique=True))
                out.append(100 * both >= percent * (len(own) + len(kept) - both))
            yield pd.Series(out, dtype=bool)

    where = classes.select("cls", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    ends = lambda side: where.select(F.col("cls").alias(side), F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"))
    texts = keyed(docs)
    located = pairs.join(ends("a"), "a").join(ends("b"), "b")
    at = lambda x, side: (x[f"{side}_key"] == texts["text_key"]) & x[f"{side}_id"].eqNullSafe(texts["doc_id"])
    first = texts.join(located, at(located, "a")).select("a", "b", "b_id", "b_key", F.col("text").alias("a_text"))
    both = first.join(texts, at(first, "b")).select("a", "b", "a_text", "text")
    return both.where(similar("a_text", "text")).select("a", "b").distinct()


def _nodes(classes: DataFrame) -> DataFrame:
    """tree, node, cls: the first node of each tree."""
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.element_at("paths", t * LEVELS + 1).alias("token")) for t in range(TREES)])
    return classes.select("cls", "n_shingles", F.explode(trees).alias("t")).select("cls", "n_shingles", F.col("t.tree").alias("tree"), F.xxhash64("t.tree", "t.token").alias("node"))


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    nodes = _nodes(classes)
    hubs = nodes.groupBy("node").agg(F.min(F.struct("cls", "n_shingles")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    pairs = nodes.join(stored(hubs), "node").where((F.col("cls") != F.col("hub.cls")) & _sizes_fit(F.col("n_shingles"), F.col("hub.n_shingles"), percent))
    pairs = pairs.select(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).distinct()
    return _pruned(pairs, classes)


def _pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda name: classes.select(F.col("cls").alias(name), F.col("sketch").alias(f"{name}_sketch"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_alike("a_sketch", "b_sketch")).select("a", "b")


def _clusters(nodes: DataFrame, percent: int) -> DataFrame:
    """part, cluster, cls, label: the classes of a part whose sketches link them with another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

        for part, group in groupby(rows(), key=lambda r: r[0]):
            own = list({r[1]: r for r in group}.values())
            cls, size, label = (np.array([r[i] for r in own], np.int64) for i in (1, 2, 3))
            marks = np.frombuffer(b"".join(r[4] for r in own), np.uint8).reshape(-1, FUNCTIONS)
            root = list(range(len(own)))
            for i in range(len(own) - 1):
                rest = np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))) + i + 1
                for j in rest[(marks[rest] == marks[i]).sum(1) >= SKETCH_LEAST].tolist():
                    _unite(root, i, j)
            roots = np.array([_root(root, i) for i in range(len(own))])
            several = np.flatnonzero(np.bincount(roots, minlength=len(own))[roots] > 1)
            if len(several):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(several), pa.string()), pa.array(roots[several], pa.int32()), pa.array(cls[several]), pa.array(label[several])], ["part", "cluster", "cls", "label"])

    dealt = nodes.select("part", "cls", "n_shingles", "label", "sketch").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "part string, cluster int, cls long, label long")


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _unite(root: list[int], i: int, j: int) -> bool:
    i, j = _root(root, i), _root(root, j)
    root[max(i, j)] = min(i, j)
    return i != j


def overlaps(sets: list[np.ndarray], width: int = 20_000) -> np.ndarray:
    """How many members each two sets share."""
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int(place.max(initial=-1)) + 1, width):
        here = (place >= at) & (place < at + width)
        marks = np.zeros((len(sets), width), np.float32)
        marks[own[here], place[here] - at] = 1
        out += marks @ marks.T
    return out


def _exhaust(clusters: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links (a, b) that join components, from comparing all full sets of a cluster; no more than it has members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()

        def rows():
            for batch in batches:
                for *head, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                    yield (*head, text)

        for _, group in groupby(rows(), key=lambda r: r[:2]):
            own, sets = {}, []
            for r in group:
                if r[2] not in own:
                    own[r[2]] = r[3]
                    sets.append(shingle_set(r[4].as_buffer().to_pybytes().translate(LOWER).split(), ids, shingle))
            cls, labels = list(own), list(own.values())
            first = {}
            root = [first.setdefault(x, i) for i, x in enumerate(labels)]
            size = np.array([len(x) for x in sets])
            both = overlaps(sets)
            near = np.argwhere(np.triu(100 * both >= percent * (size[:, None] + size[None] - both), 1))
            out = [(max(cls[i], cls[j]), min(cls[i], cls[j])) for i, j in near.tolist() if _unite(root, i, j)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    texts = keyed(docs)
    where = classes.select("cls", F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    located = clusters.join(where, "cls")
    held = texts.join(located, (located["key"] == texts["text_key"]) & located["id"].eqNullSafe(texts["doc_id"]))
    dealt = held.select("part", "cluster", "cls", "label", "text").repartition("part", "cluster").sortWithinPartitions("part", "cluster")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _open(nodes: DataFrame) -> DataFrame:
    """The rows of nodes that hold more than one component, with the number of classes."""
    state = nodes.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low <> high").select("node", "n")
    return nodes.join(stored(state), "node")


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Large nodes as parts of two blocks each, so that every two classes meet in one."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = nodes.withColumn("blocks", blocks).withColumn("at", F.pmod(F.xxhash64("cls", "node"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.concat_ws(":", F.col("node").cast("string"), F.least("at", "other").cast("string"), F.greatest("at", "other").cast("string"))
    return met.select(part.alias("part"), "cls", "n_shingles", "label")


def linked_classes(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, node: int = NODE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each document with its set_key, the classes, cls and label of the classes with links)."""
    table = sketch(docs, shingle)
    classes = table.where("n_shingles > 0").groupBy("set_key").agg(F.min("row").alias("cls"), F.min("doc_id").alias("least"))
    classes = stored(classes.join(table.select(F.col("row").alias("cls"), "doc_id", "text_key", "n_shingles", "sketch", "paths"), "cls"), "zstd")
    stars = stored(_stars(classes, percent))
    links = stored(confirm(stars, classes, docs, percent, shingle))
    labels = components(links)
    nodes = _nodes(classes).join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    nodes = stored(_open(nodes.select("tree", "node", "cls", "n_shingles", "label")))
    found, level = [], 1
    while True:
        last = level == LEVELS
        small = nodes.where(F.col("n") <= node).select(F.col("node").cast("string").alias("part"), "cls", "n_shingles", "label")
        found.append(small)
        nodes = nodes.where(F.col("n") > node)
        if last:
            found.append(_in_blocks(nodes, node))
        if last or nodes.isEmpty():
            break
        token = F.element_at("paths", F.col("tree") * LEVELS + level + 1)
        nodes = nodes.join(classes.select("cls", "paths"), "cls").select("tree", F.xxhash64("node", token).alias("node"), "cls", "n_shingles", "label")
        nodes, level = stored(_open(nodes)), level + 1
    rest = found[0]
    for more in found[1:]:
        rest = rest.unionByName(more)
    clusters = stored(_clusters(rest.join(classes.select("cls", "sketch"), "cls"), percent))
    if not clusters.isEmpty():
        links = links.unionByName(stored(_exhaust(clusters, classes, docs, percent, shingle)))
        labels = components(links)
    return table, classes, labels


def groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept for each row of docs."""
    table, classes, labels = linked_classes(docs, **options)
    known = classes.select("set_key", "cls", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = known.join(known.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("set_key", "component_id")
    out = table.where("n_shingles > 0").select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key").drop("set_key")
    out = out.unionByName(table.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return groups(docs, **options).drop("text_key")


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, all columns, one document of each group; rows that repeat an id and its text stay together."""
    names = docs.columns
    gone = stored(groups(docs, **options).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct())
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text, doc_id = F.col(f"_{names.index('text')}"), F.col(f"_{names.index('doc_id')}")
    same = (F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))) == F.col("gone_key")) & doc_id.eqNullSafe(F.col("gone_id"))
    return flat.join(gone, same, "left_anti").toDF(*names)
