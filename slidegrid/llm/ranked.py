"""Ranked lexical search by the Best Position Algorithm over impact lists of document shards.

The index has shards of about SHARD_WORDS words: their documents with their numbers of terms, and for every term the
documents that hold it and how often. A shard is cut into rows of a bounded size, which meet again where it is searched.
Corpus counts (documents, terms, documents of each asked term) are aggregates over the shards. In a shard, the list of a
term is ordered by impact, the part of the score that depends on the document. An item is read down all its lists at
once; every document met is scored in full by direct accesses to the other lists, which also mark its positions there.
The best position of a list is the last one before which all have been seen, mostly far beyond the last one read; no
document that hasn't been met can gain more from a list than its first unseen position gives. The search of a shard
stops when these gains sum to strictly less than the score of its k-th document, so equal scores are never lost. The
best of all shards are ranked in a window that each task cuts to k rows an item first.

Items are dealt in blocks of about ITEMS to all shards; neither items nor index are collected or broadcast.

Cases: a null or empty text has no terms: such documents are not counted and such items give no rows; long texts are
taken whole (one may fill a shard); repeated document rows are ranked each, a null doc_id after others of equal score;
of benchmark rows with one item_id (null is one) the smallest text counts; terms that no document holds give nothing;
empty tables give no rows; other columns, also of clashing names, don't matter. Terms are words' 64-bit ids, of which
two in 10^9 different ones collide with a chance of 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SMALL_GROUPS, ordered, pick, pieces, small_batches, stored, whole, word_hashes

NEAREST, SHARD_WORDS, ITEMS, SALTS = 20, 1_000_000, 4096, 64
#: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters and everything beyond ASCII.
BREAKS = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c > 127) for c in range(256)])
INDEX = "shard long, piece int, doc_ids array<long>, sizes array<int>, terms array<long>, counts array<int>, docs array<int>, times array<int>"
TERMS = "item long, term long, times int"
FOUND = "item long, doc_id long, score long"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def build_index(docs: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """INDEX rows: `counts` documents hold each of `terms` (ascending as unsigned numbers); these are listed one term after another in `docs` (ascending numbers within the shard), with `times` of each. All arrays are cut into pieces of PIECE_VALUES values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            ids = pa.concat_arrays([p[0] for p in parts])
            sizes, terms = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = ordered(terms)  # stable: a term's documents ascend
            terms, doc = terms[order], doc[order]
            new_term = np.append(True, terms[1:] != terms[:-1])[: len(terms)]
            new_doc = new_term | np.append(True, doc[1:] != doc[:-1])[: len(terms)]
            first = np.flatnonzero(new_doc)
            lists = np.flatnonzero(new_term[first])
            counts, times = np.diff(lists, append=len(first)), np.diff(first, append=len(terms))
            return pieces(number, {"doc_ids": ids, "sizes": pa.array(sizes, pa.int32()), "terms": pa.array(terms[first][lists].view(np.int64)), "counts": pa.array(counts, pa.int32()), "docs": pa.array(doc[first], pa.int32()), "times": pa.array(times, pa.int32())})

        for batch in small_batches(batches, 1, 1 << 20):
            terms, _, _, sizes = word_hashes(batch.column(1), lower=True, breaks=BREAKS)
            parts.append((batch.column(0), sizes, terms))
            size += len(terms) + len(sizes)
            if size >= shard_words:
                yield row()
                number, size, parts = number + 1, 0, []
        if parts:
            yield row()

    texts = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(texts.mapInArrow(run, INDEX), "zstd", **SMALL_GROUPS)


def terms_of(items: DataFrame) -> DataFrame:
    """TERMS of items (item, text): different terms and how often each stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 1 << 20):
            terms, _, _, sizes = word_hashes(batch.column(1), lower=True, breaks=BREAKS)
            item = np.repeat(batch.column(0).to_numpy(), sizes)
            order = np.lexsort((terms, item))
            terms, item = terms[order], item[order]
            first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (item[1:] != item[:-1]))[: len(terms)])
            yield pa.RecordBatch.from_arrays([pa.array(item[first]), pa.array(terms[first].view(np.int64)), pa.array(np.diff(first, append=len(terms)), pa.int32())], _names(TERMS))

    return items.select("item", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, TERMS)


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    n, length = index.agg(F.sum(F.size(F.filter("sizes", lambda x: x > 0)).cast("long")), F.sum(total)).first()
    return n or 0, length or 0


def weighted(index: DataFrame, terms: DataFrame, documents: int) -> DataFrame:
    """item, asked array<struct<term, weight>>: terms that the corpus holds, with their weight times their repeats."""
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("n"))
    held = held.join(stored(terms.select("term").distinct()), "term", "left_semi")
    counts = stored(held.groupBy("term").agg(F.sum("n").alias("df")))  # written first, so that the join can split a frequent term
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    one = F.struct("term", (F.col("times") * weight).alias("weight"))
    return terms.join(counts, "term").groupBy("item").agg(F.array_sort(F.collect_list(one)).alias("asked"))


class Shard:
    """A shard of the index; lists by term, ordered by document and by impact."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, times: np.ndarray, documents: int, length: int):
        self.terms, self.docs, self.times = terms.view(np.uint64), docs, times
        self.ends = np.append(0, np.cumsum(counts))
        n = sizes.astype(np.int64)
        exact = n if 25 * int(n.max(initial=0)) * documents < 1 << 63 else n.astype(object)
        self.length_part = 75 + (25 * exact * documents // max(1, length)).astype(np.int64)
        self.lists: dict[int, tuple] = {}

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, ascending; their impacts; the order in which impacts fall)."""
        if term not in self.lists:
            at = int(np.searchsorted(self.terms, np.int64(term).view(np.uint64)))
            held = at < len(self.terms) and self.terms[at] == np.int64(term).view(np.uint64)
            own = slice(self.ends[at], self.ends[at + 1]) if held else slice(0, 0)
            docs, times = self.docs[own].astype(np.int64), self.times[own].astype(np.int64)
            impact = 1_000_000_000 * times // (1000 * times + 12 * self.length_part[docs])
            self.lists[term] = docs, impact, np.argsort(-impact, kind="stable")
        return self.lists[term]


def best_positions(shard: Shard, asked: list[tuple[int, int]], nearest: int, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) among which are the `nearest` best of the shard and all that equal the last of them; tally gets (documents met, documents in the lists)."""
    found = [(*shard.list_of(term), weight) for term, weight in asked]
    found = [x for x in found if len(x[0])]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    many = len(shard.length_part)
    ends = np.cumsum([len(d) for d, *_ in found])
    starts = ends - [len(d) for d, *_ in found]
    keys = np.concatenate([k * many + d for k, (d, *_) in enumerate(found)])  # direct access: list and document
    gains = np.concatenate([w * i for _, i, _, w in found])
    fall = np.concatenate([s + o for s, (_, _, o, _) in zip(starts, found, strict=True)])  # sorted access: places in keys
    position = np.empty(len(keys), np.int64)
    position[fall] = np.arange(len(keys))
    seen, met = np.zeros(len(keys), bool), np.zeros(many, bool)
    docs, scores, best, step = [], [], starts.copy(), max(1, nearest)
    first, tops = np.arange(len(found))[:, None] * many, np.zeros(0, np.int64)
    while True:
        reach = np.minimum(best + step, ends)
        at = np.repeat(best - np.append(0, np.cumsum(reach - best)[:-1]), reach - best) + np.arange((reach - best).sum())
        batch = np.unique(keys[fall[at]] % many)
        batch = batch[~met[batch]]
        met[batch] = True
        wide = max(1, (1 << 20) // len(found))
        for part in (batch[i : i + wide] for i in range(0, len(batch), wide)):
            asked_keys = first + part
            place = np.minimum(np.searchsorted(keys, asked_keys), len(keys) - 1)
            hit = keys[place] == asked_keys
            seen[position[place[hit]]] = True
            docs.append(part)
            scores.append(np.where(hit, gains[place], 0).sum(0))
            tops = np.sort(np.append(tops, scores[-1]))[-nearest:]
        unseen = np.append(np.flatnonzero(~seen), len(seen))
        best = np.minimum(unseen[np.searchsorted(unseen, starts)], ends)
        open_ = best < ends
        if not open_.any() or len(tops) == nearest and gains[fall[best[open_]]].sum() < tops[0]:
            break
        step *= 2
    docs, scores = np.concatenate(docs), np.concatenate(scores)
    if tally is not None:
        tally.append((len(docs), len(np.unique(keys % many))))
    keep = scores >= (max(1, tops[0]) if len(tops) == nearest else 1)
    return docs[keep], scores[keep]


def search(index: DataFrame, asked: DataFrame, documents: int, length: int, nearest: int) -> DataFrame:
    """FOUND: the best documents of each shard for each item."""
    blocks = max(1, -(-asked.count() // ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    dealt = asked.withColumn("block", block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    shards = index.where(F.col("piece") == 0).select(F.col("shard").alias("part")).withColumns({"block": every, "salt": F.pmod(F.xxhash64("part"), F.lit(SALTS)).cast("int")})
    right = dealt.join(shards, ["block", "salt"]).select("part", "block", "item", "asked")
    left = index.withColumn("block", every)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        items, ids, values = [], [], []
        if left.num_rows and right.num_rows:
            names, *lists = whole(left, "doc_ids", "sizes", "terms", "counts", "docs", "times")
            shard = Shard(*(x.to_numpy() for x in lists), documents, length)
            for item, terms in zip(right.column("item").to_pylist(), right.column("asked").to_pylist(), strict=True):
                docs, scores = best_positions(shard, [(t["term"], t["weight"]) for t in terms], nearest)
                own = names.take(pa.array(docs))
                if len(docs) > nearest:  # of equal scores, the smallest ids
                    order = np.lexsort((own.fill_null(np.iinfo(np.int64).max).to_numpy(), -scores))[:nearest]
                    own, scores = own.take(pa.array(order)), scores[order]
                items.append(np.full(len(own), item))
                ids.append(own)
                values.append(scores)
        if not items:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, _names(FOUND))
        return pa.Table.from_arrays([pa.array(np.concatenate(items)), pa.concat_arrays(ids), pa.array(np.concatenate(values))], _names(FOUND))

    return left.groupBy("shard", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, FOUND)


def rank(docs: DataFrame, items: DataFrame, *, nearest: int = NEAREST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents."""
    index = build_index(docs, shard_words=shard_words)
    documents, length = corpus_size(index)
    texts = pick(items, item_id="item_id", text="text").groupBy("item_id").agg(F.min("text").alias("text"))
    known = stored(texts.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    found = search(index, stored(weighted(index, stored(terms_of(known)), documents)), documents, length, nearest)
    best = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", best).where(F.col("rank") <= nearest)
    return top.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
