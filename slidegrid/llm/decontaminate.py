"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each shard (of about SHARD_WORDS words) holds its documents, and for every term of
its texts the ascending list of the positions at which it stands. A shard is cut into rows of a bounded size, which meet
again where it is searched. Terms are words' 64-bit ids. The benchmark's windows
are a table too: each gets the corpus counts of its terms and is joined, by the rarest of them, with the shards that
hold that term; a window with a word that the corpus lacks goes. A shard's lists are then intersected after adjustment
by their offsets, rarest terms first, so most windows end at the first or second list. The same lists give proximity
matches. Index and benchmark may both be of any size; neither is collected or broadcast.

Cases: a null or empty text has no words and no hits; an item without words has no windows, and one with fewer than
`width` words is one window; a null item id is written as the empty string; repeated rows are judged each; empty
tables give no rows or no hits; other columns, also of clashing names, don't matter. `clean` judges texts, so a null or
repeated id never takes other texts with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import PIECE_VALUES, SMALL_GROUPS, ordered, pick, pieces, small_batches, stored, whole, word_hashes

WIDTH, SHARD_WORDS, SHARE = 13, 250_000, 20
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters and everything beyond ASCII.
BREAKS = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c > 127) for c in range(256)])
INDEX = "shard long, piece int, doc_ids array<long>, doc_keys array<long>, sizes array<int>, terms array<long>, counts array<int>, gaps array<int>"
WINDOWS = "item string, number long, term long, place int, size int"
MATCHES = "shard long, doc int, ids array<string>, places array<int>, lengths array<int>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc_key (of the text), text."""
    text = F.coalesce("text", F.lit(""))
    return pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc_key"), text.alias("text"))


def build_index(docs: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """INDEX rows. Positions of a shard leave one place free after each document; `gaps` are their differences. All arrays are cut into pieces of PIECE_VALUES values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, parts = TaskContext.get().partitionId() << 32, 0, []

        def row() -> pa.RecordBatch:
            ids, keys = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
            sizes, terms = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            places = np.arange(len(terms)) + np.repeat(np.arange(len(sizes)), sizes)
            order = ordered(terms)
            terms, places = terms[order], places[order]
            first = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
            gaps = np.diff(places, prepend=0)
            gaps[first] = places[first]
            counts = np.diff(first, append=len(terms))
            return pieces(number, {"doc_ids": ids, "doc_keys": keys, "sizes": pa.array(sizes, pa.int32()), "terms": pa.array(terms[first].view(np.int64)), "counts": pa.array(counts, pa.int32()), "gaps": pa.array(gaps, pa.int32())})

        for batch in small_batches(batches, 2, 1 << 20):
            terms, _, _, sizes = word_hashes(batch.column(2), lower=True, breaks=BREAKS)
            parts.append((batch.column(0), batch.column(1), sizes, terms))
            size += len(terms) + len(sizes)
            if size >= shard_words:
                yield row()
                number, size, parts = number + 1, 0, []
        if parts:
            yield row()

    return stored(keyed(docs).mapInArrow(run, INDEX), "zstd", **SMALL_GROUPS)


class Shard:
    """A shard of the index with its lists."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray):
        self.sizes, self.terms, self.gaps = sizes.astype(np.int64), terms, gaps
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.ends = np.append(0, np.cumsum(counts))
        self.lists: dict[int, np.ndarray] = {}

    def list_of(self, term: int) -> np.ndarray:
        if term not in self.lists:
            at = int(np.searchsorted(self.terms.view(np.uint64), np.int64(term).view(np.uint64)))
            held = at < len(self.terms) and self.terms[at] == term
            self.lists[term] = np.cumsum(self.gaps[self.ends[at] : self.ends[at + 1]].astype(np.int64)) if held else np.zeros(0, np.int64)
        return self.lists[term]

    def phrase(self, terms: list[tuple[int, int]]) -> np.ndarray:
        """Starts at which all (term, offset) stand; rarest term first."""
        term, offset = terms[0]
        found = self.list_of(term) - offset
        for term, offset in terms[1:]:
            places = self.list_of(term)
            if not len(found) or not len(places):
                return np.zeros(0, np.int64)
            at = np.searchsorted(places, found + offset)
            found = found[places[np.minimum(at, len(places) - 1)] == found + offset]
        return found

    def near(self, terms: list[int], span: int) -> np.ndarray:
        """Ends of the stretches of at most `span` words of one document that hold all terms."""
        lists = [self.list_of(t) for t in set(terms)]
        if not all(map(len, lists)):
            return np.zeros(0, np.int64)
        ends = np.sort(np.concatenate(lists))
        first = ends.copy()
        for places in lists:
            at = np.searchsorted(places, ends, "right") - 1
            first = np.minimum(first, np.where(at >= 0, places[at], -(1 << 40)))
        fits = ends - first < span
        return ends[fits & (self.doc_of(np.maximum(first, 0)) == self.doc_of(ends))]

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def windows(items: DataFrame, width: int) -> DataFrame:
    """WINDOWS: the terms of each window of items (item_id, text), with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 1, 1 << 18, 256):
            terms, _, _, sizes = word_hashes(batch.column(1), lower=True, breaks=BREAKS)
            for item, own in zip(batch.column(0).to_pylist(), np.split(terms.view(np.int64), np.cumsum(sizes)[:-1]), strict=True):
                size = min(width, len(own))
                for at in range(0, max(0, len(own) - size + 1) if size else 0, 4096):
                    seen = np.lib.stride_tricks.sliding_window_view(own, size)[at : at + 4096]
                    n = len(seen)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * (n * size), pa.string()), pa.array(np.repeat(np.arange(number, number + n), size)), pa.array(seen.ravel()), pa.array(np.tile(np.arange(size), n), pa.int32()), pa.array(np.full(n * size, size), pa.int32())], _names(WINDOWS))
                    number += n

    texts = pick(items, item_id="item_id", text="text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return stored(texts.mapInArrow(run, WINDOWS))


def search(index: DataFrame, asked: DataFrame, *, span: int | None = None) -> DataFrame:
    """MATCHES of windows, one row a document (by its number in the shard).

    Exact phrases by default; with `span`, stretches of at most so many words that hold all of a window's words.
    """
    held = index.select("shard", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("shard", F.col("x.terms").alias("term"), F.col("x.counts").cast("long").alias("n"))
    held = stored(held.join(stored(asked.select("term").distinct()), "term", "left_semi"))
    counts = stored(held.groupBy("term").agg(F.sum("n").alias("n")))  # written first, so that joins can split a frequent term
    plans = asked.join(counts, "term").groupBy("item", "number", "size").agg(F.array_sort(F.collect_list(F.struct("n", "place", "term"))).alias("plan")).where(F.size("plan") == F.col("size"))
    plans = stored(plans.select("item", "plan.term", "plan.place", F.element_at("plan", 1)["term"].alias("rarest")))
    found = plans.join(held.select("shard", F.col("term").alias("rarest")), "rarest").select("shard", "item", "term", "place")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            shard, hits = Shard(*(x.to_numpy() for x in whole(left, "sizes", "terms", "counts", "gaps"))), {}
            for item, terms, places in zip(*(right.column(c).to_pylist() for c in ("item", "term", "place")), strict=True):
                at = shard.phrase(list(zip(terms, places, strict=True))) if span is None else shard.near(terms, span)
                for doc, place in zip(shard.doc_of(at).tolist(), at.tolist(), strict=True):
                    hits.setdefault(doc, []).append((item, place - int(shard.starts[doc]), len(terms)))
            number = left.column("shard")[0].as_py()
            out = [(number, doc, *map(list, zip(*own, strict=True))) for doc, own in hits.items()]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], _names(MATCHES))

    lists = index.select("shard", "piece", "sizes", "terms", "counts", "gaps")
    return lists.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, MATCHES)


@F.pandas_udf(StructType([StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType())]))
def _digest(sizes: pd.Series, ids: pd.Series, places: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    out = []
    for n, own, starts, spans in zip(sizes, ids, places, lengths, strict=True):
        hit = np.zeros(n + 1, np.int64)
        if own is not None:
            np.add.at(hit, starts, 1)
            np.add.at(hit, np.add(starts, spans), -1)
        items = sorted(set(own)) if own is not None else []
        out.append((int((np.cumsum(hit) > 0).sum()), len(items), hashlib.sha256(",".join(items).encode()).hexdigest()))
    return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256"])


def judged(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, share: int = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    index = build_index(docs, shard_words=shard_words)
    matches = search(index, windows(benchmark, width))
    each = index.select("shard", "piece", F.posexplode(F.arrays_zip("doc_ids", "doc_keys", "sizes")).alias("doc", "x"))
    each = each.select("shard", (F.col("piece") * PIECE_VALUES + F.col("doc")).alias("doc"), F.col("x.doc_ids").alias("doc_id"), F.col("x.doc_keys").alias("doc_key"), F.col("x.sizes").alias("n_words"))
    digest = each.join(matches, ["shard", "doc"], "left").select("doc_id", "doc_key", F.col("n_words").cast("long").alias("n_words"), _digest("n_words", "ids", "places", "lengths").alias("d"))
    return digest.select("doc_id", "doc_key", "n_words", "d.*", ((F.col("d.n_hit") > 0) & (share * F.col("d.n_hit") >= F.col("n_words"))).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    return judged(docs, benchmark, **options).drop("doc_key")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns, whose texts aren't contaminated."""
    names = docs.columns
    bad = stored(judged(docs, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("doc_key").alias("bad_key")).distinct())
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text, doc_id = F.col(f"_{names.index('text')}"), F.col(f"_{names.index('doc_id')}")
    gone = (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("bad_key")) & doc_id.eqNullSafe(F.col("bad_id"))
    return flat.join(bad, gone, "left_anti").toDF(*names)
