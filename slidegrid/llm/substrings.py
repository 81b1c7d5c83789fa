"""Substring dedup by prefix-partitioned sparse suffix trees.

A window of WIDTH words is repeated if its words also start at another place. The trees hold the suffixes that begin at
anchors: the anchor of a window is the run of ANCHOR words inside it with the smallest hash, so equal windows have
their anchor at equal offsets, and two equal windows are two anchored suffixes that share a prefix, the words from the
anchor on, and the words before the anchor.

1. Neighbouring windows with the same anchor form a block, about one for 14 words: a leaf, with the words that its
   windows cover before the anchor (read backwards) and from it on. Leaves are filed by their prefix of ANCHOR words.
   A prefix that occurs once has no internal node below it, and its leaf is dropped.
2. Leaves that are equal as a whole (64-bit hashes of span and prefix) are leaves of one deep node: all their windows
   are repeated, and one of them goes on. What remains are mostly the rims of copied passages.
3. A prefix with at most MOST_LEAVES different leaves is small enough for memory. One task sorts them, takes the common
   prefixes of neighbours, and goes through the internal nodes, the deepest first: below a node of depth d, sorted left
   contexts give how far left two leaves agree, and a maximal repeat of WIDTH words or more gives repeated windows.
4. A larger group is split by longer prefixes. The windows that begin near the anchor reach far to its right, so they
   are filed by more words from the anchor on; the others by more words to its left; each goes to one of the two,
   and large ones are split again, with 22 and 29 words. What is still large is filed by all WIDTH words of a window: a
   root that is deep itself, so the number of its leaves, summed before the shuffle, decides.

Texts are read twice: once for blocks, once for the leaves that steps 3 and 4 need, and for the texts that lose some
but not all words (one shuffle serves both).

Cases: null and empty texts have no words; texts shorter than WIDTH lose nothing; repeated rows and copies repeat each
other and lose all words that windows cover; a null id is a row like any other; an empty table gives no rows. `strip`
keeps all columns, also such as differ in case only or bear a name used here, and drops rows without words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pick, rolling, small_batches, stored, text_bytes, word_hashes

WIDTH, ANCHOR, MOST_LEAVES = 35, 8, 500
SPLITS = 2  # times that a large group is halved before whole windows decide
#: A row for each text (anchor null) and for each of its blocks (sha null).
BLOCKS = "row long, doc_id long, text_key binary, n_words int, sha string, anchor long, hash long, start int, size int, before int"
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class BlockFinder:
    """Blocks of one text, given its words' ids: hashes of prefix and span, first window, number of windows, words before the anchor."""

    def __init__(self, width: int, anchor: int):
        self.width, self.anchor = width, anchor
        self.up, self.down = _powers(_BASE, 1024), _powers(_INVERSE, 1024)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(ids) - self.width + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 5
        if len(ids) >= len(self.up):
            self.up, self.down = _powers(_BASE, 2 * len(ids)), _powers(_INVERSE, 2 * len(ids))
        grams = rolling(ids, self.anchor)
        reach = self.width - self.anchor + 1
        seen = np.lib.stride_tricks.sliding_window_view(grams, reach)[:, ::-1]
        place = np.concatenate([np.arange(a, min(n, a + 65536)) + reach - 1 - seen[a : a + 65536].argmin(1) for a in range(0, n, 65536)])
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) + self.width - 1  # the span ends before this word
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * self.up[: len(ids)], dtype=np.uint64)])
        spans = mix((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))
        return grams[place[first]].view(np.int64), spans.view(np.int64), first, last - first - self.width + 1, place[first] - first


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return pick(docs, doc_id="doc_id", text="text").select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def find_blocks(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, number = BlockFinder(width, anchor), TaskContext.get().partitionId() << 33
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in small_batches(batches, 2):
            ids, begin, end, sizes = word_hashes(batch.column(2), lower=False)
            data, offsets = text_bytes(batch.column(2))
            gap = np.concatenate([[0], np.cumsum((begin[1:] - end[:-1] != 1) | (data[end[:-1]] != 32))]) if len(ids) else np.zeros(1, np.int64)
            after = np.cumsum(sizes)
            shas, found = [], []
            for k, (p, q) in enumerate(zip((after - sizes).tolist(), after.tolist(), strict=True)):
                plain = q > p and gap[q - 1] == gap[p]  # single spaces between all words
                left = data[begin[p] : end[q - 1]].tobytes() if plain else b" ".join(data[offsets[k] : offsets[k + 1]].tobytes().split())
                shas.append(hashlib.sha256(left).hexdigest())
                found.append(finder(ids[p:q]))
            m = len(sizes)
            texts = np.arange(number, number + m)
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(texts), batch.column(0).cast(pa.int64()), batch.column(1), pa.array(sizes, pa.int32()), pa.array(shas), none(m, pa.int64()), none(m, pa.int64()), *[none(m, pa.int32())] * 3], names)
            owner = np.repeat(texts, [len(f[0]) for f in found])
            if len(owner):
                columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                n = len(owner)
                yield pa.RecordBatch.from_arrays([pa.array(owner), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.int32()), none(n, pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], names)
            number += m

    return stored(keyed(docs).mapInArrow(run, BLOCKS), "zstd")


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Subtree:
    """The suffix tree of the leaves of one prefix.

    A leaf is (words from the anchor on, words before it read backwards). `order` has the leaves sorted by their words,
    `depths[i]` how many words the i-th and the next have in common. The internal nodes are the runs of leaves with
    depths of d or more, for each d that occurs.
    """

    def __init__(self, leaves: list[tuple[list[bytes], list[bytes]]]):
        self.leaves = leaves
        self.order = sorted(range(len(leaves)), key=lambda k: leaves[k][0])
        self.depths = [_common(leaves[a][0], leaves[b][0]) for a, b in zip(self.order, self.order[1:], strict=False)]

    def nodes(self) -> Iterator[tuple[int, list[int]]]:
        """(depth, leaves below) of each internal node, the deepest first."""
        for depth in sorted(set(self.depths), reverse=True):
            below = [self.order[0]]
            for leaf, shared in zip(self.order[1:], self.depths, strict=True):
                if shared < depth:
                    if len(below) > 1:
                        yield depth, below
                    below = []
                below.append(leaf)
            if len(below) > 1:
                yield depth, below

    def repeats(self, width: int) -> dict[int, set[int]]:
        """For each leaf, how many words before the anchor the repeated windows begin that maximal repeats cover."""
        out: dict[int, set[int]] = {}
        for depth, below in self.nodes():
            if depth + max(len(self.leaves[k][1]) for k in below) < width:
                continue
            below = sorted(below, key=lambda k: self.leaves[k][1])
            left = [_common(self.leaves[a][1], self.leaves[b][1]) for a, b in zip(below, below[1:], strict=False)]
            for k, reach in zip(below, map(max, [0, *left], [*left, 0]), strict=True):
                if reach + depth >= width:  # a maximal repeat of reach + depth words
                    out.setdefault(k, set()).update(range(max(0, width - depth), reach + 1))
        return out


LEAVES = "name long, anchor long, hash long, n long, before int, low int, high int, span binary"


def _grow(leaves: DataFrame, width: int) -> DataFrame:
    """anchor, hash, at (starts in the span) from the subtrees of groups that fit into memory; low <= words before the anchor <= high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True)

        out = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            own = list({r[1:3]: r for r in group}.values())
            if len(own) < 2:
                continue
            words = [r[7].split(b" ") for r in own]
            tree = Subtree([(w[r[4] :], w[: r[4]][::-1]) for r, w in zip(own, words, strict=True)])
            for k, reach in tree.repeats(width).items():
                name, anchor, key, n, before, low, high, _ = own[k]
                starts = sorted(before - x for x in reach if low <= x <= high and len(words[k]) - (before - x) >= width)
                if starts and n == 1:
                    out.append((anchor, key, starts))
            if len(out) > 1000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    dealt = leaves.select(*[x.split()[0] for x in LEAVES.split(", ")]).repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, "anchor long, hash long, at array<int>")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], ["anchor", "hash", "at"])


def _longer(leaves: DataFrame, width: int, anchor: int) -> DataFrame:
    """Leaves filed by longer prefixes: by words to the left for windows that begin far before the anchor, by words to the right for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, first, key, n, before, low, high, span in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                words, middle = span.split(b" "), (low + high + 1) // 2
                # windows that begin x words before the anchor, low <= x <= high, hold x words before it and width - x after
                for a, b in ((low, middle - 1), (middle, high)):
                    inside = before - a, before + width - b
                    least = max(0, before + width - len(words))  # the span's last window
                    if a <= b and inside[0] >= 0 and before >= a and b >= least:
                        own = hashlib.blake2b(b" ".join(words[inside[0] : inside[1]]) + bytes([a, b]), digest_size=8).digest()
                        out.append((int.from_bytes(own, "little", signed=True), first, key, n, before, a, b, span))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in LEAVES.split(", ")])

    return leaves.select(*[x.split()[0] for x in LEAVES.split(", ")]).mapInArrow(run, LEAVES)


def _whole_windows(leaves: DataFrame, width: int) -> DataFrame:
    """anchor, hash, at for groups that are large still: each window is filed by all its words, and the leaves of that root decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, first, key, n, before, low, high, span in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                words = span.split(b" ")
                starts = range(max(0, before - high), min(before - low, len(words) - width) + 1)
                out += [(first, key, n, i, hashlib.md5(b" ".join(words[i : i + width])).digest()) for i in starts]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "hash", "n", "at", "prefix"])

    suffixes = stored(leaves.select(*[x.split()[0] for x in LEAVES.split(", ")]).mapInArrow(run, "anchor long, hash long, n long, at int, prefix binary"))
    deep = stored(suffixes.groupBy("prefix").agg(F.sum("n").alias("leaves")).where("leaves > 1").select("prefix"))
    return suffixes.where("n = 1").join(deep, "prefix").select("anchor", "hash", F.array("at").alias("at"))


def _shared(leaves: DataFrame, width: int, anchor: int, most_leaves: int) -> DataFrame:
    """anchor, hash, at of the windows that different leaves share."""
    found = []
    for turn in range(SPLITS + 1):
        if turn:
            leaves = stored(_longer(leaves, width, anchor))
        counts = stored(leaves.groupBy("name").agg(F.count("*").alias("leaves")))  # written first, so that the join can split a frequent name
        sized = leaves.join(counts, "name")
        found.append(_grow(sized.where((F.col("leaves") > 1) & (F.col("leaves") <= most_leaves)), width))
        if counts.where(F.col("leaves") > most_leaves).isEmpty():
            break
        leaves = sized.where(F.col("leaves") > most_leaves).drop("leaves")
    else:
        found.append(_whole_windows(leaves, width))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(rows: DataFrame) -> DataFrame:
    """LEAVES: text, blocks -> the words of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            out = []
            for text, blocks in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_buffer().to_pybytes().split()
                for b in blocks.as_py():
                    out.append((b["anchor"], b["anchor"], b["hash"], b["n"], b["before"], 0, b["most"], b" ".join(words[b["start"] : b["start"] + b["size"]])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], [x.split()[0] for x in LEAVES.split(", ")])

    return rows.mapInArrow(run, LEAVES)


def _strip(width: int, texts: bool):
    """doc_id, text, runs (first window, number of windows) -> what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for r in runs:
                    edge[r["first"]] += 1
                    edge[r["first"] + r["size"] + width - 1] -= 1
                gone = (np.cumsum(edge) > 0)[:-1]
                left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((doc_id, len(words), int(gone.sum()), left if texts else hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def repeated_runs(docs: DataFrame, *, width: int = WIDTH, anchor: int = ANCHOR, most_leaves: int = MOST_LEAVES) -> tuple[DataFrame, DataFrame]:
    """(one row a text with its key and size, the runs of repeated windows by row)."""
    both = find_blocks(docs, width, anchor)
    table, each = both.where("anchor is null").select("row", "doc_id", "text_key", "n_words", "sha"), both.where("anchor is not null").select("row", "anchor", "hash", "start", "size", "before")
    often = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    blocks = stored(each.join(stored(often), "anchor"))  # sums are written first, so that the join can split a frequent anchor
    kinds = blocks.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "size", "before")).alias("at"))
    leaves = kinds.groupBy("anchor").agg(F.count("*").alias("leaves"))
    kinds = stored(kinds.join(stored(leaves), "anchor"))
    wanted = kinds.where("leaves > 1").select("at.row", F.struct("anchor", "hash", "n", "at.before", F.lit(width - anchor).alias("most"), "at.start", (F.col("at.size") + width - 1).alias("size")).alias("b"))
    wanted = wanted.groupBy("row").agg(F.collect_list("b").alias("blocks")).join(table.select("row", "doc_id", "text_key"), "row")
    texts = keyed(docs).withColumnRenamed("doc_id", "id")
    same = lambda a: (a["text_key"] == texts["text_key"]) & a["doc_id"].eqNullSafe(texts["id"])
    spans = stored(_cut(texts.join(wanted, same(wanted)).select("text", "blocks")))
    shared = _shared(spans.dropDuplicates(["anchor", "hash"]), width, anchor, most_leaves)
    whole = blocks.join(kinds.where("n > 1").select("anchor", "hash"), ["anchor", "hash"]).select("row", F.struct(F.col("start").alias("first"), "size").alias("run"))
    some = blocks.join(shared, ["anchor", "hash"]).select("row", F.explode("at").alias("at"), "start").select("row", F.struct((F.col("start") + F.col("at")).alias("first"), F.lit(1).alias("size")).alias("run"))
    return table, whole.unionByName(some).groupBy("row").agg(F.collect_list("run").alias("runs"), F.sum("run.size").alias("covered"))


def _judged(docs: DataFrame, texts_wanted: bool, options: dict) -> tuple[DataFrame, DataFrame]:
    """(rows that lose nothing or everything, rows that lose some words)."""
    width = options.get("width", WIDTH)
    table, runs = repeated_runs(docs, **options)
    rows = stored(table.join(runs, "row", "left"))
    partly = F.coalesce(F.col("covered") < F.col("n_words") - width + 1, F.lit(False))
    lost = F.when(F.col("covered").isNull(), 0).otherwise(F.col("n_words")).cast("long")
    sha = F.when(F.col("covered").isNull(), F.col("sha")).otherwise(hashlib.sha256(b"").hexdigest())
    plain = rows.where(~partly).select("doc_id", F.col("n_words").cast("long").alias("n_words"), lost.alias("n_removed"), sha.alias("kept"), "text_key")
    some = rows.where(partly).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "runs").dropDuplicates(["id", "key"])
    texts = keyed(docs)
    joined = texts.join(some, (texts["text_key"] == some["key"]) & texts["doc_id"].eqNullSafe(some["id"]))
    return plain, joined.select("doc_id", "text", "runs").mapInArrow(_strip(width, texts_wanted), "doc_id long, n_words long, n_removed long, kept string")


def removal(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    plain, partly = _judged(docs, False, options)
    return plain.drop("text_key").unionByName(partly).withColumnRenamed("kept", "kept_sha256")


def strip(docs: DataFrame, **options) -> DataFrame:
    """docs with the words that are left as text; texts that lose nothing stay as they are, and rows without words go."""
    names, width = docs.columns, options.get("width", WIDTH)
    table, runs = repeated_runs(docs, **options)
    rows = stored(table.select("row", "doc_id", "text_key", "n_words").join(runs, "row"))
    cut = rows.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "runs").dropDuplicates(["id", "key"])
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    of = lambda name: f"_{names.index(name)}"
    source = flat.withColumn("text_key", F.unhex(F.md5(F.coalesce(F.col(of("text")), F.lit("")).cast("binary"))))
    joined = source.join(cut, (source["text_key"] == cut["key"]) & source[of("doc_id")].eqNullSafe(cut["id"]), "left")

    @F.pandas_udf("string")
    def left(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, runs, strict=True):
            if own is None:
                out.append(text)
                continue
            words = text.encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            for r in own:
                edge[r["first"]] += 1
                edge[r["first"] + r["size"] + width - 1] -= 1
            out.append(b" ".join(w for w, g in zip(words, (np.cumsum(edge) > 0).tolist(), strict=False) if not g).decode())
        return pd.Series(out, dtype=object)

    out = joined.withColumn(of("text"), left(of("text"), "runs"))
    if "n_chars" in names:
        out = out.withColumn(of("n_chars"), F.when(F.col("runs").isNull(), F.col(of("n_chars"))).otherwise(F.length(of("text")).cast("long")))
    blank = F.rlike(F.coalesce(F.col(of("text")), F.lit("")), F.lit(r"^[\x20\x09-\x0D]*$"))
    return out.where(~blank).select(*[F.col(f"_{i}") for i in range(len(names))]).toDF(*names)
