"""Best-fit packing of documents into bins of a fixed number of words, with conflicts.

Documents are cut into pieces of at most CAPACITY words (the pieces before the last fill a bin each). What remains is
packed best-fit, largest first: bins stand in the order of their room, and the search goes from the tightest bin that
has room to its successors until one is compatible. A bin carries two bitmaps. A set bit of the first means that a
duplicate cluster is in the bin; two documents of a cluster never share one. A set bit of the second means that a
source has its SOURCE_PIECES pieces in the bin, and takes no more of it. Both are exact: bits are numbered per group.

Groups of about GROUP pieces are packed independently. They are dealt by a hash of the row's id, words and source and, for rows
equal in these, their number, so a source or a cluster that holds a third of all rows is spread over all groups, bins do not
depend on files or partitions, and more input only means more groups. A cluster is the
set of documents with the same words (lower-cased), or the given cluster column.

Cases: null and empty texts hold no words and are in no bin; a null source is one more source, and a null id a row as
any other; repeated rows are of one cluster and thus never share a bin; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

CAPACITY, SOURCE_PIECES, GROUP = 2048, 4, 4000
PACKED = "group long, bin int, doc_id long, part int, first_word long, n_words int, source string, used int"


class Bin:
    __slots__ = ("room", "number", "clusters", "full_sources", "sources", "pieces")

    def __init__(self, capacity: int, number: int):
        self.room, self.number, self.clusters, self.full_sources, self.sources, self.pieces = capacity, number, 0, 0, {}, []

    def takes(self, cluster: int, source: int) -> bool:
        return not (self.clusters & cluster or self.full_sources & source)

    def put(self, piece, size: int, cluster: int, source: int, most: int) -> None:
        self.room -= size
        self.clusters |= cluster
        self.sources[source] = self.sources.get(source, 0) + 1
        if self.sources[source] >= most:
            self.full_sources |= source
        self.pieces.append(piece)


def best_fit(pieces: list[tuple[int, object, object]], capacity: int = CAPACITY, source_pieces: int = SOURCE_PIECES) -> list[Bin]:
    """Bins for (size, cluster, source) pieces, given largest first; a bin's pieces are their numbers."""
    bit = {}
    bins: list[Bin] = []
    order: list[tuple[int, int]] = []  # (room, number), ascending
    for k, (size, cluster, source) in enumerate(pieces):
        own = 1 << bit.setdefault(("c", cluster), len(bit))
        kind = 1 << bit.setdefault(("s", source), len(bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and not bins[order[at][1]].takes(own, kind):
            at += 1
        if at < len(order):
            chosen = bins[order.pop(at)[1]]
        else:
            bins.append(chosen := Bin(capacity, len(bins)))
        chosen.put(k, size, own, kind, source_pieces)
        if chosen.room:
            insort(order, (chosen.room, chosen.number))
    return bins


def pieces_of(docs: DataFrame, capacity: int, cluster: str | None) -> DataFrame:
    names = {"doc_id": "doc_id", "text": "text", "source": "source"} | ({"cluster": cluster} if cluster else {})
    rows = pick(docs, **names)
    words = F.coalesce(F.array_size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")), F.lit(0))
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    same = F.xxhash64("cluster") if cluster else F.xxhash64(F.trim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")))
    sized = rows.select("doc_id", "source", same.alias("cluster"), words.alias("words")).where("words > 0")
    # rows equal in all of these are counted, which keeps a hot one small, and numbered: which of them is which makes no difference
    alike = sized.groupBy(*sized.columns).agg(F.count("*").alias("copies"))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0), F.expr("(copies - 1) div 65536"))))
    one = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * 65536, F.least("copies", (F.col("block") + 1) * 65536) - 1)))
    return one.select(*sized.columns, F.xxhash64("doc_id", "cluster", "source", "copy").alias("mark"))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, source_pieces: int = SOURCE_PIECES, group: int = GROUP, cluster: str | None = None) -> DataFrame:
    """PACKED: a row for each piece, with its bin and the words in it altogether."""
    rows = stored(pieces_of(docs, capacity, cluster))
    groups = max(1, -(-rows.count() // group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("mark", F.lit(11)), F.lit(groups)))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["words", "mark", "cluster", "doc_id"], ascending=False)
        out, rest, number = [], [], 0
        for doc_id, source, own, words in zip(frame["doc_id"], frame["source"], frame["cluster"], frame["words"], strict=True):
            whole, left = divmod(int(words), capacity)
            for part in range(whole):
                out.append((key[0], number, doc_id, part, part * capacity, capacity, source, capacity))
                number += 1
            if left:
                rest.append((left, own, source, doc_id, whole))
        rest.sort(key=lambda r: -r[0])
        for held in best_fit([r[:3] for r in rest], capacity, source_pieces):
            for k in held.pieces:
                size, _, source, doc_id, part = rest[k]
                out.append((key[0], number + held.number, doc_id, part, part * capacity, size, source, capacity - held.room))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return rows.groupBy("group").applyInPandas(run, PACKED)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How well bins are used: bins, words, share of their room that is used."""
    bins = packed.groupBy("group", "bin").agg(F.sum("n_words").alias("n"))
    return bins.agg(F.count("*").alias("bins"), F.sum("n").alias("words"), (F.sum("n") / (F.count("*") * capacity)).alias("share"))
