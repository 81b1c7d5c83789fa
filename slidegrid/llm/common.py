"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are split at these bytes only: [^\x20\x09-\x0D]+, which is what bytes.split() does.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name under new names; other columns, also such as differ in case only, don't disturb."""
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder of the cluster (spark.checkpoint.dir); in local mode a temporary folder will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="slidegrid-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/slidegrid-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "lz4", **options: int | bool) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends there, and what was computed is computed once."""
    path = scratch(df.sparkSession)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Values of an array in a row of an index, and how such rows are written: readers decode whole row groups, whose size is looked at after so many rows (100 by default). Dictionaries of hashes and positions only cost time.
PIECE_VALUES, SMALL_GROUPS = 8192, {"parquet.block.size": 1 << 21, "parquet.page.size.row.check.min": 8, "parquet.enable.dictionary": False}


def pieces(shard: int, arrays: dict[str, pa.Array], values: int = PIECE_VALUES) -> pa.RecordBatch:
    """A shard as rows (shard, piece, a slice of each array), so that no row is large; arrays that have ended are empty in later rows."""
    n = max(1, -(-max(map(len, arrays.values())) // values))
    cut = lambda x: pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(n + 1) * values, len(x)), pa.int32()), x)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n), pa.int32()), *map(cut, arrays.values())], ["shard", "piece", *arrays])


def whole(rows: pa.Table, *names: str) -> list[pa.Array]:
    """Arrays of a shard from its pieces, in whatever order these come."""
    rows = rows.sort_by("piece")
    return [rows.column(c).combine_chunks().flatten() for c in names]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Integer vectors have a square sum below this, so that inner products and squared distances fit 64 bits.
MOST_SQUARES = 1 << 60


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, vector array<int>, norm long (square sum): floor(scale * x) of each component x of `embedding`, as double.

    Vectors that are null or hold null or non-finite components are left out; one whose square sum reaches MOST_SQUARES raises.
    """
    out = pick(rows, vec_id="vec_id", v="embedding").select("vec_id", F.col("v").cast("array<double>").alias("v"))
    out = out.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    whole = F.transform("v", lambda x: F.floor(scale * x))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(scale * F.abs(x) + 1, F.lit(2)))
    fits = F.when(squares < float(MOST_SQUARES), whole).otherwise(F.raise_error(F.concat(F.lit("too large components in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    out = out.select("vec_id", fits.cast("array<int>").alias("vector"))
    return out.withColumn("norm", F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x))


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 0), kind)


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit integers: by doubles where each sum of absolute products stays below 2**53, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[-1]
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 1 << 53 else a @ b


def cleared(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose frames are gone; it does so when the driver has collected its garbage twice."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def bucket_of(column: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from a key."""
    return (F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values, so that near inputs give unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class WordIds:
    """64-bit ids of words by content; the cache is emptied when it is full, so memory stays bounded."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in set(words).difference(known):
                known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolling(ids: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of `width` ids, by doubling."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mask, out, done, power, block, size = (1 << 64) - 1, None, 0, base | 1, ids, 1
    left = width
    while left:
        if left & 1:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(power) + block[size:]
            size, power = size * 2, power * power & mask
    return mix(out)


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
PIECE = 1 << 22


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, where each begins and the last ends); a null text is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array, *, lower: bool, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit ids of words, bytes at which they begin and end, number of words of each text), for all texts at once.

    A word is a run of bytes outside `breaks` within one text; its id depends on its bytes (A-Z lower-cased on request).
    Bytes are looked at in pieces, so that the working memory is some times PIECE and 16 bytes for each word.
    """
    data, offsets = text_bytes(texts)
    n, at, ids, begins, ends = len(data), 0, [], [], []
    edges = np.unique(offsets)
    while at < n:
        end = n if n - at <= PIECE else at + PIECE
        if end < n:  # a piece ends where a text or a word does
            after = edges[np.searchsorted(edges, end)]
            space = np.flatnonzero(breaks[data[end : min(after, end + PIECE)]])
            while not len(space) and end + PIECE < after:
                end += PIECE
                space = np.flatnonzero(breaks[data[end : min(after, end + PIECE)]])
            end = end + int(space[0]) if len(space) else int(after)
        raw = data[at:end].tobytes()
        raw = np.frombuffer((raw.translate(LOWER) if lower else raw) + bytes(8), np.uint8)
        inside = ~breaks[raw[:-8]]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, end)] - at
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        begin = np.flatnonzero(first)
        after = np.flatnonzero(last) + 1
        ids.append(_hash(raw, begin, after - begin))
        begins.append(begin + at)
        ends.append(after + at)
        at = end
    begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends))
    return np.concatenate(ids) if ids else np.zeros(0, np.uint64), begin, end, np.diff(np.searchsorted(begin, offsets))


def _hash(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    lanes = np.lib.stride_tricks.as_strided(raw[:8].view(np.uint64), (len(raw) - 7,), (1,))
    out = mix(lanes[begin] & _LANE[np.minimum(size, 8)] ^ size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    long, step = np.flatnonzero(size > 8), 8
    while len(long):
        own = lanes[begin[long] + step] & _LANE[np.minimum(size[long] - step, 8)]
        out[long] = mix(out[long] * np.uint64(0xD1342543DE82EF95) + own)
        step += 8
        long = long[size[long] > step]
    return out


def small_batches(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = PIECE, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about most_bytes of text each, one row at least."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(sizes, done + most_bytes, "right"))), at + most_rows)
            yield batch.slice(at, end - at)
            at = end


def ordered(keys: np.ndarray) -> np.ndarray:
    """The stable order in which keys ascend. Sorts high bits with places below them; the few keys that differ in low bits only are sorted in full."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    order = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order = (order & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = keys[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(keys, kind="stable")


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, ascending; the number of each key among them)."""
    order = ordered(keys)
    keys = keys[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return keys[first], place
