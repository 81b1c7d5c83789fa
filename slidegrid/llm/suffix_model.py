"""Language-model scoring with a probabilistic suffix tree over words.

Training counts whole texts. Every string of up to `depth` words that occurs at least LEAST_STATE times is a candidate
context, and a next symbol counts after it if the two together occur at least LEAST_SYMBOL times. These are absolute
counts of 2, so a phrase is modelled alike in a small and in a large corpus, and the tree grows with it. The divergence
test keeps a symbol at a context if its probability there is at least RATIO times that after the next shorter context
and the counts gain at least GAIN nats; a context without kept symbols is no state of the tree.

The next-symbol distribution of a context s is smoothed with that of its longest proper suffix,
P(x | s) = (kept(s, x) + (n(s) - kept(s) + MU) P(x | suffix)) / (n(s) + MU), which sums to one; the empty context is the
base model. Scoring takes the longest suffix in the tree at every place.

Texts are coded once, in chunks of about CHUNK tokens, and the tree is counted level by level. For each level a chunk
sends its different strings, sorted by their 64-bit keys and cut at the borders of key ranges, with their counts; each
range adds up what all chunks send and answers each chunk with the totals, in the order asked. A string is in a chunk's
message once, so a frequent one is no hot key, and ranges are as large as chunks, whatever the size of the corpus. Longer strings
are sent only where both the words before the last and those after the first are frequent enough, which loses none; at
the last level, only where a symbol can still gain GAIN nats. kept(s) is added up in the same messages. Nothing of the
tree is broadcast, or comes to the driver.

Cases: a null text is empty and has the end token only; null ids are neither learnt from nor held out; repeated rows
count each; without training rows N and V are 0, the base probability is 1 and all scores are 0; an empty table gives no
rows; other columns, also of clashing names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleared, mix, numbered, pick, small_batches, stored, word_hashes

DEPTH, LEAST_STATE, LEAST_SYMBOL, RATIO, GAIN, MU, ALPHA = 3, 2, 2, 1.2, 3.0, 5.0, 0.1
CHUNK = 5 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
END = mix(np.array([0x656E64], np.uint64))[0]  # the id of the end token
CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes binary, words binary, codes binary"
SENT = "range int, chunk long, kind int, keys binary, counts binary"
ANSWERS = "chunk long, range int, kind int, totals binary, tokens long, words long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
MASS = 100  # kind k: strings of k words; kind MASS + k: kept(s) of contexts of k words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs."""
    wide = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    wide = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return wide.view("<u8").ravel()


def _planes(values: np.ndarray) -> bytes:
    """The same, with all low bytes first, compressed: most values are small."""
    data = packed(values)
    return data[:1] + len(values).to_bytes(8, "little") + pa.compress(np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0]).T.tobytes(), codec="zstd", asbytes=True)


def _of_planes(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    plain = np.frombuffer(pa.decompress(data[9:], width * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return unpacked(bytes([width]) + plain.reshape(width, n).T.tobytes())


def _coded(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """One row a chunk of texts: their ids and sizes in tokens, its different words, and tokens as numbers of words (frequent ones first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, size = TaskContext.get().partitionId() << 33, [], 0

        def chunk() -> pa.RecordBatch:
            ids, held = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
            sizes, tokens = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
            words, place = numbered(tokens)
            n = np.bincount(place)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return _batch(CHUNKS, [number], one(ids), one(held), [packed(sizes)], [packed(words[order])], [_planes(rank[place])])

        for batch in small_batches(batches, 1):
            ids, _, _, sizes = word_hashes(batch.column(1), lower=True)
            tokens = np.full(len(ids) + len(sizes), END, np.uint64)
            ends = np.cumsum(sizes + 1) - 1
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = ids
            parts.append((batch.column(0), batch.column(2), sizes + 1, tokens))
            size += len(tokens)
            if size >= chunk_tokens:
                yield chunk()
                number, parts, size = number + 1, [], 0
        if parts:
            yield chunk()

    return stored(docs.mapInArrow(run, CHUNKS))


def _followed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The keys of contexts, each with a word after it."""
    return context * BASE + word


class Strings:
    """Different strings that end at some tokens: keys ascending, and the number of the string at each of the tokens."""

    def __init__(self, keys: np.ndarray, place: np.ndarray, at: np.ndarray, n: int):
        self.keys, self.at, self.place, self.n = keys, at, place, n

    @staticmethod
    def at_tokens(gram: np.ndarray, at: np.ndarray) -> "Strings":
        return Strings(*numbered(gram[at]), at, len(gram))

    def before(self, at: np.ndarray) -> "Strings":
        """Those of these strings that end right before some tokens, as the strings of these tokens."""
        number = np.zeros(self.n, np.int32)
        number[self.at] = self.place
        place = number[at - 1]
        used = np.zeros(len(self.keys), bool)
        used[place] = True
        return Strings(self.keys[used], (np.cumsum(used) - 1)[place], at, self.n)

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """How many of each string's places are marked; marks by token."""
        return np.bincount(self.place[marks[self.at]], minlength=len(self.keys))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values by string to tokens, 0 elsewhere."""
        out = np.zeros(self.n, np.int64)
        out[self.at] = values[self.place] if len(values) else 0
        return out


class Chunk:
    """A chunk with what the ranges have answered: at each token the totals of the strings that end there, and P so far."""

    def __init__(self, row: dict, answers: dict[int, np.ndarray], total: int, distinct: int, depth: int):
        self.ids, self.held = row["ids"], row["held"]
        self.sizes = unpacked(row["sizes"]).astype(np.int64)
        words, codes = unpacked(row["words"]), _of_planes(row["codes"]).astype(np.int64)
        tokens = words[codes]
        self.n, self.depth = len(tokens), depth
        self.first = np.cumsum(self.sizes) - self.sizes
        self.offset = np.arange(self.n) - np.repeat(self.first, self.sizes)
        each = ~np.fromiter((h is None for h in self.ids), bool, len(self.ids)) & ~np.array(self.held, bool)
        self.learnt = np.repeat(each, self.sizes)
        self.grams = [tokens]
        keys, rank = numbered(words)
        strings = Strings(keys, rank[codes], np.arange(self.n), self.n)
        self.to_send: list[tuple[int, np.ndarray, np.ndarray]] = []
        if not answers:
            self._send_strings(0, strings)
            self._send_strings(1, self._longer(np.flatnonzero(self.offset >= 1)))
            return
        whole = total + ALPHA * (distinct + 1)
        self.counts = [strings.spread(answers[1])]
        self.p = (self.counts[0] + ALPHA) / whole
        self.base = self.p.copy()
        for k in range(1, depth + 1):
            # level k: contexts of k words, counts[k - 1] at the place before; symbols are strings of k + 1 words
            shorter, strings = strings, self._longer(np.flatnonzero(self.offset >= 1)) if k == 1 else self._candidates(k)
            self.counts.append(strings.spread(answers[k + 1]))
            at = np.flatnonzero(self.offset >= k)
            at = at[self.counts[k - 1][at - 1] >= LEAST_STATE]
            of, n = self.counts[k - 1][at - 1], self.counts[k][at]
            kept = diverges(n, of, self.p[at])
            contexts = shorter.before(at)
            if k == depth - 1:
                self.floor = self.p.copy()  # of P at this level: kept(s) is n(s) at most
                self.floor[at] = (np.where(kept, n, 0) + MU * self.p[at]) / (of + MU)
            if MASS + k not in answers:
                marks = np.zeros(self.n, bool)
                marks[at] = kept & self.learnt[at]
                self.to_send.append((MASS + k, contexts.keys, contexts.sums(marks)))
                if k < depth:
                    self._send_strings(k + 1, self._candidates(k + 1))
                return
            mass = contexts.spread(answers[MASS + k])[at]
            back = np.where(mass > 0, (of - mass + MU) / (of + MU), 1.0)
            self.p[at] = np.where(kept, n / (of + MU), 0.0) + back * self.p[at]

    def _gram(self, k: int) -> np.ndarray:
        """Keys of the k + 1 words that end at each token, sound where offset >= k."""
        while len(self.grams) <= k:
            self.grams.append(_followed(np.append(np.uint64(0), self.grams[-1][:-1]), self.grams[0]))
        return self.grams[k]

    def _longer(self, at: np.ndarray) -> Strings:
        return Strings.at_tokens(self._gram(1), at)

    def _candidates(self, k: int) -> Strings:
        """Strings of k + 1 words whose first k and last k words are frequent enough."""
        last = self.counts[k - 1]
        at = np.flatnonzero((self.offset >= k) & (last >= LEAST_SYMBOL))
        at = at[last[at - 1] >= LEAST_STATE]
        if k == self.depth > 1:  # no longer one needs them: those that can't pass the test are left out
            at = at[gain(last[at], 1.0, self.floor[at]) >= GAIN]
        return Strings.at_tokens(self._gram(k), at)

    def _send_strings(self, k: int, strings: Strings) -> None:
        self.to_send.append((k + 1, strings.keys, strings.sums(self.learnt)))


def gain(n: np.ndarray, here, shorter: np.ndarray) -> np.ndarray:
    return n * np.log(here / shorter)


def diverges(n: np.ndarray, of: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The divergence test for symbols that occur n times after a context that occurs `of` times."""
    here = np.maximum(n, 1) / of
    return (n >= LEAST_SYMBOL) & (here >= RATIO * shorter) & (gain(n, here, shorter) >= GAIN)


def _starts(ranges: int) -> np.ndarray:
    """The smallest key of each range of keys."""
    return np.array([-(-(k << 32) // ranges) << 32 for k in range(ranges)], np.uint64)


def _messages(number: int, kind: int, keys: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
    cuts = np.append(np.searchsorted(keys, starts), len(keys))
    for k in np.flatnonzero(np.diff(cuts)):
        own = keys[cuts[k] : cuts[k + 1]]
        yield int(k), number, kind, packed(np.diff(own, prepend=starts[k])), _planes(counts[cuts[k] : cuts[k + 1]])


def _answered(starts: np.ndarray):
    """For one range: the totals of what all chunks have sent, for each message in its order."""

    def run(key: tuple, sent: pa.Table) -> pa.Table:
        start, out = starts[key[0].as_py()], []
        rows = list(zip(*(sent.column(name).to_pylist() for name in ("chunk", "kind")), sent.column("keys"), sent.column("counts"), strict=True))
        for kind in sorted({r[1] for r in rows}):
            own = [r for r in rows if r[1] == kind]
            parts = [start + np.cumsum(unpacked(memoryview(r[2].as_buffer())), dtype=np.uint64) for r in own]
            keys, place = numbered(np.concatenate(parts))
            totals = np.bincount(place, np.concatenate([_of_planes(r[3].as_py()) for r in own]), len(keys)).astype(np.int64)
            tokens, words = (int(totals.sum()), int((totals > 0).sum())) if kind == 1 else (0, 0)
            if 1 < kind < MASS:
                totals[totals < min(LEAST_STATE, LEAST_SYMBOL)] = 0
            for r, part in zip(own, np.split(totals[place], np.cumsum([len(p) for p in parts])[:-1]), strict=True):
                out.append((r[0], key[0].as_py(), kind, _planes(part), tokens, words))
                tokens = words = 0
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in ANSWERS.split(", ")])

    return run


def _row(table: pa.Table) -> dict:
    return {name: table.column(name)[0].as_py() for name in table.column_names}


def _answers(table: pa.Table) -> dict[int, np.ndarray]:
    """kind -> totals in the order of the chunk's keys."""
    rows = sorted(zip(*(table.column(name).to_pylist() for name in ("kind", "range", "totals")), strict=True))
    return {kind: np.concatenate([_of_planes(r[2]) for r in rows if r[0] == kind]).astype(np.int64) for kind in {r[0] for r in rows}}


class _Filled(dict):
    """Answers to what was sent; a kind of which a chunk had nothing to send was answered with nothing."""

    def __init__(self, found: dict[int, np.ndarray], asked: set[int]):
        super().__init__({kind: np.zeros(0, np.int64) for kind in asked} | found)


def _asked(level: int) -> set[int]:
    """Kinds that have been sent in the first `level` rounds."""
    return {*range(1, level + 2)} | {MASS + k for k in range(1, level)} if level else set()


def _sender(starts: np.ndarray, level: int, total: int, distinct: int, depth: int):
    """Functions for the first round, on batches of chunks, and for later ones, on a chunk and its answers."""

    def send(row: dict, known: dict[int, np.ndarray]) -> pa.Table:
        out = [m for kind, keys, counts in Chunk(row, known, total, distinct, depth).to_send for m in _messages(row["chunk"], kind, keys, counts, starts)]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], [x.split()[0] for x in SENT.split(", ")])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from send(_row(pa.Table.from_batches([batch.slice(k, 1)])), {}).to_batches()

    def later(left: pa.Table, right: pa.Table) -> pa.Table:
        return send(_row(left), _Filled(_answers(right), _asked(level)))

    return first, later


def counted(chunks: DataFrame, *, depth: int = DEPTH) -> tuple[DataFrame, int, int]:
    """(ANSWERS of all levels, N, V): what the corpus says of the strings of each chunk."""
    starts, answers, total, distinct = _starts(max(1, chunks.count())), None, 0, 0
    for level in range(depth + 1):
        first, later = _sender(starts, level, total, distinct, depth)
        sent = chunks.mapInArrow(first, SENT) if answers is None else chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(later, SENT)
        found = stored(sent.groupBy("range").applyInArrow(_answered(starts), ANSWERS))
        cleared(chunks.sparkSession)
        if answers is None:
            total, distinct = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        answers = found if answers is None else answers.unionByName(found)
    return answers, total, distinct


def score_corpus(docs: DataFrame, *, depth: int = DEPTH, chunk_tokens: int = CHUNK) -> DataFrame:
    """SCORED: learn from the rows that aren't held out and score all rows."""
    rows = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    chunks = _coded(rows, chunk_tokens)
    answers, total, distinct = counted(chunks, depth=depth)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = Chunk(_row(left), _Filled(_answers(right), _asked(depth + 1)), total, distinct, depth)
        sums = lambda x: np.add.reduceat(x, chunk.first)
        known = sums((chunk.counts[0] > 0).astype(np.int64))
        return pa.Table.from_batches([_batch(SCORED, pa.array(chunk.ids, pa.int64()), pa.array(chunk.held, pa.bool_()), chunk.sizes, known, np.full(len(chunk.sizes), total), sums(np.log10(chunk.base)), sums(np.log10(chunk.p)))])

    return chunks.groupBy("chunk").cogroup(answers.select("chunk", "range", "kind", "totals").groupBy("chunk")).applyInArrow(run, SCORED)
