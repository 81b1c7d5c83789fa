"""Regression forests and boosted trees for all targets at once, grown level by level.

A level is one job whatever the number of targets. Tasks sum up weights and residuals by (tree, target, node, feature,
bin) over pieces of their rows; the sums are added up by key and turned into the best split of each node where they
meet. Only the splits come to the driver, a row for each node. Features are cut at approximate quantiles (BINS) and kept
as one byte each. A row's weight in a tree follows a hash of the row, and the features a node may use follow the seed, so
the result does not depend on partitions.

What a level sends is pieces x trees x targets x nodes x features x BINS sums: `at_once` trees of a forest grow together.
The model that tasks get has targets x trees x 2^depth splits; one of over MOST_BYTES raises.

Cases: rows without features take no part; a null target leaves its row out for that target only; a null or NaN feature
goes left; a target without any value predicts 0; rows equal in features, targets and key are drawn together; an empty
table raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

BINS, PIECE, ROWS, BLOCK, KEEP, MOST_BYTES = 32, 16384, 262144, 64, 10, 1 << 30
_SUMS = "tree int, target int, node int, block int, sums binary"
_SPLIT = "gain double, feature int, bin int, n double, s double, left_n double, left_s double"


@dataclass(frozen=True)
class Growth:
    """How trees grow. rate None: a forest whose trees are averaged; else boosting, a tree a round, shrunk by the rate."""

    trees: int = 70
    depth: int = 8
    rate: float | None = None
    features: float = 1 / 3  # share of the features a node (forest) or tree (boosting) may use
    rows: float | None = None  # share of the rows a tree takes; None draws with repetition
    ridge: float = 0.0  # added to a node's weight in its value and gain
    least: float = 1.0  # weight a child must have
    at_once: int = 10
    seed: int = 1


FOREST = Growth()
BOOSTED = Growth(trees=100, depth=3, rate=0.1, features=0.8, rows=0.8, ridge=1.0)


@dataclass
class Trees:
    """Splits of complete binary trees in heap order: feature, cut (trees x targets x inner nodes) and leaf values; feature -1 is no split."""

    start: np.ndarray
    rate: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def place(self, x: np.ndarray, tree: int, levels: int | None = None) -> np.ndarray:
        """The heap number, for each row and target, of the node after so many levels."""
        feature, cut = self.feature[tree], self.cut[tree]
        rows, targets = np.arange(len(x))[:, None], np.arange(feature.shape[0])
        at = np.zeros((len(x), feature.shape[0]), np.int64)
        for _ in range((feature.shape[1] + 1).bit_length() - 1 if levels is None else levels):
            f = feature[targets, at]
            at = 2 * at + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[targets, at]))
        return at

    def added(self, x: np.ndarray, trees: range) -> np.ndarray:
        out = np.zeros((len(x), len(self.start)))
        targets, inner = np.arange(len(self.start)), self.feature.shape[2]
        for t in trees:
            out += self.rate * self.value[t][targets, self.place(x, t) - inner]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.added(x, range(len(self.feature)))


def cuts_of(rows: DataFrame, x: str, bins: int = BINS) -> np.ndarray:
    """features x (bins - 1) ascending cuts; those beyond a feature's distinct ones are infinite."""
    value = F.col("value").cast("double")
    found = rows.select(F.posexplode(x).alias("feature", "value")).groupBy("feature").agg(F.percentile_approx(F.when(~F.isnan(value), value), [k / bins for k in range(1, bins)]).alias("cuts")).collect()  # a row for each feature
    out = np.full((len(found), bins - 1), np.inf)
    for feature, cuts in found:
        own = np.unique(cuts or [])
        out[feature, : len(own)] = own
    return out


def codes_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    codes = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(len(cuts))], 1)
    return np.where(np.isnan(x), 0, codes).astype(np.uint8)


def _coded(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                codes = codes_of(np.array(frame["x"].tolist(), float), cuts)
                yield pd.DataFrame({"codes": [c.tobytes() for c in codes], "y": frame["y"], "fit": [[]] * len(frame), "mark": frame["mark"]})

    return rows.mapInPandas(run, "codes binary, y array<double>, fit array<double>, mark long")


def _read(frame: pd.DataFrame, model: Trees, fitted: int, done: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, fit of the first `done` trees) of coded rows; the column fit holds that of the first `fitted`."""
    codes = np.frombuffer(b"".join(frame["codes"]), np.uint8).reshape(len(frame), -1)
    fit = np.array(frame["fit"].tolist()) if fitted else np.tile(model.start, (len(frame), 1))
    return codes, fit + model.added(codes, range(fitted, done)) if done > fitted else fit


def drawn(mark: np.ndarray, tree: int, growth: Growth) -> np.ndarray:
    """Weights of rows in a tree, by a mixed hash of the row's mark."""
    z = mark.astype(np.int64).view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (tree + 1) + growth.seed) % 2**64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    if growth.rows is not None:
        return (u < growth.rows).astype(float)
    poisson = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(poisson, u).astype(float)


def usable(tree: int, node: int, p: int, growth: Growth) -> np.ndarray:
    """The features that a node may use: its own in a forest, its tree's in boosting."""
    most = max(1, round(growth.features * p))
    key = [growth.seed, tree, node if growth.rate is None else 0]
    return np.sort(np.random.default_rng(key).permutation(p)[:most])


def _sums(rows: DataFrame, sent, level: int, growing: range, growth: Growth) -> DataFrame:
    first, last = 2**level - 1, 2 ** (level + 1) - 1

    def of_rows(frames: list[pd.DataFrame], model: Trees, fitted: int) -> Iterator[pd.DataFrame]:
        frame = pd.concat(frames, ignore_index=True)
        codes, fit = _read(frame, model, fitted, growing[0] if growth.rate is not None else 0)
        residual, mark = np.array(frame["y"].tolist(), float) - fit, frame["mark"].to_numpy()
        p = codes.shape[1]
        for tree in growing:
            at, weight = model.place(codes, tree, level), drawn(mark, tree, growth)
            features = np.stack([usable(tree, node, p, growth) for node in range(first, last)])
            m = features.shape[1]
            for target in range(residual.shape[1]):
                is_open = np.array([node == 0 or model.feature[tree, target, (node - 1) // 2] >= 0 for node in range(first, last)])
                own, r = at[:, target] - first, residual[:, target]
                take = np.flatnonzero((weight > 0) & np.isfinite(r) & is_open[own])
                total = np.zeros(((last - first) * m * BINS, 2))
                for k in range(0, len(take), PIECE):
                    some = take[k : k + PIECE]
                    cell = ((own[some, None] * m + np.arange(m)) * BINS + np.take_along_axis(codes[some], features[own[some]], 1)).ravel()
                    for column, v in enumerate((weight[some], weight[some] * r[some])):
                        total[:, column] += np.bincount(cell, np.repeat(v, m), len(total))
                total = total.reshape(last - first, m, BINS, 2)
                held = np.flatnonzero(total[:, 0, :, 0].sum(1))
                blocks = range(0, m, BLOCK)
                yield pd.DataFrame({"tree": tree, "target": target, "node": np.repeat(held + first, len(blocks)), "block": np.tile(np.arange(len(blocks)), len(held)), "sums": [total[h, b : b + BLOCK].tobytes() for h in held for b in blocks]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, fitted = sent.value
        held, n = [], 0
        for frame in frames:
            if len(frame):
                held.append(frame)
                n += len(frame)
            if n >= ROWS:
                yield from of_rows(held, model, fitted)
                held, n = [], 0
        if held:
            yield from of_rows(held, model, fitted)

    return rows.mapInPandas(run, _SUMS)


def best_split(total: np.ndarray, features: np.ndarray, growth: Growth) -> tuple:
    """_SPLIT's values from sums (features x bins x 2): the first of the best; feature -1 if none is better than no split."""
    left = np.cumsum(total, 1)
    whole = left[:, -1:]
    right = whole - left
    of = lambda v: v[..., 1] ** 2 / np.maximum(v[..., 0] + growth.ridge, 1e-300)
    gain = of(left) + of(right) - of(whole)
    gain[(left[..., 0] < growth.least) | (right[..., 0] < growth.least)] = -np.inf
    k = int(gain.argmax())
    f, b = divmod(k, total.shape[1])
    n, s = whole[0, 0]
    if not gain[f, b] > 1e-10 * of(whole)[f, 0]:
        return (0.0, -1, 0, n, s, 0.0, 0.0)
    return (gain[f, b], int(features[f]), b, n, s, *left[f, b])


def _splits(sums: DataFrame, p: int, growth: Growth) -> DataFrame:
    """tree, target, node and _SPLIT: sums of a key stand together, so one of them is held at a time."""
    keys = ["tree", "target", "node", "block"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None

        def closed() -> tuple:
            tree, _, node, block = key
            features = usable(tree, node, p, growth)[block * BLOCK : (block + 1) * BLOCK]
            return (*key[:3], *best_split(total.reshape(len(features), BINS, 2), features, growth))

        for frame in frames:
            out = []
            for *own, raw in zip(*(frame[c] for c in keys), frame["sums"], strict=True):
                part = np.frombuffer(raw)
                if own == key:
                    total = total + part
                else:
                    if key is not None:
                        out.append(closed())
                    key, total = own, part
            yield pd.DataFrame(out, columns=_names)
        if key is not None:
            yield pd.DataFrame([closed()], columns=_names)

    schema = "tree int, target int, node int, " + _SPLIT
    _names = [c.split()[0] for c in schema.split(", ")]
    found = sums.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)
    best = F.max_by(F.struct(*_names[3:]), F.struct("gain", -F.col("feature")))
    return found.groupBy(*keys[:3]).agg(best.alias("best")).select(*keys[:3], "best.*")


def fit(train: DataFrame, growth: Growth = FOREST, *, x: str = "features", y: str = "targets", key: tuple[str, ...] = ()) -> Trees:
    """Trees for every position of the array y, from the array x. Columns `key` tell rows apart that are else equal."""
    spark = train.sparkSession
    rows = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"), F.xxhash64(*key, x, y).alias("mark"))
    cuts = cuts_of(rows, "x")
    value = F.when(~F.isnan("value"), F.col("value"))
    means = rows.select(F.posexplode("y").alias("target", "value")).groupBy("target").agg(F.avg(value)).collect()  # a row for each target
    if not means:
        raise ValueError("no training rows")
    p, targets, inner = len(cuts), len(means), 2**growth.depth - 1
    size = growth.trees * targets * (inner * 16 + (inner + 1) * 8)
    if size > MOST_BYTES:
        raise ValueError(f"{targets} targets need a model of {size} bytes: fit fewer at a time")
    start = np.zeros(targets)
    for target, mean in means:
        start[target] = mean or 0.0
    shape = (growth.trees, targets)
    model = Trees(start, growth.rate or 1 / growth.trees, np.full((*shape, inner), -1), np.zeros((*shape, inner)), np.zeros((*shape, inner + 1)))
    coded, fitted = stored(_coded(rows, cuts)), 0
    step = 1 if growth.rate is not None else growth.at_once
    for begin in range(0, growth.trees, step):
        growing = range(begin, min(begin + step, growth.trees))
        if growth.rate is not None and begin - fitted >= KEEP:  # what the last trees add is written, not computed again and again
            coded, fitted = stored(_refitted(coded, model, fitted, begin)), begin
        heap = np.full((len(growing), targets, 2 * inner + 1), np.nan)
        for level in range(growth.depth):
            sent = spark.sparkContext.broadcast((model, fitted))
            found = _splits(_sums(coded, sent, level, growing, growth), p, growth).collect()  # a row for each node of the level
            sent.destroy()
            for r in found:
                own, node = heap[r["tree"] - begin, r["target"]], r["node"]
                own[node] = r["s"] / max(r["n"] + growth.ridge, 1e-300)
                if r["feature"] >= 0:
                    model.feature[r["tree"], r["target"], node], model.cut[r["tree"], r["target"], node] = r["feature"], r["bin"]
                    own[2 * node + 1] = r["left_s"] / (r["left_n"] + growth.ridge)
                    own[2 * node + 2] = (r["s"] - r["left_s"]) / (r["n"] - r["left_n"] + growth.ridge)
            if not any(r["feature"] >= 0 for r in found):
                break
        heap[:, :, 0] = np.nan_to_num(heap[:, :, 0])
        for node in range(1, 2 * inner + 1):
            up = heap[:, :, (node - 1) // 2]
            heap[:, :, node] = np.where(np.isnan(heap[:, :, node]), up, heap[:, :, node])
        model.value[growing[0] : growing[-1] + 1] = heap[:, :, inner:]
    real = np.where(model.feature >= 0, cuts[np.maximum(model.feature, 0), model.cut.astype(int)], np.inf)
    return Trees(start, model.rate, model.feature, real, model.value)


def _refitted(coded: DataFrame, model: Trees, fitted: int, done: int) -> DataFrame:
    sent = coded.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                _, fit = _read(frame, sent.value, fitted, done)
                yield frame.assign(fit=list(fit))

    return coded.mapInPandas(run, coded.schema)
