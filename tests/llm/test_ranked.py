import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from slidegrid.llm import ranked


def terms(text):
    return [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, nearest):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length, df = len(bags), sum(x for *_, x in bags), Counter(w for _, b, _ in bags for w in b)
    least = {}
    for i, t in items:
        if t is not None:
            least[i] = min(t, least.get(i, t), key=lambda x: x.encode())
    out = []
    for item, text in least.items():
        found = []
        for i, b, size in bags:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 12 * m)) for w in terms(text) if b[w])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:nearest])]
    return sorted(out, key=str)


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    words = ["the", "OF", "été", "Über", "x9", *[f"w{k}" for k in range(60)]]
    text = lambda k: " ".join(rng.choices(words, weights=[40, 30, 8, 3, 2, *[2 / (k + 1) for k in range(60)]], k=k))
    docs = [(i, text(rng.randrange(1, 80))) for i in range(n)]
    docs += [(i, "the same words, again") for i in range(n, n + 90)]  # ties
    docs += [(900, None), (901, ""), (902, "...!?"), (None, "w1 the"), (None, None), docs[5], docs[5], (903, "w3-w4 " + "the OF w2 " * 20_000)]
    items = [(i, text(12)) for i in range(25)] + [(50, "the"), (51, "same words same words"), (52, None), (53, ""), (54, "nowhere to be-found"), (None, "x9 été"), (7, "w5 the"), (7, "w5 the"), (55, "w7 " * 4000 + text(300))]
    return docs, items


@pytest.mark.parametrize("shard_words", [1_000_000, 900])
@pytest.mark.parametrize("block", [4096, 7])
def test_equals_brute_force(spark, monkeypatch, shard_words, block):
    monkeypatch.setattr(ranked, "ITEMS", block)
    docs, items = corpus()
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, Shard string").repartition(3)
    b = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, doc_id int")
    got = ranked.rank(d, b, shard_words=shard_words)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 20)


def test_stops_before_the_ends_of_the_lists():
    rng, many = np.random.default_rng(1), 20_000
    sizes = rng.integers(20, 400, size=many)
    docs = [np.flatnonzero(rng.random(many) < p) for p in (0.9, 0.5, 0.02, 0.01)]
    times = [rng.geometric(0.4, size=len(d)) for d in docs]
    shard = ranked.Shard(sizes, np.arange(4), np.array([len(d) for d in docs]), np.concatenate(docs), np.concatenate(times), many, int(sizes.sum()))
    asked, tally = [(0, 50), (1, 400), (2, 3000), (3, 4000)], []
    found, scores = ranked.best_positions(shard, asked, 20, tally)
    whole = np.zeros(many, np.int64)
    for (term, weight), d in zip(asked, docs, strict=True):
        whole[d] += weight * shard.list_of(term)[1]
    kth = np.sort(whole)[-20]
    assert sorted(found) == np.flatnonzero(whole >= kth).tolist() and (whole[found] == scores).all()
    assert tally[0][0] < 0.5 * tally[0][1]


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some_d, some_b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b a a")], "item_id long, text string")
    assert ranked.rank(none_d, some_b).count() == ranked.rank(some_d, none_b).count() == ranked.rank(none_d, none_b).count() == 0
    assert ranked.rank(some_d, some_b).count() == 1


def test_rows_and_row_groups_of_the_index_are_small(spark):
    """A reader holds a row group at once, and a shuffle or a group whole rows, however much a task has read."""
    docs = [(i, f"d{i} the") for i in range(20_000)] + [(30_000 + k, " ".join(f"w{(i * (k + 1)) % 20_011} x{k}" for i in range(20_000))) for k in range(30)]
    items = [(1, "w5 w19 x3 x4"), (2, "the d19999"), (3, "d7 x29 the"), (4, "nowhere")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    index = ranked.build_index(d)
    longest = index.selectExpr(*[f"max(size({c})) as {c}" for c, kind in index.dtypes if kind.startswith("array")]).first()
    assert max(longest) <= 8192 and index.select("shard").distinct().count() > 1
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(m.row_group(k).total_byte_size for m in groups for k in range(m.num_row_groups)) < 6 << 20
    assert sorted(map(tuple, ranked.rank(d, b).collect()), key=str) == brute(docs, items, 20)
