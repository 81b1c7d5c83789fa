import hashlib

import numpy as np
import pytest

from slidegrid.llm import centroids

WIDE = "vec_id long, embedding array<double>, cluster string, Distance int, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], WIDE)


def brute(rows, components, count, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda k: (far(v, centres[k]), k)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for k in range(len(centres)):
            if members := [v for (_, v), c in zip(kept, own, strict=True) if c == k]:
                centres[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = assign()
    ds = [far(v, centres[c]) for (_, v), c in zip(kept, own, strict=True)]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, c, d, sum(x for x, y in zip(ds, own, strict=True) if y == c), sum(ds), names[c]) for (i, _), c, d in zip(kept, own, ds, strict=True)], key=str)


def odd_rows(seed=3, n=300, components=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, components)) + 3 * rng.integers(0, 5, size=(n, 1))
    x[50:150] = x[50]  # a common vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [1.0] * (components - 1)), (903, [None] + [1.0] * (components - 1)), (904, [float("nan")] * components), (905, [float("inf")] * components)]
    return rows + [(None, [0.5] * components), rows[3], rows[3], (7, [-9.25] * components), (906, [0.0] * components)]


@pytest.mark.parametrize("count", [6, 40, 1000])
def test_equals_brute_force(spark, count):
    rows, seen = odd_rows(), []
    got = centroids.cluster(frame(spark, rows), components=8, centroids=count, each_round=seen)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 8, count, 5)
    assert 1 <= len(seen) <= 5


def test_increments_equal_whole_products(spark):
    from slidegrid.llm.common import integer_vectors, matrix

    rng = np.random.default_rng(5)
    vectors = integer_vectors(frame(spark, odd_rows(4)), 256).where("size(vector) = 8")
    before = rng.integers(-900, 900, size=(5, 8))
    after = before.copy()
    after[1, [0, 3]] += 7
    after[4] -= 11
    state = centroids.moved(centroids.measured(vectors, before), before, after).toArrow()
    assert (matrix(state["products"]) == matrix(state["vector"]) @ after.T).all()


def test_large_components_are_exact_and_too_large_ones_raise(spark):
    rows = [(i, [float(2**16 * (i + 1)), -float(2**16 + i)]) for i in range(30)]
    got = centroids.cluster(frame(spark, rows), components=2, centroids=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2, 4, 5)
    with pytest.raises(Exception, match="too large components in vector 7"):
        centroids.cluster(frame(spark, [(7, [1e300, 1.0])]), components=2).collect()


def test_empty(spark):
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        out = centroids.cluster(frame(spark, rows), components=2)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
