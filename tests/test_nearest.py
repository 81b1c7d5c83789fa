import numpy as np
import pytest

from slidegrid.operators.nearest import knn


def brute(patches, seeds, k):
    out = []
    for sample, seed, sx, sy in seeds:
        if sx is None or sy is None or not np.isfinite(sx) or not np.isfinite(sy):
            continue
        own = sorted(((x - sx) * (x - sx) + (y - sy) * (y - sy), q) for s, q, x, y in patches if s == sample and x is not None and np.isfinite(x))[:k]
        out += [(sample, seed, q, d, r + 1) for r, (d, q) in enumerate(own)]
    return sorted(out, key=str)


def found(spark, patches, seeds, k, **options):
    p = spark.createDataFrame(patches, "sample_id string, seq int, x double, y double")
    s = spark.createDataFrame(seeds, "sample_id string, seed string, seed_x double, seed_y double")
    return sorted([(r["sample_id"], r["seed"], r["seq"], r["d2"], r["rank"]) for r in knn(p, s, k, **options).collect()], key=str)


@pytest.mark.parametrize("options", [{}, {"leaf": 3, "depth": 4}])
def test_sparse_samples_ties_and_odd_rows(spark, options):
    patches = [("a", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 1), (1.9, 1.9), (0.5, -1.2), (30, 0), (200, 200), (-7.5, 3)])]
    patches += [("b", 0, 5.0, 5.0), ("c", 0, 0.0, 0.0), ("c", 1, None, 1.0), ("c", 2, float("nan"), 1.0)]
    patches += [("grid", 10 * i + j, float(i), float(j)) for i in range(10) for j in range(10)] + [("same", i, 4.0, -4.0) for i in range(300)]
    seeds = [("a", "in", 0.1, 0.1), ("a", "rim", 12.0, 0.0), ("a", "far", 900.0, 900.0), ("a", "very far", 1e7, -3e6), ("a", None, 1.0, 1.0), ("b", "few", 5.0, 5.0), ("c", "one", 1.0, 1.0), ("d", "none", 0.0, 0.0)]
    seeds += [("grid", "mid", 4.5, 4.5), ("grid", "on", 3.0, 7.0), ("same", "at", 4.0, -4.0), ("same", "off", 90.0, 0.0), ("a", "null", None, 1.0), ("a", "nan", float("nan"), 1.0)]
    assert found(spark, patches, seeds, 3, **options) == brute(patches, seeds, 3)


def clustered(rng):
    """Two dense clusters and single patches in a void, and a second sample that is even."""
    xy = np.concatenate([rng.normal(size=(2500, 2)), rng.normal(size=(2500, 2)) * 0.1 + 1000, rng.uniform(-400, 1400, size=(40, 2))])
    return [("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("t", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 50, size=(2000, 2)))]


def test_clusters_are_exact_and_no_seed_meets_its_sample(spark):
    rng, tally = np.random.default_rng(6), []
    patches = clustered(rng)
    seeds = [("s", f"v{i}", *map(float, rng.uniform(-500, 1500, size=2))) for i in range(40)] + [("s", f"c{i}", float(x), float(y)) for i, (_, _, x, y) in enumerate(patches[:5000:250])] + [("t", f"u{i}", *map(float, rng.uniform(-5, 55, size=2))) for i in range(40)]
    assert found(spark, patches, seeds, 8, tally=tally) == brute(patches, seeds, 8)
    print("patches met by a seed", tally[0] / len(seeds))
    assert tally[0] < 500 * len(seeds)


def test_empty(spark):
    assert found(spark, [], [("a", "x", 1.0, 1.0)], 3) == found(spark, [("a", 1, 1.0, 1.0)], [], 3) == []
