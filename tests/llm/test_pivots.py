import numpy as np
import pytest

from slidegrid.llm import pivots

WIDE = "vec_id long, embedding array<double>, key string, Score int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], WIDE)


def brute(rows, nearest=20):
    known = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(64 * x)) for x in v]
            known[i] = min(whole, known.get(i, whole))
    out = []
    for q, v in known.items():
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:nearest])]
    return sorted(out)


def vectors(n, size, seed=1):
    """Clusters of vectors of very different lengths, with one common vector and many equal scores."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, size))[np.arange(n) % 20] + 0.2 * rng.normal(size=(n, size))
    x *= rng.lognormal(sigma=1, size=(n, 1))
    x[n // 4 : n // 2] = x[n // 4]
    x[-50:] = np.round(x[-50:])
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("options", [{}, {"block": 50, "group": 7, "pivots": 5, "first": 1}, {"block": 3, "group": 2, "pivots": 1}])
def test_equals_brute_force(spark, options):
    rows = vectors(420, 6)
    rows += [(2000, None), (2020, []), (2021, []), (2040, [0.0] * 6), (2060, [float("nan")] * 6), (2080, [None] * 6), (None, [1.0] * 6), rows[3], (20, [9.0] * 6), (-40, [1.0] * 6)]
    rows += [(3000 + i, [float(i), -1.0, 2.0]) for i in range(30)] + [(4000, [1.0] * 9)]
    got = pivots.nearest_exact(frame(spark, rows), **options)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_small_chunks_of_bounds(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CHUNK", 4)
    monkeypatch.setattr(pivots, "GROUP", 5)
    rows = vectors(300, 4, 9)
    assert sorted(map(tuple, pivots.nearest_exact(frame(spark, rows), block=9, group=5).collect())) == brute(rows)


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(3)
    y = np.floor(64 * (rng.normal(size=(40, 16))[np.arange(4000) % 40] + 0.05 * rng.normal(size=(4000, 16)))).astype(np.int64)
    q, chosen = y[17], [np.zeros(16, np.int64), *y[:31]]
    far = lambda v: np.sqrt(((v[..., None, :] - np.array(chosen)) ** 2).sum(-1).astype(float))
    bound = pivots.upper(np.int64((q * q).sum()), (y * y).sum(1), np.abs(far(y) - far(q)).max(1))
    scores = y @ q
    assert (bound >= scores).all()
    rows, found, looked = pivots.eliminate(q, y, bound, 21, float("-inf"))
    kth = np.sort(scores)[-21]
    assert sorted(rows) == np.flatnonzero(scores >= kth).tolist() and (scores[rows] == found).all()
    assert looked < 0.1 * len(y)


@pytest.mark.parametrize("clusters", [0, 40])
def test_weak_bounds_give_way_to_one_product(monkeypatch, clusters):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(clusters, 32))[np.arange(3000) % clusters] + 0.02 * rng.normal(size=(3000, 32)) if clusters else rng.normal(size=(3000, 32))
    y = np.floor(64 * y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.int64)
    x, chosen = y[:200], y[-32:]
    far = lambda v: np.sqrt(((v[:, None] - chosen) ** 2).sum(-1).astype(float))
    norm, products, floors = (y * y).sum(1), [], np.full(200, -np.inf)
    floors[::2] = np.sort(x @ y.T, 1)[::2, -30]
    monkeypatch.setattr(pivots, "exact_product", lambda a, b, own=pivots.exact_product: (products.append(1), own(a, b))[1])
    got = {int(i): (sorted(row), sorted(score)) for i, row, score in pivots.reaching(x, y, norm[:200], norm, far(x), np.ascontiguousarray(far(y).T), floors, 21)}
    for i, scores in enumerate(x @ y.T):
        want = np.flatnonzero(scores >= np.sort(scores)[-21])
        assert got[i] == (want.tolist(), sorted(scores[want]))
    assert len(got) == 200 and (len(products) >= 200 if clusters else len(products) == 2)


def test_few_empty_and_large(spark):
    assert pivots.nearest_exact(frame(spark, [])).count() == 0
    assert pivots.nearest_exact(frame(spark, [(20, [1.0])])).count() == 0
    rows = [(i, [2.0**19 * (i - 7), float(i), -(2.0**18)]) for i in range(25)]
    assert sorted(map(tuple, pivots.nearest_exact(frame(spark, rows)).collect())) == brute(rows)
    with pytest.raises(Exception, match="too large components"):
        pivots.nearest_exact(frame(spark, [(20, [1e200])])).collect()
