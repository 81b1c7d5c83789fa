import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.functions.polygons import point_in_polygon
from slidegrid.operators.cover import cover, points_in_polygons

RING = "sample_id string, polygon_id string, ring array<struct<x:double,y:double>>"


def star(rng, n, x, y, r):
    """A ring with n vertices at different distances, so a concave one."""
    return [(float(x + r * d * np.cos(a)), float(y + r * d * np.sin(a))) for a, d in zip(np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(0.3, 1, n), strict=True)]


@pytest.mark.parametrize("depth", [0, 2, 5])
def test_equals_testing_all_pairs(spark, depth):
    rng = np.random.default_rng(3)
    polygons = [("a", "slide", star(rng, 40, 0, 0, 900)), ("a", "bow", [(-50.0, -50.0), (50.0, 50.0), (50.0, -50.0), (-50.0, 50.0)]), ("a", "box", [(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)])]
    polygons += [("a", f"t{i}", star(rng, 7, *rng.uniform(-500, 500, 2), 3)) for i in range(60)] + [("b", "only", star(rng, 12, 10, 10, 30))]
    polygons += [("a", "line", [(1.0, 1.0), (2.0, 2.0)]), ("a", "none", None), ("a", "nan", [(0.0, 0.0), (float("nan"), 1.0), (3.0, 3.0)]), ("a", "dot", [(5.0, 5.0)] * 4)]
    points = [("a", float(x), float(y)) for x, y in np.concatenate([rng.uniform(-900, 900, (1500, 2)), rng.integers(-64, 65, (700, 2)), rng.uniform(-3, 3, (300, 2)) + np.repeat([p[2][0] for p in polygons[3:63]], 5, axis=0)])]
    points += [("b", float(x), float(y)) for x, y in rng.uniform(-30, 50, (300, 2))] + [("a", None, 1.0), ("a", float("nan"), 1.0), ("c", 1.0, 1.0)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(points)], "id int, sample_id string, x double, y double")
    g = spark.createDataFrame(polygons, RING)
    good = g.where("size(ring) >= 3 and polygon_id <> 'nan'")
    want = p.where("x is not null and not isnan(x)").join(good, "sample_id").where(point_in_polygon(F.col("x"), F.col("y"), F.col("ring"))).select("id", "polygon_id")
    key = lambda df: sorted(map(tuple, df.select("id", "polygon_id").collect()))
    assert key(points_in_polygons(p, g, depth=depth)) == key(want)
    assert not {"line", "none", "nan"} & {r[0] for r in cover(g, depth=depth).select("polygon_id").distinct().collect()}


def test_cells_are_bounded_whatever_the_sizes(spark):
    rng = np.random.default_rng(5)
    g = spark.createDataFrame([("a", "huge", star(rng, 30, 0, 0, 1e9))] + [("a", f"t{i}", star(rng, 6, *rng.uniform(-1e8, 1e8, 2), 0.5)) for i in range(400)], RING)
    cells = {r["polygon_id"]: r for r in cover(g).groupBy("polygon_id").agg(F.count("*").alias("n"), F.count_if("whole").alias("whole")).collect()}
    assert len(cells) == 401 and max(r["n"] for r in cells.values()) < 700
    assert cells["huge"]["whole"] > 0


def test_empty(spark):
    p, g = spark.createDataFrame([("a", 1.0, 1.0)], "sample_id string, x double, y double"), spark.createDataFrame([], RING)
    assert points_in_polygons(p, g).count() == 0
    assert points_in_polygons(p.where("false"), spark.createDataFrame([("a", "q", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)])], RING)).count() == 0
