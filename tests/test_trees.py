import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from slidegrid.operators import metrics, models, trees

SCHEMA = "seq long, embedding array<double>, targets array<double>"


def made(spark, genes, n=700, p=10, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    parts = rng.integers(0, p, (genes, 3))
    y = np.stack([2.0 * (x[:, a] > 0.3) + np.abs(x[:, b]) + x[:, a] * (x[:, c] > 0) for a, b, c in parts], 1) + 0.3 * rng.normal(size=(n, genes))
    return x, y, spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(3)


def plain_tree(codes, r, w, features_of, growth, node=0, depth=0):
    """The same splits by recursion over all features and bins of one node's rows."""
    n, s = w.sum(), (w * r).sum()
    leaf = s / (n + growth.ridge)
    best = (1e-10 * s * s / (n + growth.ridge), None)
    if depth < growth.depth:
        for f in features_of(node):
            for b in range(trees.BINS):
                left = codes[:, f] <= b
                nl, sl = w[left].sum(), (w * r)[left].sum()
                if nl >= growth.least and n - nl >= growth.least:
                    gain = sl**2 / (nl + growth.ridge) + (s - sl) ** 2 / (n - nl + growth.ridge) - s * s / (n + growth.ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, b, left))
    if best[1] is None:
        return lambda c: np.full(len(c), leaf)
    f, b, left = best[1]
    one, two = (plain_tree(codes[m], r[m], w[m], features_of, growth, 2 * node + k, depth + 1) for k, m in ((1, left), (2, ~left)))
    return lambda c: np.where(c[:, f] <= b, one(c), two(c))


@pytest.mark.parametrize("growth", [trees.Growth(trees=3, depth=3, at_once=2), trees.Growth(trees=12, depth=2, rate=0.3, features=0.8, rows=0.8, ridge=1.0)])
def test_equals_trees_grown_by_recursion(spark, growth):
    x, y, frame = made(spark, 2, n=300, p=6)
    got = trees.fit(frame, growth, x="embedding")
    again = trees.fit(frame.repartition(5), growth, x="embedding")
    assert np.array_equal(got.feature, again.feature) and np.allclose(got(x), again(x))
    cuts = trees.cuts_of(frame, "embedding")
    codes = trees.codes_of(x, cuts)
    marks = np.array([r[0] for r in frame.orderBy("seq").select(F.xxhash64("embedding", "targets")).collect()])
    want = np.tile(y.mean(0), (len(x), 1))
    for g in range(2):
        fit = np.full(len(x), y[:, g].mean())
        for t in range(growth.trees):
            w = trees.drawn(marks, t, growth)
            grown = plain_tree(codes, y[:, g] - (fit if growth.rate else y[:, g].mean()), w, lambda node, t=t: trees.usable(t, node, 6, growth), growth)
            step = (growth.rate or 1 / growth.trees) * grown(codes)
            fit = fit + step
            want[:, g] += step
    assert np.allclose(got(x), want)


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)), out


@pytest.mark.parametrize("method, growth", [("rf", {"trees": 20, "depth": 5}), ("gbt", {"trees": 20, "rate": 0.3})])
def test_near_spark_ml_on_fifty_genes_in_as_many_jobs_as_for_one(spark, method, growth):
    _, _, frame = made(spark, 50)
    train, test = frame.where("seq % 4 > 0"), frame.where("seq % 4 = 0")
    narrow = [d.withColumn("features", F.col("embedding")).withColumn("targets", F.slice("targets", 1, 1)) for d in (train, test)]
    one, _ = jobs_of(spark, f"one-{method}", lambda: models.tree_fit(narrow[0], method, key=("seq",), **growth))
    all_jobs, model = jobs_of(spark, f"all-{method}", lambda: models.tree_fit(train.withColumnRenamed("embedding", "features"), method, key=("seq",), **growth))
    assert all_jobs == one
    genes = [f"g{i}" for i in range(50)]
    rows = models.tree_predict(model, test.withColumnRenamed("embedding", "features"))
    pairs = rows.select(F.posexplode(F.arrays_zip("preds", "targets")).alias("pos", "v")).select("pos", F.col("v.preds").alias("pred"), F.col("v.targets").alias("target"))
    ours = {r["pos"]: r["pearson"] for r in metrics.gene_metrics(pairs, ("pos",)).collect()}
    assert len(ours) == len(genes)
    make = RandomForestRegressor(numTrees=20, seed=1, featuresCol="v") if method == "rf" else GBTRegressor(maxIter=20, stepSize=0.3, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=1, featuresCol="v")
    theirs = {}
    for g in (0, 7, 21, 49):
        parts = [d.select(array_to_vector("embedding").alias("v"), F.element_at("targets", g + 1).alias("label")) for d in (train, test)]
        theirs[g] = metrics.gene_metrics(make.fit(parts[0]).transform(parts[1]).withColumnRenamed("prediction", "pred"), (), target="label").first()["pearson"]
    assert all(ours[g] > theirs[g] - 0.06 for g in theirs), (ours, theirs)
    assert np.mean([ours[g] - theirs[g] for g in theirs]) > -0.03


def test_odd_values(spark):
    rows = [(i, [float(i % 7), None if i % 5 == 0 else 1.0, float("nan")], [float(i % 7 > 3), None if i % 2 else 4.0, None]) for i in range(60)]
    rows += [(100, None, [1.0, 1.0, 1.0]), (101, [1.0, 1.0, 1.0], None)]
    model = trees.fit(spark.createDataFrame(rows, SCHEMA), trees.Growth(trees=15, depth=2, rate=0.5, features=1.0, rows=1.0), x="embedding")
    out = model(np.array([[1.0, np.nan, np.nan], [6.0, 1.0, 0.0]]))
    assert np.allclose(out, [[0, 4, 0], [1, 4, 0]], atol=1e-3)
    with pytest.raises(ValueError, match="rows"):
        trees.fit(spark.createDataFrame([], SCHEMA), x="embedding")
    with pytest.raises(ValueError, match="fewer"):
        trees.fit(spark.createDataFrame(rows, SCHEMA), trees.Growth(trees=10000, depth=14), x="embedding")
    with pytest.raises(TypeError):
        models.tree_fit(spark.createDataFrame(rows, SCHEMA), "rf", leaves=3)
