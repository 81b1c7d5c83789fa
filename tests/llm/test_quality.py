import numpy as np
from pyspark.sql import functions as F

from slidegrid.llm import quality

SCHEMA = "doc_id long, text string, Text string, score string"


def rows(spark):
    good = [(i, f"The morning train number {i} was late, and people waited on platform {i % 7}.\nIt came at last.", "x", "y") for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i}!! BUY!! NOW!! $$$ ### {i} BUY!! NOW!!", None, None) for i in range(60)]
    return good + bad


def test_separates_and_handles_odd_rows(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    odd = [(None, None, None, None), (500, "", None, None), (501, "word " * 30_000, None, None), (0, rows(spark)[0][1], "x", "y")]
    docs = spark.createDataFrame(rows(spark) + odd, SCHEMA)
    spark.conf.unset("spark.sql.caseSensitive")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).toPandas()
    assert len(out) == 124 and list(out.columns) == ["doc_id", "held_out", "score", "predicted"]
    assert out.score.between(0, 1).all()
    held = out[out.held_out & (out.doc_id < 200)]
    assert len(held) > 10 and ((held.doc_id < 100) == (held.predicted == 1)).all()
    assert quality.accept(docs, labels).columns == docs.columns


def test_empty_and_one_class(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.classify(one, labels).first()["score"] == 0.5


def test_held_out_rows_are_never_learnt_from(spark):
    docs = spark.createDataFrame(rows(spark), SCHEMA.replace("Text", "t2"))
    ids = [(r[0], int(r[0] < 100)) for r in rows(spark)]
    labels = spark.createDataFrame(ids, "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(a.means, b.means) and a.prior == b.prior


def test_scores_equal_plain_densities():
    import math

    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(90, 4)), rng.normal(0.7, 2.0, size=(60, 4))])
    y = np.repeat([0, 1], [90, 60])
    got = quality.QuadraticDiscriminant.fit(x, y, pooled=0.2, diagonal=0.1).score(x)

    def shrunk(own):
        return 0.9 * own + 0.1 * np.diag(np.maximum(np.diag(pooled), 1e-4))

    parts = [x[y == k] for k in (0, 1)]
    pooled = sum(np.cov(p.T, bias=True) * len(p) for p in parts) / len(x)
    density = []
    for p in parts:
        weight = len(p) / (len(p) + 4)
        cov = 0.8 * (weight * shrunk(np.cov(p.T, bias=True)) + (1 - weight) * shrunk(pooled)) + 0.2 * shrunk(pooled)
        inverse, det = np.linalg.inv(cov), np.linalg.det(cov)
        density.append([math.exp(-0.5 * (v - p.mean(0)) @ inverse @ (v - p.mean(0))) / math.sqrt(det) * len(p) for v in x])
    want = np.array(density[1]) / (np.array(density[0]) + np.array(density[1]))
    assert np.allclose(got, want)
