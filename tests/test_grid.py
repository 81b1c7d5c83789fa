import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import metrics, models

GENES = ["g1", "g2"]


def inputs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4))
    rows = [(f"s{i % 6}", i, [float(v) for v in r], [float(r[0] + r[1]), float(r[2] - 2 * r[3])]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "sample_id string, seq int, embedding array<double>, targets array<double>")
    splits = spark.createDataFrame([(k, "test" if i % 3 == k else "train", f"s{i}") for k in range(3) for i in range(6)], "split int, part string, sample_id string")
    return frame, {"001": (splits, GENES), "odd/name=%": (splits.where("split < 2"), GENES)}


def test_a_stopped_grid_goes_on_where_it_ended(spark, tmp_path):
    frame, datasets = inputs(spark)
    root, calls, broken = str(tmp_path / "results"), [], True

    def features(dataset, encoder):
        calls.append((dataset, encoder))
        if broken and encoder == "e2" and dataset == "odd/name=%":
            raise RuntimeError("no features")
        return frame

    run = lambda encoders: models.grid(spark, datasets, features, encoders, results=root, threads=2, dimreduce=None)
    with pytest.raises(RuntimeError, match="no features"):
        run(["e1", "e2"])
    done = {tuple(r) for r in models.finished(spark, root).collect()}
    assert 0 < len(done) < 10
    stamps = {d: os.stat(models._folder(root, *d) + "/_SUCCESS").st_mtime_ns for d in done}
    os.remove(models._folder(root, *sorted(done)[0]) + "/_SUCCESS")  # a task that was stopped while it wrote
    broken, before = False, len(calls)
    out = run(["e1", "e2"]).collect()
    assert len(calls[before:]) == len(set(calls[before:])) <= 4  # features once for a dataset and encoder
    assert {d: os.stat(models._folder(root, *d) + "/_SUCCESS").st_mtime_ns for d in sorted(done)[1:]} == {d: stamps[d] for d in sorted(done)[1:]}
    assert {(r["dataset"], r["encoder"], r["split"], r["gene"]) for r in out} == {(d, e, k, g) for d, n in (("001", 3), ("odd/name=%", 2)) for e in ("e1", "e2") for k in range(n) for g in GENES}
    assert len(out) == 20 and all(r["pearson"] > 0.99 for r in out)
    before = len(calls)
    assert run(["e1"]).count() == 10 and len(calls) == before
    whole = {(r["split"], r["gene"]): r["mse"] for r in models.probe(frame, datasets["001"][0], GENES, dimreduce=None).collect()}
    assert {(r["split"], r["gene"]): pytest.approx(r["mse"]) for r in out if r["dataset"] == "001" and r["encoder"] == "e1"} == whole


def test_metrics_in_one_pass(spark):
    rng = np.random.default_rng(9)
    t = 1e6 + rng.normal(size=4000)
    rows = [("g", float(a), float(a + b)) for a, b in zip(t, rng.normal(size=4000), strict=True)] + [("flat", 3.0, float(i)) for i in range(5)] + [("one", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "gene string, target double, pred double").repartition(7)
    got = {r["gene"]: r for r in metrics.gene_metrics(df).collect()}
    p = np.array([r[2] for r in rows[:4000]])
    assert abs(got["g"]["pearson"] - np.corrcoef(p, t)[0, 1]) < 1e-9 and abs(got["g"]["mse"] - ((p - t) ** 2).mean()) < 1e-9
    assert abs(got["g"]["r2"] - (1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())) < 1e-9
    assert (got["flat"]["pearson"], got["flat"]["r2"], got["one"]["pearson"], got["one"]["r2"], got["one"]["mse"]) == (None, None, None, None, 1.0)
    assert df.groupBy("gene").agg(F.count("*")).count() == 3
