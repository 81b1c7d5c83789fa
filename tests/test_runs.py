import json
import math

from slidegrid.sources import runs

SPECS = "dataset string, source string, factor double, part int"


def put(path, doc):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))


def encoders(spark):
    rows = [("run_1", "A", "e1", 0.25, 0.125), ("run_1", "A", "e2", 0.5, 0.0625), ("run_1", "A", "e3", float("nan"), None), ("run_1", "B", "e1", 0.75, 0.5), ("run_2 a+b%", "A", "odd name/é", -0.5, 0.25)]
    return rows, spark.createDataFrame(rows, "run string, dataset string, encoder string, pearson_mean double, pearson_std double")


def test_round_trip_of_dataset_results(spark, tmp_path):
    rows, frame = encoders(spark)
    assert runs.write_documents(runs.dataset_documents(frame), str(tmp_path)) == 2
    doc = json.loads((tmp_path / "run_1" / "dataset_results.json").read_text())
    assert [d["dataset_name"] for d in doc["results"]] == ["A", "B"]
    assert [e["encoder_name"] for e in doc["results"][0]["results"]] == ["e2", "e1", "e3"] and list(doc["average"].items()) == [("e1", 0.5), ("e2", 0.5), ("e3", None)]
    results, averages = runs.read_dataset_results(spark, str(tmp_path))
    clean = lambda x: None if x is not None and isinstance(x, float) and math.isnan(x) else x
    assert {(r["run"], r["dataset"], r["encoder"], r["pearson_mean"], r["pearson_std"]) for r in results.collect()} == {tuple(map(clean, r)) for r in rows}
    assert {tuple(r) for r in averages.collect()} == {("run_1", "e1", 0.5), ("run_1", "e2", 0.5), ("run_1", "e3", None), ("run_2 a+b%", "odd name/é", -0.5)}


def test_summary_of_drifting_documents(spark, tmp_path):
    root, data = tmp_path / "runs", tmp_path / "data"
    put(root / "run_a" / "config.json", {"gene_list": "g50.json", "datasets": ["A", "B"], "alpha": "0.5", "batch_size": 128, "dimreduce": "PCA", "normalize": True, "library_size_normalize": True, "latent_dim": 256, "method": "ridge", "more": {"x": [1]}})
    put(root / "run_a" / "dataset_results.json", '{"results": [{"dataset_name": "A", "results": [{"encoder_name": "e1", "pearson_mean": NaN, "pearson_std": 0.1}, {"encoder_name": "e2", "pearson_mean": 0.25, "pearson_std": NaN}, {"encoder_name": "e3", "pearson_mean": 0.25, "pearson_std": 0.5}]}, {"dataset_name": "B", "results": [{"encoder_name": "e9", "pearson_mean": 0.9, "pearson_std": 0.1}]}], "average": {"e2": 0.25}}')
    put(root / "run_a" / "A" / "enc_results.json", {"results": [{"encoder_name": "e2"}, {"name": "e1"}, "plain", {"encoder_name": ""}, 7]})
    put(root / "run_a" / "B" / "deep" / "enc_results.json", {"results": [{"encoder_name": "e9"}]})
    put(root / "run_b" / "x" / "config.json", {"datasets": "B", "gene_list": "sub/list.json", "alpha": {"odd": 1}, "batch_size": "many"})
    put(root / "run_b" / "enc_results.json", "no json {")
    put(root / "run_c" / "dataset_results.json", {"results": []})
    put(root / "run_d" / "config.json", {"datasets": ["A"], "gene_list": "missing.json"})
    put(root / "other" / "config.json", {"datasets": ["A"]})
    put(data / "A" / "g50.json", {"genes": ["x", "y", "z"]})
    put(data / "A" / "bad.json", {"genes": "x"})
    put(data / "B" / "sub" / "list.json", ["x", "y"])
    rules = spark.createDataFrame([("A", "s", 2.0, 0)], SPECS)
    means = spark.createDataFrame([("s", 10.0)], "source string, mean double")
    out = runs.summarise_runs(spark, str(root), str(data), rules, means).collect()
    got = [tuple(r) for r in out]
    assert got == [
        ("run_a", "g50.json", 3, 0.5, 128, "PCA", "e1, e2, e9, plain", True, True, 256, "ridge", "A", "e2", 0.25, None, 20.0),
        ("run_d", "missing.json", None, None, None, None, None, None, False, None, None, "A", None, None, None, 20.0),
        ("run_b", "sub/list.json", 2, None, None, None, None, None, False, None, None, "B", None, None, None, None),
        ("run_c", "", None, None, None, None, None, None, False, None, None, None, None, None, None, None),
    ]


def test_no_documents(spark, tmp_path):
    rules, means = spark.createDataFrame([], SPECS), spark.createDataFrame([], "source string, mean double")
    assert runs.summarise_runs(spark, str(tmp_path / "nothing"), str(tmp_path / "none"), rules, means).count() == 0
    results, averages = runs.read_dataset_results(spark, str(tmp_path / "nothing"))
    assert results.count() == averages.count() == 0
