"""Small cases with results worked out by hand, numpy checks, and properties."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.functions import columns as c
from slidegrid.functions.polygons import exclusion_expr, point_in_polygon
from slidegrid.operators import catalog, genes, metrics, models, report, spatial, splits, writeback
from slidegrid.sources import tables
from slidegrid.streaming import incremental

BOX = lambda w, h: (F.lit(0.0), F.lit(float(w)), F.lit(0.0), F.lit(float(h)))


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr).first()[0] if values else spark.range(1).select(expr).first()[0]


def xy(spark, *points):
    return spark.createDataFrame([(float(a), float(b)) for a, b in points], "x double, y double")


def test_clip_is_half_open(spark):
    obs = spark.createDataFrame([("s", 0.0, 0.0), ("s", 9.9, 9.9), ("s", 10.0, 5.0), ("s", -0.1, 5.0)], "sample_id string, x double, y double")
    slide = spark.createDataFrame([("s", 10, 10)], "sample_id string, width int, height int")
    assert spatial.clip_to_slide(obs, slide).count() == 2


@pytest.mark.parametrize(
    ("rule", "size", "points", "want"),
    [
        ({"type": "corner", "corner": "top-left", "width": 10, "height": 10}, (100, 100), [(9, 9), (10, 9), (9, 50)], [True, False, False]),
        ({"type": "strip", "side": "top", "size": 0.1, "units": "frac"}, (200, 100), [(5, 9.9), (5, 10)], [True, False]),
        ({"type": "rect", "xmin": 2, "xmax": 4, "ymin": 2, "ymax": 4}, (9, 9), [(2, 2), (4, 4), (4.01, 4.01)], [True, True, False]),
        ({"type": "trapezoid", "orientation": "left", "top_width": 40, "bottom_width": 20, "height": 30}, (100, 100), [(1, 32), (29, 32), (29, 50), (31, 50)], [True, False, True, False]),
    ],
)
def test_rules(spark, rule, size, points, want):
    got = xy(spark, *points).select(exclusion_expr([rule], F.col("x"), F.col("y"), BOX(*size)))
    assert [r[0] for r in got.collect()] == want


def test_bad_rules_raise():
    for rule in ({"type": "circle"}, {"type": "corner", "corner": "middle", "width": 1, "height": 1}, {"type": "strip", "side": "top"}, {"type": "strip", "side": "top", "size": 1, "units": "mm"}):
        with pytest.raises(ValueError, match="unknown|lacks"):
            exclusion_expr([rule], F.lit(1), F.lit(1), BOX(1, 1))


def test_polygon_equals_ray_cast(spark):
    ring = [(0.0, 0.0), (10.0, 2.0), (6.0, 5.0), (9.0, 10.0), (1.0, 8.0)]
    pts = np.random.default_rng(0).uniform(-1, 11, (800, 2))

    def inside(x, y):
        out, j = False, len(ring) - 1
        for i in range(len(ring)):
            (xi, yi), (xj, yj) = ring[i], ring[j]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                out = not out
            j = i
        return out

    column = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring])
    got = xy(spark, *pts).select(point_in_polygon(F.col("x"), F.col("y"), ring), point_in_polygon(F.col("x"), F.col("y"), column)).collect()
    want = [inside(*p) for p in pts]
    assert [r[0] for r in got] == want == [r[1] for r in got]


def test_pooling_conserves_counts_and_smoothing_keeps_constants(spark):
    pts = np.random.default_rng(1).uniform(0, 1000, (500, 2))
    frame = spark.createDataFrame([("s", "g", float(a), float(b)) for a, b in pts], "sample_id string, feature_name string, he_x double, he_y double")
    pooled = spatial.pool_spots(frame, spot_size_um=100.0)
    assert pooled.agg(F.sum("value")).first()[0] == 500
    flat = pooled.withColumn("value", F.lit(3)).withColumnRenamed("feature", "gene")
    assert {round(r["value"], 9) for r in spatial.smooth_neighbours(flat, flat).collect()} == {3.0}


def test_min_cells_and_gene_sets(spark):
    assert one(spark, genes.min_cells(0.10, F.lit(11))) == 2
    obs = spark.createDataFrame([(s, o) for s in "ab" for o in range(10)], "sample_id string, obs_id int")
    rows = [(s, o, "common", 1) for s in "ab" for o in range(10)] + [("a", 0, "rare", 1), ("b", 0, "rare", 1), ("a", 1, "only", 1)] + [(s, o, g, 1) for s in "ab" for o in range(10) for g in ("BLANK_1", "NegControl_1", "Intergenic_Region_1", "Codeword_1")]
    got = {r["gene"]: (r["in_common"], r["in_filtered_common"]) for r in genes.gene_sets(spark.createDataFrame(rows, "sample_id string, obs_id int, gene string, value int"), obs, 0.2).collect()}
    assert got == {"common": (True, True), "rare": (True, False), "only": (False, False), "BLANK_1": (False, False), "NegControl_1": (False, False), "Intergenic_Region_1": (False, True), "Codeword_1": (False, True)}
    panel = spark.createDataFrame([(s, g) for s in "ab" for g in ("common", "only", "silent")], "sample_id string, gene string")
    frame = spark.createDataFrame(rows, "sample_id string, obs_id int, gene string, value int")
    got = {r["gene"]: (r["in_common"], r["in_filtered_common"]) for r in genes.gene_sets(frame, obs, 0.2, panel=panel).collect()}
    assert got == {"common": (True, True), "only": (True, False), "silent": (True, False)}
    with pytest.raises(ValueError, match="criteria"):
        genes.top_k_genes(obs, obs, criteria="max")


def test_folds(spark):
    meta = spark.createDataFrame([(f"s{i}", f"p{i:02}", "d") for i in range(11)] + [("x", "p00", "d")], "sample_id string, patient string, dataset_title string")
    out = splits.group_kfold(meta, 4).toPandas()
    test = out[out.part == "test"].merge(meta.toPandas(), on="sample_id")
    assert sorted(test.groupby("split").patient.nunique(), reverse=True) == [3, 3, 3, 2] and test.groupby("patient").split.nunique().max() == 1
    for k in range(4):
        own = out[out.split == k].merge(meta.toPandas(), on="sample_id")
        assert not set(own[own.part == "test"].patient) & set(own[own.part == "train"].patient)
    few = meta.where("patient < 'p03'")
    assert splits.group_kfold(few, 5).agg(F.countDistinct("split")).first()[0] == 3
    with pytest.raises(ValueError, match="at least"):
        splits.group_kfold(few, 0)


def test_metrics_by_hand(spark):
    pairs = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("flat", 1.0, 1.0), ("flat", 2.0, 1.0)], "gene string, pred double, target double")
    got = {r["gene"]: r for r in metrics.gene_metrics(pairs).collect()}
    assert got["a"]["mse"] == pytest.approx(1 / 3) and got["a"]["r2"] == pytest.approx(0.5) and got["a"]["pearson"] == pytest.approx(np.corrcoef([1, 2, 2], [1, 2, 3])[0, 1])
    assert got["flat"]["pearson"] is None and got["flat"]["r2"] is None
    folds = spark.createDataFrame([("g", 0, 0.2), ("g", 1, 0.4), ("h", 0, 0.5), ("h", 1, float("nan")), ("n", 0, float("nan"))], "gene string, fold int, corr double")
    strict = {r["gene"]: (r["mean"], r["std"]) for r in metrics.merge_folds(folds).collect()}
    loose = {r["gene"]: (r["mean"], r["std"]) for r in metrics.merge_folds(folds, nan="skip").collect()}
    assert strict["g"] == pytest.approx((0.3, 0.1)) and strict["h"] == (None, None)
    assert loose["h"] == (0.5, 0.0) and loose["n"] == (None, None)
    enc = spark.createDataFrame([("d", "A", 0.3), ("d", "B", None), ("d", "C", 0.5)], "dataset string, encoder string, pearson_mean double")
    assert [r["encoder"] for r in metrics.rank_encoders(enc).orderBy("rank").collect()] == ["C", "A", "B"]
    box = metrics.box_stats(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 100)], "v double"), "v").first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_low"], box["whisker_high"]) == (2, 3, 4, 1, 4)
    bins = metrics.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10)], "v double"), "v", 2).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in bins] == [(0, 2), (1, 2)]


def test_slices(spark):
    counts = spark.createDataFrame([(0, 0, "a", 3), (0, 1, "b", 4), (1, 0, "a", 3), (1, 1, "b", None), (1, 2, "c", None), (2, 0, "a", 8), (2, 1, "b", 4), (3, 0, "a", 2), (3, 1, "b", 3)], "split int, pos int, sample_id string, n int")
    totals = spark.createDataFrame([(0, 7), (1, 10), (2, 6), (3, 9)], "split int, rows int")
    got = {(r["split"], r["sample_id"]): (r["start"], r["stop"]) for r in writeback.allocate(counts, totals).collect()}
    assert got == {(0, "a"): (0, 3), (0, "b"): (3, 7), (1, "a"): (0, 3), (1, "b"): (3, 7), (1, "c"): (7, 10), (2, "a"): (0, 4), (2, "b"): (4, 6), (3, "a"): (0, 2), (3, "b"): (2, 9)}


def test_names(spark):
    for raw, clean in (("b'000x001'", "000x001"), ("['a']", "a"), ('"q"', "q"), ("plain", "plain")):
        assert one(spark, c.clean_barcode(F.col("v")), v=raw) == clean
    assert one(spark, c.ensure_prefix(F.col("v"), F.lit("P1S1")), v="ROI1") == "P1S1ROI1" and one(spark, c.ensure_prefix(F.col("v"), F.lit("P1S1")), v="P1S1ROI1") == "P1S1ROI1"
    assert one(spark, c.run_number(F.col("v")), v="PanelR12_slideA") == 12 and one(spark, c.slide_number(F.col("v")), v="x_slide-3") == 3
    assert one(spark, c.resolution_column(F.col("v")), v="run_25um") == "num_patches_25um" and one(spark, c.resolution_column(F.col("v")), v="run") == "num_patches_100um"
    for code, want in (("UC1_NI", ("ulcerative colitis", False)), ("DC5", ("diverticulitis", None)), ("X_i", (None, True))):
        row = spark.createDataFrame([(code,)], "v string").select(*c.derived_condition(F.col("v"))).first()
        assert tuple(row) == want
    assert one(spark, c.sanitised_tag(F.col("v")), v="--") == "R"
    assert [r[0] for r in genes.split_cells(spark.createDataFrame([("A; B,,A",)], "x string"), "x").collect()] == ["A", "B"]


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(80, 6)), rng.normal(size=(6, 2))
    y = x @ w + 0.1 * rng.normal(size=(80, 2))
    frame = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "seq long, features array<double>, targets array<double>")
    got = models.ridge_fit(frame, targets=2)
    alpha = 100 / (6 * 2)
    assert np.allclose(got, np.linalg.solve(x.T @ x + alpha * np.eye(6), x.T @ y))
    p = models.fit_scaler_pca(frame, 3, column="features")
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(np.abs(p(x)), np.abs(z @ np.linalg.svd(z - z.mean(0), full_matrices=False)[2].T[:, :3]))
    with pytest.raises(ValueError, match="method"):
        models.probe_split(frame, frame, ["a"], "svm")


def test_tree_probe_and_embed(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    frame = spark.createDataFrame([(i, a.tolist(), [float(a[0] > 0)]) for i, a in enumerate(x)], "seq long, embedding array<double>, targets array<double>")
    out = metrics.gene_metrics(models.probe_split(frame, frame, ["g"], "rf", dimreduce=None)).first()
    assert out["n"] == 60 and out["pearson"] > 0.8
    images = spark.createDataFrame([("s", i, f"b{i}", [float(i), 2.0]) for i in range(5)], "sample_id string, seq long, barcode string, img array<double>")
    got = models.embed(images, lambda: lambda m: m * 2, batch_size=2).orderBy("seq").collect()
    assert [list(r["embedding"]) for r in got] == [[2.0 * i, 4.0] for i in range(5)]
    tokens = spark.createDataFrame([([[1.0, 2.0], [9.0, 9.0], [3.0, 4.0], [5.0, 6.0]],)], "t array<array<double>>")
    assert tokens.select(models.pool_tokens(F.col("t"), 1)).first()[0] == [1.0, 2.0, 4.0, 5.0] and tokens.select(models.pool_tokens(F.col("t"))).first()[0] == [1.0, 2.0]


def test_annotation_fan_out(spark):
    listed = spark.createDataFrame([("Abc",), ("x",)], "gene string")
    labels = spark.createDataFrame([("ABC", "1"), ("abc ", "2"), ("ABC", "3")], "gene string, label string")
    assert catalog.annotate_genes(listed, {"kind": labels}).count() == 3
    assert catalog.annotate_genes(listed, {"kind": labels}, strict=True).count() == 2


def test_patch_metadata_cascade(spark):
    spots = spark.createDataFrame([("s", 0, "a", "q"), ("s", 1, "n", "b"), ("s", 2, "m", "z")], "sample_id string, seq long, obs_id string, barcode string")
    patches = spark.createDataFrame([("s", 0, "a", 1, 1), ("s", 1, "b", 2, 2), ("s", 2, "c", 3, 3)], "sample_id string, seq long, barcode string, coord_x int, coord_y int")
    got = {r["obs_id"]: (r["tier"], r["coord_x"]) for r in writeback.attach_patch_metadata(spots, patches).collect()}
    assert got == {"a": (1, 1), "n": (2, 2), "m": (3, 3)}


def test_label_matrix_checks_sizes(spark):
    listed = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, gene string")
    good = spark.createDataFrame([(0, 0, [1.0, 2.0], [3.0, 4.0])], "split int, seq long, preds array<double>, targets array<double>")
    assert sorted(tuple(r) for r in writeback.label_matrix(good, listed).collect()) == [(0, 0, "a", 1.0, 3.0), (0, 0, "b", 2.0, 4.0)]
    with pytest.raises(Exception, match="does not have 2 values"):
        writeback.label_matrix(good.withColumn("preds", F.array(F.lit(1.0))), listed).collect()


def test_files(spark, tmp_path):
    for name, rows in (("train_0.csv", "a,p,e"), ("test_0.csv", "b,p,e"), ("test_1.csv", "a,p,e"), ("other.csv", "z,p,e")):
        (tmp_path / name).write_text(f"sample_id,patches_path,expr_path\n{rows}\n")
    got = sorted((r["split"], r["part"], r["sample_id"]) for r in tables.read_splits(spark, str(tmp_path)).collect())
    assert got == [(0, "test", "b"), (0, "train", "a"), (1, "test", "a")]
    run = tmp_path / "run_1" / "d1"
    run.mkdir(parents=True)
    (run / "enc_results.json").write_text('{"results": [{"encoder_name": "A", "pearson_mean": NaN, "pearson_std": 0.1}, {"name": "B", "pearson_mean": 0.4, "pearson_std": 0.2}]}')
    enc = {r["encoder"]: (r["run"], r["dataset"], r["pearson_mean"]) for r in tables.read_encoder_results(spark, str(tmp_path)).collect()}
    assert enc == {"A": ("run_1", "d1", None), "B": ("run_1", "d1", 0.4)}
    (run / "results_kfold.json").write_text('{"pearson_corrs": [{"name": "g", "pearson_corrs": [0.1, NaN], "mean": NaN, "std": NaN}]}')
    row = tables.read_kfold(spark, f"{tmp_path}/*/*/results_kfold.json").first()
    assert (row["gene"], row["values"], row["mean"]) == ("g", [0.1, None], None)
    for k, text in enumerate(('{"genes": ["b", "a"]}', '["b", "a"]', "nonsense")):
        (tmp_path / f"g{k}.json").write_text(text)
    lists = [[r["gene"] for r in tables.read_gene_list(spark, str(tmp_path / f"g{k}.json")).collect()] for k in range(3)]
    assert lists == [["b", "a"], ["b", "a"], []]
    tables.write_gene_list(spark.createDataFrame([("b",), ("a",)], "gene string"), str(tmp_path / "out"), min_cells_pct=0.1)
    assert [r["gene"] for r in tables.read_gene_list(spark, str(tmp_path / "out")).collect()] == ["a", "b"]
    assert tables.read_metadata(spark, str(tmp_path / "none.csv")).count() == 0
    files = tables.listing(spark, str(tmp_path), "*.json")
    assert {r["name"] for r in files.collect()} >= {"enc_results.json", "g0.json"}
    stale = tables.stale_runs(files, "enc_results.json", now=F.current_timestamp() + F.expr("INTERVAL 2 DAYS"))
    assert "d1" not in {r["folder"] for r in stale.collect()} and stale.count() > 0


def test_discovery(spark):
    files = spark.createDataFrame([(f"/r/R3/{f}/{n}", n, f) for f, n in (("roi1", "adata.parquet"), ("roi1", "roi1_patches.parquet"), ("roi1", "a_patch.parquet"), ("roi2", "adata.parquet"), ("roi3", "x.txt"))], "path string, name string, folder string")
    got = {r["sample_id"]: r["patch_path"] for r in tables.discover_samples(files).collect()}
    assert got == {"R3roi1": "/r/R3/roi1/roi1_patches.parquet", "R3roi2": None}
    twice = files.union(spark.createDataFrame([("/q/R3/roi1/adata.parquet", "adata.parquet", "xroi1")], files.schema)).withColumn("folder", F.when(F.col("folder") == "xroi1", "roi1").otherwise(F.col("folder")))
    assert tables.discover_samples(twice).count() == 2


def test_predictions_resume(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    path = str(tmp_path / "p")
    tables.write_predictions(frame.where("sample_id = 'a'"), path)
    tables.write_predictions(frame.withColumn("v", F.col("v") + 10), path)
    assert sorted((r["sample_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 12)]
    tables.write_predictions(frame.where("sample_id = 'a'").withColumn("v", F.lit(7)), path, force=True)
    assert sorted((r["sample_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 12)]


def test_rule_text(spark):
    def parsed(text):
        return spark.createDataFrame([(text,)], "t string").select(tables.parse_rules(F.col("t"))).first()[0]

    assert parsed("[{'type': 'strip', 'size': 0.1}]") == [{"type": "strip", "size": "0.1"}] == parsed('{"type": "strip", "size": 0.1}')
    assert len(parsed("{'a': 1} and {'b': 2}")) == 2 and parsed(None) == [] == parsed(" ")
    with pytest.raises(Exception, match="no rules"):
        parsed("nothing here")


def test_stream_equals_batch(spark, tmp_path):
    schema = "sample_id string, feature_name string, he_x double, he_y double"
    for k in range(3):
        spark.createDataFrame([("s", "g", float(k * 10 + i), 5.0) for i in range(20)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.pool_stream(source, str(tmp_path / "out"), str(tmp_path / "cp"), spot_size_um=10.0).awaitTermination()
    got = incremental.pooled(spark.read.parquet(str(tmp_path / "out"))).collect()
    want = spatial.pool_spots(spark.read.parquet(str(tmp_path / "in")), spot_size_um=10.0).collect()
    key = lambda rows: sorted((r["array_row"], r["array_col"], r["feature"], r["value"]) for r in rows)
    assert key(got) == key(want)


def test_report_tables(spark):
    rows = [(f"g{i}", s, "u" if s < "c" else "v", i / 10 + ord(s) / 1000) for i in range(8) for s in "abcd"]
    by_sample = spark.createDataFrame(rows, "gene string, sample_id string, condition string, corr double")
    merged = by_sample.groupBy("gene").agg(F.avg("corr").alias("mean"))
    out = report.report_tables(merged, by_sample, ["condition", "absent"], bins=4, n=3)
    assert set(out) == {"top_genes", "histogram", "boxes", "boxes_condition"}
    assert [r["gene"] for r in out["top_genes"].collect()] == ["g7", "g6", "g5"] and out["boxes_condition"].count() == 4


def test_age(spark):
    row = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "a timestamp, b timestamp")
    assert row.select(c.age_hours(F.col("a"), F.col("b"))).first()[0] == 24.0


def test_package(spark, tmp_path):
    from slidegrid.plans import packages

    obs = spark.createDataFrame([(s, o) for s in "abc" for o in range(6)], "sample_id string, obs_id int")
    expression = spark.createDataFrame([(s, o, g, o + k) for s in "abc" for o in range(6) for k, g in enumerate(("g1", "g2"), 1)], "sample_id string, obs_id int, gene string, value int")
    meta = spark.createDataFrame([(s, s, "d") for s in "abc"], "sample_id string, patient string, dataset_title string")
    found = spark.createDataFrame([(s, k) for s in "abc" for k in ("matrix", "patch")][:-1], "sample_id string, kind string")
    package = packages.build_package(expression, obs, meta, found)
    with pytest.raises(FileNotFoundError, match="patch"):
        packages.write_package(package, str(tmp_path))
    packages.write_package(package, str(tmp_path), allow_missing=True)
    assert [r["gene"] for r in tables.read_gene_list(spark, f"{tmp_path}/genes_common").collect()] == ["g1", "g2"]
    assert package.splits.where("part = 'test'").count() == 3 and {"patches_path", "expr_path"} <= set(package.splits.columns)


def test_split_predictions_and_log(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, "g", 1.0, 2.0), (1, 0, "g", 1.0, 1.0)], "split int, seq long, gene string, pred double, target double")
    tables.write_split_predictions(rows, str(tmp_path / "p"))
    wanted = spark.createDataFrame([(0,), (7,)], "split int")
    got, missing = tables.read_split_predictions(spark, str(tmp_path / "p"), wanted)
    assert got.count() == 1 and [r[0] for r in missing.collect()] == [7]
    parts = spark.createDataFrame([(0, "train", "a"), (0, "train", "b"), (0, "test", "c")], "split int, part string, sample_id string")
    tables.write_run_log(parts, spark.createDataFrame([(0, 0.5, 1.0)], "split int, pearson double, mse double"), str(tmp_path / "log"), method="ridge")
    row = spark.read.json(str(tmp_path / "log")).first()
    assert (row["n_train"], row["n_test"], row["pearson_mean"], row["method"]) == (2, 1, 0.5, "ridge")


def test_columns_and_spot_table(spark):
    frame = spark.createDataFrame([("S1", "3", "SLIDE 7"), ("S2", "x", None)], "sample_id string, roi string, slide string")
    out = c.arrange(c.rename_existing(frame, {"slide": "slide_id", "none": "n"}, panel="p"), ("slide_id",), ("roi",), {"slide_id": "SLIDE "})
    assert out.columns == ["slide_id", "sample_id", "roi", "panel"] and [tuple(r) for r in out.collect()] == [("7", "S1", 3, "p"), (None, "S2", None, "p")]
    assert c.require_non_null(frame, "SLIDE").count() == 1
    with pytest.raises(ValueError, match="missing"):
        c.require_columns(frame, "nothing")
    written = spark.createDataFrame([("s", "o", "g", 1.0, 2.0)], "sample_id string, obs_id string, gene string, pred double, target double")
    layers = spark.createDataFrame([("s", "o", "g", None, 5.0)], "sample_id string, obs_id string, gene string, raw double, value double")
    obs = spark.createDataFrame([("s", "o", 0.0, 0.0), ("s", "p", 1.0, 0.0)], "sample_id string, obs_id string, x double, y double")
    got = {r["obs_id"]: (r["pred"], r["measured"]) for r in report.spot_table(written, layers, obs, "g").collect()}
    assert got == {"o": (1.0, 5.0), "p": (None, None)}
    boxes = {r["layer"]: r["median"] for r in report.prediction_boxes(written.withColumn("split", F.lit(0))).collect()}
    assert boxes == {"pred": 1.0, "target": 2.0}


def test_splits_round_trip(spark, tmp_path):
    rows = [(0, "train", "a", "p/a", "e/a"), (0, "test", "b", "p/b", "e/b"), (11, "test", "a", None, "e/a")]
    tables.write_splits(spark.createDataFrame(rows, "split int, part string, sample_id string, patches_path string, expr_path string"), f"{tmp_path}/s")
    assert sorted(map(tuple, tables.read_splits(spark, f"{tmp_path}/s").collect()), key=str) == sorted(rows, key=str)


def test_spots_with_a_code_column_are_not_placed_by_order(spark):
    obs = spark.createDataFrame([("a", i, f"o{i}", f"c{i // 2}") for i in range(4)] + [("b", i, f"p{i}", f"x{i}") for i in range(2)], "sample_id string, seq int, obs_id string, cell_id string")
    preds = spark.createDataFrame([("a", 0, "c0"), ("a", 1, "c1"), ("b", 0, "?"), ("b", 1, "p")], "sample_id string, seq int, barcode string")
    got = {tuple(r) for r in writeback.match_spots(preds, obs).collect()}
    assert got == {("a", 0, "o1", 2), ("a", 1, "o3", 2)}  # the last spot of a code; nothing for b
    placed = {tuple(r) for r in writeback.match_spots(preds, obs.drop("cell_id")).collect()}
    assert placed == {("a", 0, "o0", 4), ("a", 1, "o1", 4), ("b", 0, "p0", 3), ("b", 1, "p1", 3)}


def test_patients_of_ids(spark):
    meta = spark.createDataFrame([("XR1S1", 0, "p1"), ("R1S1", 1, "p2"), ("Q_7", 2, "p3"), ("Q_7", 3, "p4"), ("N9", 4, None)], "id string, pos int, patient string")
    ids = spark.createDataFrame([("R1S1",), ("S1",), ("7",), ("Z_3",), ("N9",), ("R1S1",)], "sample_id string")
    got = {r["sample_id"]: (r["id"], r["patient"], r["how"]) for r in catalog.suffix_match(ids, meta).collect()}
    assert got == {"R1S1": ("R1S1", "p2", "exact"), "S1": ("XR1S1", "p1", "suffix"), "7": ("Q_7", "p4", "suffix"), "Z_3": (None, "Z", "own"), "N9": (None, "N9", "own")}


def test_summaries(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (float("nan"), "a"), (None, "b")], "x double, k string")
    assert [tuple(r) for r in catalog.numeric_summary(df, "x", quantiles=(0.5,)).collect()] == [("x", 2, 2.0, 2**0.5, 1.0, 3.0, 1.0)]
    assert [tuple(r) for r in catalog.value_counts(df, "k").collect()] == [("a", 2), (None, 1), ("b", 1)]


def test_reading_order_begins_at_the_least_y(spark):
    patches = spark.createDataFrame([("s", 0, 30.0, 7.0), ("s", 1, 10.0, 16.0), ("s", 2, 10.0, 7.5), ("s", 3, 20.0, 17.0)], "sample_id string, seq int, x double, y double")
    # steps of 0.5, 8.5 and 1: rows are 1 high and begin at 7
    assert [r["seq"] for r in spatial.reading_order(patches).orderBy("position").collect()] == [2, 0, 1, 3]
