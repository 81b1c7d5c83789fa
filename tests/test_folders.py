import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from slidegrid.sources import folders, tables


def place(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("")


@pytest.fixture()
def tree(tmp_path):
    place(tmp_path / "XeniumPR1" / "slide1", "ROI1/aligned_adata.h5ad", "ROI1/patches/other.h5", "ROI1/patches/ROI1.h5", "ROI1/patches_vis/a.png", "ROI1/patches_vis/ROI1_patch_vis.png")
    place(tmp_path / "XeniumPR1" / "slide1", "ROI2/aligned_adata.h5ad", "ROI2/patches/b.h5", "ROI2/patches/a.h5", "ROI2/notes.txt", "ROI3/notes.txt")
    place(tmp_path / "XeniumPR1" / "Slide_2", "ROI1/aligned_adata.h5ad")
    place(tmp_path / "XeniumPR1" / "logs", "ROI9/aligned_adata.h5ad")  # not named like a slide, and there are slides
    place(tmp_path / "flat-PR2", "A/aligned_adata.h5ad", "B b/aligned_adata.h5ad")  # samples directly
    place(tmp_path / "un named" / "left.half", "Z/aligned_adata.h5ad")  # neither run nor slide number
    return tmp_path


def named(frame):
    return {r["sample_id"]: r for r in frame.collect()}


def all_roots(tree):
    return [str(tree / r) for r in ("XeniumPR1", "flat-PR2", "un named", "absent")]


def test_ids_and_files(spark, tree):
    found = folders.unique_samples(folders.sample_folders(spark, all_roots(tree), run_prefix="XeniumPR{}", run_pattern=r"PR(\d+)"))
    got = named(found)
    assert set(got) == {"XeniumPR1S1ROI1", "XeniumPR1S1ROI2", "XeniumPR1S2ROI1", "XeniumPR2SFLAA", "XeniumPR2SFLAB b", "LEFTHASLEFZ"}
    first, second = got["XeniumPR1S1ROI1"], got["XeniumPR1S1ROI2"]
    assert (first["run"], first["slide"], first["roi"]) == (1, "1", "ROI1")
    assert first["patch_path"].endswith("/ROI1/patches/ROI1.h5") and first["vis_path"].endswith("/ROI1_patch_vis.png")
    assert second["patch_path"].endswith("/ROI2/patches/a.h5") and second["vis_path"] is None
    assert got["LEFTHASLEFZ"]["run"] is None and got["XeniumPR2SFLAA"]["matrix_path"].endswith("/A/aligned_adata.h5ad")


def test_filters_reach_the_listing(spark, tree):
    every = folders.sample_folders(spark, all_roots(tree), run_pattern=r"PR(\d+)")
    plan = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert every.rdd.getNumPartitions() == 4  # a partition a slide
    one = every.where("run = 1 and slide = '2'")
    assert "PushedFilters" in plan(one) and "EqualTo(slide,2)" in plan(one) and "Filter (" not in plan(one)
    assert one.rdd.getNumPartitions() == 1 and [r["roi"] for r in one.collect()] == ["ROI1"]
    assert every.where("roi = 'ROI1'").count() == 2 and every.where("sample_id in ('R1S1ROI2', 'R2SFLAA', 'none')").count() == 2
    assert every.where("run is not null").count() == 5 and every.where("run is null").count() == 1
    assert every.where("run = 1 and run is not null and run = 2").count() == 0
    assert every.where("run > 1").count() == 2  # not pushed, Spark's own filter
    assert every.where("roi = 'ROI1' or run = 2").count() == 4


def test_samples_without_a_run_or_a_root(spark, tmp_path):
    assert folders.sample_folders(spark, [str(tmp_path / "absent")]).count() == 0
    assert folders.sample_folders(spark, []).count() == 0


def test_duplicate_ids_raise(spark, tmp_path):
    place(tmp_path / "a" / "PR1" / "slide1", "ROI1/aligned_adata.h5ad")
    place(tmp_path / "b" / "PR1" / "slide1", "ROI1/aligned_adata.h5ad")
    both = folders.sample_folders(spark, [str(tmp_path / "a" / "PR1"), str(tmp_path / "b" / "PR1")], run_pattern=r"PR(\d+)")
    assert both.count() == 2
    with pytest.raises(PySparkException, match="duplicate sample R1S1ROI1"):
        folders.unique_samples(both).collect()
    assert folders.unique_samples(both.where(F.col("root").contains("/a/"))).count() == 1


def test_missing_assets(spark, tree):
    found = folders.sample_folders(spark, all_roots(tree), run_pattern=r"PR(\d+)").where("run = 1")
    missing = tables.asset_manifest(found, ["matrix", "patch", "vis"], folders.assets_of(found))
    assert {(r["sample_id"], r["kind"]) for r in missing.collect()} == {("R1S1ROI2", "vis"), ("R1S2ROI1", "patch"), ("R1S2ROI1", "vis")}


def test_tables_of_all_samples_in_one_scan(spark, tree):
    points = lambda i: spark.createDataFrame([(i, float(i), "g")], "transcript_id long, x double, gene string")
    points(1).write.parquet(str(tree / "XeniumPR1/slide1/ROI1/transcripts.parquet"))
    points(2).toPandas().to_parquet(str(tree / "flat-PR2/B b/transcripts.parquet"))  # a single file, a blank in its path
    found = folders.sample_folders(spark, all_roots(tree), run_pattern=r"PR(\d+)")
    rows = folders.read_experiments(spark, found, "transcripts")
    assert {(r["sample_id"], r["transcript_id"]) for r in rows.select("sample_id", "transcript_id").collect()} == {("R1S1ROI1", 1), ("R2SFLAB b", 2)}
    plan = rows.where("x > 1").select("sample_id", "transcript_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,1.0)" in plan and "gene" not in plan.split("ReadSchema")[1].split("\n")[0]
    with pytest.raises(ValueError, match="no sample has cells"):
        folders.read_experiments(spark, found, "cells")
    assert folders.read_experiments(spark, found, "cells", "cell_id string").count() == 0
