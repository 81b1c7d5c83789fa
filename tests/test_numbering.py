import numpy as np
import pytest
from pyspark.sql import functions as F

from slidegrid.operators import metrics, report, writeback
from slidegrid.operators.numbering import PART, in_order, numbered, running_sum
from slidegrid.operators.quantiles import exact_quantiles


def test_one_group_over_many_partitions(spark):
    df = spark.range(20_000).select(F.lit("s").alias("sample_id"), ((F.col("id") * 7919) % 20_000).alias("key")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = in_order(df, ["sample_id"], ["key"]).groupBy(PART).count().collect()
        got = numbered(df, ["sample_id"], ["key"], "at", size="all").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and max(r["count"] for r in spread) < 15_000
    assert all(r["at"] == r["key"] and r["all"] == 20_000 for r in got) and len(got) == 20_000


def test_groups_nulls_and_descending_order(spark):
    rows = [(g, i, (i * 37) % 101) for g in ("a", None, "b") for i in range(50)] + [("c", 0, 5)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    by = {}
    for g, i, v in rows:
        by.setdefault(g, []).append((v, i))
    want = {(g, i): (k, sum(x for x, _ in sorted(own, reverse=True)[:k])) for g, own in by.items() for k, (_, i) in enumerate(sorted(own, reverse=True))}
    order = [F.desc("v"), F.desc("i")]
    assert {(r["g"], r["i"]): r["at"] for r in numbered(df, ["g"], order).collect()} == {k: n for k, (n, _) in want.items()}
    assert {(r["g"], r["i"]): r["before"] for r in running_sum(df, ["g"], order, "v").collect()} == {k: s for k, (_, s) in want.items()}
    assert numbered(df.where("false"), ["g"], ["i"]).count() == 0
    assert sorted(r["at"] for r in numbered(df, [], ["g", "i"]).collect()) == list(range(151))


def test_offsets_and_placing_use_them(spark):
    counts = spark.createDataFrame([(0, p, f"s{p}", p % 3) for p in range(200)], "split int, pos int, sample_id string, n int")
    got = {r["pos"]: (r["start"], r["stop"]) for r in writeback.offsets(counts).collect()}
    assert got == {p: (sum(q % 3 for q in range(p)), sum(q % 3 for q in range(p + 1))) for p in range(200)}
    obs = spark.range(500).select(F.lit("a").alias("sample_id"), (1000 - F.col("id")).alias("seq"), F.concat(F.lit("o"), (1000 - F.col("id")).cast("string")).alias("obs_id"))
    preds = spark.range(300).select(F.lit("a").alias("sample_id"), (F.col("id") * 3).alias("seq"), F.lit("?").alias("barcode"))
    assert {(r["seq"], r["obs_id"], r["tier"]) for r in writeback.match_spots(preds, obs).collect()} == {(3 * k, f"o{501 + k}", 4) for k in range(300)}


VALUES = {
    "normal": lambda rng: rng.normal(size=5000),
    "skewed": lambda rng: np.exp(30 * rng.normal(size=5000)) * rng.choice([-1, 1], size=5000),
    "outlier": lambda rng: np.append(rng.uniform(size=4999), 1e300),
    "ties": lambda rng: rng.integers(0, 4, size=5000).astype(float),
    "one": lambda rng: np.full(5000, -2.5),
    "near": lambda rng: 1e9 + rng.integers(0, 900, size=5000) * 1e-6,
    "extremes": lambda rng: np.append(rng.normal(size=4000), [1.7e308, -1.7e308, 5e-324, 0.0]),
    "few": lambda rng: np.array([3.0, 1.0]),
}


@pytest.mark.parametrize("direct", [40, 1_000_000])
def test_quantiles_equal_numpy(spark, direct):
    rng, rows, want, passes = np.random.default_rng(8), [], {}, []
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    for name, make in VALUES.items():
        x = make(rng)
        rows += [(None if name == "ties" else name, float(v)) for v in x]
        s = np.sort(x)
        at = [p * (len(x) - 1) for p in ps]
        want[None if name == "ties" else name] = [s[int(np.floor(a))] + (s[int(np.ceil(a))] - s[int(np.floor(a))]) * (a - np.floor(a)) for a in at]
    rows += [("normal", float("nan")), ("normal", None), ("normal", float("inf")), ("void", None)]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(ps))] for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ("g",), ps, direct=direct, passes=passes).collect()}
    assert got == want
    print("open ranges of the passes", passes)
    assert (len(passes) == 1) if direct > 40 else (3 <= len(passes) <= 9)


def test_quantiles_of_all_rows_and_boxes(spark):
    x = np.random.default_rng(2).normal(size=3000)
    df = spark.createDataFrame([("a" if i % 2 else None, float(v)) for i, v in enumerate(x)], "g string, v double")
    row = exact_quantiles(df, "v", (), (0.5,), direct=10).first()
    assert (row["n"], row["q0"]) == (3000, np.quantile(x, 0.5))
    boxes = {r["g"]: r for r in metrics.box_stats(df, "v", ("g",)).collect()}
    for g, own in (("a", x[1::2]), (None, x[::2])):
        q1, q3 = np.quantile(own, [0.25, 0.75])
        held = own[(own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))]
        assert (boxes[g]["n"], boxes[g]["whisker_low"], boxes[g]["whisker_high"]) == (1500, held.min(), held.max())
        assert abs(boxes[g]["q1"] - q1) < 1e-12
    assert report.size_legend(df, "v").first()["middle"] == np.quantile(x, 0.5)


def test_rows_of_a_box_are_not_gathered_by_group(spark, tmp_path):
    spark.range(400_000).select((F.col("id") % 2).cast("string").alias("g"), F.rand(3).alias("v")).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000000")  # less than the rows
    try:
        boxes = metrics.box_stats(spark.read.parquet(f"{tmp_path}/t"), "v", ("g",))
        assert sorted((r["g"], r["n"]) for r in boxes.collect()) == [("0", 200_000), ("1", 200_000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("Initial Plan")[0] and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
