import pytest
from pyspark.sql import functions as F

from slidegrid.functions.polygons import exclusion_expr
from slidegrid.operators import rules

CELLS = {
    "a": '[{"type": "corner", "corner": "top-left", "width": 0.2, "height": 0.25, "units": "frac"}, {"type": "strip", "side": "bottom", "size": 7}]',
    "b": "{'type': 'rect', 'xmin': 10, 'xmax': 20, 'ymin': 5, 'ymax': 9},\n{'type': 'trapezoid', 'orientation': 'left', 'top_width': 30, 'bottom_width': 10, 'height': 12, 'center_offset': -4}",
    "c": "{'type': 'trapezoid', 'orientation': 'bottom', 'top_width': 0.5, 'bottom_width': 0.9, 'height': 0.3, 'units': 'frac', 'center_offset': 0.1}",
    "d": "[{'type': 'trapezoid', 'orientation': 'right', 'top_width': 9, 'bottom_width': 44, 'height': 21}, {'type': 'corner', 'corner': 'bottom-right', 'width': 6, 'height': 8}]",
    "e": '{"type": "trapezoid", "top_width": 20, "bottom_width": 4, "height": 15}',
    "f": None,
    "g": " ",
}
SIZES = {s: (60 + 5 * i, 50 + 3 * i) for i, s in enumerate(CELLS)}


def tables_of(spark, cells=CELLS):
    sheet = spark.createDataFrame(list(cells.items()), "sample_id string, crop string")
    samples = spark.createDataFrame([(s, *SIZES[s]) for s in cells if s in SIZES], "sample_id string, width int, height int")
    return rules.rule_rows(sheet, "crop"), samples


def test_each_sample_has_its_own_rules(spark):
    table, samples = tables_of(spark)
    points = [(s, float(x), float(y)) for s, (w, h) in SIZES.items() for x in range(-2, w + 3, 3) for y in range(-2, h + 3, 2)]
    obs = spark.createDataFrame([*points, ("none", 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 1.0)], "sample_id string, x double, y double")
    got = {(r["sample_id"], r["x"], r["y"]): r["excluded"] for r in rules.exclude_by_rules(obs, samples, table, keep_flag=True).where("x is not null and not isnan(x)").collect()}
    parsed = {}
    for r in table.collect():
        parsed.setdefault(r["sample_id"], []).append({k: v for k, v in r.asDict().items() if v is not None and k not in ("sample_id", "rule")})
    assert {s: len(v) for s, v in parsed.items()} == {"a": 2, "b": 2, "c": 1, "d": 2, "e": 1}
    for s, (w, h) in SIZES.items():  # the rules as literals of the plan
        box = (F.lit(0.0), F.lit(float(w)), F.lit(0.0), F.lit(float(h)))
        want = obs.where((F.col("sample_id") == s) & F.col("x").isNotNull() & ~F.isnan("x")).withColumn("e", exclusion_expr(parsed.get(s, []), F.col("x"), F.col("y"), box)).collect()
        assert all(got[s, r["x"], r["y"]] == r["e"] for r in want), s
        assert (s in parsed) == any(r["e"] for r in want)
    assert got["none", 1.0, 1.0] is False
    assert rules.exclude_by_rules(obs, samples, table).count() == obs.count() - sum(got.values())
    assert rules.exclude_by_rules(obs, samples, table.where("false")).count() == obs.count()


def test_plan_does_not_grow_with_the_rules(spark):
    many = {f"s{i}": CELLS["d"] for i in range(300)}
    sheet = spark.createDataFrame(list(many.items()), "sample_id string, crop string")
    samples = sheet.select("sample_id", F.lit(100).alias("width"), F.lit(100).alias("height"))
    obs = sheet.select("sample_id", F.lit(99.0).alias("x"), F.lit(99.0).alias("y"))
    few = rules.exclude_by_rules(obs.limit(1), samples, rules.rule_rows(sheet.limit(1), "crop"), keep_flag=True)
    whole = rules.exclude_by_rules(obs, samples, rules.rule_rows(sheet, "crop"), keep_flag=True)
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert size(whole) < 1.2 * size(few)
    assert whole.where("excluded").count() == 300


@pytest.mark.parametrize(
    ("cell", "said"),
    [("{'type': 'circle'}", "unknown type"), ("{'type': 'strip', 'side': 'middle', 'size': 1}", "unknown side"), ("{'type': 'strip', 'side': 'top'}", "no size"), ("{'type': 'corner', 'width': 1, 'height': 1}", "unknown corner"),
     ("{'type': 'rect', 'xmin': 1, 'xmax': 2, 'ymin': 0, 'ymax': 1, 'units': 'mm'}", "unknown units"), ("{'type': 'trapezoid', 'orientation': 'up', 'top_width': 1, 'bottom_width': 1, 'height': 1}", "unknown orientation")],
)
def test_bad_rules_raise(spark, cell, said):
    table, samples = tables_of(spark, {"a": cell})
    with pytest.raises(Exception, match=f"{said} in rule 0 of sample a"):
        rules.rule_shapes(table, samples).collect()


def test_sample_without_size_raises(spark):
    table, samples = tables_of(spark, {"zz": CELLS["a"]})
    with pytest.raises(Exception, match="no slide size in rule 0 of sample zz"):
        rules.rule_shapes(table, samples).collect()
