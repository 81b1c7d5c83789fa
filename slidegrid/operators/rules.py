"""Exclusion rules as rows: a table of rules per sample, whose shapes are built from its columns.

No rule is part of the plan: a table of any number of samples and rules gives one plan, and Spark sends the shapes out if
they are few or joins them by sample otherwise. A spot has all shapes of its sample in one array, so it stays one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.polygons import point_in_polygon
from ..sources.tables import parse_rules

TEXTS = ("type", "corner", "side", "orientation", "units")
NUMBERS = ("width", "height", "size", "xmin", "xmax", "ymin", "ymax", "top_width", "bottom_width", "center_offset")


def rule_rows(sheet: DataFrame, cell: str, *, sample: str = "sample_id") -> DataFrame:
    """sample_id, rule (from 0) and the columns TEXTS and NUMBERS, from a sheet with rule text in a cell: a list, an object or
    several {...} blocks. Empty cells give no rows; text without rules, and numbers that are none, raise."""
    rows = sheet.select(F.col(sample).alias("sample_id"), F.posexplode(parse_rules(F.col(cell))).alias("rule", "m"))
    part = lambda n: F.try_element_at("m", F.lit(n))
    return rows.select("sample_id", "rule", *[part(n).alias(n) for n in TEXTS], *[part(n).cast("double").alias(n) for n in NUMBERS])


CHOICES = {"corner": ("corner", "top-left", "top-right", "bottom-left", "bottom-right"), "strip": ("side", "top", "bottom", "left", "right"), "trapezoid": ("orientation", "top", "bottom", "left", "right")}
NEEDS = {"corner": ("width", "height"), "strip": ("size",), "rect": ("xmin", "xmax", "ymin", "ymax"), "trapezoid": ("top_width", "bottom_width", "height")}


def _problem() -> Column:
    """What is wrong with a rule, or null."""
    of = F.col("type")
    found = [F.when(F.col("w").isNull() | F.col("h").isNull(), "no slide size"), F.when(~F.col("units").isin("px", "frac"), "unknown units"), F.when(of.isNull() | ~of.isin(*NEEDS), "unknown type")]
    found += [F.when((of == kind) & (F.col(name).isNull() | ~F.col(name).isin(*choices)), f"unknown {name}") for kind, (name, *choices) in CHOICES.items()]
    return F.coalesce(*found, *[F.when((of == kind) & F.col(n).isNull(), f"no {n}") for kind, names in NEEDS.items() for n in names])


def rule_shapes(rules: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id and `shape` for each rule: a box (left, right, low, high; open for corners and strips, closed for rectangles) or a
    ring. samples: sample_id, width, height. Unknown types, corners, sides, orientations and units, missing numbers and samples
    without a size raise."""
    size = samples.select(F.col("sample_id").alias("_of"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    rows = rules.join(size, F.col("sample_id").eqNullSafe(F.col("_of")), "left").withColumns({"units": F.coalesce("units", F.lit("px")), "orientation": F.coalesce("orientation", F.lit("top"))})
    said = F.concat(F.col("problem"), F.lit(" in rule "), F.col("rule").cast("string"), F.lit(" of sample "), F.coalesce(F.col("sample_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("problem", _problem()).withColumn("type", F.when(F.col("problem").isNull(), F.col("type")).otherwise(F.raise_error(said)))
    upright = (F.col("type") != "trapezoid") | F.col("orientation").isin("top", "bottom")
    rows = rows.withColumns({"along": F.when(upright, F.col("w")).otherwise(F.col("h")), "deep": F.when(upright, F.col("h")).otherwise(F.col("w")), "upright": upright})
    share = F.col("units") == "frac"
    scaled = {n: F.when(share, F.col(n) * F.col(of)).otherwise(F.col(n)) for n, of in (("width", "along"), ("height", "deep"), ("xmin", "along"), ("xmax", "along"), ("ymin", "deep"), ("ymax", "deep"), ("top_width", "along"), ("bottom_width", "along"), ("center_offset", "along"))}
    where = {"corner": F.col("corner"), "strip": F.col("side"), "trapezoid": F.col("orientation")}
    across = F.when(share, F.col("size") * F.when(F.col("side").isin("left", "right"), F.col("w")).otherwise(F.col("h"))).otherwise(F.col("size"))
    at = F.coalesce(*[F.when(F.col("type") == kind, c) for kind, c in where.items()], F.lit(""))
    rows = rows.withColumns({**scaled, "size": across, "at": at})
    kind, far = F.col("type"), F.lit(float("inf"))
    # how far the shape reaches in from an edge: corners by width and height, strips by size
    reach_x, reach_y = (F.when(kind == "strip", F.col("size")).otherwise(F.col(c)) for c in ("width", "height"))
    on = lambda *sides: F.col("at").isin(*sides)
    left = F.when(kind == "rect", F.col("xmin")).when(on("right", "top-right", "bottom-right"), F.col("w") - reach_x).otherwise(-far)
    right = F.when(kind == "rect", F.col("xmax")).when(on("left", "top-left", "bottom-left"), reach_x).otherwise(far)
    low = F.when(kind == "rect", F.col("ymin")).when(on("bottom", "bottom-left", "bottom-right"), F.col("h") - reach_y).otherwise(-far)
    high = F.when(kind == "rect", F.col("ymax")).when(on("top", "top-left", "top-right"), reach_y).otherwise(far)
    # a trapezoid's top lies on the named edge, its bottom inside
    middle, far_edge = F.col("along") / 2 + F.coalesce("center_offset", F.lit(0.0)), on("bottom", "right")
    edge, inner = F.when(far_edge, F.col("deep")).otherwise(0.0), F.when(far_edge, F.col("deep") - F.col("height")).otherwise(F.col("height"))
    ends = [(middle - F.col("top_width") / 2, edge), (middle + F.col("top_width") / 2, edge), (middle + F.col("bottom_width") / 2, inner), (middle - F.col("bottom_width") / 2, inner)]
    point = lambda a, b: F.struct(F.when(F.col("upright"), a).otherwise(b).alias("x"), F.when(F.col("upright"), b).otherwise(a).alias("y"))
    ring = F.when(kind == "trapezoid", F.array(*[point(a, b) for a, b in ends]))
    box = {"closed": kind == "rect", "left": left, "right": right, "low": low, "high": high, "ring": ring}
    return rows.select("sample_id", F.struct(*[c.alias(n) for n, c in box.items()]).alias("shape"))


def _inside(shape: Column, x: Column, y: Column) -> Column:
    open_ = (x > shape["left"]) & (x < shape["right"]) & (y > shape["low"]) & (y < shape["high"])
    closed = (x >= shape["left"]) & (x <= shape["right"]) & (y >= shape["low"]) & (y <= shape["high"])
    return F.when(shape["ring"].isNotNull(), point_in_polygon(x, y, shape["ring"])).when(shape["closed"], closed).otherwise(open_)


def exclude_by_rules(obs: DataFrame, samples: DataFrame, rules: DataFrame, *, x: str = "x", y: str = "y", keep_flag: bool = False) -> DataFrame:
    """Drop the spots that any rule of their own sample excludes, or flag them in `excluded`. Samples without rules, and spots without coordinates, keep all."""
    shapes = rule_shapes(rules, samples).groupBy(F.col("sample_id").alias("_sample")).agg(F.collect_list("shape").alias("_shapes"))
    joined = obs.join(shapes, F.col("sample_id").eqNullSafe(F.col("_sample")), "left")
    hit = F.coalesce(F.exists("_shapes", lambda s: F.coalesce(_inside(s, F.col(x).cast("double"), F.col(y).cast("double")), F.lit(False))), F.lit(False))
    judged = joined.withColumn("excluded", hit).drop("_sample", "_shapes")
    return judged if keep_flag else judged.where("not excluded").drop("excluded")
