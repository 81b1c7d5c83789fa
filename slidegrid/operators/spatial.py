"""Points, grids and polygons: pooling, clipping, alignment, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.polygons import exclusion_expr


def get_xy(x: str = "x", y: str = "y", fallback_x: str = "pxl_col_in_fullres", fallback_y: str = "pxl_row_in_fullres") -> tuple[Column, Column]:
    return F.coalesce(F.col(x), F.col(fallback_x)), F.coalesce(F.col(y), F.col(fallback_y))


def pool_spots(points: DataFrame, *, sample: str = "sample_id", feature: str = "feature_name", x: str = "he_x", y: str = "he_y", pixel_size_um: float = 1.0, spot_size_um: float = 100.0) -> DataFrame:
    """Counts by square bin and feature; one shuffle, with partial counts before it, so a large sample does no harm."""
    step = spot_size_um / pixel_size_um
    cell = lambda c: F.floor(F.col(c) / step).cast("int")
    binned = points.select(F.col(sample).alias("sample_id"), cell(y).alias("array_row"), cell(x).alias("array_col"), F.col(feature).alias("feature"))
    counted = binned.groupBy("sample_id", "array_row", "array_col", "feature").agg(F.count("*").alias("value"))
    middle = lambda c: (F.col(c) + 0.5) * step
    return counted.select("sample_id", "array_row", "array_col", middle("array_col").alias("x"), middle("array_row").alias("y"), "feature", "value")


def pool_cells(cells: DataFrame, *, cell_type: str = "cell_type", x: str = "cell_centroid_x", y: str = "cell_centroid_y", **options) -> DataFrame:
    return pool_spots(cells, feature=cell_type, x=x, y=y, **options)


def spot_totals(expression: DataFrame, by=("sample_id", "array_row", "array_col"), value: str = "value") -> DataFrame:
    total = F.sum(value)
    return expression.groupBy(*by).agg(total.alias("total_counts"), F.log1p(total.cast("double")).alias("log1p_total_counts"))


def log1p_normalise(expression: DataFrame, *, value: str = "value", library_size: bool = False, target: float = 1e4, by=("sample_id", "obs_id")) -> DataFrame:
    raw = F.col(value).cast("double")
    if library_size:
        total = F.sum(raw).over(W.partitionBy(*by))
        raw = F.coalesce(F.try_divide(raw * target, total), F.lit(0.0))
    return expression.withColumn(value, F.log1p(raw))


def clip_to_slide(obs: DataFrame, samples: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points inside [0, width) x [0, height) of their sample. Spark broadcasts `samples` if it is small."""
    size = samples.select("sample_id", "width", "height")
    return obs.join(size, "sample_id").where((F.col(x) >= 0) & (F.col(x) < F.col("width")) & (F.col(y) >= 0) & (F.col(y) < F.col("height"))).drop("width", "height")


def coord_range(obs: DataFrame, x: str = "x", y: str = "y", by=("sample_id",)) -> DataFrame:
    return obs.groupBy(*by).agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"))


def bbox_filter(obs: DataFrame, cells: DataFrame, margin: float = 400.0, *, x: str = "x", y: str = "y") -> DataFrame:
    """Spots within the box of the sample's cells, widened by margin."""
    box = coord_range(cells)
    inside = F.col(x).between(F.col("x_min") - margin, F.col("x_max") + margin) & F.col(y).between(F.col("y_min") - margin, F.col("y_max") + margin)
    return obs.join(box, "sample_id").where(inside).drop("x_min", "x_max", "y_min", "y_max")


def exclude_spots(obs: DataFrame, samples: DataFrame, rules: list[dict], *, x: str = "x", y: str = "y", keep_flag: bool = False) -> DataFrame:
    """Drop spots that any rule excludes, or flag them; the box is (0, width, 0, height) of the sample."""
    box = (F.lit(0.0), F.col("width").cast("double"), F.lit(0.0), F.col("height").cast("double"))
    judged = obs.join(samples.select("sample_id", "width", "height"), "sample_id").withColumn("excluded", exclusion_expr(rules, F.col(x), F.col(y), box)).drop("width", "height")
    return judged if keep_flag else judged.where("not excluded").drop("excluded")


def affine_align(df: DataFrame, samples: DataFrame, *, x: str = "x_location", y: str = "y_location", out_x: str = "he_x", out_y: str = "he_y") -> DataFrame:
    """Micrometres to pixels, then the sample's forward 3x3 homogeneous matrix a11..a33."""
    cells = [f"a{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
    joined = df.join(samples.select("sample_id", F.col("pixel_size").alias("_px"), *[F.col(c).alias(f"_{c}") for c in cells]), "sample_id")
    px, py = F.col(x) / F.col("_px"), F.col(y) / F.col("_px")
    line = lambda i: F.col(f"_a{i}1") * px + F.col(f"_a{i}2") * py + F.col(f"_a{i}3")
    return joined.withColumn(out_x, line(1) / line(3)).withColumn(out_y, line(2) / line(3)).drop("_px", *[f"_{c}" for c in cells])


def scale_coords(df: DataFrame, pixel_size: float, columns=("x", "y")) -> DataFrame:
    return df.withColumns({c: F.col(c) / pixel_size for c in columns})


def spot_to_display(coords: DataFrame, scale: float, patch: int, x: str = "coord_x", y: str = "coord_y") -> DataFrame:
    """Coordinates on a thumbnail, and the slide's size as its largest coordinate plus a patch."""
    size = coords.groupBy("sample_id").agg((F.max(x) + patch).alias("width"), (F.max(y) + patch).alias("height"))
    return coords.join(size, "sample_id").withColumns({f"{x}_shown": F.col(x) * scale, f"{y}_shown": F.col(y) * scale})


def matrix_to_points(expression: DataFrame, obs: DataFrame) -> DataFrame:
    """A point for each non-zero entry."""
    return expression.where("value > 0").select("sample_id", "obs_id", "gene").join(obs.select("sample_id", "obs_id", "x", "y"), ["sample_id", "obs_id"]).select("sample_id", F.col("gene").alias("feature_name"), F.col("x").alias("x_location"), F.col("y").alias("y_location"))


def smooth_neighbours(expression: DataFrame, obs: DataFrame, radius: int = 1) -> DataFrame:
    """Mean over the existing spots of a (2 radius + 1) square, zeros included.

    Every value is sent to the spots around it and every spot counts the spots around it: two hash aggregates instead
    of a range self-join.
    """
    spots = obs.select("sample_id", "array_row", "array_col").distinct()
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]))
    moved = lambda df, *extra: df.withColumn("s", shift).select("sample_id", (F.col("array_row") + F.col("s.i")).alias("array_row"), (F.col("array_col") + F.col("s.j")).alias("array_col"), *extra)
    around = moved(spots).groupBy("sample_id", "array_row", "array_col").agg(F.count("*").alias("n"))
    sums = moved(expression, "gene", "value").groupBy("sample_id", "array_row", "array_col", "gene").agg(F.sum(F.col("value").cast("double")).alias("total"))
    there = spots.join(around, ["sample_id", "array_row", "array_col"])
    return sums.join(there, ["sample_id", "array_row", "array_col"]).select("sample_id", "array_row", "array_col", "gene", (F.col("total") / F.col("n")).alias("value"))


def reading_order(patches: DataFrame, patch_height: float = 1.0) -> DataFrame:
    """position: row by row from the least y of a sample's patches, then by x and seq. Give the chosen patches only: a row is as
    high as the median step of their y, in whole units and at least 1, or patch_height if all have one y."""
    steps = patches.select("sample_id", "y").distinct().withColumn("step", F.col("y") - F.lag("y").over(W.partitionBy("sample_id").orderBy("y")))
    rows = steps.groupBy("sample_id").agg(F.min("y").alias("_top"), F.coalesce(F.greatest(F.lit(1.0), F.floor(F.median("step"))), F.lit(float(patch_height))).alias("_height"))
    row = F.floor((F.col("y") - F.col("_top")) / F.col("_height"))
    at = F.row_number().over(W.partitionBy("sample_id").orderBy(row, "x", "seq"))
    return patches.join(rows, "sample_id").withColumn("position", at).drop("_top", "_height")


def grid_block(patches: DataFrame, x0: int, y0: int, size: int) -> DataFrame:
    """Patches whose ranks among the sample's distinct x and y lie in a block that starts at (x0, y0), from 0."""
    rank = lambda c: (F.dense_rank().over(W.partitionBy("sample_id").orderBy(c)) - 1)
    axis = lambda c: patches.select("sample_id", c).distinct().withColumn(f"{c}_rank", rank(c))
    out = patches.join(axis("x"), ["sample_id", "x"]).join(axis("y"), ["sample_id", "y"])
    return out.where(F.col("x_rank").between(x0, x0 + size - 1) & F.col("y_rank").between(y0, y0 + size - 1))


def densify(expression: DataFrame, obs: DataFrame, genes: DataFrame) -> DataFrame:
    """Every spot with every listed gene, 0 where there is no value; joined by name. `genes` is a list, not data."""
    keys = [c for c in ("sample_id", "obs_id", "array_row", "array_col") if c in obs.columns and c in expression.columns]
    listed = genes.agg(F.collect_set("gene").alias("_genes"))
    spread = obs.select(*keys).crossJoin(F.broadcast(listed)).withColumn("gene", F.explode("_genes")).drop("_genes")  # one row
    return spread.join(expression.select(*keys, "gene", "value"), [*keys, "gene"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def random_cap(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows, the same ones each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
