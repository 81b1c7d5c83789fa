"""The k nearest patches of each seed, by a quadtree of counts.

Each sample's square is halved `depth` times. Cells of all sizes have their number of patches; a leaf is the largest cell with
at most `leaf` patches, so dense regions have small leaves and sparse ones large leaves, with the box of their patches.

For a seed, the smallest cell size at which the cell and its eight neighbours hold k patches bounds the distance of the
k-th one. Only leaves that this circle meets are looked at, and of these, in the order of their farthest corners, so many
as hold k patches give a narrower bound; leaves beyond it go. The seed then meets the patches of the leaves left. So a seed in
a void meets boxes at its rim instead of the patches of its sample, and one in a cluster a few small leaves. All steps
are equi-joins on cells; nothing is ranked but the patches of these leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import finite
from ..sources.shared import stored

LEAF, DEPTH = 64, 16


def _power(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def _cell(at: Column) -> Column:
    return F.floor(at / _power(F.col("bottom"))).cast("long")


def sample_boxes(patches: DataFrame, depth: int) -> DataFrame:
    """sample_id, x0, x1, y0, y1, bottom: the box of each sample, and the smallest cells' width as a power of 2."""
    boxes = patches.groupBy("sample_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return boxes.withColumn("bottom", F.when(extent > 0, F.ceil(F.log2(extent))).otherwise(0).cast("int") + 1 - depth)


def quadtree(located: DataFrame, leaf: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """From patches with their smallest cells (sample_id, fx, fy, x, y): the counts of all cells (sample_id, j, cx, cy, held), and
    for each smallest cell its leaf (lj, lx, ly) with n and the box of its patches. j counts doublings of the smallest width."""
    fine = stored(located.groupBy("sample_id", "fx", "fy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    path = fine.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(depth)))).select("*", F.expr("shiftright(fx, j)").alias("cx"), F.expr("shiftright(fy, j)").alias("cy"))
    counts = stored(path.groupBy("sample_id", "j", "cx", "cy").agg(F.sum("n").alias("held")))
    largest = path.join(counts.where(F.col("held") <= leaf), ["sample_id", "j", "cx", "cy"]).groupBy("sample_id", "fx", "fy").agg(F.max("j").alias("lj"))
    leaves = fine.join(largest, ["sample_id", "fx", "fy"], "left").withColumn("lj", F.coalesce("lj", F.lit(0)))
    return counts, stored(leaves.select("*", F.expr("shiftright(fx, lj)").alias("lx"), F.expr("shiftright(fy, lj)").alias("ly")))


def _circles(seeds: DataFrame, counts: DataFrame, k: int, depth: int) -> DataFrame:
    """seeds with `reach`, within which of their nearest point of the sample's box (px, py) all k nearest patches lie, and `far`, the same from the seed itself."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    around = counts.withColumn("s", step).groupBy("sample_id", "j", (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy")).agg(F.sum("held").alias("held")).where(F.col("held") >= k)
    levels = seeds.select("sample_id", "id", _cell(F.col("px")).alias("fx"), _cell(F.col("py")).alias("fy"), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("j"))
    levels = levels.select("sample_id", "id", "j", F.expr("shiftright(fx, j)").alias("cx"), F.expr("shiftright(fy, j)").alias("cy"))
    least = levels.join(around, ["sample_id", "j", "cx", "cy"]).groupBy("id").agg(F.min("j").alias("level"))
    out = seeds.join(least, "id", "left").withColumn("level", F.coalesce("level", F.lit(depth)))
    width, off = _power(F.col("bottom") + F.col("level")), F.hypot(F.col("seed_x") - F.col("px"), F.col("seed_y") - F.col("py"))
    return out.withColumns({"reach": F.sqrt(4 * 2**0.5 * width * off + 8 * width * width) * (1 + 1e-9), "far": (off + 2 * 2**0.5 * width) * (1 + 1e-9)})


def _leaves_near(seeds: DataFrame, leaves: DataFrame, k: int, depth: int) -> DataFrame:
    """id, sample_id, lj, lx, ly: the leaves that may hold one of the seed's k nearest patches."""
    level = F.least(F.lit(depth), F.greatest(F.col("level"), F.ceil(F.log2(F.col("reach") / _power(F.col("bottom")))).cast("int") - 1))
    seeds = seeds.withColumn("at", level)
    cell = lambda v: F.floor(v / _power(F.col("bottom") + F.col("at"))).cast("long")
    span = lambda p, low, high: F.sequence(cell(F.greatest(F.col(p) - F.col("reach"), F.col(low))), cell(F.least(F.col(p) + F.col("reach"), F.col(high))))
    seeds = seeds.withColumns({"xs": span("px", "x0", "x1"), "ys": span("py", "y0", "y1")})
    # cells of the size `at`, and the larger cells around them for leaves larger than that
    up = "transform(sequence(at, {depth}), i -> array_distinct(flatten(transform(xs, x -> transform(ys, y -> struct(i AS j, shiftright(x, i - at) AS cx, shiftright(y, i - at) AS cy))))))"
    asked = seeds.select("id", "sample_id", "seed_x", "seed_y", "far", "at", F.explode(F.flatten(F.expr(up.format(depth=depth)))).alias("c")).select("id", "sample_id", "seed_x", "seed_y", "far", (F.col("c.j") == F.col("at")).alias("whole"), "c.*")
    boxes = leaves.groupBy("sample_id", "lj", "lx", "ly").agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    above = boxes.withColumn("j", F.explode(F.sequence(F.col("lj"), F.lit(depth)))).select("*", F.expr("shiftright(lx, j - lj)").alias("cx"), F.expr("shiftright(ly, j - lj)").alias("cy"))
    met = asked.join(above, ["sample_id", "j", "cx", "cy"]).where(F.col("whole") | (F.col("j") == F.col("lj")))
    outside = lambda s, low, high: F.greatest(F.col(low) - F.col(s), F.col(s) - F.col(high), F.lit(0.0))
    across = lambda s, low, high: F.greatest(F.abs(F.col(low) - F.col(s)), F.abs(F.col(high) - F.col(s)))
    square = lambda f: f("seed_x", "x0", "x1") * f("seed_x", "x0", "x1") + f("seed_y", "y0", "y1") * f("seed_y", "y0", "y1")
    met = met.withColumns({"least": square(outside), "most": square(across)}).where(F.col("least") <= F.col("far") * F.col("far"))
    held = F.sum("n").over(W.partitionBy("id").orderBy("most").rowsBetween(W.unboundedPreceding, 0))
    enough = F.min(F.when(F.col("held") >= k, F.col("most"))).over(W.partitionBy("id"))
    kept = met.withColumn("held", held).withColumn("enough", F.coalesce(enough, F.lit(float("inf")))).where(F.col("least") <= F.col("enough"))
    return kept.select("id", "sample_id", "lj", "lx", "ly", "seed_x", "seed_y")


def knn(patches: DataFrame, seeds: DataFrame, k: int, *, leaf: int = LEAF, depth: int = DEPTH, tally: list | None = None) -> DataFrame:
    """All columns of patches (sample_id, seq, x, y, ...) and seeds (sample_id, seed, seed_x, seed_y, ...) with d2 and rank: the k
    patches nearest to each seed row in its sample, by squared distance, then seq. Rows without finite coordinates take no
    part; a sample with fewer patches gives all. tally gets the number of patches that were compared with seeds."""
    patches = patches.where(finite(F.col("x").cast("double")) & finite(F.col("y").cast("double")))
    seeds = seeds.where(finite(F.col("seed_x").cast("double")) & finite(F.col("seed_y").cast("double")))
    place = lambda df, *names: [F.col(n).cast("double").alias(n) for n in names]
    rows = stored(patches.select("sample_id", *place(patches, "x", "y"), F.col("seq").alias("seq"), F.struct(*patches.columns).alias("patch")))
    boxes = sample_boxes(rows, depth)  # a row for each sample
    located = rows.join(boxes.select("sample_id", "bottom"), "sample_id").withColumns({"fx": _cell(F.col("x")), "fy": _cell(F.col("y"))})
    counts, leaves = quadtree(located.select("sample_id", "fx", "fy", "x", "y"), leaf, depth)
    known = seeds.select("sample_id", *place(seeds, "seed_x", "seed_y"), F.struct(*[c for c in seeds.columns if c != "sample_id"]).alias("asked")).withColumn("id", F.monotonically_increasing_id())
    known = stored(known)
    inside = lambda s, low, high: F.least(F.greatest(F.col(s), F.col(low)), F.col(high))
    near = known.drop("asked").join(boxes, "sample_id").withColumns({"px": inside("seed_x", "x0", "x1"), "py": inside("seed_y", "y0", "y1")})
    kept = _leaves_near(_circles(near, counts, k, depth), leaves, k, depth)
    held = located.select("sample_id", "fx", "fy", "x", "y", "seq", "patch").join(leaves.select("sample_id", "fx", "fy", "lj", "lx", "ly"), ["sample_id", "fx", "fy"])
    met = held.join(kept, ["sample_id", "lj", "lx", "ly"])
    if tally is not None:
        tally.append(met.count())
    dx, dy = F.col("x") - F.col("seed_x"), F.col("y") - F.col("seed_y")
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "seq"))
    best = met.select("id", "seq", "patch", (dx * dx + dy * dy).alias("d2")).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(known.select("id", "asked"), "id").select("patch.*", "asked.*", "d2", "rank")
