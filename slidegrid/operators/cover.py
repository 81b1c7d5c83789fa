"""Points in polygons by an adaptive cover of square cells.

A polygon starts with the few cells of about its own size that its box meets. Cells that an edge meets are split, `depth` times; those
inside that no edge meets stay whole. So the number of cells depends on a polygon's form, not on its size or that of others: one that
fills a slide and thousands of tiny ones stand side by side. The cover is made polygon by polygon, without a shuffle. Points
meet cells by equi-joins on the sizes that their sample uses; points in whole cells need no test, the others get the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..functions.columns import finite
from ..functions.polygons import EPSILON, point_in_polygon
from ..sources.shared import stored

DEPTH, AT_ONCE = 4, 1 << 20


def _meets(edges: np.ndarray, cells: np.ndarray, width: float) -> np.ndarray:
    """For each cell, whether an edge may meet it (closed, a hair widened): their boxes overlap, and the corners don't all lie on one side of the edge's line."""
    out, (ax, ay, bx, by) = np.zeros(len(cells), bool), edges.T[:, None, :]
    step = max(1, AT_ONCE // len(edges))
    for k in range(0, len(cells), step):
        low = cells[k : k + step] * width
        hair = (np.abs(low).sum(1, keepdims=True) + width) * 1e-9
        (x0, y0), (x1, y1) = ((low - hair).T[:, :, None], (low + width + hair).T[:, :, None])
        overlap = (np.minimum(ax, bx) <= x1) & (np.maximum(ax, bx) >= x0) & (np.minimum(ay, by) <= y1) & (np.maximum(ay, by) >= y0)
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)]
        out[k : k + step] = (overlap & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)).any(1)
    return out


def _inside(edges: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The even-odd rule."""
    out, (ax, ay, bx, by) = np.zeros(len(points), bool), edges.T[:, None, :]
    step = max(1, AT_ONCE // len(edges))
    for k in range(0, len(points), step):
        x, y = points[k : k + step].T[:, :, None]
        out[k : k + step] = (((ay > y) != (by > y)) & (x < ax + (y - ay) * (bx - ax) / (by - ay + EPSILON))).sum(1) % 2 == 1
    return out


def ring_cells(x: np.ndarray, y: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(levels, cells, whole) of a ring: cells of width 2**level at level-wide steps from the origin."""
    extent = max(x.max() - x.min(), y.max() - y.min())
    level = int(np.ceil(np.log2(extent))) if extent > 0 else 0
    edges = np.stack([x, y, np.roll(x, 1), np.roll(y, 1)], 1)
    first, last = (np.floor(np.array([f(x), f(y)]) / 2.0**level).astype(np.int64) for f in (np.min, np.max))
    cells = np.stack(np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(first, last, strict=True)), indexing="ij"), -1).reshape(-1, 2)
    out = []
    for step in range(depth + 1):
        if step:
            level -= 1
            cells = (cells[:, None, :] * 2 + np.array([[0, 0], [0, 1], [1, 0], [1, 1]])).reshape(-1, 2)
        met = _meets(edges, cells, 2.0**level)
        free = cells[~met]
        free = free[_inside(edges, (free + 0.5) * 2.0**level)]
        out.append((np.full(len(free), level), free, np.ones(len(free), bool)))
        cells = cells[met]
    out.append((np.full(len(cells), level), cells, np.zeros(len(cells), bool)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cover(polygons: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """polygons with level, cx, cy and `whole` (no point of the cell needs a test; such rows have no ring), a row for each cell. Rings
    with fewer than three or with non-finite vertices have no cells."""
    at = polygons.columns.index("ring")
    more = [StructField("level", IntegerType()), StructField("cx", LongType()), StructField("cy", LongType()), StructField("whole", BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ring in enumerate(batch.column(at)):
                if not ring.is_valid or len(ring.values) < 3 or ring.values.null_count:
                    continue
                x, y = (ring.values.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
                if not (np.isfinite(x).all() and np.isfinite(y).all()):
                    continue
                levels, cells, whole = ring_cells(x, y, depth)
                rows = [c.take(pa.array(np.full(len(levels), i), mask=whole if k == at else None)) for k, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(levels, pa.int32()), pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(whole)], [*batch.schema.names, *[f.name for f in more]])

    return polygons.mapInArrow(run, StructType([*[StructField(f.name, f.dataType) for f in polygons.schema.fields], *more]))


def points_in_polygons(points: DataFrame, polygons: DataFrame, *, depth: int = DEPTH, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the polygons (sample_id, polygon_id, ring of x and y, ...) of their sample that hold them; points without finite coordinates are in none."""
    cells = stored(cover(polygons, depth=depth))
    levels = cells.groupBy("sample_id").agg(F.collect_set("level").alias("_levels"))  # a row for each sample
    at = lambda c: F.floor(F.col(c).cast("double") / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    placed = points.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double"))).join(levels, "sample_id")
    placed = placed.withColumn("level", F.explode("_levels")).drop("_levels").withColumns({"cx": at(x), "cy": at(y)})
    met = placed.join(cells, ["sample_id", "level", "cx", "cy"])
    return met.where(F.col("whole") | point_in_polygon(F.col(x), F.col(y), F.col("ring"))).drop("level", "cx", "cy", "whole", "ring")
