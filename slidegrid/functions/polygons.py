"""Exclusion rules and polygons as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-20


def point_in_polygon(x: Column, y: Column, polygon: Column | list[tuple[float, float]]) -> Column:
    """Even-odd rule for a list of vertices, or for an array<struct<x, y>> column; the polygon closes itself."""
    if isinstance(polygon, list):
        ring = list(polygon)
        if len(ring) < 3:
            return F.lit(False)
        crossings = [((F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)) & (x < xi + (y - yi) * ((xj - xi) / (yj - yi + EPSILON))) for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True) if yi != yj]
        return reduce(lambda a, b: a != b, crossings, F.lit(False))

    def flip(inside: Column, i: Column) -> Column:
        a = F.element_at(polygon, i.cast("int"))
        b = F.element_at(polygon, F.when(i > 1, i - 1).otherwise(F.size(polygon)).cast("int"))
        crosses = ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"] + EPSILON))
        return inside != crosses

    return F.when(F.size(polygon) < 3, False).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(polygon)), F.lit(False), flip))


def _size(rule: dict, name: str, whole: Column) -> Column:
    value = rule.get(name)
    if value is None:
        raise ValueError(f"rule {rule} lacks {name}")
    if rule.get("units", "px") not in ("px", "frac"):
        raise ValueError(f"unknown units in {rule}")
    return whole * float(value) if rule.get("units") == "frac" else F.lit(float(value))


def exclusion_expr(rules: list[dict], x: Column, y: Column, bbox: tuple[Column, Column, Column, Column]) -> Column:
    """True where any rule excludes the point. bbox: xmin, xmax, ymin, ymax."""
    return reduce(lambda a, b: a | b, [_rule(r, x, y, bbox) for r in rules], F.lit(False))


def _rule(rule: dict, x: Column, y: Column, bbox) -> Column:
    x0, x1, y0, y1 = bbox
    w, h = x1 - x0, y1 - y0
    kind = rule.get("type")
    if kind == "corner":
        cut_x, cut_y = _size(rule, "width", w), _size(rule, "height", h)
        where = {"top-left": (x < x0 + cut_x, y < y0 + cut_y), "top-right": (x > x1 - cut_x, y < y0 + cut_y), "bottom-left": (x < x0 + cut_x, y > y1 - cut_y), "bottom-right": (x > x1 - cut_x, y > y1 - cut_y)}
        if rule.get("corner") not in where:
            raise ValueError(f"unknown corner in {rule}")
        a, b = where[rule["corner"]]
        return a & b
    if kind == "strip":
        sides = {"top": lambda: y < y0 + _size(rule, "size", h), "bottom": lambda: y > y1 - _size(rule, "size", h), "left": lambda: x < x0 + _size(rule, "size", w), "right": lambda: x > x1 - _size(rule, "size", w)}
        if rule.get("side") not in sides:
            raise ValueError(f"unknown side in {rule}")
        return sides[rule["side"]]()
    if kind == "rect":
        at = (lambda name, low, size: low + _size(rule, name, size)) if rule.get("units") == "frac" else (lambda name, low, size: _size(rule, name, size))
        return x.between(at("xmin", x0, w), at("xmax", x0, w)) & y.between(at("ymin", y0, h), at("ymax", y0, h))
    if kind == "trapezoid":
        return _trapezoid(rule, x, y, bbox)
    raise ValueError(f"unknown rule type in {rule}")


def _trapezoid(rule: dict, x: Column, y: Column, bbox) -> Column:
    """The wide or narrow `top_width` lies on the named edge, `bottom_width` inside at depth `height`."""
    x0, x1, y0, y1 = bbox
    side = rule.get("orientation", "top")
    if side not in ("top", "bottom", "left", "right"):
        raise ValueError(f"unknown orientation in {rule}")
    upright = side in ("top", "bottom")
    along, depth = (x1 - x0, y1 - y0) if upright else (y1 - y0, x1 - x0)
    top, bottom, deep = _size(rule, "top_width", along), _size(rule, "bottom_width", along), _size(rule, "height", depth)
    offset = _size(rule, "center_offset", along) if rule.get("center_offset") is not None else F.lit(0.0)
    middle = ((x0 + x1) if upright else (y0 + y1)) / 2 + offset
    edge, inner = {"top": (y0, y0 + deep), "bottom": (y1, y1 - deep), "left": (x0, x0 + deep), "right": (x1, x1 - deep)}[side]
    corners = [(middle - top / 2, edge), (middle + top / 2, edge), (middle + bottom / 2, inner), (middle - bottom / 2, inner)]
    points = [F.struct((a if upright else b).alias("x"), (b if upright else a).alias("y")) for a, b in corners]
    return point_in_polygon(x, y, F.array(*points))
