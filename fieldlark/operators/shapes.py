"""Checks of annotation shapes as array expressions: one pass over the shapes, no shuffle, no Python.

A null list of points or attributes counts as empty; a null label is unknown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.functions.numbers import drop_repeated_points, line_length, ring_area
from fieldlark.functions.text import is_valid_id

_ISSUE = "struct<severity:string,code:string,detail:string>"


@dataclass(frozen=True)
class Label:
    """What a label's shapes must look like: kind, attribute names in order, allowed values of some."""

    kind: str
    attributes: tuple[str, ...]
    allowed: Mapping[str, Sequence[str]]


def _issue(failed: Column, severity: str, code: str, detail: Column | None = None) -> Column:
    return F.when(failed, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit("") if detail is None else detail).cast("string").alias("detail")))


def crosses_itself(ring: Column) -> Column:
    """Two sides of an open ring that aren't neighbours meet, or a side turns back on the one before (n^2 of its sides)."""
    n = F.size(ring)
    at = lambda i: F.get(ring, i % n)
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def spans(a: Column, b: Column, c: Column, d: Column, axis: str) -> Column:
        return (F.least(a[axis], b[axis]) <= F.greatest(c[axis], d[axis])) & (F.least(c[axis], d[axis]) <= F.greatest(a[axis], b[axis]))

    def meet(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        split = (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) <= 0) & (F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) <= 0)
        return split & spans(a, b, c, d, "x") & spans(a, b, c, d, "y")

    def back(i: Column) -> Column:
        a, b, c = at(i), at(i + 1), at(i + 2)
        return (turn(a, b, c) == 0) & ((b["x"] - a["x"]) * (c["x"] - b["x"]) + (b["y"] - a["y"]) * (c["y"] - b["y"]) < 0)

    sides = F.sequence(F.lit(0), n - 1)
    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    return F.exists(sides, lambda i: back(i) | F.exists(sides, lambda j: apart(i, j) & meet(i, j)))


def attribute_issues(attributes: Column, label: Label) -> Column:
    """Array of issues: names first, their order only if all are there once, then values of known ones."""
    names = F.transform(attributes, lambda a: a["name"])
    want = F.array(*(F.lit(a) for a in label.attributes))
    times = lambda n: F.size(F.filter(names, lambda m: m == n))
    many = lambda xs, code: F.transform(F.array_sort(xs), lambda n: F.struct(F.lit("error").alias("severity"), F.lit(code).alias("code"), n.alias("detail")))
    odd = F.concat(
        many(F.filter(F.array_distinct(names), lambda n: times(n) > 1), "duplicate_attr"),
        many(F.array_except(want, names), "missing_attr"),
        many(F.array_except(names, want), "extra_attr"),
    )
    order = F.when((F.size(odd) == 0) & (names != want), F.array(_issue(F.lit(True), "warning", "attr_order"))).otherwise(F.array().cast(f"array<{_ISSUE}>"))

    def value(a: Column) -> Column:
        v, listed = F.coalesce(a["value"], F.lit("")), F.lit(False)
        bad = F.lit(False)
        for name, values in label.allowed.items():
            listed = listed | (a["name"] == name)
            bad = bad | ((a["name"] == name) & ~v.isin(*values))
        return F.coalesce(_issue(bad, "error", "bad_enum", a["name"]), _issue(~listed & (v == ""), "error", "empty_id", a["name"]), _issue(~listed & (v != F.trim(v)), "error", "id_whitespace", a["name"]))

    known = F.filter(attributes, lambda a: a["name"].isin(*label.attributes))
    return F.concat(odd, order, F.filter(F.transform(known, value), lambda x: x.isNotNull()))


def shape_issues(shapes: DataFrame, labels: Mapping[str, Label], *, side: float, least_area: float, least_length: float, source: str) -> DataFrame:
    """(image, seq, severity, code, detail) of all shapes.

    shapes: image, seq, label, kind (polygon, polyline, box), source, points
    (x, y, x, y ...; a box: two corners) and attributes (array of name, value).
    A shape of an unknown label or the wrong kind has no further check, a
    polygon of too few corners or with crossing sides none of its area.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("points") / 2).cast("int")), lambda i: F.struct(F.get("points", i * 2).alias("x"), F.get("points", i * 2 + 1).alias("y")))
    s = shapes.select("image", "seq", "label", "kind", "source", F.coalesce("points", F.array().cast("array<double>")).alias("points"), F.coalesce("attributes", F.array().cast("array<struct<name:string,value:string>>")).alias("attributes"))
    s = s.withColumn("line", F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    first, last = F.get("line", F.lit(0)), F.get("line", F.size("line") - 1)
    s = s.withColumn("closed", F.coalesce((F.size("line") >= 2) & (first == last), F.lit(False))).withColumn("once", drop_repeated_points(F.col("line")))
    again = (F.size("once") > 1) & (F.get("once", F.lit(0)) == F.get("once", F.size("once") - 1))
    s = s.withColumn("ring", F.when(again, F.slice("once", F.lit(1), F.greatest(F.size("once") - 1, F.lit(0)))).otherwise(F.col("once")))
    s = s.withColumn("corners", F.size(F.array_distinct("line")))
    enough = (F.col("kind") == "polygon") & (F.col("corners") >= 3)
    s = s.withColumn("crosses", F.when(enough, crosses_itself(F.col("ring")))).withColumn("area", F.when(enough & ~F.col("crosses"), ring_area(F.col("ring"))))

    polygon, polyline = F.col("kind") == "polygon", F.col("kind") == "polyline"
    outside = F.exists("points", lambda v: (v < 0) | (v > side))
    geometry = [
        _issue(F.col("source") != source, "warning", "shape_source", F.col("source")),
        _issue(outside, "error", "coord_out_of_range"),
        _issue(polygon & F.col("closed"), "error", "closing_vertex"),
        _issue((polygon & (F.col("corners") < 3)) | (polyline & (F.col("corners") < 2)), "error", "too_few_vertices", F.col("corners")),
        _issue(enough & (F.size("ring") < F.size("line") - F.col("closed").cast("int")), "warning", "duplicate_vertex"),
        _issue(F.col("crosses"), "error", "invalid_geometry"),
        _issue(F.abs("area") < least_area, "error", "area_too_small"),
        _issue(F.col("area") >= 0, "error", "wrong_orientation"),
        _issue(polyline & (F.col("corners") >= 2) & (line_length(F.col("line")) < least_length), "error", "polyline_too_short"),
        _issue((F.col("kind") == "box") & ~F.coalesce((F.get("points", F.lit(0)) < F.get("points", F.lit(2))) & (F.get("points", F.lit(1)) < F.get("points", F.lit(3))), F.lit(False)), "error", "box_degenerate"),
    ]
    found = F.array(_issue(F.lit(True), "error", "unknown_label", F.col("label")))
    for name, label in labels.items():
        own = F.concat(attribute_issues(F.col("attributes"), label), F.filter(F.array(*geometry), lambda x: x.isNotNull()))
        wrong = F.array(_issue(F.lit(True), "error", "wrong_shape", F.col("kind")))
        found = F.when(F.col("label") == name, F.when(F.col("kind").eqNullSafe(label.kind), own).otherwise(wrong)).otherwise(found)
    return s.select("image", "seq", F.explode(found).alias("issue")).select("image", "seq", "issue.*")


def image_issues(images: DataFrame, *, side: int, ending: str = ".tif") -> DataFrame:
    """(image, code) of images of another size than ``side`` or whose name is no tile id with the ending."""
    size = F.when(~(F.col("width").eqNullSafe(F.lit(side)) & F.col("height").eqNullSafe(F.lit(side))), "image_size")
    base = F.when(F.endswith("image", F.lit(ending)), F.expr(f"substring(image, 1, length(image) - {len(ending)})"))
    name = F.when(~is_valid_id(base, "tile"), "image_name_invalid")
    return images.select("image", F.explode(F.filter(F.array(size, name), lambda x: x.isNotNull())).alias("code"))
