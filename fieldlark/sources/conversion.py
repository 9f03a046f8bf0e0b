"""Annotation documents to typed layers and back.

``document_objects`` checks every shape of a document and puts it into metres;
``to_layers`` makes the four layers of it, ``to_shapes`` the shapes of a
document again, for ``write_annotations``. A shape has tile, label, kind,
points (numbers x, y, x, y, ... in pixels from the tile's upper left corner; a
box has its two corners) and attributes, and ``seq``, its place in the image.

A shape is an object unless its label does not go with its kind, it is a row
without row_id, or its form is too small (a line under ``least_length``, a ring
of fewer than three different points or no area, a box without area): then it
is an issue only. Attributes with blanks around them, other spellings and
synonyms are put right with a warning; missing ones are an error and empty text,
unknown values an error and kept. Outlines that cross themselves are not
repaired. An image that is no known tile, or of another size, raises. Shapes
with equal tile and seq are told apart by nothing and get ids in any order.
"""

from __future__ import annotations

import struct
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldlark.functions.text import padded, parse_tile_id
from fieldlark.operators.geometry import box_ring, drop_repeats, from_wkb, line_length, ring_area, to_wkb
from fieldlark.operators.layers import ENUMS
from fieldlark.session import Steps

#: Label, its kind of shape, its layer, its attributes.
LABELS = {
    "vineyard": ("polygon", "canopies", ("vineyard_id",)),
    "waste": ("box", "waste", ("vineyard_id",)),
    "row": ("polyline", "row_pieces", ("vineyard_id", "row_id", "row_structure")),
    "interrow_area": ("polygon", "interrow_pieces", ("vineyard_id", "interrow_cover")),
}

_ISSUE = "struct<severity:string,code:string,message:string>"
_NO_ISSUES = f"array<{_ISSUE}>"


def _issue(rule: Column, severity: str, code: str, *message: Column) -> Column:
    return F.when(rule, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.concat(*message).alias("message")))


def _spelled(raw: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(raw)), r"[\s\-]+", "_")


def _attribute(name: str, synonyms: Mapping[str, str], needed: Column) -> tuple[Column, list[Column]]:
    """The value put right, and its issues."""
    raw = F.try_element_at("attributes", F.lit(name))
    held = F.coalesce(F.trim(raw), F.lit(""))
    missing = _issue(needed & (held == ""), "error", "missing_attr", F.lit(f"{name} is missing"))
    if name not in ENUMS:
        return held, [missing, _issue((held != "") & (held != raw), "warning", "id_whitespace", F.lit(f"{name} has blanks around it: "), held)]
    known = _spelled(raw)
    if synonyms:
        table = F.create_map(*(F.lit(x) for k, v in sorted(synonyms.items()) for x in (k.strip().lower().replace(" ", "_").replace("-", "_"), v)))
        known = F.when(known.isin(*ENUMS[name]), known).otherwise(F.coalesce(F.try_element_at(table, known), known))
    fits = known.isin(*ENUMS[name])
    value = F.when(held == "", "").when(fits, known).otherwise(raw)
    return value, [missing, _issue((held != "") & fits & (known != raw), "warning", "enum_normalized", F.lit(f"{name} read as "), known), _issue((held != "") & ~fits, "error", "bad_enum", F.lit(f"{name} is not allowed: "), held)]


_FORM = ("geometry", "n_vertices", "distinct", "measure", "bounds", "swapped")


def _form(kind: str | None, flat: np.ndarray | None, x: float, y: float, g: float) -> tuple:
    """What _FORM names, of one shape."""
    px = np.asarray([] if flat is None else flat, float)
    px = px[: len(px) // 2 * 2].reshape(-1, 2)
    px = px[~np.isnan(px).any(axis=1)]
    swapped = False
    if kind == "box":
        swapped = len(px) == 2 and bool((px[0] > px[1]).any())
        px = box_ring(*px.min(0), *px.max(0)) if len(px) == 2 else px[:0]
    px = drop_repeats(px, kind != "polyline")
    if not len(px):
        return None, 0, 0, 0.0, None, False
    m = px * (g, -g) + (x, y)
    bounds = [*px.min(0), *px.max(0)]
    if kind == "polyline":
        return to_wkb("line", m), len(px), len(np.unique(px, axis=0)), line_length(m), bounds, False
    area = ring_area(m)
    return to_wkb("polygon", [m if area >= 0 else m[::-1]]), len(px), len(np.unique(px, axis=0)), abs(area), bounds, swapped


def _plain_forms(line: bool, px: np.ndarray, x: np.ndarray, y: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """(which, forms) of many shapes of one number of points (shapes, points, 2), by whole arrays; shapes with missing or repeated points are left out."""
    m = np.stack((px[:, :, 0] * g[:, None] + x[:, None], px[:, :, 1] * -g[:, None] + y[:, None]), axis=2)
    plain = ~np.isnan(m).any(axis=(1, 2)) & ~np.isnan(px).any(axis=(1, 2)) & (px[:, 1:] != px[:, :-1]).any(axis=2).all(axis=1)
    if not line:
        plain &= (px[:, 0] != px[:, -1]).any(axis=1) & (m[:, 0] != m[:, -1]).any(axis=1)
    px, m = px[plain], m[plain]
    n = px.shape[1]
    ranked = np.sort(px[:, :, 0] + 1j * px[:, :, 1], axis=1)
    distinct = 1 + (ranked[:, 1:] != ranked[:, :-1]).sum(axis=1)
    bounds = np.concatenate((px.min(axis=1), px.max(axis=1)), axis=1)
    if line:
        measure = np.hypot(np.diff(m[:, :, 0], axis=1), np.diff(m[:, :, 1], axis=1)).sum(axis=1)
        head, data = struct.pack("<BII", 1, 2, n), m
    else:
        u, v = m[:, :, 0] - m[:, :1, 0], m[:, :, 1] - m[:, :1, 1]
        area = (u * np.roll(v, -1, axis=1) - np.roll(u, -1, axis=1) * v).sum(axis=1) / 2 if n > 2 else np.zeros(len(m))
        measure, turned = np.abs(area), np.where((area >= 0)[:, None, None], m, m[:, ::-1])
        head, data = struct.pack("<BIII", 1, 3, 1, n + 1), np.concatenate((turned, turned[:, :1]), axis=1)
    raw, size = np.ascontiguousarray(data, "<f8").tobytes(), 16 * data.shape[1]
    forms = [(head + raw[i * size : (i + 1) * size], n, d, f, b, False) for i, (d, f, b) in enumerate(zip(distinct.tolist(), measure.tolist(), bounds.tolist()))]
    return np.flatnonzero(plain), forms


def _batch_forms(kind: pd.Series, points: pd.Series, x0: pd.Series, y0: pd.Series, gsd: pd.Series) -> list[tuple]:
    """_form of all shapes: those of one kind and number of points at once, what is not plain one by one."""
    out: list[tuple | None] = [None] * len(kind)
    alike: dict[tuple, list[int]] = {}
    for i, (k, p) in enumerate(zip(kind, points)):
        if p is not None and len(p) > 3 and (k != "box" or len(p) // 2 == 2):
            alike.setdefault((k if k in ("polyline", "box") else "", len(p) // 2), []).append(i)
    x, y, g = (c.to_numpy(float, na_value=np.nan) for c in (x0, y0, gsd))
    for (k, n), at in alike.items():
        px = np.stack([np.asarray(points.iloc[i][: 2 * n], float) for i in at]).reshape(len(at), n, 2)
        rows, swapped = np.array(at), np.zeros(len(at), bool)
        if k == "box":
            swapped = (px[:, 0] > px[:, 1]).any(axis=1)
            (u0, v0), (u1, v1) = px.min(axis=1).T, px.max(axis=1).T
            px = np.stack([np.column_stack(c) for c in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))], axis=1)
        which, forms = _plain_forms(k == "polyline", px, x[rows], y[rows], g[rows])
        for j, form in zip(which, forms):
            out[at[j]] = (*form[:-1], bool(swapped[j]))
    return [_form(*r) if f is None else f for f, r in zip(out, zip(kind, points, x0, y0, gsd))]


@F.pandas_udf(T.StructType([T.StructField(n, k) for n, k in zip(_FORM, (T.BinaryType(), T.IntegerType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.DoubleType()), T.BooleanType()))]))
def _forms(kind: pd.Series, points: pd.Series, x0: pd.Series, y0: pd.Series, gsd: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_batch_forms(kind, points, x0, y0, gsd), columns=list(_FORM))


def _pixels(kind: str, decimals: int):
    """Geometry to rounded pixels as x, y, x, y, ...; null if the form vanishes."""

    def one(data: bytes, x: float, y: float, g: float) -> np.ndarray | None:
        form, parts = from_wkb(bytes(data))
        m = np.asarray(parts if form == "line" else parts[0], float)
        px = drop_repeats(np.round((m - (x, y)) / (g, -g), decimals) + 0.0, form != "line")
        if kind == "box":
            px = np.array([px.min(0), px.max(0)])
            return px.ravel() if (px[0] < px[1]).all() else None
        return px.ravel() if len(np.unique(px, axis=0)) >= (2 if kind == "polyline" else 3) else None

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(wkb: pd.Series, x0: pd.Series, y0: pd.Series, gsd: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else one(w, x, y, g) for w, x, y, g in zip(wkb, x0, y0, gsd)], dtype=object)

    return run.asNondeterministic()


def document_objects(shapes: DataFrame, tiles: DataFrame, *, side: int = 2048, least_length: float = 0.5, synonyms: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, issues) of shapes (tile, width, height, seq, kind, label, points, attributes); tiles: (tile_id, x0, y0, gsd_m).

    objects: tile_id, seq, label, geometry, n_vertices, measure (length or area, in
    metres), bounds in pixels and the attributes; issues: severity, code, tile_id, object_id, message.
    """
    labels = F.create_map(*(F.lit(x) for k, v in LABELS.items() for x in (k, v[0])))
    known = tiles.select(F.col("tile_id").alias("known_"), "x0", "y0", F.col("gsd_m").alias("gsd"))
    at = shapes.join(known, shapes["tile"].eqNullSafe(F.col("known_")), "left")
    bad = F.col("known_").isNull() | (F.coalesce("width", F.lit(0)) != side) | (F.coalesce("height", F.lit(0)) != side)
    good = F.when(bad, F.raise_error(F.concat(F.lit("no such tile or size: "), F.coalesce("tile", F.lit("null"))))).otherwise(F.lit(True)).cast("boolean")
    at = at.where(good).withColumn("tile_id", F.col("known_"))

    # once per shape, in Arrow: as expressions the steps would be repeated in every column that needs them
    at = at.withColumn("form", _forms.asNondeterministic()("kind", "points", "x0", "y0", "gsd")).select("*", "form.*").drop("form")
    at = at.withColumn("small", F.when(F.col("kind") == "polyline", (F.col("distinct") < 2) | (F.col("measure") < least_length)).otherwise((F.col("distinct") < 3) | (F.col("measure") <= 0)))

    allowed = F.coalesce(F.try_element_at(labels, F.col("label")) == F.col("kind"), F.lit(False))
    values, found = {}, [_issue(~allowed, "error", "schema_violation", F.lit("label and kind do not go together: "), F.coalesce("label", F.lit("null")), F.lit(" as "), F.coalesce("kind", F.lit("null")))]
    for name in ("vineyard_id", "row_id", "row_structure", "interrow_cover"):
        mine = F.col("label").isin(*(k for k, x in LABELS.items() if name in x[2])) & allowed
        value, issues = _attribute(name, synonyms or {}, ~((F.col("label") == "waste") & (F.lit(name) == "vineyard_id")))
        values[name] = F.when(mine, value)
        found += [F.when(mine, i) for i in issues]
    unnamed = (F.col("label") == "row") & (F.coalesce(F.trim(F.try_element_at("attributes", F.lit("row_id"))), F.lit("")) == "")
    found.append(F.when(allowed & ~unnamed, _issue(F.col("small"), "error", "geom_dropped", F.lit("too small: "), F.col("kind"))))
    found.append(F.when(allowed, _issue(F.col("swapped") & ~F.col("small"), "warning", "geom_repaired", F.lit("corners were swapped"))))

    checked = at.withColumns({**values, "found": F.filter(F.array(*found), lambda i: i.isNotNull()).cast(_NO_ISSUES), "usable": allowed & ~unnamed & ~F.col("small")})
    # written, as issues and each layer read it: forms are made once, not once per reader
    checked = Steps(shapes.sparkSession).put("checked", checked.select("tile_id", "seq", "label", "geometry", "n_vertices", "measure", "bounds", "gsd", *values, "found", "usable"))
    name = F.concat(F.coalesce("label", F.lit("null")), F.lit("["), F.col("seq").cast("string"), F.lit("]"))
    issues = checked.select("tile_id", name.alias("object_id"), F.inline("found")).select("severity", "code", "tile_id", "object_id", "message")
    return checked.where("usable").select("tile_id", "seq", "label", "geometry", "n_vertices", "measure", "bounds", "gsd", *values), issues


def to_layers(objects: DataFrame, *, source: str, run_id: str, model_version: str | None = None, clump_area: float = 2.0, edge: float = 1.0, side: int = 2048) -> dict[str, DataFrame]:
    """canopies, row_pieces, interrow_pieces and waste, with ids in the order of the images.

    A canopy's row, cover shares, widths and gaps are left to the operators that
    find them (null or NaN). Waste is numbered over all tiles by (tile, upper
    edge, left edge), from counts per row of tiles and per tile.
    """
    held = {"source": F.lit(source), "run_id": F.lit(run_id), "model_version": F.lit(model_version).cast("string"), "confidence": F.lit(1.0).cast("float"), "qa_flags": F.lit("")}
    of = {k: objects.where(F.col("label") == k) for k in LABELS}
    within = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    nan = F.lit(float("nan"))
    area, n = F.col("measure"), F.col("n_vertices")

    k = within("row_id", "tile_id")
    rows = of["row"].select(
        F.concat("row_id", F.lit("@"), "tile_id", F.when(k > 1, F.concat(F.lit("#"), k.cast("string"))).otherwise("")).alias("piece_id"), "row_id", "vineyard_id", "tile_id", "row_structure",
        F.col("measure").alias("length_m"), nan.alias("max_gap_m"), n.alias("n_vertices"), "geometry", *(c.alias(x) for x, c in held.items()),
    )
    tile = of["vineyard"].withColumn("k", within("tile_id")).withColumns({"near": F.array_min(F.slice("bounds", 1, 2)), "far": F.array_max(F.slice("bounds", 3, 2))})
    canopies = tile.select(
        F.concat("tile_id", F.lit(":C"), padded(F.col("k"), 4)).alias("canopy_id"), "tile_id", "vineyard_id", F.lit(None).cast("string").alias("row_id"), area.alias("area_m2"), n.alias("n_vertices"), nan.alias("along_m"),
        (area > clump_area).alias("is_clump"), ((F.col("near") <= edge) | (F.col("far") >= side - edge)).alias("touches_edge"), "geometry", *(c.alias(x) for x, c in held.items()),
    )
    none = F.lit(None).cast("string")
    lanes = of["interrow_area"].select(
        F.concat("tile_id", F.lit(":I"), padded(within("tile_id"), 3)).alias("piece_id"), none.alias("interrow_id"), "vineyard_id", "tile_id", none.alias("row_left_id"), none.alias("row_right_id"), "interrow_cover",
        nan.alias("veg_frac"), nan.alias("shadow_frac"), area.alias("area_m2"), nan.alias("width_mean_m"), F.lit(0).alias("n_notches"), "geometry", *(c.alias(x) for x, c in held.items()),
    )

    px = {c: F.get("bounds", F.lit(i)) for i, c in enumerate(("px_xtl", "px_ytl", "px_xbr", "px_ybr"))}
    w = of["waste"].withColumns(px).withColumn("line_", parse_tile_id(F.col("tile_id"))["row"])
    per = w.groupBy("line_", "tile_id").agg(F.count(F.lit(1)).alias("n_"))
    lines = per.groupBy("line_").agg(F.sum("n_").alias("m_"))
    before = lines.select(F.col("line_").alias("l_"), (F.sum("m_").over(Window.orderBy("line_")) - F.col("m_")).alias("a_"))  # a row per row of tiles
    base = per.join(before, F.col("line_").eqNullSafe(F.col("l_"))).select("tile_id", (F.col("a_") + F.sum("n_").over(Window.partitionBy("l_").orderBy("tile_id")) - F.col("n_")).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("tile_id").orderBy("px_ytl", "px_xtl", "px_ybr", "px_xbr", "seq"))
    waste = w.withColumn("i_", inside).join(base, "tile_id").select(
        F.concat(F.lit("W"), padded(F.col("base_") + F.col("i_"), 4)).alias("waste_id"), "tile_id", "vineyard_id", nan.alias("dist_block_m"), *px,
        area.alias("area_m2"), F.lit("unknown").alias("category"), F.lit("manual").alias("detector"), F.lit(True).alias("exported"),
        "geometry", *(c.alias(x) for x, c in held.items()),
    )
    return {"canopies": canopies, "row_pieces": rows, "interrow_pieces": lanes, "waste": waste}


#: Key of each layer.
_KEYS = {"canopies": "canopy_id", "row_pieces": "piece_id", "interrow_pieces": "piece_id", "waste": "waste_id"}


def to_shapes(layers: Mapping[str, DataFrame], tiles: DataFrame, *, decimals: int = 2) -> DataFrame:
    """(image, seq, shape, label, points, attributes) of layers, for ``write_annotations``: by layer in the order of LABELS, then by key.

    Coordinates are rounded; forms that vanish by it (fewer than two or three
    different points, a box without extent) go. Geometries lie within their tile.
    """
    at = tiles.select("tile_id", "x0", "y0", F.col("gsd_m").alias("gsd"))
    out = []
    for rank, (label, (kind, name, attributes)) in enumerate(LABELS.items()):
        held = F.map_from_arrays(F.array(*map(F.lit, attributes)), F.array(*(F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes)))
        cols = layers[name].select("tile_id", F.col(_KEYS[name]).alias("key"), "geometry", held.alias("attributes")).join(at, "tile_id")
        cols = cols.withColumn("points", _pixels(kind, decimals)("geometry", "x0", "y0", "gsd")).where("points IS NOT NULL")
        seq = F.row_number().over(Window.partitionBy("tile_id").orderBy("key")) + rank * 1_000_000
        out.append(cols.select(F.concat("tile_id", F.lit(".tif")).alias("image"), seq.alias("seq"), F.lit(kind).alias("shape"), F.lit(label).alias("label"), "points", "attributes"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
