"""Readers and writers of layers, GeoJSON, annotation XML, reports, archives, masks and annotation JSON.

All read through Spark's file sources, so any path that Spark reads will do;
formats without a reader are parsed from ``binaryFile`` or ``wholetext`` rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.functions.text import format_fixed, normalize_enum
from fieldlark.operators.layers import Layer, coerce_layer, validate_layer

# --- layers ------------------------------------------------------------------------------------------------


def write_layer(df: DataFrame, spec: Layer, path: str) -> None:
    """Coerced, validated, one committed write."""
    validate_layer(coerce_layer(df, spec), spec).write.mode("overwrite").parquet(path)


def read_layer(spark: SparkSession, spec: Layer, path: str, *, validate: bool = True) -> DataFrame:
    df = spark.read.schema(spec.schema).parquet(path)
    return validate_layer(df, spec) if validate else df


def write_bundle(layers: dict[str, tuple[DataFrame, Layer]], folder: str, meta: dict[str, str]) -> None:
    """Several layers and a meta row with their counts."""
    spark = next(iter(layers.values()))[0].sparkSession
    for name, (df, spec) in layers.items():
        write_layer(df, spec, f"{folder}/{name}")
    counts = {name: spark.read.parquet(f"{folder}/{name}").count() for name in layers}
    spark.createDataFrame([(meta, counts)], "meta map<string,string>, counts map<string,bigint>").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def read_bundle(spark: SparkSession, specs: dict[str, Layer], folder: str, *, validate: bool = True) -> dict[str, DataFrame]:
    return {name: read_layer(spark, spec, f"{folder}/{name}", validate=validate) for name, spec in specs.items()}


def latest_run(runs: DataFrame, source: str, run: str, at: str) -> DataFrame:
    """The newest run of each source."""
    return runs.groupBy(source).agg(F.max_by(run, F.struct(at, run)).alias(run))


# --- GeoJSON -----------------------------------------------------------------------------------------------


def read_geojson(spark: SparkSession, path: str, properties: str, *, epsg: int | None = None) -> DataFrame:
    """(kind, coordinates as JSON text, properties by schema) of a FeatureCollection; another declared CRS raises."""
    schema = f"type string, crs struct<properties:struct<name:string>>, features array<struct<type:string, geometry:struct<type:string, coordinates:string>, properties:struct<{properties}>>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    if epsg is not None:
        name = F.col("crs.properties.name")
        doc = doc.where(F.when(name.isNotNull() & ~name.rlike(rf"(^|\D){epsg}$"), F.raise_error(F.concat(F.lit("unexpected CRS "), name))).otherwise(F.lit(True)).cast("boolean"))
    return doc.select(F.explode("features").alias("f")).select(F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def feature(kind: Column, coordinates: Column, properties: Sequence[str]) -> Column:
    """One Feature as JSON text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_geojson_lines(df: DataFrame, kind: str, coordinates: str, properties: Sequence[str], path: str) -> None:
    """A Feature per line, for layers of any size. coordinates: nested arrays of numbers."""
    df.select(feature(F.lit(kind), F.col(coordinates), properties).alias("value")).write.mode("overwrite").text(path)


def geojson_collection(df: DataFrame, kind: str, coordinates: str, properties: Sequence[str], order: str, *, epsg: int) -> DataFrame:
    """One FeatureCollection as text, for small layers: features in order, the CRS named."""
    one = df.select(F.struct(F.col(order).alias("o"), feature(F.lit(kind), F.col(coordinates), properties).alias("f")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = f'{{"type":"FeatureCollection","crs":{{"type":"name","properties":{{"name":"EPSG:{epsg}"}}}},"features":['
    return one.select(F.concat(F.lit(head), F.array_join(F.transform("xs", lambda x: x["f"]), ","), F.lit("]}")).alias("value"))


# --- annotation XML ----------------------------------------------------------------------------------------

_SHAPE = "struct<_label:string,_points:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double,_rle:string,_left:int,_top:int,_width:int,_height:int,attribute:array<struct<_VALUE:string,_name:string>>>"


def read_annotations(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, image, width, height, seq, shape, label, points, box, rle, attributes) of every shape of the exports; seq counts lines, then polygons, boxes, masks."""
    kinds = ("polyline", "polygon", "box", "mask")
    schema = "_name string, _width int, _height int, " + ", ".join(f"{k} array<{_SHAPE}>" for k in kinds)
    images = spark.read.format("xml").option("rowTag", "image").schema(schema).load(list(paths)).withColumn("file", F.col("_metadata.file_name"))

    def tagged(kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), F.array().cast(f"array<{_SHAPE}>")), lambda s: F.struct(F.lit(kind).alias("shape"), s.alias("s")))

    each = F.concat(*map(tagged, kinds))
    number = F.transform(F.split("x.s._points", "[;,]"), lambda v: v.try_cast("double"))
    attributes = F.map_from_entries(F.transform(F.coalesce("x.s.attribute", F.array().cast("array<struct<_VALUE:string,_name:string>>")), lambda a: F.struct(F.trim(a["_name"]), F.trim(a["_VALUE"]))))
    return images.select("file", F.col("_name").alias("image"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.posexplode(each).alias("seq", "x")).select(
        "file", "image", "width", "height", "seq", "x.shape", F.col("x.s._label").alias("label"), number.alias("points"),
        F.when(F.col("x.s._xtl").isNotNull(), F.array("x.s._xtl", "x.s._ytl", "x.s._xbr", "x.s._ybr")).alias("box"),
        F.col("x.s._rle").alias("rle"), F.array("x.s._left", "x.s._top", "x.s._width", "x.s._height").alias("frame"), attributes.alias("attributes"),
    )


def last_copy_wins(shapes: DataFrame, order: DataFrame) -> DataFrame:
    """Shapes of each image from the last file that has it. order: (file, seq), few rows."""
    last = shapes.select("file", "image").distinct().join(F.broadcast(order), "file").groupBy("image").agg(F.max_by("file", "seq").alias("file"))
    return shapes.join(last, ["file", "image"], "left_semi")


def clean_attribute(attributes: Column, name: str, allowed: Sequence[str], synonyms: dict[str, str] | None = None) -> Column:
    return normalize_enum(F.try_element_at(attributes, F.lit(name)), allowed, synonyms)


def _rooted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A root around the lines of a partition, which become a file: readers stop after a first element without one."""
    held, first = pd.DataFrame({"value": [""]}), True
    for g in batches:
        if len(g):
            if not first:
                yield held
            held = g if not first else g.assign(value=["<annotations>" + g["value"].iloc[0], *g["value"].iloc[1:]])
            first = False
    if first:
        held = pd.DataFrame({"value": ["<annotations>"]})
    yield held.assign(value=[*held["value"].iloc[:-1], held["value"].iloc[-1] + "</annotations>"])


def write_annotations(shapes: DataFrame, path: str, *, decimals: int = 2) -> None:
    """Files with a root of their own and an <image> element per line, shapes and attributes in order. shapes: (image, seq, shape, label, points, attributes), width and height if there are any; a box has its corners as points."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = F.size("points") / 2
    pair = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.concat_ws(",", *(F.format_string(f"%.{decimals}f", F.get("points", i * 2 + k)) for k in (0, 1))))
    inner = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit('<attribute name="'), esc(e["key"]), F.lit('">'), esc(e["value"]), F.lit("</attribute>"))), "")
    corner = lambda name, k: (F.lit(f'" {name}="'), F.format_string(f"%.{decimals}f", F.get("points", F.lit(k))))
    place = F.when(F.col("shape") == "box", F.concat(*corner("xtl", 0), *corner("ytl", 1), *corner("xbr", 2), *corner("ybr", 3))).otherwise(F.concat(F.lit('" points="'), F.array_join(pair, ";")))
    text = F.concat(F.lit("<"), F.col("shape"), F.lit(' label="'), esc(F.col("label")), place, F.lit('">'), inner, F.lit("</"), F.col("shape"), F.lit(">"))
    size = F.concat(*(F.coalesce(F.concat(F.lit(f' {c}="'), F.max(c).cast("string"), F.lit('"')), F.lit("")) for c in ("width", "height") if c in shapes.columns), F.lit(""))
    sized = [c for c in ("width", "height") if c in shapes.columns]
    per = shapes.select("image", *sized, F.struct("seq", text.alias("t")).alias("x")).groupBy("image").agg(F.array_sort(F.collect_list("x")).alias("xs"), size.alias("size"))
    per.select(F.concat(F.lit('<image name="'), esc(F.col("image")), F.lit('"'), F.col("size"), F.lit(">"), F.array_join(F.transform("xs", lambda x: x["t"]), ""), F.lit("</image>")).alias("value")).mapInPandas(_rooted, "value string").write.mode("overwrite").text(path)


# --- measurement report ------------------------------------------------------------------------------------

#: Columns of the report, in order.
REPORT_COLUMNS = ("level", "vineyard_id", "row_id", "block_count", "row_count", "row_length_m", "canopy_area_m2", "canopy_area_ha", "interrow_area_m2", "interrow_area_ha", "plant_count", "row_structure")


def report_cells(df: DataFrame, *, m_decimals: int = 2, ha_decimals: int = 4) -> DataFrame:
    """All columns as text cells: fixed decimals, empty for null."""
    cell = lambda c: format_fixed(F.col(c), ha_decimals if c.endswith("_ha") else m_decimals) if c.endswith(("_m", "_m2", "_ha")) else F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(*(cell(c).alias(c) for c in REPORT_COLUMNS))


def write_report(df: DataFrame, path: str, **decimals: int) -> None:
    report_cells(df, **decimals).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The cells as text, no conversion; a wrong header raises."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if tuple(df.columns) != REPORT_COLUMNS:
        raise ValueError(f"unexpected header {df.columns}")
    return df.na.fill("")


def check_report(cells: DataFrame, *, tol: float = 0.0) -> DataFrame:
    """(column, blocks, survey, ok): block sums against the survey line, within half a unit of each written value."""
    number = ("row_length_m", "interrow_area_m2", "plant_count", "row_count")
    of = lambda c, level: F.sum(F.when(F.col("level") == level, F.col(c).try_cast("double")))
    n = F.count_if(F.col("level") == "block")
    one = cells.agg(n.alias("n"), *(of(c, lv).alias(f"{c}_{lv}") for c in number for lv in ("block", "survey")))
    unit = {"row_length_m": 0.01, "interrow_area_m2": 0.01}
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"{c}_block").alias("blocks"), F.col(f"{c}_survey").alias("survey"), (F.abs(F.col(f"{c}_block") - F.col(f"{c}_survey")) <= tol + 0.5 * unit.get(c, 0.0) * (F.col("n") + 1) + 1e-9).alias("ok")) for c in number))
    return one.select(F.inline(rows))


# --- archives, masks, annotation JSON ----------------------------------------------------------------------


def list_zip_members(spark: SparkSession, path: str, pattern: str = r"^[A-Za-z0-9_./-]+$") -> DataFrame:
    """(archive, member, size, sha256) of every file of every archive; bad names raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import re

        for g in batches:
            for archive, content in zip(g["path"], g["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = []
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        if not re.match(pattern, m.filename) or ".." in m.filename:
                            raise ValueError(f"bad member name {m.filename!r} in {archive}")
                        h = hashlib.sha256()
                        with z.open(m) as f:
                            for part in iter(lambda f=f: f.read(1 << 20), b""):
                                h.update(part)
                        rows.append((archive, m.filename, m.file_size, h.hexdigest()))
                    yield pd.DataFrame(rows, columns=["archive", "member", "size", "sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, size long, sha256 string")


def repeated_members(members: DataFrame) -> DataFrame:
    return members.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def encode_mask_png(mask: np.ndarray) -> bytes:
    """One-bit grey PNG."""
    h, w = mask.shape
    raw = b"".join(b"\0" + r.tobytes() for r in np.packbits(mask, axis=1))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def decode_mask_png(data: bytes) -> np.ndarray:
    """Inverse of encode_mask_png, for one-bit or eight-bit grey without interlace (any row filter)."""
    at, idat, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat += body
        at += 12 + n
    w, h, depth, colour, _, _, lace = head
    if colour != 0 or lace or depth not in (1, 8):
        raise ValueError("not a plain one-channel mask")
    line = (w * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, line + 1)
    out, prev = np.zeros((h, line), np.uint8), np.zeros(line, int)
    for v in range(h):
        f, row = raw[v, 0], raw[v, 1:].astype(int)
        if f == 2:
            row = (row + prev) % 256
        elif f:
            for i in range(line):
                a, b, c = (row[i - 1] if i else 0), prev[i], (prev[i - 1] if i else 0)
                p = a + b - c
                row[i] = (row[i] + (a if f == 1 else (a + b) // 2 if f == 3 else min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2])) % 256
        out[v] = prev = row
    return (np.unpackbits(out, axis=1)[:, :w] if depth == 1 else out[:, :w] > 0).astype(bool)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, object_id, category, x, y, w, h) of a COCO document, in file order of ids."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>>>, categories array<struct<id:long,name:string>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(path)
    images = doc.select(F.inline("images")).withColumnRenamed("id", "image_id")
    objects = doc.select(F.inline("annotations")).withColumnRenamed("id", "object_id")
    names = doc.select(F.inline("categories")).withColumnsRenamed({"id": "category_id", "name": "category"})
    j = images.join(objects, "image_id", "left").join(names, "category_id", "left")
    return j.select("image_id", "file_name", "width", "height", "object_id", "category", *(F.get("bbox", F.lit(k)).alias(c) for k, c in enumerate("xywh")))


def yolo_polygons(text: Column, width: Column, height: Column) -> Column:
    """array<struct(class, points)> of normalised polygon lines, points in pixels."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != "")

    def one(s: Column) -> Column:
        v = F.transform(F.split(F.trim(s), r"\s+"), lambda x: x.try_cast("double"))
        pts = F.transform(F.sequence(F.lit(1), F.size(v) - 2, F.lit(2)), lambda i: F.struct((F.get(v, i) * width).alias("x"), (F.get(v, i + 1) * height).alias("y")))
        return F.struct(F.get(v, F.lit(0)).cast("int").alias("class"), pts.alias("points"))

    return F.transform(lines, one)


def first_per_code(parcels: DataFrame, code: str, order: str) -> DataFrame:
    """One feature per cadastral number."""
    w = Window.partitionBy(code).orderBy(order)
    return parcels.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")
