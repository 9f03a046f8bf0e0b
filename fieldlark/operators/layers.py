"""Typed layers: a schema registry, coercion and validation as one query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.functions.text import ID_PATTERNS

#: Provenance columns that every layer ends with.
PROVENANCE = "source:string run_id:string model_version:string? confidence:float qa_flags:string"

#: Layer, primary key, columns (a ? marks nullable; floats keep NaN as their null).
LAYERS = {
    "tile_index": ("tile_id", "tile_id:string file_name:string grid_row:short grid_col:short x0:double y0:double x1:double y1:double gsd_m:double width_px:short height_px:short sha256:string file_size:long nodata_frac:float"),
    "tile_status": ("tile_id", "tile_id:string status:string has_vineyard:boolean n_canopies:int n_row_pieces:int n_interrow_pieces:int n_waste:int veg_frac:float review_priority:byte issues:string"),
    "canopies": ("canopy_id", "canopy_id:string tile_id:string vineyard_id:string row_id:string? area_m2:double n_vertices:short along_m:float is_clump:boolean touches_edge:boolean geometry:binary"),
    "row_pieces": ("piece_id", "piece_id:string row_id:string vineyard_id:string tile_id:string row_structure:string length_m:double max_gap_m:float n_vertices:short geometry:binary"),
    "interrow_pieces": ("piece_id", "piece_id:string interrow_id:string? vineyard_id:string tile_id:string row_left_id:string? row_right_id:string? interrow_cover:string veg_frac:float shadow_frac:float area_m2:double width_mean_m:float n_notches:byte geometry:binary"),
    "waste": ("waste_id", "waste_id:string tile_id:string vineyard_id:string dist_block_m:float px_xtl:float px_ytl:float px_xbr:float px_ybr:float area_m2:float category:string detector:string exported:boolean geometry:binary"),
    "rows": ("row_id", "row_id:string vineyard_id:string row_index:short length_m:double extent_m:double n_pieces:short tile_ids:string angle_deg:float spacing_prev_m:float spacing_next_m:float max_gap_m:float geometry:binary"),
    "blocks": ("vineyard_id", "vineyard_id:string n_rows:int n_row_pieces:int n_canopies:int? row_length_m:double canopy_area_m2:double interrow_area_m2:double outline_area_m2:double angle_deg:float spacing_med_m:float geometry:binary"),
    "targets": ("target_id", "target_id:string kind:string vineyard_id:string tile_id:string row_id:string? interrow_id:string? waste_id:string? x:double y:double gap_length_m:float priority:byte reachable:boolean reach_note:string snap_dist_m:float"),
    "farms": ("farm_id", "farm_id:string vineyard_ids:string n_blocks:int area_m2:double n_parcels:int? cadastral_codes:string? geometry:binary"),
    "roads": ("road_id", "road_id:string road_class:string highway:string name:string? surface:string? farm_id:string? length_m:double geometry:binary"),
    "walk_nodes": ("node_id", "node_id:long kind:string ref_id:string geometry:binary"),
    "walk_edges": ("edge_id", "edge_id:long u:long v:long length_m:double kind:string ref_id:string inside_frac:float cost:double geometry:binary"),
    "route_stops": ("route_id seq", "route_id:string seq:int target_id:string? cum_dist_m:double leg_m:double"),
    "qa_issues": ("issue_id", "issue_id:string severity:string code:string tile_id:string object_id:string message:string"),
}

#: Allowed values by column.
ENUMS = {
    "row_structure": ("regular", "disrupted", "unassessable"),
    "interrow_cover": ("bare", "vegetation", "mixed", "unassessable"),
    "severity": ("error", "warning", "info"),
}
#: id kind by column.
ID_KINDS = {"tile_id": "tile", "row_id": "row", "farm_id": "farm", "issue_id": "issue"}


@dataclass(frozen=True)
class Layer:
    name: str
    key: tuple[str, ...]
    schema: T.StructType


def layer(name: str, *, provenance: bool = False, spec: tuple[str, str] | None = None) -> Layer:
    """A layer of the registry, or of a (key, columns) spec of the same form."""
    key, columns = spec or LAYERS[name]
    fields = []
    for c in (columns + (" " + PROVENANCE if provenance else "")).split():
        field, kind = c.split(":")
        fields.append(T.StructField(field, T._parse_datatype_string(kind.rstrip("?")), kind.endswith("?"), {k: v for k, v in (("enum", list(ENUMS.get(field, ()))), ("id_kind", ID_KINDS.get(field))) if v}))
    return Layer(name, tuple(key.split()), T.StructType(fields))


def empty_layer(spark: SparkSession, spec: Layer) -> DataFrame:
    return spark.createDataFrame([], spec.schema)


def coerce_layer(df: DataFrame, spec: Layer) -> DataFrame:
    """Contract columns in order and type, missing nullable ones as null; a cast that would lose a value raises."""
    out = []
    for f in spec.schema:
        if f.name not in df.columns:
            if not f.nullable:
                raise ValueError(f"{spec.name}: no column {f.name}")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        old, kind = F.col(f.name), df.schema[f.name].dataType
        if kind == f.dataType:
            out.append(old)
            continue
        new = old.try_cast(f.dataType) if not isinstance(f.dataType, T.BinaryType) else old.cast("binary")
        lost = old.isNotNull() & new.isNull()
        if isinstance(f.dataType, T.IntegralType) and isinstance(kind, T.FractionalType):
            lost = lost | (old != F.rint(old))
        out.append(F.when(lost, F.raise_error(F.concat(F.lit(f"{spec.name}.{f.name}: lossy cast of "), old.cast("string")))).otherwise(new).alias(f.name))
    return df.select(*out)


def violations(df: DataFrame, spec: Layer, *, strict_ids: bool = True) -> DataFrame:
    """(rule, column, n) of every broken rule: one aggregate over the table and one by key."""
    rules: dict[tuple[str, str], Column] = {}
    for f in spec.schema:
        c = F.col(f.name)
        if not f.nullable and not isinstance(f.dataType, T.FractionalType):  # NaN is the null of floats
            rules["null", f.name] = c.isNull()
        if f.metadata.get("enum"):
            rules["enum", f.name] = c.isNotNull() & ~c.isin(*f.metadata["enum"])
        if kind := f.metadata.get("id_kind"):
            rules["id", f.name] = c.isNotNull() & ~(c.rlike(f"^(?:{ID_PATTERNS[kind]})$") if strict_ids else F.trim(c) != "")
        if f.name == "geometry":
            rules["geometry", f.name] = c.isNull() | (F.octet_length(c) < 9)
    names = list(rules)
    counted = df.agg(*(F.count_if(rules[k]).alias(f"r{i}") for i, k in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"r{i}").alias("n")) for i, (r, c) in enumerate(names)))
    per = counted.select(F.inline(rows))
    twice = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("k_")).where("k_ > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("key").alias("rule"), F.lit(" ".join(spec.key)).alias("column"), "n")
    return per.unionByName(twice).where("n > 0")


def validate_layer(df: DataFrame, spec: Layer, *, strict_ids: bool = True) -> DataFrame:
    """df itself, after a check that raises at the first broken rule."""
    missing = [f.name for f in spec.schema if f.name not in df.columns]
    wrong = [f.name for f in spec.schema if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
    if missing or wrong:
        raise ValueError(f"{spec.name}: missing columns {missing}, wrong types {wrong}")
    if bad := violations(df, spec, strict_ids=strict_ids).orderBy("rule", "column").head(1):
        raise ValueError(f"{spec.name}: {bad[0]['n']} rows break {bad[0]['rule']} of {bad[0]['column']}")
    return df


def union_layers(*parts: DataFrame) -> DataFrame:
    """Union by name, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
