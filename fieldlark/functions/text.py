"""Text and id expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Id patterns by kind.
ID_PATTERNS = {
    "tile": r"[a-z0-9]+_r\d{3}_c\d{3}",
    "block": r"V\d{2,3}",
    "row": r"V\d{2,3}-R\d{3}",
    "interrow": r"V\d{2,3}-I\d{3}",
    "farm": r"F\d{2}",
    "issue": r"Q\d{5}",
}


def natural_key(text: Column) -> Column:
    """Sort key by digit runs as numbers: V01-R9 comes before V01-R10; null sorts as empty."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(p.rlike(r"^\D").cast("int").alias("k"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n"), p.alias("s")))


def text_or_none(text: Column) -> Column:
    """Trimmed text; null for blank, NaN-like and null."""
    t = F.trim(text.cast("string"))
    return F.when((t == "") | (F.lower(t) == "nan"), None).otherwise(t)


def normalize_enum(raw: Column, allowed: Iterable[str], synonyms: Mapping[str, str] | None = None) -> Column:
    """Trim, lower-case, blank and dash to underscore, synonyms; null if not an allowed value."""
    t = F.translate(F.lower(F.trim(raw)), " -", "__")
    if synonyms:
        pairs = F.create_map(*(F.lit(x) for kv in sorted(synonyms.items()) for x in kv))
        t = F.coalesce(F.try_element_at(pairs, t), t)
    return F.when(t.isin(*sorted(allowed)), t)


def is_valid_id(text: Column, kind: str, *, strict: bool = True) -> Column:
    """Full match of the kind's pattern, or just not blank."""
    ok = text.rlike(f"^(?:{ID_PATTERNS[kind]})$") if strict else F.trim(text) != ""
    return F.coalesce(ok, F.lit(False))


def parse_tile_id(tile: Column) -> Column:
    """struct(row, col) of a tile id; null fields if it has no such parts."""
    part = lambda p: F.nullif(F.regexp_extract(tile, p, 1), F.lit("")).try_cast("int")
    return F.struct(part(r"_r(\d+)_c\d+$").alias("row"), part(r"_r\d+_c(\d+)$").alias("col"))


def row_index_of(row_id: Column) -> Column:
    """Number of a trailing -R<digits>, else null."""
    return F.nullif(F.regexp_extract(row_id, r"-R(\d+)$", 1), F.lit("")).try_cast("int")


def format_block_id(index: Column, n_blocks: Column) -> Column:
    """V and the index, two digits, or three if there are over 99 blocks."""
    return F.concat(F.lit("V"), F.lpad(index.cast("string"), F.when(n_blocks > 99, 3).otherwise(2), F.lit("0")))


def padded(number: Column, width: int) -> Column:
    """Digits with leading zeros to a width; longer numbers stay whole."""
    n = number.cast("string")
    return F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)


def merge_flags(*groups: Column) -> Column:
    """';' lists joined, each flag once, in order of first sight."""
    lists = [F.filter(F.transform(F.split(F.coalesce(g, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "") for g in groups]
    return F.array_join(F.array_distinct(F.concat(*lists)), ";")


def normalize_landuse(text: Column) -> Column:
    """Cedilla letters to comma-below ones, lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "şţŞŢ", "șțȘȚ")), r"\s+", " "))


def format_fixed(x: Column, decimals: int) -> Column:
    """Fixed decimals without negative zero; empty for null and NaN."""
    shown = F.format_string(f"%.{decimals}f", x.cast("double"))
    return F.when(x.isNull() | F.isnan(x.cast("double")), "").otherwise(F.regexp_replace(shown, r"^-(0(?:\.0*)?)$", "$1"))


def parse_area_ha(text: Column) -> Column:
    """The number of a text like '0.12 ha'; null without one."""
    return F.nullif(F.regexp_extract(F.translate(text, ",", "."), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:ha)?\s*$", 1), F.lit("")).try_cast("double")


def parse_rle(text: Column) -> Column:
    """Run lengths of a comma list."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("int"))


def rle_to_mask(runs: Column) -> Column:
    """Flat booleans of run lengths that begin with an unset run."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))


def batch_of(file_name: Column) -> Column:
    """Leading letters and digits of a file name before the first underscore."""
    return F.regexp_extract(file_name, r"^([^_/.]+)", 1)


def cache_key(stage: Column, version: Column, config: Column, inputs: Column) -> Column:
    """sha1 of stage, version, configuration digest and sorted input keys."""
    return F.sha1(F.concat_ws("|", stage, version, config, F.array_join(F.array_sort(inputs), "|")).cast("binary"))


def run_id(at: Column, source: Column, digest: Column) -> Column:
    """Time, source and the first six digits of a digest."""
    return F.concat_ws("-", F.date_format(at, "yyyyMMdd'T'HHmm"), source, F.substring(digest, 1, 6))


def generated_at(run: Column) -> Column:
    """The time a run id begins with; null if it has none."""
    return F.try_to_timestamp(F.regexp_extract(run, r"^(\d{8}T\d{4})", 1), F.lit("yyyyMMdd'T'HHmm"))


def json_safe(x: Column) -> Column:
    """Null in place of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def task_title(kind: Column, row: Column, block: Column, gap_m: Column) -> Column:
    """A line of text for a field task."""
    place = F.coalesce(row, block, F.lit("?"))
    return F.when(kind == "gap", F.format_string("Gap of %.1f m in %s", gap_m.cast("double"), place)).when(kind == "waste", F.concat(F.lit("Waste near "), place)).otherwise(F.concat(F.initcap(F.translate(kind, "_", " ")), F.lit(" in "), place))
