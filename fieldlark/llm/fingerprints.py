"""Canonical exact digests of documents, in DataFrame functions only.

A text's canonical form is NFKC, upper then lower case, white-space runs as one
blank, none at the ends. Its fingerprint is 128 bits of xxhash over that form.
Where several texts share a hash, their canonical bytes are compared; should
they differ, the fingerprints of the second and later forms (in byte order) get
a suffix, so fingerprints are equal if and only if canonical forms are.

Only texts of shared hashes are compared; copies meet map-side first.

Null texts count as empty, repeated rows have equal fingerprints, an empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_KEYS = 1 << 20  # 16 MB of key values at most
_SIDE = 64  # id ranges are found in two steps of so many cuts


def nfkc(text: Column) -> Column:
    """NFKC by the ICU library that ships with Spark, called as a SQL function; ASCII texts are their own.

    Spark takes such a call for non-deterministic and so evaluates it once where
    it stands; ICU's answer depends on the text alone.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(F.char_length(text) == F.octet_length(text), text).otherwise(composed)


_WHITE = "\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}"


def canonical(text: Column) -> Column:
    folded = F.lower(F.upper(nfkc(F.coalesce(text, F.lit("")))))
    single = F.regexp_replace(folded, f"[{_WHITE}&&[^ ]][{_WHITE}]*| [{_WHITE}]+", " ")
    return F.trim(single)


def wide_hash(canon: Column) -> Column:
    """128 bits, with length and crc32 beside them."""
    return F.struct(F.xxhash64(F.lit(1), canon).alias("h1"), F.xxhash64(F.lit(2), canon).alias("h2"), F.octet_length(canon).alias("size"), F.crc32(canon.cast("binary")).alias("crc"))


# --- byte comparison -------------------------------------------------------------------------------------


def semi_join(df: DataFrame, keys: DataFrame, condition: Column) -> DataFrame:
    """Rows of df with a key; the keys are broadcast only if there are few. keys: checkpointed."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, condition, "left_semi")


def _shared(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("b1"), F.col("h2").alias("b2")).checkpoint()


def _unequal(canon: DataFrame) -> DataFrame | None:
    """(h, form) of all but the first form of hashes whose texts differ; None if there are none. canon: (h, canon) of shared hashes."""
    forms = canon.distinct()
    several = forms.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h1").alias("b1"), F.col("h2").alias("b2")).checkpoint()
    if several.isEmpty():
        return None
    order = Window.partitionBy("h.h1", "h.h2").orderBy(F.col("canon").cast("binary"))
    ranked = forms.join(several, (F.col("h.h1") == F.col("b1")) & (F.col("h.h2") == F.col("b2")), "left_semi").withColumn("form", F.row_number().over(order) - 1)
    per = ranked.groupBy("h").agg(F.max("form").alias("form"), F.count(F.lit(1)).alias("n"))
    return per.select("h", F.when(F.assert_true(F.col("n") == 1, F.lit("texts of one hash, length and crc32 differ")).isNull(), F.col("form")).alias("form")).where("form > 0").checkpoint()


def _named(df: DataFrame, forms: DataFrame | None, hash_col: str, name: str) -> DataFrame:
    digits = F.lower(F.concat(F.lpad(F.hex(F.col(hash_col)["h1"]), 16, "0"), F.lpad(F.hex(F.col(hash_col)["h2"]), 16, "0")))
    if forms is None:
        return df.withColumn(name, digits)
    forms = forms.select(F.col("h").alias("form_of"), "form")
    return df.join(forms, F.col(hash_col) == F.col("form_of"), "left").withColumn(name, F.concat(digits, F.when(F.col("form") > 0, F.concat(F.lit("-"), F.col("form"))).otherwise(""))).drop("form_of", "form")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    canon = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon")).withColumn("h", wide_hash(F.col("canon")))
    rows = canon.select("id", "h").checkpoint()
    shared = _shared(rows)
    same = (F.col("h.h1") == F.col("b1")) & (F.col("h.h2") == F.col("b2"))
    forms = _unequal(semi_join(canon.select("h", "canon"), shared, same))
    return _named(rows, forms, "h", "fingerprint").select(F.col("id").alias(id_col), "fingerprint")


# --- each document beside the next -----------------------------------------------------------------------


def id_ranges(docs: DataFrame, rows_each: int = 256, most: int = _SIDE * _SIDE) -> Callable[[Column], Column]:
    """A rule id -> range number, ranges of about equally many rows (``most`` at most); null ids come below all."""
    n = docs.count()
    count = max(1, min(most, n // rows_each))
    cuts = []
    if count > 1:
        found = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 10 * count).alias("cuts")).first().cuts
        cuts = sorted(set(found or []))
    groups = [cuts[i : i + _SIDE] for i in range(0, len(cuts), _SIDE)]
    if not groups:
        return lambda i: F.when(i.isNull(), F.lit(-1)).otherwise(F.lit(0))
    coarse = F.lit([g[0] for g in groups])
    fine = F.array(*(F.lit(g) for g in groups))

    def rule(i: Column) -> Column:
        group = F.size(F.filter(coarse, lambda c: c <= i))
        return F.when(i.isNull(), F.lit(-1)).when(group == 0, F.lit(0)).otherwise((group - 1) * _SIDE + F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(1))), lambda c: c <= i)))

    return rule


def beside_next(docs: DataFrame, rule: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, text, h, next_id, next_text, next_h): next by falling id, then rising text; the first comes after the last.

    docs: (doc_id, text, h). Rows go to their range and, for the first of a
    range, to the range above it too, so no range needs another. The driver
    holds one id per range.
    """
    docs = docs.withColumn("range", rule(F.col("doc_id")))
    tops = docs.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    if not tops:
        return docs.select("doc_id", "text", "h", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"), F.col("h").alias("next_h"))
    above = [(r.top, tops[(k + 1) % len(tops)]["range"]) for k, r in enumerate(tops)]
    rows = ", ".join(f"(CAST({'NULL' if t is None else t} AS BIGINT), {g})" for t, g in above)
    guests = docs.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS guests(top_id, guest_range)")
    placed = docs.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("top_id")), "left")
    places = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("guest_range").alias("range"), F.lit(True).alias("guest")))
    placed = placed.select("doc_id", "text", "h", F.inline(F.filter(places, lambda p: p["range"].isNotNull())))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    following = [F.lead(c).over(order).alias(n) for c, n in (("doc_id", "next_id"), ("text", "next_text"), ("h", "next_h"))]
    return placed.select("doc_id", "text", "h", "guest", *following).where(~F.col("guest")).drop("guest")


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the next document's likeness.

    The edited text's last half of code points is the next document's first as
    many. Likeness of two fingerprints is 1.0 if they are equal, else 0.0.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rule = id_ranges(docs.select("doc_id"))

    def edited(some: DataFrame) -> DataFrame:
        pairs = beside_next(some.withColumn("h", wide_hash(canonical(F.col("text")))), rule)
        n = F.char_length("text")
        half = F.floor(n / 2).cast("int")
        pairs = pairs.select("doc_id", "h", "next_id", "next_h", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
        return pairs.withColumn("canon", canonical(F.col("edited"))).withColumn("edited_h", wide_hash(F.col("canon")))

    rows = edited(docs).select("doc_id", "h", "next_id", "next_h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited_h").checkpoint()
    shared = _shared(rows.select("h").union(rows.select(F.col("edited_h").alias("h"))))
    same = (F.col("h.h1") == F.col("b1")) & (F.col("h.h2") == F.col("b2"))
    own = docs.select(canonical(F.col("text")).alias("canon")).select(wide_hash(F.col("canon")).alias("h"), "canon")
    texts = semi_join(own, shared, same)
    flagged = rows.join(shared, (F.col("edited_h.h1") == F.col("b1")) & (F.col("edited_h.h2") == F.col("b2")), "left_semi")
    need = flagged.select("doc_id").union(flagged.select("next_id")).distinct().withColumnRenamed("doc_id", "need_id").checkpoint()
    some = semi_join(docs, need, F.col("doc_id").eqNullSafe(F.col("need_id")))  # a flagged row's next is there, so it is its next here too
    again = edited(some).select(F.col("edited_h").alias("h"), "canon")
    forms = _unequal(texts.union(semi_join(again, shared, same)))
    out = _named(_named(_named(rows, forms, "h", "fingerprint"), forms, "edited_h", "edited_fingerprint"), forms, "next_h", "next_fingerprint")
    like = lambda name: F.when(F.col("fingerprint") == F.col(name), 1.0).otherwise(0.0)
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
