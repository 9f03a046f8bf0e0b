"""Lines that many documents share, dropped but for one document, in DataFrame functions only.

A line ends at ``\\n``. Its key is the line without ``0x20`` and ``0x09-0x0D`` at
both ends, A-Z lower-cased. Lines are exploded, keys hashed (128 bits), and the
distinct documents of each hash counted; a key of at least ``min_chars`` code
points that ``min_docs`` documents hold stays only in the document with the
largest id that holds it, all its lines there included. What is dropped returns
to each text as line numbers, and the other lines are joined in their order.

Counting is by (hash, id) first, so a line that all documents hold is dealt out
by document, then per hash, summed map-side. The hashes of the most frequent
lines (MOST_HOT at most, by a count that grows with the sum of all counts) are
broadcast to the lines; the others meet theirs by a shuffle join, which so has no
hot key. No line text is shuffled, only hashes and numbers; each text moves
once, to its line numbers.

Rows with equal ids count as one document. Null ids count as one document below
all others. Null texts count as empty, and an empty text is one empty line; it
stays empty. Repeated rows are treated alike. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.session import Steps

MOST_HOT, LEAST_HOT = 4096, 256  # hashes broadcast; documents that each is in at least
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when(F.char_length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _text_hash() -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.octet_length("text"), "text")


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, text_hash, line, h1, h2): number and key hash of every line that is long enough. docs: (id, text)."""
    hashed = docs.select("id", "text", _text_hash().alias("text_hash"))  # once a text, before its lines
    lines = hashed.select("id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    keys = lines.where(F.octet_length("raw") >= min_chars).withColumn("key", line_key(F.col("raw"))).where(F.char_length("key") >= min_chars)
    return keys.select("id", "text_hash", "line", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, holder): keys of at least min_docs documents, and the largest id of these."""
    once = lines.select("h1", "h2", "id").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("holder")).where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, keep_columns: bool = False) -> DataFrame:
    """(id, text, n_lines, n_dropped, dropped): text without its dropped lines, whose numbers from 0 are in dropped; keep_columns: and the other columns of docs."""
    added = ("n_lines", "n_dropped", "dropped")
    extra = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in added] if keep_columns else []
    named = [f"extra_{i}" for i in range(len(extra))]
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(extra, named)))
    lines = keyed_lines(docs.select("id", "text"), min_chars)
    repeated = Steps(docs.sparkSession).put("repeated", repeated_lines(lines, min_docs))
    hot_docs = max(LEAST_HOT, -(-(repeated.agg(F.sum("n_docs").alias("n")).first().n or 0) // MOST_HOT))
    hot = repeated.where(F.col("n_docs") >= hot_docs).select(F.col("h1").alias("hot1"), F.col("h2").alias("hot2"), F.col("holder").alias("hot_holder"))  # MOST_HOT at most
    rest = repeated.where(F.col("n_docs") < hot_docs).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "holder")
    met = lines.join(F.broadcast(hot), (F.col("h1") == F.col("hot1")) & (F.col("h2") == F.col("hot2")), "left")
    met = met.withColumn("h1", F.when(F.col("hot_holder").isNull(), F.col("h1")).otherwise(F.xxhash64("id", "text_hash", "line")))  # met already: dealt out evenly
    met = met.join(rest, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & F.col("hot_holder").isNull(), "left")
    lost = met.withColumn("holder", F.coalesce("hot_holder", "holder")).where(F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder")))
    lost = lost.groupBy(F.col("id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    both = docs.withColumn("text_hash", _text_hash()).join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    split = both.select("id", "text", *named, F.split("text", "\n", -1).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(F.array_join(F.transform(numbers, lambda i: F.get("lines", i)), "\n"))
    out = split.select("id", kept.alias("text"), *named, F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col(n).alias(c) for c, n in zip(extra, named)), *added)


SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
raw AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM docs),
keyed AS (SELECT doc_id, line, n, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM raw),
hot AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, line, n, hot.key IS NOT NULL AND doc_id <> holder AS gone FROM keyed LEFT JOIN hot USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
