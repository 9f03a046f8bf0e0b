"""How quality filters interact: what each removes, in every order, by a Walsh-Hadamard transform.

Each document has a mask of the filters that it fails. Per part and label, the
2**n signed parity sums (for every set w of filters, the sum of -1 to the number
of failed filters in w) are aggregated map-side in one pass; their inverse
transform gives the number of documents of every mask exactly, as whole numbers.
From these cells follow, for each order of the filters, what is kept, removed
and redundant at each step, and Shapley values in closed form: a document that
fails k filters is removed first by each of them in n!/k of the n! orders.

Copies are marked by table: the smallest id of every text that several rows
have, by 128-bit hash, length and crc32 (summed map-side), joined back to rows;
only ids, masks and hashes are shuffled. The hashes of the most frequent texts
(MOST_HOT at most, by a count that grows with the sum of all counts) are
broadcast, so the shuffle join of the others has no hot key. What follows the sums has 2**n numbers per part and label.

Null texts count as empty, so they are copies of empty ones. Null parts count as
the empty string. Null ids come after all others, equal ids are no copies of one
another, and both have the labels of their id (null: none; of several label rows
any that is 1 counts). Repeated rows count each. An empty table gives no row.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.session import Steps

from .fingerprints import wide_hash

MOST_HOT, LEAST_HOT = 4096, 256  # texts broadcast; rows that each has at least


def word_counts(text: Column) -> tuple[Column, Column]:
    """(words, distinct words): maximal runs other than 0x20 and 0x09-0x0D, case-sensitive."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")
    return F.size(words), F.size(F.array_distinct(words))


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text."""
    few, distinct = word_counts(text)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": few < 200,
        "B": 100 * distinct < 50 * few,
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(conditions: dict[str, Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask): bits 0 to 4 are conditions A to E; E: the text of a smaller id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    hashed = ("h1", "h2", "size", "crc")
    rows = texts.select("id", "part", _mask(text_conditions(F.col("text"))).alias("mask"), wide_hash(F.col("text")).alias("h")).select("id", "part", "mask", "h.*")
    copies = texts.select("id", wide_hash(F.col("text")).alias("h")).select("id", "h.*").groupBy(*hashed).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = Steps(docs.sparkSession).put("copies", copies)
    hot_rows = max(LEAST_HOT, -(-(copies.agg(F.sum("n").alias("n")).first().n or 0) // MOST_HOT))
    named = lambda some, prefix: some.select(F.col("least").alias(f"{prefix}least"), F.lit(True).alias(f"{prefix}met"), *(F.col(c).alias(f"{prefix}{c}") for c in hashed))
    same = lambda prefix: [F.col(c) == F.col(f"{prefix}{c}") for c in hashed]
    rows = rows.join(F.broadcast(named(copies.where(F.col("n") >= hot_rows), "hot_")), same("hot_"), "left")  # MOST_HOT at most
    rows = rows.withColumn("h1", F.when(F.col("hot_met").isNull(), F.col("h1")).otherwise(F.xxhash64("id")))  # met already: dealt out evenly
    rows = rows.join(named(copies.where(F.col("n") < hot_rows), "copy_"), [*same("copy_"), F.col("hot_met").isNull()], "left")
    least = F.coalesce("hot_least", "copy_least")
    later = least.isNotNull() & (F.col("id").isNull() | (F.col("id") > least))
    return rows.select("id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def parity_sums(masks: DataFrame, labels: DataFrame, n: int, *, id_col: str = "doc_id") -> DataFrame:
    """(part, label, sums): for each w < 2**n, the sum of (-1) ** (bits of mask & w); label: all, good, toxic."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    labels = labels.select(F.col(id_col).alias("label_id"), "quality", "toxic").groupBy("label_id").agg(is_one("quality"), is_one("toxic"))
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    named = masks.join(labels, F.col("id") == F.col("label_id"), "left").select("part", "mask", F.explode(names).alias("label"))
    signs = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(w)) % 2).cast("long")).alias(f"s{w}") for w in range(1 << n)]
    return named.groupBy("part", "label").agg(*signs).select("part", "label", F.array(*(F.col(f"s{w}") for w in range(1 << n))).alias("sums"))


def mask_cells(sums: DataFrame, n: int) -> DataFrame:
    """(part, label, cells): documents of each mask, the inverse transform of the sums."""
    numbers = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    sign = lambda m, w: 1 - 2 * (F.bit_count(m.bitwiseAND(w)) % 2)
    total = lambda m: F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, w: acc + sign(m, w) * F.get("sums", w))
    return sums.select("part", "label", F.transform(numbers, lambda m: F.shiftright(total(m), n)).alias("cells"))


def evaluate_orders(cells: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step; names: a letter per bit of the masks."""
    n = len(names)
    none = F.array_repeat(F.lit(0).cast("long"), 1 << n)
    of = lambda label: F.coalesce(F.first(F.when(F.col("label") == label, F.col("cells")), ignorenulls=True), none).alias(label)
    parts = cells.groupBy("part").agg(of("all"), of("good"), of("toxic"))
    steps = [("".join(o), k + 1, 1 << names.index(o[k]), sum(1 << names.index(c) for c in o[:k])) for o in permutations(names) for k in range(n)]
    steps = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "bit", "before"), s)) for s in steps])), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    numbers = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    rows = parts.select("part", "all", "good", "toxic", F.inline(steps))
    total = lambda counts, keep, times=lambda m: F.lit(1): F.aggregate(F.filter(numbers, keep), F.lit(0).cast("long"), lambda acc, m: acc + F.get(counts, m) * times(m))
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    share = lambda m: F.floor(F.lit(factorial(n)) / F.bit_count(m))
    return rows.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), total("all", removed).alias("removed"), total("all", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("all", F.col("bit")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("all", fails, share).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Filters A to E over documents, by part_col, against labels (id, quality, toxic)."""
    masks = failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    return evaluate_orders(mask_cells(parity_sums(masks, labels, 5, id_col=id_col), 5), "ABCDE")


SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
words AS (SELECT doc_id, part, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM texts),
lab AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': w.doc_id > least} AS f
  FROM words w JOIN firsts USING (text) LEFT JOIN lab ON lab.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM letters a, letters b, letters d, letters e, letters g
  WHERE b.c <> a.c AND d.c NOT IN (a.c, b.c) AND e.c NOT IN (a.c, b.c, d.c) AND g.c NOT IN (a.c, b.c, d.c, e.c)),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
seen AS (
  SELECT part, filter_order, step, n, good, toxic, f[filter_order[step]] AS now,
    len(list_filter(range(1, step), lambda i: f[filter_order[i]])) AS before, len(list_filter(map_values(f), lambda x: x)) AS all_fails
  FROM kinds, steps),
out AS (
  SELECT part, filter_order, step, sum(n) FILTER (NOT now AND before = 0) AS kept, sum(n) FILTER (now AND before = 0) AS removed, sum(n) FILTER (now AND before > 0) AS redundant,
    sum(n) FILTER (now AND all_fails = 1) AS unique_fails, sum(good) FILTER (now AND before = 0) AS good_lost, sum(toxic) FILTER (now AND before = 0) AS toxic_lost
  FROM seen GROUP BY ALL),
shap AS (SELECT part, filter_order[step] AS letter, sum(removed) AS shapley FROM out GROUP BY ALL)
SELECT part, filter_order, step::int AS step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
  coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, coalesce(shapley, 0)::bigint AS shapley
FROM out JOIN shap USING (part) WHERE filter_order[step] = letter
"""
