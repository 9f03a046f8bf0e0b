"""Queries of checks, evaluation, joins, selection and graphs on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.functions import numbers as N
from fieldlark.operators import checks as K
from fieldlark.operators import evaluate as E
from fieldlark.operators import graph as G
from fieldlark.operators import matching as M
from fieldlark.operators import spatial as P

from .registry import Tables, query
from .relational import cents

# --- checks ------------------------------------------------------------------------------------------------


@query(
    "issue_checks_union",
    """WITH i AS (
SELECT 1 AS r, 'error' AS severity, 'missing_attribute' AS code, CAST(doc_id AS VARCHAR) AS object_id, 'text' AS detail FROM documents WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT 1, 'error', 'enum_bad', CAST(doc_id AS VARCHAR), lang FROM documents WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT 2, 'warning', 'whitespace', CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_name <> trim(p_name)
UNION ALL SELECT 1, 'error', 'missing', CAST(doc_id AS VARCHAR), NULL FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 1, 'error', 'out_of_range', CAST(doc_id AS VARCHAR), CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars > 10000)
SELECT 'Q' || CASE WHEN length(CAST(row_number() OVER w AS VARCHAR)) >= 5 THEN CAST(row_number() OVER w AS VARCHAR) ELSE lpad(CAST(row_number() OVER w AS VARCHAR), 5, '0') END AS issue_id, severity, code, object_id, detail FROM i WINDOW w AS (ORDER BY r, code, object_id, detail NULLS FIRST)""",
)
def issue_checks_union(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang", "n_chars")
    return K.all_issues(
        K.missing_attributes(docs, "doc_id", ["text"]),
        K.enum_values(docs, "doc_id", "lang", ["en", "fr"]),
        K.untrimmed(t.part, "p_partkey", "p_name"),
        K.missing_keys(docs, t.labels, "doc_id"),
        K.out_of_range(docs, "doc_id", "n_chars", 0, 10_000),
    )


@query(
    "case_collisions",
    """WITH v AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) WHEN p_partkey % 3 = 1 THEN lower(p_brand) ELSE p_brand END AS s FROM part), n AS (SELECT lower(s) AS folded, s, count(*) AS n FROM v GROUP BY 1, 2)
SELECT folded, string_agg(s, ';' ORDER BY s) AS spellings, arg_max(s, n) AS majority FROM (SELECT * FROM n ORDER BY s) GROUP BY folded HAVING count(*) > 1""",
)
def case_collisions(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    out = K.case_collisions(t.part.select(F.when(k == 0, F.upper("p_brand")).when(k == 1, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("s")), "s")
    return out


@query("enum_normalize", "SELECT o_orderkey, lower(replace(replace(trim(o_orderpriority), ' ', '_'), '-', '_')) AS raw_form, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN replace(lower(o_orderpriority), '-', '_') END AS normal FROM orders")
def enum_normalize(t: Tables) -> DataFrame:
    from fieldlark.functions.text import normalize_enum

    raw = F.lower(F.translate(F.trim("o_orderpriority"), " -", "__"))
    return t.orders.select("o_orderkey", raw.alias("raw_form"), normalize_enum(F.col("o_orderpriority"), ["1_urgent", "2_high", "3_medium"]).alias("normal"))


@query("missing_keys_anti", "SELECT 'error' AS severity, 'missing' AS code, CAST(doc_id AS VARCHAR) AS object_id, CAST(NULL AS VARCHAR) AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id")
def missing_keys_anti(t: Tables) -> DataFrame:
    return K.missing_keys(t.documents, t.labels, "doc_id")


@query("duplicate_keys", "SELECT 'error' AS severity, 'duplicate_key' AS code, l_orderkey || '|' || l_linenumber AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return K.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "compare_sets",
    """WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_nationkey AS v FROM customer), a AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS v FROM supplier)
SELECT 'error' AS severity, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'different' END AS code, coalesce(e.k, a.k) AS object_id, concat_ws(' / ', CAST(e.v AS VARCHAR), CAST(a.v AS VARCHAR)) AS detail FROM e FULL JOIN a ON e.k = a.k WHERE a.k IS NULL OR e.k IS NULL OR e.v <> a.v""",
)
def compare_sets(t: Tables) -> DataFrame:
    e = t.customer.select(F.col("c_custkey").cast("string").alias("k"), F.col("c_nationkey").alias("v"))
    return K.compare_sets(e, t.supplier.select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").alias("v")), "k", "v")


@query("dense_order", "SELECT 'error' AS severity, 'order_not_dense' AS code, CAST(l_orderkey AS VARCHAR) AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def dense_order(t: Tables) -> DataFrame:
    return K.dense_order(t.lineitem, "l_orderkey", "l_linenumber")


_ISSUES = "SELECT CASE WHEN value > 90 THEN 'error' WHEN value > 60 THEN 'warning' ELSE 'info' END AS severity, event_type AS code, user_id FROM events"
_SUMMARY = "SELECT user_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, string_agg(DISTINCT code, ';' ORDER BY code) AS codes, CASE WHEN bool_or(severity = 'error') THEN 1 WHEN bool_or(severity = 'warning') THEN 2 ELSE 3 END AS priority FROM i GROUP BY user_id"


def _issues(t: Tables) -> DataFrame:
    return t.events.select(F.when(F.col("value") > 90, "error").when(F.col("value") > 60, "warning").otherwise("info").alias("severity"), F.col("event_type").alias("code"), "user_id")


@query("issue_summary", f"WITH i AS ({_ISSUES}) {_SUMMARY}")
def issue_summary(t: Tables) -> DataFrame:
    return K.summarize_issues(_issues(t), "user_id")


@query("review_queue", f"WITH i AS ({_ISSUES} WHERE value > 60), s AS ({_SUMMARY}) SELECT u.user_id, coalesce(n_errors, 0) AS n_errors, coalesce(n_warnings, 0) AS n_warnings, coalesce(codes, '') AS codes, coalesce(priority, 3) AS priority FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s ON s.user_id = u.user_id")
def review_queue(t: Tables) -> DataFrame:
    return K.review_queue(t.events.select("user_id").distinct(), K.summarize_issues(_issues(t).where("severity <> 'info'"), "user_id"), "user_id")


# --- evaluation --------------------------------------------------------------------------------------------


@query(
    "macro_f1",
    """WITH d AS (SELECT quality AS ref, toxic AS pred FROM labels), c AS (SELECT ref, pred, count(*) AS n FROM d GROUP BY 1, 2),
k AS (SELECT DISTINCT ref AS c FROM c UNION SELECT pred FROM c WHERE pred IN (0, 1)),
f AS (SELECT k.c, 2.0 * coalesce(sum(n) FILTER (WHERE ref = k.c AND pred = k.c), 0) / (coalesce(sum(n) FILTER (WHERE ref = k.c), 0) + coalesce(sum(n) FILTER (WHERE pred = k.c), 0)) AS f1 FROM k CROSS JOIN c GROUP BY k.c)
SELECT floor((SELECT CAST(sum(n) FILTER (WHERE ref = pred) AS DOUBLE) / sum(n) FROM c) * 1000000 + 0.5) / 1000000 AS accuracy, floor(avg(f1) * 1000000 + 0.5) / 1000000 AS macro_f1 FROM f""",
)
def macro_f1(t: Tables) -> DataFrame:
    return E.attribute_scores(t.labels, "quality", "toxic", [0, 1])


@query(
    "pair_counting_f1",
    """WITH d AS (SELECT label AS r, vec_id % 7 AS p FROM embeddings), b AS (SELECT sum(n * (n - 1) / 2) AS tp FROM (SELECT count(*) AS n FROM d GROUP BY r, p)), r AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT count(*) AS n FROM d GROUP BY r)), p AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM d GROUP BY p))
SELECT CAST(tp AS DOUBLE) AS tp, CAST(r AS DOUBLE) AS ref_pairs, CAST(p AS DOUBLE) AS pred_pairs, floor(2 * tp / (p + r) * 1000000 + 0.5) / 1000000 AS f1 FROM b CROSS JOIN r CROSS JOIN p""",
)
def pair_counting_f1(t: Tables) -> DataFrame:
    return E.grouping_consistency(t.embeddings.select(F.col("label").alias("r"), (F.col("vec_id") % 7).alias("p")), "r", "p")


@query(
    "value_scores",
    """WITH s AS (SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS pred, 50.0 * count(*) / 2 AS ref FROM lineitem GROUP BY 1)
SELECT l_partkey, floor(greatest(0.0, 1.0 - abs(pred - ref) / abs(ref) / 0.5) * 10000 + 0.5) / 10000 AS score FROM s""",
)
def value_scores(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("pred"), (50.0 * F.count(F.lit(1)) / 2).alias("ref"))
    return s.select("l_partkey", N.round_up(N.value_score(F.col("pred"), F.col("ref"), 0.5), 4).alias("score"))


@query(
    "mean_and_gates",
    """WITH m AS (SELECT event_type, floor(avg(v) * 1000000 + 0.5) / 1000000 AS mean, min(v) AS least FROM (SELECT event_type, user_id, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2) GROUP BY 1),
g(event_type, "on", minimum) AS (VALUES ('click', 'mean', 5.0), ('click', 'least', 100.0), ('view', 'mean', 1.0), ('absent', 'mean', 0.0))
SELECT g.event_type, g."on", CAST(g.minimum AS DOUBLE) AS minimum, CASE WHEN g."on" = 'least' THEN least ELSE mean END AS value, coalesce(CASE WHEN g."on" = 'least' THEN least ELSE mean END >= minimum, false) AS passed FROM g LEFT JOIN m ON m.event_type = g.event_type""",
)
def mean_and_gates(t: Tables) -> DataFrame:
    per = t.events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).cast("double").alias("v"))
    gates = t.spark.sql("SELECT * FROM VALUES ('click', 'mean', 5.0D), ('click', 'least', 100.0D), ('view', 'mean', 1.0D), ('absent', 'mean', 0.0D) AS g(event_type, `on`, minimum)")
    return E.evaluate_gates(E.mean_of_tiles(per, "event_type", "v"), gates, "event_type")


@query(
    "baseline_drops",
    """WITH c AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS v FROM events WHERE event_type <> 'view' GROUP BY 1), b AS (SELECT user_id, CAST(count(*) + user_id % 3 AS DOUBLE) AS v FROM events GROUP BY 1)
SELECT b.user_id, b.v AS was, c.v AS now FROM b LEFT JOIN c ON b.user_id = c.user_id WHERE c.v IS NULL OR b.v - c.v > 1""",
)
def baseline_drops(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    current = t.events.where("event_type <> 'view'").groupBy("user_id").agg(n.cast("double").alias("v"))
    base = t.events.groupBy("user_id").agg((n + F.first("user_id") % 3).cast("double").alias("v"))
    return E.compare_to_baseline(current, base, ["user_id"], "v", max_drop=1)


# --- joins -------------------------------------------------------------------------------------------------

_ZONE = "SELECT s_suppkey AS k, CAST(s_suppkey * 7 % 100 AS DOUBLE) AS x0, CAST(s_suppkey * 11 % 50 AS DOUBLE) AS y0, CAST(s_suppkey * 7 % 100 + 3 AS DOUBLE) AS x1, CAST(s_suppkey * 11 % 50 + 4 AS DOUBLE) AS y1 FROM supplier"
_BOX = "SELECT p_partkey AS k, CAST(p_partkey % 100 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0, CAST(p_partkey % 100 + 1 + p_partkey % 3 AS DOUBLE) AS x1, CAST(p_size + 2 AS DOUBLE) AS y1 FROM part"


def _boxes(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(k.alias("k"), (k % 100).cast("double").alias("x0"), s.cast("double").alias("y0"), (k % 100 + 1 + k % 3).cast("double").alias("x1"), (s + 2).cast("double").alias("y1"))


def _zones(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("k"), (k * 7 % 100).cast("double").alias("x0"), (k * 11 % 50).cast("double").alias("y0"), (k * 7 % 100 + 3).cast("double").alias("x1"), (k * 11 % 50 + 4).cast("double").alias("y1"))


@query(
    "range_bin_join",
    f"""WITH b AS ({_BOX}), p AS (SELECT l.k AS l_k, r.k AS r_k, (least(l.x1, r.x1) - greatest(l.x0, r.x0)) * (least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS overlap, (l.x1 - l.x0) * (l.y1 - l.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS s
FROM b l JOIN b r ON l.k < r.k AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1)
SELECT l_k, r_k, overlap, floor(overlap / (s - overlap) * 10000 + 0.5) / 10000 AS iou FROM p""",
)
def range_bin_join(t: Tables) -> DataFrame:
    """Box pairs with common area, once each."""
    b = _boxes(t)
    return P.crowd_pairs(b, "k", cell=8).select(F.least("l_k", "r_k").alias("l_k"), F.greatest("l_k", "r_k").alias("r_k"), "overlap", N.round_up(F.col("iou"), 4).alias("iou"))


@query(
    "interval_overlap_join",
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a, CAST(floor(epoch(ts)) AS BIGINT) + 7200 AS b FROM events)
SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND l.a < r.b AND r.a < l.b""",
)
def interval_overlap_join(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.unix_timestamp("ts").alias("a")).withColumn("b", F.col("a") + 7200)
    return P.interval_join(e, e, ("a", "b"), bin_size=14_400, keys=["user_id"]).where("l_event_id < r_event_id").select("l_event_id", "r_event_id")


@query(
    "nearest_with_limit",
    """WITH s AS (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS x, s_acctbal / 100 AS y FROM supplier), c AS (SELECT c_custkey, CAST(c_custkey % 50 AS DOUBLE) AS x, c_acctbal / 100 AS y FROM customer),
d AS (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d FROM c JOIN s ON abs(c.x - s.x) <= 5 AND abs(c.y - s.y) <= 5), n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS turn FROM d WHERE d <= 5)
SELECT c.c_custkey, n.s_suppkey, floor(n.d * 10000 + 0.5) / 10000 AS distance FROM c LEFT JOIN n ON n.c_custkey = c.c_custkey AND turn = 1""",
)
def nearest_with_limit(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", (F.col("c_custkey") % 50).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 50).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return P.nearest(c, s, "c_custkey", "s_suppkey", limit=5).select("c_custkey", "s_suppkey", N.round_up(F.col("distance"), 4).alias("distance"))


@query(
    "nearest_value_join",
    """WITH l AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS v FROM events WHERE event_type = 'click'), r AS (SELECT event_id AS rid, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS v FROM events WHERE event_type <> 'click'),
d AS (SELECT l.event_id, r.rid, abs(l.v - r.v) AS gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.v - r.v), r.v, r.rid) AS turn FROM l JOIN r ON l.user_id = r.user_id)
SELECT l.event_id, d.rid, d.gap FROM l LEFT JOIN d ON d.event_id = l.event_id AND turn = 1""",
)
def nearest_value_join(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.unix_timestamp("ts").alias("v"))
    return P.nearest_value(e.where("event_type = 'click'"), e.where("event_type <> 'click'").withColumnRenamed("event_id", "rid"), ["user_id"], "v", "event_id", "rid")


@query(
    "best_block_lookup",
    f"""WITH w AS ({_BOX}), z AS ({_ZONE}),
p AS (SELECT w.k AS k, z.k AS block, greatest(0, least(w.x1, z.x1) - greatest(w.x0, z.x0)) * greatest(0, least(w.y1, z.y1) - greatest(w.y0, z.y0)) AS o,
  sqrt(pow(greatest(0, greatest(w.x0, z.x0) - least(w.x1, z.x1)), 2) + pow(greatest(0, greatest(w.y0, z.y0) - least(w.y1, z.y1)), 2)) AS d FROM w CROSS JOIN z),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o DESC, d, block) AS turn FROM p WHERE d <= 2) SELECT w.k, n.block FROM w LEFT JOIN n ON n.k = w.k AND turn = 1""",
)
def best_block_lookup(t: Tables) -> DataFrame:
    return P.best_block(_boxes(t), _zones(t).withColumnRenamed("k", "block"), "k", "block", cell=8, limit=2.0)


@query(
    "overlap_shares",
    f"""WITH a AS ({_ZONE}), z AS (SELECT *, 'kind' || CAST(k % 3 AS VARCHAR) AS kind FROM ({_BOX})),
p AS (SELECT a.k AS k, z.k AS zk, z.kind, (least(a.x1, z.x1) - greatest(a.x0, z.x0)) * (least(a.y1, z.y1) - greatest(a.y0, z.y0)) AS o, (z.x1 - z.x0) * (z.y1 - z.y0) AS own FROM a JOIN z ON a.x0 < z.x1 AND z.x0 < a.x1 AND a.y0 < z.y1 AND z.y0 < a.y1),
q AS (SELECT * FROM p WHERE o >= 2 OR o >= 0.5 * own), n AS (SELECT k, kind, count(*) AS c FROM q GROUP BY 1, 2)
SELECT q.k, count(*) AS n_parcels, string_agg('Z' || zk, ';' ORDER BY 'Z' || zk) AS parcel_ids, (SELECT string_agg(kind || '=' || c, ';' ORDER BY kind || '=' || c) FROM n WHERE n.k = q.k) AS kinds FROM q GROUP BY q.k""",
)
def overlap_shares(t: Tables) -> DataFrame:
    z = _boxes(t).withColumn("kind", F.concat(F.lit("kind"), F.col("k") % 3)).withColumn("parcel", F.concat(F.lit("Z"), F.col("k")))
    return P.overlap_shares(_zones(t), z, "k", "parcel", "kind", cell=8, least_area=2, least_share=0.5)


# --- selection ---------------------------------------------------------------------------------------------


@query(
    "topk_per_group_cap",
    """SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 20 ORDER BY value DESC, event_id LIMIT 50""",
)
def topk_per_group_cap(t: Tables) -> DataFrame:
    return M.caps(t.events.select("event_id", "event_type", "value"), "event_type", "value", "event_id", per_tile=20, total=50)


@query("drop_noisiest", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id DESC) AS r, count(*) OVER () AS n FROM events) WHERE r > floor(0.1 * n)")
def drop_noisiest(t: Tables) -> DataFrame:
    return M.drop_worst(t.events.select("event_id", "value"), "value", "event_id", 0.1)


@query("hold_out_tiles", "SELECT p_partkey, big FROM (SELECT p_partkey, p_size > 25 AS big, row_number() OVER (PARTITION BY p_size > 25 ORDER BY md5(CAST(p_partkey AS VARCHAR)), p_partkey) AS r FROM part) WHERE r <= CASE WHEN big THEN 12 ELSE 8 END")
def hold_out_tiles(t: Tables) -> DataFrame:
    return M.hold_out(t.part.select("p_partkey", (F.col("p_size") > 25).alias("big")), "p_partkey", "big", 20, 0.6)


@query(
    "drop_confirmed_boxes",
    f"""WITH b AS (SELECT *, k % 5 AS tile FROM ({_BOX})), z AS (SELECT *, k % 5 AS tile FROM ({_ZONE})) SELECT a.* FROM b a WHERE NOT EXISTS (SELECT 1 FROM z c WHERE c.tile = a.tile AND a.x0 < c.x1 AND c.x0 < a.x1 AND a.y0 < c.y1 AND c.y0 < a.y1
AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) - (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0))) >= 0.3)""",
)
def drop_confirmed_boxes(t: Tables) -> DataFrame:
    b = _boxes(t).withColumn("tile", F.col("k") % 5)
    return M.drop_duplicates_of(b, _zones(t).withColumn("tile", F.col("k") % 5), "tile", "k")


@query("nms_1d")
def nms_1d(t: Tables) -> DataFrame:
    """Greedy suppression per tile; tested against brute force."""
    b = _boxes(t).withColumn("tile", F.col("k") % 20).withColumn("rank", (F.col("k") * 7919 % 1009).cast("double"))
    return M.suppress(b, "tile", "k", "rank", limit=0.2, cell=8).where("kept").select("tile", "k")


def _matched(t: Tables, method: str) -> DataFrame:
    b = _boxes(t).withColumn("tile", F.col("k") % 20)
    return M.match_boxes(b, _zones(t), "tile", "k", "k", cell=8, least=0.1, method=method)


@query("greedy_match")
def greedy_match(t: Tables) -> DataFrame:
    return _matched(t, "greedy")


@query("optimal_match")
def optimal_match(t: Tables) -> DataFrame:
    return _matched(t, "optimal")


@query("dedupe_points")
def dedupe_points(t: Tables) -> DataFrame:
    p = t.customer.select("c_custkey", F.col("c_nationkey").alias("block"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_acctbal") / 100).alias("y"))
    return M.dedupe(p, "block", ["c_custkey"], ["x", "y"], limit=3.0)


@query("contiguous_parts")
def contiguous_parts(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_brand").alias("brand"), "p_partkey", "p_size")
    return M.parts_of_sizes(p, "brand", ["p_partkey"], "p_size", budget=300)


# --- graphs ------------------------------------------------------------------------------------------------


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + p_size * 37 AS b FROM part), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, reach) AS (SELECT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach) SELECT node, min(reach) AS component FROM r GROUP BY node""",
)
def graph_components(t: Tables) -> DataFrame:
    return G.components(t.part.select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + F.col("p_size") * 37).alias("b")))


_ROADS = "SELECT CAST(c_nationkey AS BIGINT) AS a, c_custkey % 25 AS b, CAST(1 + c_custkey % 9 AS BIGINT) AS w FROM customer"


def _roads(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"), (1 + F.col("c_custkey") % 9).alias("w"))


@query("adjacency", f"WITH e AS ({_ROADS}), o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM e WHERE a <> b GROUP BY 1, 2) SELECT * FROM o UNION ALL SELECT b, a, w FROM o")
def adjacency(t: Tables) -> DataFrame:
    return G.adjacency(_roads(t), "w")


_LENGTHS = f"""WITH RECURSIVE e AS ({_ROADS}), s AS (SELECT a, b, w FROM e UNION SELECT b, a, w FROM e),
r(source, node, dist) AS (SELECT n_nationkey, CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT) FROM nation UNION SELECT r.source, s.b, r.dist + s.w FROM r JOIN s ON s.a = r.node WHERE r.dist + s.w <= 40)
SELECT CAST(source AS BIGINT) AS source, node, min(dist) AS dist FROM r GROUP BY 1, 2"""


@query("shortest_path_len", _LENGTHS)
def shortest_path_len(t: Tables) -> DataFrame:
    return G.shortest_lengths(_roads(t), t.nation.select(F.col("n_nationkey").cast("long").alias("node")), "w")


@query("distance_matrix", f"SELECT source, node, CAST(dist AS DOUBLE) AS dist FROM ({_LENGTHS})")
def distance_matrix(t: Tables) -> DataFrame:
    """The same distances, as doubles."""
    return G.distance_matrix(_roads(t), t.nation.select(F.col("n_nationkey").alias("node")), "w")


# --- sets, bundles, changes --------------------------------------------------------------------------------


@query("distinct_union", "SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier UNION SELECT o_custkey FROM orders")
def distinct_union(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("id")).union(t.supplier.select("s_suppkey")).union(t.orders.select("o_custkey")).distinct()


@query("union_missing_columns", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def union_missing_columns(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@query(
    "latest_copy_wins",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
)
def latest_copy_wins(t: Tables) -> DataFrame:
    """The last copy of each key, a row per key by one aggregate."""
    last = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return last.select("user_id", "m.event_id", "m.event_type")


@query(
    "changed_state",
    "SELECT * FROM (SELECT event_id, user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, event_type AS now FROM events) WHERE was IS NOT NULL AND was <> now",
)
def changed_state(t: Tables) -> DataFrame:
    """State changes, as a row trigger would see them."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", "user_id", F.lag("event_type").over(w).alias("was"), F.col("event_type").alias("now")).where("was is not null and was <> now")


@query(
    "visible_rows",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus <> 'P'",
)
def visible_rows(t: Tables) -> DataFrame:
    """Row policy as a predicate: rows of one's own tenant that are not drafts."""
    mine = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus <> 'P'").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(
    "group_by_farm",
    """SELECT coalesce(n_name, '__none') AS farm, count(*) AS n, string_agg(DISTINCT CAST(c_custkey % 7 AS VARCHAR), ';' ORDER BY CAST(c_custkey % 7 AS VARCHAR)) AS blocks FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON c_nationkey = n_nationkey GROUP BY 1""",
)
def group_by_farm(t: Tables) -> DataFrame:
    farms = t.nation.where("n_regionkey <> 0").select("n_nationkey", "n_name")
    j = t.customer.join(F.broadcast(farms), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations
    return j.groupBy(F.coalesce("n_name", F.lit("__none")).alias("farm")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set((F.col("c_custkey") % 7).cast("string"))), ";").alias("blocks"))


@query(
    "event_sessions",
    """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 3600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n FROM s GROUP BY user_id, s.n""",
)
def event_sessions(t: Tables) -> DataFrame:
    """Sessions that a silence of an hour ends (the watchdog's rule)."""
    s = t.events.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "session_start", "last_event", "n")


@query("money_report", "SELECT c_nationkey, printf('%.2f', CAST(sum(CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 100) AS cell FROM customer GROUP BY 1")
def money_report(t: Tables) -> DataFrame:
    """Sums as fixed-decimal report cells."""
    from fieldlark.functions.text import format_fixed

    return t.customer.groupBy("c_nationkey").agg(format_fixed(F.sum(cents("c_acctbal")).cast("double") / 100, 2).alias("cell"))


# --- event windows -----------------------------------------------------------------------------------------


@query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS stop, event_type, count(*) AS n, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total, max(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS top FROM events GROUP BY ALL")
def tumbling_windows(t: Tables) -> DataFrame:
    from fieldlark.streaming.events import windowed

    return windowed(t.events.select("ts", "event_type", cents("value").alias("v")), "ts", "event_type", "v", size="1 day")


@query(
    "sliding_windows",
    """WITH e AS (SELECT event_type, ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS v, unnest([0, 1]) AS k FROM events), w AS (SELECT event_type, v, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM e)
SELECT start, start + INTERVAL 12 HOUR AS stop, event_type, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS top FROM w GROUP BY ALL""",
)
def sliding_windows(t: Tables) -> DataFrame:
    from fieldlark.streaming.events import windowed

    return windowed(t.events.select("ts", "event_type", cents("value").alias("v")), "ts", "event_type", "v", size="12 hours", slide="6 hours")


@query("best_tour")
def best_tour(t: Tables) -> DataFrame:
    """Closed tours over the suppliers of each nation group, exact or improved by a fixed number of sweeps."""
    import numpy as np

    from fieldlark.operators import tours as R

    p = t.supplier.select((F.col("s_nationkey") % 5).cast("long").alias("block"), "s_suppkey", (F.col("s_suppkey") % 97).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))

    def run(g):
        import pandas as pd

        g = g.sort_values("s_suppkey")
        xy = g[["x", "y"]].to_numpy()
        tour = R.improve_tour(xy, R.nearest_neighbour_tour(xy), 5)
        return pd.DataFrame({"block": g["block"].iloc[0], "seq": np.arange(len(tour)), "s_suppkey": g["s_suppkey"].to_numpy()[tour]})

    apart = p.repartition(20, "block")  # a task a block: few bytes are much work, and small partitions would be put together
    return apart.groupBy("block").applyInPandas(run, "block long, seq long, s_suppkey long")


@query("tile_raster_masks")
def tile_raster_masks(t: Tables) -> DataFrame:
    """Component counts and areas of a synthetic mask tile per size class of parts."""
    import numpy as np

    from fieldlark.operators import geometry as Y
    from fieldlark.operators import raster as R

    p = t.part.select((F.col("p_partkey") % 16).alias("tile"), (F.col("p_partkey") % 61).alias("u"), F.col("p_size").alias("v"))

    def run(g):
        import pandas as pd

        mask = np.zeros((64, 64), bool)
        mask[g["v"].to_numpy(), g["u"].to_numpy()] = True
        labels, n = R.label_components(mask)
        rings = R.outline_rings(mask)
        return pd.DataFrame({"tile": [g["tile"].iloc[0]], "components": [n], "pixels": [int(mask.sum())], "ring_area": [abs(sum(Y.ring_area(r) for r in rings))]})

    return p.groupBy("tile").applyInPandas(run, "tile long, components long, pixels long, ring_area double")


# --- survey compositions -----------------------------------------------------------------------------------

_LINE = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS pos FROM events"


@query(
    "occupancy_profile",
    f"""WITH p AS ({_LINE}), r AS (SELECT user_id, max(pos) + 1 AS length FROM p GROUP BY 1), b AS (SELECT user_id, unnest(range(CAST(ceil(length / 21600.0) AS BIGINT))) AS bin FROM r)
SELECT b.user_id, b.bin, count(p.pos) AS n FROM b LEFT JOIN p ON p.user_id = b.user_id AND p.pos // 21600 = b.bin GROUP BY 1, 2""",
)
def occupancy_profile(t: Tables) -> DataFrame:
    from fieldlark.operators import survey as V

    p = t.events.select("user_id", (F.unix_timestamp("ts") - 1704067200).alias("at"))
    return V.occupancy_profile(p, p.groupBy("user_id").agg((F.max("at") + 1).alias("length")), "user_id", "at", "length", bin_m=21_600)


@query(
    "profile_gap_kinds",
    f"""WITH p AS ({_LINE}), r AS (SELECT user_id, max(pos) + 1 AS length FROM p GROUP BY 1), b AS (SELECT user_id, unnest(range(CAST(ceil(length / 21600.0) AS BIGINT))) AS bin FROM r),
o AS (SELECT b.user_id, b.bin, count(p.pos) = 0 AS e FROM b LEFT JOIN p ON p.user_id = b.user_id AND p.pos // 21600 = b.bin GROUP BY 1, 2),
i AS (SELECT *, bin - row_number() OVER (PARTITION BY user_id, e ORDER BY bin) AS island, max(bin) OVER (PARTITION BY user_id) AS last FROM o),
g AS (SELECT user_id, min(bin) AS a, max(bin) + 1 AS b, any_value(last) + 1 AS n FROM i WHERE e GROUP BY user_id, island)
SELECT user_id, a * 21600 AS gap_start, b * 21600 AS gap_stop, (b - a) * 21600 AS gap, CASE WHEN a <= 0 AND b >= n THEN 'full' WHEN a <= 0 THEN 'head' WHEN b >= n THEN 'tail' ELSE 'interior' END AS kind FROM g WHERE (b - a) * 21600 >= 43200""",
)
def profile_gap_kinds(t: Tables) -> DataFrame:
    from fieldlark.operators import survey as V

    return V.profile_gaps(occupancy_profile(t), "user_id", bin_m=21_600, least=43_200)


@query(
    "farms_of_blocks",
    f"""WITH RECURSIVE b AS (SELECT 'V' || k AS block, k, x0 * 4 AS x0, y0 * 4 AS y0, x1 * 4 - 3 AS x1, y1 * 4 - 7 AS y1 FROM ({_BOX})),
l AS (SELECT p.k AS a, q.k AS b FROM b p JOIN b q ON p.k <> q.k AND pow(greatest(0, greatest(p.x0, q.x0) - least(p.x1, q.x1)), 2) + pow(greatest(0, greatest(p.y0, q.y0) - least(p.y1, q.y1)), 2) <= 4),
r(node, reach) AS (SELECT k, k FROM b UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach), c AS (SELECT node, min(reach) AS farm FROM r GROUP BY node)
SELECT CASE WHEN row_number() OVER (ORDER BY farm) < 10 THEN 'F0' ELSE 'F' END || row_number() OVER (ORDER BY farm) AS farm_id, string_agg(b.block, ',' ORDER BY b.k) AS blocks, count(*) AS n_blocks, CAST(sum((x1 - x0) * (y1 - y0)) AS DOUBLE) AS area FROM c JOIN b ON b.k = c.node GROUP BY farm""",
)
def farms_of_blocks(t: Tables) -> DataFrame:
    from fieldlark.operators import survey as V

    k = F.col("k")
    b = _boxes(t).select(F.concat(F.lit("V"), k).alias("block"), (F.col("x0") * 4).alias("x0"), (F.col("y0") * 4).alias("y0"), (F.col("x1") * 4 - 3).alias("x1"), (F.col("y1") * 4 - 7).alias("y1")).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    links = V.place_links(b, "block", gap_m=2.0, cell=16)
    return V.farms(b, links, "block", "area")


@query("cut_overlaps", f"WITH b AS ({_BOX}), p AS (SELECT l.k AS a, r.k AS b FROM b l JOIN b r ON l.k < r.k AND l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1), s AS (SELECT l_partkey AS k, CAST(count(*) AS DOUBLE) AS s FROM lineitem GROUP BY 1), j AS (SELECT p.a, p.b, coalesce(x.s, 0) AS sa, coalesce(y.s, 0) AS sb FROM p LEFT JOIN s x ON x.k = p.a LEFT JOIN s y ON y.k = p.b) SELECT CASE WHEN sa > sb OR sa = sb AND a < b THEN b ELSE a END AS loser, CASE WHEN sa > sb OR sa = sb AND a < b THEN a ELSE b END AS winner FROM j")
def cut_overlaps(t: Tables) -> DataFrame:
    from fieldlark.operators import survey as V

    support = t.lineitem.groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("support"))
    pairs = P.crowd_pairs(_boxes(t).join(support, "k", "left"), "k", cell=8)
    return V.contest(pairs.select(F.col("l_k").alias("a"), F.col("r_k").alias("b"), F.col("l_support").alias("sa"), F.col("r_support").alias("sb")))
