"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

A document's set holds the hashes of its distinct ``shingle``-word runs (ASCII
case folded); one with fewer words has its whole sequence as one. Equal sets
are one class, so exact copies cost one signature. A signature has a register
per bucket: the leading-zero count and ten mantissa bits of the bucket's least
hash. Sets of over SMALL elements are partitioned over the buckets (an empty
bucket borrows from the first filled one of its own permutation); sets of up to
SMALL / 0.8 have a hash function per bucket. Sets in between have both kinds,
so any two that can reach the threshold share a kind.

Bands of registers are hashed; a pair of linked sets (0.8) shares none of the
40 bands of 5 with odds of 1e-7. No bucket's pairs are all made: a bucket has
one hub, every class is tested against the ``HUBS`` hubs it shares most buckets
with, and the links found make components. What may still be linked then are
classes of different components in one bucket. Those classes order their
members by rarity and meet only over members of their rarest fifth that leave
enough others behind, as sets that reach the threshold must (prefix and
positional filter), so variants of one text with many edits of their own do not
meet again. A test is the collision-corrected register
estimate with a margin of five deviations, then the full sets.

Nulls and texts without words have an empty set and are linked with nothing.
Repeated rows are copies; rows are told apart by their set, so repeated ids are
no trouble; a null id counts as larger than any other. An empty table gives no
row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldlark.operators.graph import components
from fieldlark.session import Steps

from .blocks import Block, blocks, mix

BANDS, ROWS, MANTISSA, SMALL = 40, 5, 10, 250
BUCKETS = BANDS * ROWS
HUBS = 2
_rng = np.random.Generator(np.random.PCG64(71))
_A = _rng.integers(0, 2**63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, BUCKETS, dtype=np.uint64)
_BORROW = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.int32)
_U = np.uint64


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of its n-word runs."""
    h, at = block.hashes, block.word_at
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for k in range(n):
            run = mix(run * _U(3) + h[k : k + len(run)])
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                out.append(np.unique(run[a : b - n + 1]))
            else:
                whole = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    whole = mix(whole * _U(5) + h[k : k + 1])
                out.append(whole if b > a else whole[:0])
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        both = np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(), mix(s ^ _U(0x14057B7EF767814F)).sum() + _U(len(s))], np.uint64)
    return tuple(both.view(np.int64).tolist())


def _registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit hashes."""
    v = np.maximum(least >> _U(11), _U(1))
    e = np.frexp(v.astype(np.float64))[1].astype(np.uint64)
    zeros = _U(53) - e
    return (zeros * _U(1 << MANTISSA) + ((v << zeros) >> _U(52 - MANTISSA)) % _U(1 << MANTISSA)).astype(np.uint16)


def small_signature(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = s[:, None] * _A + _B
        return _registers(mix((x ^ (x >> _U(32))).min(0)))


def large_signature(s: np.ndarray) -> np.ndarray:
    y = mix(s ^ _U(0x9E3779B97F4A7C15))
    bucket = ((y >> _U(32)) * _U(BUCKETS)) >> _U(32)
    with np.errstate(over="ignore"):
        value = mix(y + _U(1))
    least = np.full(BUCKETS, 2**64 - 1, np.uint64)
    np.minimum.at(least, bucket.astype(np.int64), value)
    filled = np.zeros(BUCKETS, bool)
    filled[bucket.astype(np.int64)] = True
    if not filled.all():
        gaps = np.flatnonzero(~filled)
        order = _BORROW[gaps]
        least[gaps] = least[order[np.arange(len(gaps)), filled[order].argmax(1)]]
    return _registers(least)


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less chance collisions."""
    chance = 0.1699195 * 2.0**-MANTISSA * 4 * n_a * n_b / (n_a + n_b) ** 2
    return (same - chance) / (1 - chance)


def _sets_of(batches: Iterator[pa.RecordBatch], column: int, shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for block in blocks(batch.column(column)):
            yield batch.slice(block.first, block.n), shingle_sets(block, shingle)


def _signatures(shingle: int, threshold: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets_of(batches, 1, shingle):
            hashes = [set_hash(s) for s in sets]
            small = [small_signature(s).tobytes() if 0 < len(s) <= SMALL * 100 // threshold + 1 else None for s in sets]
            large = [large_signature(s).tobytes() if len(s) >= SMALL else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array(small, pa.binary()), pa.array(large, pa.binary())],
                names=["id", "t", "n_shingles", "h1", "h2", "small", "large"],
            )

    return run


def _band_keys() -> Column:
    def of(kind: str) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.lit(kind), i, F.substring(F.col(kind), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
        return F.when(F.col(kind).isNotNull(), keys).otherwise(F.array().cast("array<long>"))

    return F.concat(of("small"), of("large"))


def _hub_pairs(shared: DataFrame, steps: Steps) -> DataFrame:
    """Pairs (a, b), a < b: each node with the HUBS hubs that it shares most buckets with. shared: (key, node, central).

    A bucket's hub is its most central node (the one with most mates over all
    its buckets): the original of many edited copies is most central.
    """
    hubs = steps.put("hubs", shared.groupBy("key").agg(F.min_by("node", F.struct((-F.col("central")).alias("c"), F.xxhash64("node").alias("x"))).alias("hub")))
    met = shared.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("times"))
    best = Window.partitionBy("node").orderBy(F.col("times").desc(), F.xxhash64("hub"))
    top = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS)
    return top.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose registers allow the threshold."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "small", "large"))), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n_a, n_b = (col[f"n_{s}"].to_numpy().astype(float) for s in "ab")
            same = np.zeros(batch.num_rows)
            done = np.zeros(batch.num_rows, bool)
            for kind in ("small", "large"):
                x, y = col[f"{kind}_a"], col[f"{kind}_b"]
                use = np.flatnonzero(x.is_valid().to_numpy(False) & y.is_valid().to_numpy(False) & ~done)
                if len(use):
                    both = [np.frombuffer(b"".join(v.take(pa.array(use)).to_pylist()), np.uint16).reshape(-1, BUCKETS) for v in (x, y)]
                    same[use] = (both[0] == both[1]).mean(1)
                    done[use] = True
            margin = 5 * np.sqrt(0.16 * (1 / BUCKETS + 1 / np.maximum(n_a, n_b)))
            like = estimate(same, n_a, n_b)
            keep = done & (like >= threshold / 100 - margin)
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _members(nodes: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, members): full sets of the nodes, made from their texts again."""
    need = classes.select("node", "first", "h1", "h2").join(nodes, "node", "left_semi")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t"))  # equal ids with other texts don't meet
    texts = docs.join(need, own).select("node", "h1", "h2", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _sets_of(batches, 3, shingle):
            want = list(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()))
            keep = [i for i, s in enumerate(found) if set_hash(s) == want[i]]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i].tobytes() for i in keep], pa.binary())], names=["node", "members"])

    return texts.mapInArrow(sets, "node long, members binary").dropDuplicates(["node"])


def _meeting(nodes: DataFrame, members: DataFrame, threshold: int, steps: Steps) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose rarest members meet. nodes: (node, component).

    A node's members are ranked by how many nodes have them, counted exactly
    (map-side first; ties by hash).
    """

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(2)]
                size = np.array([len(s) for s in sets], np.int64)
                at = np.repeat(np.arange(len(sets)), size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(size[at]), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["node", "component", "n", "member"])

    every = nodes.join(members, "node").select("node", "component", "members").mapInArrow(apart, "node long, component long, n long, member long")
    seen = every.groupBy("member").agg(F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = steps.put("mixed", seen.where("low < high").select("member", "often"))
    # members of one component alone come first in the order: they take places, but no one meets there
    whole = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(whole) + F.row_number().over(whole.orderBy("often", "member")) - 1
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    placed = every.join(mixed, "member").withColumn("place", place).where(F.col("place") < prefix)
    left = steps.put("rare", placed.select("member", "component", F.col("node").alias("a"), "n", "place"))
    right = left.select("member", F.col("a").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("other"))
    # the first member that linked sets share leaves enough others behind it in both
    near_size = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) * (100 + threshold) >= (F.col("n") + F.col("n_b")) * threshold
    return left.join(right, "member").where((F.col("component") != F.col("other")) & (F.col("a") < F.col("b")) & near_size).select("a", "b").distinct()


def _confirmed(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((p, q))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inter >= threshold * (len(p) + len(q) - inter))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(members.withColumnsRenamed({"node": "a", "members": "set_a"}), "a").join(members.withColumnsRenamed({"node": "b", "members": "set_b"}), "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; threshold: percent of the union.

    component_id is the least id that links reach, kept whether it is the row's own.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"))
    steps = Steps(docs.sparkSession)
    rows = steps.put("rows", docs.mapInArrow(_signatures(shingle, threshold), f"id {kind}, t long, n_shingles long, h1 long, h2 long, small binary, large binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(first, F.max("n_shingles").alias("n"), F.first("small").alias("small"), F.first("large").alias("large"))
    classes = steps.put("classes", classes.orderBy("first").withColumn("node", F.monotonically_increasing_id()))  # the least node of a component has its least id

    bands = classes.select("node", F.explode(_band_keys()).alias("key"))
    keys = steps.put("keys", bands.groupBy("key").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1"))
    shared = steps.put("met", bands.join(keys, "key"))
    shared = steps.put("shared", shared.select("key", "node").join(shared.groupBy("node").agg(F.sum("mates").alias("central")), "node"))
    steps.drop("met")
    pairs = steps.put("pairs", _hub_pairs(shared, steps))
    likely = steps.put("likely", _estimated(pairs, classes, threshold))
    ends = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    members = steps.put("members", _members(ends, classes, docs, shingle))
    links = steps.put("links", _confirmed(likely, members, threshold))

    # classes of different components in one bucket
    grouped = steps.put("grouped", shared.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    steps.drop("shared")
    keys = steps.put("keys", grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"))
    apart = steps.put("apart", grouped.join(keys, "key").select("node", "component").distinct())
    members = steps.put("members", _members(apart.select("node"), classes, docs, shingle))
    cross = _meeting(apart, members, threshold, steps).join(pairs, ["a", "b"], "left_anti")
    more = _confirmed(steps.put("likely", _estimated(cross, classes, threshold)), members, threshold)
    links = steps.put("all_links", links.union(more))

    named = classes.select("node", "h1", "h2").join(components(links), "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    named = steps.put("named", named).join(classes.select(F.col("node").alias("component"), F.col("first.id").alias("component_id")), "component")
    out = rows.select("id", "n_shingles", "h1", "h2").join(named.select("h1", "h2", "component_id"), ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    out = steps.put("out", out)
    steps.drop(*(n for n in list(steps.paths) if n != "out"))
    return out
