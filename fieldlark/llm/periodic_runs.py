"""Stretches of text that repeat themselves, found by divide and conquer over word ids.

Words (maximal runs of bytes other than ``0x20`` and ``0x09-0x0D``) of a text are
interned as numbers. A run is a stretch with smallest period q and at least
``repeats`` periods and ``min_words`` words that no neighbouring word extends.
After Main and Lorentz, a stretch is halved; Z-functions of its halves at the
midpoint give, for each period, how far words agree to the left and right of it,
so every run that crosses the midpoint is found there, whole; runs beside it are
found in the halves. Intervals that a neighbouring word would extend belong to
an ancestor and are left out; of equal intervals the smallest period stays.

Before that, words that cannot lie in a run are set apart, exactly: after its
first period each word of a run was met at most one period before, so a stretch
of words met again within a third of its length must hold what is left of a run.
Prose falls apart under that rule, and only the rest is halved.

A text is one row of one task: n words take O(n log n) steps and some 100 bytes a
word. Nothing is shuffled. Null texts have no words, as empty ones. Repeated rows
and ids are rows of their own; an empty table gives no row; other columns are
left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PIECE = 1 << 20  # bytes split into words at once
_OUT = 1 << 22  # bytes of text given back at once
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def intern(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """(ids of the words in order, the distinct words by id)."""
    table: defaultdict[bytes, int] = defaultdict()
    table.default_factory = table.__len__
    parts, at = [], 0
    while at < len(data):
        found = _BLANK.search(data, at + _PIECE)
        stop = found.start() if found else len(data)
        parts.append(np.array([table[w] for w in data[at:stop].split()], np.int64))
        at = stop
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), list(table)


def _z(s: list[int], m: int) -> list[int]:
    """For i < m, how many words of s[i:] agree with s."""
    n = len(s)
    z = [0] * m
    if m:
        z[0] = n
    left = right = 0
    for i in range(1, m):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _agree(s: list[int], z: list[int], t: list[int], m: int) -> list[int]:
    """For i < m, how many words of t[i:] agree with s; z: of s."""
    out = [0] * m
    n, most = len(t), len(s)
    left = right = 0
    for i in range(m):
        k = 0
        if left < i < right:
            k = z[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while k < most and i + k < n and s[k] == t[i + k]:
            k += 1
        out[i] = k
        left, right = i, i + k
    return out


def _crossing(w: list[int], lo: int, mid: int, hi: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, stop, period) of stretches of w[lo:hi] around mid with so many periods."""
    before, after = w[lo:mid][::-1], w[mid:hi]
    most = (hi - lo) // repeats
    za, zb = _z(after, min(len(after), most + 1)), _z(before, min(len(before), most + 1))
    right, left = min(most, len(after)), min(most, len(before))
    back = _agree(before, zb, w[lo : mid + right][::-1], right)
    ahead = _agree(after, za, w[mid - left : hi], left)
    for q in range(1, right + 1):
        a, b = back[right - q], za[q] if q < len(after) else 0
        if a + b + q >= repeats * q:
            yield mid - a, mid + q + b, q
    for q in range(1, left + 1):
        a, b = zb[q] if q < len(before) else 0, ahead[left - q]
        if a + b + q >= repeats * q:
            yield mid - q - a, mid + b, q


def _stretches(ids: np.ndarray, min_words: int, repeats: int) -> list[tuple[int, int]]:
    """Stretches that hold every run."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order][1:] == ids[order][:-1]
    gap = np.full(n, n)
    gap[order[1:][same]] = np.diff(order)[same]
    alive = gap < n
    least = min(max(min_words - q, (repeats - 1) * q) for q in range(1, min_words + 1))
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        size = stop - start
        cap = np.where(size >= least, size // (repeats - 1), 0)
        fits = np.zeros(n, bool)
        fits[alive] = gap[alive] <= np.repeat(cap, size)
        if (fits == alive).all():
            return [(max(0, int(a - c)), int(b)) for a, b, c in zip(start, stop, cap)]
        alive = fits


def find_runs(ids: np.ndarray, min_words: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period; repeats: 2 at least."""
    n, found = len(ids), {}
    if n < min_words:
        return []
    windows = _stretches(ids, min_words, repeats)
    w = ids.tolist() if windows else []
    while windows:
        lo, hi = windows.pop()
        if hi - lo < max(min_words, repeats):
            continue
        mid = (lo + hi) // 2
        for a, b, q in _crossing(w, lo, mid, hi, repeats):
            if b - a < min_words or a and w[a - 1] == w[a - 1 + q] or b < n and w[b] == w[b - q]:
                continue
            found[a, b] = min(q, found.get((a, b), q))
        windows += [(lo, mid), (mid, hi)]
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    depth = np.zeros(len(ids) + 1, np.int64)
    for a, size, q in runs:
        depth[a + q] += 1
        depth[a + size] -= 1
    return b" ".join([words[i] for i in ids[np.cumsum(depth)[:-1] == 0].tolist()])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, repeats: int = 4) -> DataFrame:
    """(id, n_words, runs, text): runs as (start, length, period) in words; text with each run's first period only, words joined by one blank."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, counts, runs, texts = 0, 0, [], [], []
            column = batch.column(1).cast(pa.binary())
            for i in range(len(column)):
                ids, words = intern(column[i].as_py() or b"")
                found = find_runs(ids, min_words, repeats)
                counts.append(len(ids))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                texts.append(collapsed(ids, words, found))
                size += len(texts[-1])
                if size >= _OUT or i + 1 == len(column):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "n_words", "runs", "text"])
                    first, size, counts, runs, texts = i + 1, 0, [], [], []

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", F.col("text").alias(text_col))


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the texts, chosen by id, the words from a place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    white = F.translate(F.col("text"), "\t\n\x0b\x0c\r", "     ")
    hit = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split(white, " ", -1), "")))
    sized = hit.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    source: Column = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise((F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(source, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The result of op12 from periodic_runs: the longest run, and digests of all."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.withColumn("longest", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )
