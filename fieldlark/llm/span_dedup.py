"""Sentences that repeat across a corpus in runs, removed but for the first.

A sentence ends at ``.``, ``!`` or ``?`` before white space, at a line end, or
at the end of the text; a stretch of over LONG words without such an end is cut
by winnowing, after the least word hash (the first of equal ones) of every WINDOW
words in a row. So there is a cut in every WINDOW words, equal stretches are cut
alike but for WINDOW - 1 words at their ends, and any 50 words that two documents
share have a run in common if their sentences end alike: less than LONG words to
the first cut, then less than ``min_words`` and one more sentence of at most
LONG. Twenty words are the most for which this holds; shorter runs are phrases
that clean texts share. From each sentence a run goes on until it has ``min_sentences`` and
``min_words``; its 128-bit hash covers its words, ASCII case folded. A run
belongs to the document with the least id that has it (and there to its first
place); every sentence that any other occurrence covers is removed.

Hashes are joined globally: least id per hash (summed map-side), then back to
the runs; only (id, hash) of repeated runs goes on to the texts. Hot runs are
split by the engine's skew join.

Rows with equal ids count as one document. Null ids count as one id, after all
others. Null texts stay null; texts that are removed whole become empty;
repeated rows are kept alike; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, blocks, mix

LONG, WINDOW = 16, 8
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True
_U = np.uint64
_Q = (0x9E6C63D0676A9A99 | 1, 0xD6E8FEB86659FD93 | 1)
_INVERSE = tuple(pow(q, -1, 2**64) for q in _Q)


@dataclass
class Sentences:
    """Of a block: sentence k has words first[k] .. first[k + 1], of text doc[k]."""

    first: np.ndarray
    doc: np.ndarray
    start: np.ndarray  # sentence numbers where runs start
    stop: np.ndarray  # and end, exclusive
    h1: np.ndarray
    h2: np.ndarray


def _powers(base: int, n: int) -> np.ndarray:
    step = np.full(n, base, np.uint64)
    step[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(step)


def sentences(block: Block, min_sentences: int, min_words: int) -> Sentences:
    n = len(block.starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(np.zeros(1, np.int64), none, none, none, none, none)
    data, s, e = block.data, block.starts, block.ends
    tail = e - 1
    for _ in range(2):
        tail = np.where(_CLOSE[data[tail]] & (tail > s), tail - 1, tail)
    last = np.zeros(n + 1, bool)
    last[:n] = _ENDS[data[tail]]
    lines = np.flatnonzero(data == 10)
    word = np.searchsorted(s, lines) - 1  # the word before a line end
    last[word[word >= 0]] = True
    ends_of_text = block.word_at[1:] - 1
    last[ends_of_text[ends_of_text >= 0]] = True
    last = last[:n]
    first = np.concatenate(([0], np.flatnonzero(last) + 1))
    size = np.diff(first)
    if (size > LONG).any():
        inside = np.repeat(size > LONG, size)
        stretch = np.repeat(np.arange(len(size)), size)
        window = np.flatnonzero(inside[WINDOW - 1 :] & (stretch[WINDOW - 1 :] == stretch[: n - WINDOW + 1]))  # first words
        last[window + np.lib.stride_tricks.sliding_window_view(mix(block.hashes), WINDOW)[window].argmin(1)] = True
        first = np.concatenate(([0], np.flatnonzero(last) + 1))
    count = len(first) - 1
    doc = np.searchsorted(block.word_at, first[:-1], "right") - 1
    top = np.searchsorted(doc, doc, "right")  # sentences of the text end here
    k = np.arange(count)
    stop = np.maximum(np.searchsorted(first, first[:-1] + min_words), k + min_sentences)
    start = k[stop <= top]
    stop = stop[start]
    out = []
    with np.errstate(over="ignore"):
        for q, inverse, salt in zip(_Q, _INVERSE, (0, 0xA0761D6478BD642F)):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mix(block.hashes ^ _U(salt)) | _U(1)) * _powers(q, n))))
            out.append(mix((total[first[stop]] - total[first[start]]) * _powers(inverse, n + 1)[first[start]] + (first[stop] - first[start]).astype(np.uint64)).view(np.int64))
    return Sentences(first, doc, start, stop, *out)


def _again(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True for runs that their text had before."""
    order = np.lexsort((np.arange(len(h)), h, doc))
    same = np.zeros(len(h), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = same
    return out


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, min_sentences: int, min_words: int) -> DataFrame:
    """(id, runs): hashes of the document's runs that belong to another document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                x = sentences(block, min_sentences, min_words)
                doc = x.doc[x.start]
                once = ~_again(doc, x.h1)
                ids = batch.column(0).take(pa.array(block.first + doc[once]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(x.h1[once]), pa.array(x.h2[once])], names=["id", "h1", "h2"])

    runs = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, h1 long, h2 long")
    firsts = runs.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    return runs.join(firsts, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first"))).groupBy("id").agg(F.collect_set("h1").alias("runs"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 20, keep_columns: bool = False) -> DataFrame:
    """(id, text, n_sentences, n_removed, removed): text without repeated runs; keep_columns: and the other columns of docs.

    removed: the (start, stop) UTF-8 byte spans taken out of the old text, in order.
    """
    added = ("n_sentences", "n_removed", "removed")
    extra = [c for c in docs.columns if c not in (id_col, text_col) and c.lower() not in added] if keep_columns else []
    named = [f"extra_{i}" for i in range(len(extra))]
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(n) for c, n in zip(extra, named)))
    schema = T.StructType([*(T.StructField(n, docs.schema[n].dataType) for n in ("id", "text", *named)), *T._parse_datatype_string("n_sentences long, n_removed long, removed array<struct<start:long,stop:long>>").fields])
    found = repeated_runs(docs, "id", "text", min_sentences, min_words).withColumnRenamed("id", "found_id")
    both = docs.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left").select("id", "text", "runs", *named)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = batch.slice(block.first, block.n)
                x = sentences(block, min_sentences, min_words)
                doc = x.doc[x.start]
                gone = _again(doc, x.h1)
                taken = rows.column(2)
                size = np.array([len(v) if v.is_valid else 0 for v in taken]) if taken.null_count < len(taken) else np.zeros(len(taken), int)
                for i in np.flatnonzero(size):
                    a, b = np.searchsorted(doc, [i, i + 1])
                    gone[a:b] |= np.isin(x.h1[a:b], taken[int(i)].values.to_numpy())
                depth = np.zeros(len(x.first), np.int64)  # sentences covered
                np.add.at(depth, x.start[gone], 1)
                np.add.at(depth, x.stop[gone], -1)
                covered = np.cumsum(depth)[:-1] > 0
                texts, removed, per = [], [], np.bincount(x.doc, minlength=block.n)
                lost = np.bincount(x.doc[covered], minlength=block.n)
                at = np.concatenate(([0], np.cumsum(per)))
                valid = rows.column(1).is_valid().to_numpy(False)
                for i in range(block.n):
                    if not valid[i] or not lost[i]:
                        texts.append(block.text(i) if valid[i] else None)
                        removed.append([])
                        continue
                    c = np.concatenate(([False], covered[at[i] : at[i + 1]], [False]))
                    turn = np.flatnonzero(c[1:] != c[:-1])
                    edges = np.append(block.starts[x.first[at[i] : at[i + 1]]], block.text_at[i + 1])  # a sentence takes the white space after it along
                    cuts = edges[turn].reshape(-1, 2)
                    keep = np.concatenate(([block.text_at[i]], cuts.ravel(), [block.text_at[i + 1]])).reshape(-1, 2)
                    texts.append(b"".join(block.data[a:b].tobytes() for a, b in keep).rstrip(b" \t\n\r\x0b\x0c"))
                    removed.append([{"start": int(a), "stop": int(b)} for a, b in cuts - block.text_at[i]])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *(rows.column(3 + i) for i in range(len(named))), pa.array(per.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(removed, spans)], names=["id", "text", *named, "n_sentences", "n_removed", "removed"])

    out = both.mapInArrow(cut, schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col(n).alias(c) for c, n in zip(extra, named)), *added)
