"""Token counts: pieces once per distinct pre-token, joined to frequencies.

The distinct pre-tokens of all texts (words between white space, by 64-bit hash)
are gathered with how often they occur, summed map-side, and each is counted in
pieces once. The ``common`` most frequent go to the tasks as sorted arrays of
that size, so a document's frequencies of them are joined and summed where they
are made; its rarer pre-tokens, some tens of rows a document and none of them
hot, meet the rest of the dictionary in a shuffle join. No ids of a document are
made. Two pre-tokens of one hash (odds of 2**-64 a pair) would count alike.

Words that hold ``<|`` may hold special strings and are counted where they stand.
Null texts count as empty (0 tokens); repeated rows each give a row; an empty
table gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlark.session import Steps

from .blocks import blocks, ragged
from .pieces import DEFAULT_TOKENIZER, pieces, special_words, tokenizer_path

_ENCODED = 4096  # words given to the tokenizer at once


def _pre_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, n) of each block's distinct words."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            plain = np.ones(len(block.hashes), bool)
            plain[special_words(block)] = False
            plain = np.flatnonzero(plain)
            h, first, n = np.unique(block.hashes[plain], return_index=True, return_counts=True)
            start, size = block.starts[plain[first]], (block.ends - block.starts)[plain[first]]
            at = np.concatenate((np.zeros(1, np.int64), np.cumsum(size))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(block.data[ragged(start, size)].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), words, pa.array(n)], names=["h", "word", "n"])


def dictionary(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """(h, n, pieces): each distinct pre-token of the texts, how often it occurs, its number of pieces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, _ENCODED):
                part = batch.slice(i, _ENCODED)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(memo.encode(part.column(2).to_pylist())[0], pa.int32())], names=["h", "n", "pieces"])

    words = docs.select(text_col).mapInArrow(_pre_tokens, "h long, word binary, n long")
    return words.groupBy("h").agg(F.sum("n").alias("n"), F.first("word").alias("word")).mapInArrow(encode, "h long, n long, pieces int")


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048, common: int = 1 << 18) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text; path: a vocabulary file of tokenizers, on every machine; common: pre-tokens sent to all tasks."""
    path = path or tokenizer_path(DEFAULT_TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()
    steps = Steps(docs.sparkSession)
    known = steps.put("dictionary", dictionary(docs, text_col, path))
    top = known.orderBy(F.col("n").desc(), "h").limit(common).select("h", "pieces").toArrow()  # 12 bytes each
    keys, sizes = top["h"].to_numpy().view(np.uint64), top["pieces"].to_numpy()
    order = np.argsort(keys)
    keys, sizes = keys[order], sizes[order].astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pieces(path)
        for batch in batches:
            for block in blocks(batch.column(1)):
                word, total = block.hashes, np.zeros(block.n, np.int64)
                doc = block.doc_of_word()
                odd = special_words(block)
                for w in odd.tolist():
                    total[doc[w]] += memo.one(block.word(w))
                if len(odd):
                    word, doc = np.delete(word, odd), np.delete(doc, odd)
                k = np.minimum(np.searchsorted(keys, word), max(0, len(keys) - 1))
                hit = keys[k] == word if len(keys) else np.zeros(len(word), bool)
                total += np.bincount(doc[hit], weights=sizes[k[hit]], minlength=block.n).astype(np.int64)
                rest, doc = word[~hit], doc[~hit]
                order = np.lexsort((rest, doc))
                rest, doc = rest[order], doc[order]
                first = np.flatnonzero(np.append(len(rest) > 0, (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1]))) if len(rest) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rest)))
                at = np.searchsorted(doc[first], np.arange(block.n + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(rest[first].view(np.int64)), pa.array(times, pa.int32())], names=["h", "times"]))
                ids = batch.column(0).slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(block.text_at)), pa.array(total), rare], names=["id", "n_bytes", "n_common", "rare"])

    each = docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(sums, f"id {kind}, n_bytes long, n_common long, rare array<struct<h:long,times:int>>")
    each = steps.put("documents", each.withColumn("row", F.monotonically_increasing_id()))
    rare = each.select("row", F.inline("rare")).join(known.select("h", "pieces"), "h").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rare"))
    n = F.col("n_common") + F.coalesce("n_rare", F.lit(0))
    return each.select("row", "id", "n_bytes", "n_common").join(rare, "row", "left").select(F.col("id").alias(id_col), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
