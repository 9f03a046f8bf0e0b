"""Packing of tokenised documents into fixed windows by dynamic programming.

Documents keep the order in which a partition of the table is read. Their
tokens form a stream; windows are cut at ends of documents (free), ends of
sentences (``split_penalty``) or, only inside a sentence of over
``long_sentence`` tokens (tables, symbol runs, missing full stops), every
``hard_step`` tokens (``hard_penalty``). Among all cuts with windows of at
most ``window`` tokens, the sum of padding and penalties is least:

    f(j) = pen(j) + min over i, b(j) - b(i) <= window, of f(i) + window - (b(j) - b(i))

The inner minimum slides over the boundaries, so a queue with rising
f(i) + b(i) gives every transition in constant time.

Memory is bounded: a block of ``block_tokens`` is packed at a time and the last,
still open window is carried into the next block. Each partition is packed by
itself without a shuffle, so one window a partition at most stays short.
A lost task packs its partition again to the same result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blocks import blocks, ragged
from .pieces import DEFAULT_TOKENIZER, pieces, tokenizer_path

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices of the boundaries to cut at, first and last included.

    at: rising offsets, gaps at most ``window``; penalty: of a cut at each.
    """
    b, pen = at.tolist(), penalty.tolist()
    last = len(b) - 1
    if last <= 0:
        return [0]
    g = [0] * (last + 1)  # f(i) + b(i)
    came = [0] * (last + 1)
    g[0] = b[0]
    queue: deque[int] = deque([0])
    for j in range(1, last + 1):
        bj = b[j]
        least = bj - window
        while b[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        came[j] = i
        v = g[j] = g[i] + window + pen[j]
        while queue and g[queue[-1]] > v:
            queue.pop()
        queue.append(j)
    cuts = [last]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return cuts[::-1]


class _Stream:
    """Tokens not yet given out, with the documents they are of."""

    def __init__(self, window: int, split_penalty: int, hard_penalty: int, long_sentence: int, hard_step: int, first_sequence: int):
        self.window, self.split, self.hard, self.sequence = window, split_penalty, hard_penalty, first_sequence
        self.long, self.step = min(long_sentence, window), min(hard_step, window)
        self.base = 0  # stream position of the first token kept
        self.ids: list[np.ndarray] = []
        self.size = 0
        self.ends: list[np.ndarray] = []  # sentence ends, in stream positions
        self.doc_start: list[np.ndarray] = []
        self.doc_len: list[np.ndarray] = []
        self.doc_key: list[pa.Array] = []

    def add(self, ids: np.ndarray, sentence_ends: np.ndarray, doc_len: np.ndarray, keys: pa.Array) -> None:
        here = self.base + self.size
        self.ids.append(ids)
        self.ends.append(here + sentence_ends)
        self.doc_start.append(here + np.cumsum(doc_len) - doc_len)
        self.doc_len.append(doc_len)
        self.doc_key.append(keys)
        self.size += len(ids)

    def flush(self, final: bool) -> tuple | None:
        if not self.size:
            return None
        ids = np.concatenate(self.ids)
        start, length = np.concatenate(self.doc_start), np.concatenate(self.doc_len)
        keys = pa.concat_arrays(self.doc_key)
        sentence = np.concatenate(self.ends)
        top = self.base + len(ids)
        free = start + length
        at = np.union1d(sentence[(sentence > self.base) & (sentence < top)], np.concatenate((free[free > self.base], [self.base, top])))
        gap = np.diff(at)
        if (long := np.flatnonzero(gap > self.long)).size:
            extra = np.concatenate([np.arange(at[k] + self.step, at[k + 1], self.step) for k in long])
            at = np.union1d(at, extra)
            hard = np.isin(at, extra)
        else:
            hard = np.zeros(len(at), bool)
        cost = np.where(np.isin(at, free), 0, np.where(hard, self.hard, self.split))
        cost[-1] = 0
        cuts = at[best_cuts(at, cost, self.window)]
        if not final and len(cuts) > 2:
            cuts = cuts[:-1]
        elif not final and len(cuts) == 2 and cuts[1] - cuts[0] < self.window:
            self.ids, self.ends = [ids], [sentence]
            self.doc_start, self.doc_len, self.doc_key = [start], [length], [keys]
            return None
        # pieces: the stream between cuts, split at documents
        edges = np.union1d(cuts, free[(free > cuts[0]) & (free < cuts[-1])])
        s, e = edges[:-1], edges[1:]
        doc = np.searchsorted(start, s, "right") - 1
        seq = np.searchsorted(cuts, s, "right") - 1
        body = ids[: cuts[-1] - self.base].astype("<u4")
        out = (keys.take(pa.array(doc)), s - start[doc], e - s, length[doc], self.sequence + seq, s - cuts[seq], body, s - self.base, e - self.base)
        self.sequence += len(cuts) - 1
        keep = free > cuts[-1]
        k = int(np.argmax(keep)) if keep.any() else len(free)
        self.ids, self.ends = [ids[cuts[-1] - self.base :]], [sentence[sentence > cuts[-1]]]
        self.doc_start, self.doc_len, self.doc_key = [start[k:]], [length[k:]], [keys.slice(k)]
        self.size = top - int(cuts[-1])
        self.base = int(cuts[-1])
        return out


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = 2048, eos_id: int = 1, split_penalty: int = 4, hard_penalty: int = 8, long_sentence: int = 64, hard_step: int = 8, block_tokens: int = 1 << 20
) -> DataFrame:
    """A row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    ids: binary, little-endian unsigned 32-bit token ids of the piece. The
    pieces of a sequence follow each other from offset 0; those of a document
    cover its ids and the end id once. A null or empty text is its end id
    alone; repeated rows are packed each; an empty table gives no row; other
    columns are left out, whatever their names.
    """
    path = path or tokenizer_path(DEFAULT_TOKENIZER)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def batches_of(found: tuple) -> Iterator[pa.RecordBatch]:
        key, start, length, total, seq, offset, body, a, b = found
        for i in range(0, len(a), 4096):
            j = min(len(a), i + 4096)
            cut = np.concatenate((a[i:j], b[j - 1 : j]))
            part = body[cut[0] : cut[-1]]
            binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32).tobytes()), pa.py_buffer(part.tobytes())])
            yield pa.RecordBatch.from_arrays([key.slice(i, j - i), *(pa.array(np.asarray(x[i:j], np.int64)) for x in (start, length, total, seq, offset)), binary], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pieces(path)
        stream = _Stream(window, split_penalty, hard_penalty, long_sentence, hard_step, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for block in blocks(batch.column(1)):
                n_word, ids = memo.tokens(block)
                end = np.concatenate(([0], np.cumsum(n_word)))
                per_doc = end[block.word_at[1:]] - end[block.word_at[:-1]]
                doc = block.doc_of_word()
                # each document's ids, then the end id
                full = np.full(len(ids) + block.n, eos_id, ids.dtype)
                full[ragged(np.cumsum(per_doc + 1) - per_doc - 1, per_doc)] = ids
                stop = _ENDS[block.data[block.ends - 1]] if len(block.ends) else np.zeros(0, bool)
                if len(stop):
                    after = block.data[np.minimum(block.ends, len(block.data) - 1)]
                    stop |= after == 10
                sentence = (end[1:] + doc)[stop]
                stream.add(full, sentence, per_doc + 1, batch.column(0).slice(block.first, block.n))
                if stream.size >= block_tokens and (found := stream.flush(False)):
                    yield from batches_of(found)
        if found := stream.flush(True):
            yield from batches_of(found)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
