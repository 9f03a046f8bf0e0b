"""Toxicity by the nearest labelled examples, exact TF-IDF cosine.

Terms are words, ASCII-lower-cased and without punctuation at their ends. All
terms of a bounded labelled sample count, whatever their class or frequency. A
term's weight is its inverse document frequency over all documents times
``floor + z ** 2``; z says how surely it is likelier in toxic examples (log odds
over their standard error, with ``prior`` pseudo-counts, as a share of the
surest term's; 0 if it leans to the other class). So a word that tells the
classes apart outweighs topic and language without a cut between terms.

Examples form an inverted index: a posting list per term, by blocks of examples
with the largest weight of every (term, block). A text visits blocks by falling
bound until its k-th cosine reaches the next bound, so the k nearest are exact.
The cosine-weighted vote, calibrated by a logistic fit on votes of examples by
an index that lacks their half of the sample, is the score; the neighbours are
its evidence.

The fit holds ``per_class`` labelled rows on the driver; the frequency count is
one pass that returns a number per term of the sample; scoring is one pass
without a shuffle. Labels, language, source and id are no inputs of a score.
Null and empty texts and texts without any known term get the base rate of the
training rows, as do all texts where training rows of both classes lack
(0 if there are none). Ties of cosine go to the earlier example. Repeated rows
score each; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, ragged
from .models import fit_logistic, held_out_of, labelled_sample, logistic

_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_INDEX_BLOCK = 64


def terms(block: Block) -> np.ndarray:
    """Hash of each word of the block."""
    s, e = block.starts.copy(), block.ends.copy()
    for _ in range(4):
        s[(s < e - 1) & _MARKS[block.data[s]]] += 1
        e[(s < e - 1) & _MARKS[block.data[e - 1]]] -= 1
    return block.span_hash(s, e)


def counts(block: Block, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the vocabulary's terms, texts rising. vocabulary: sorted hashes."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    h = terms(block)
    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[k] == h
    pair, times = np.unique(block.doc_of_word()[hit] * len(vocabulary) + k[hit], return_counts=True)
    text, term = np.divmod(pair, len(vocabulary))
    return text, term, times


@dataclass
class Index:
    """Posting lists in (term, example) order; a run holds the postings of a term in one block of examples."""

    label: np.ndarray
    ids: np.ndarray
    of_term: np.ndarray  # terms + 1 offsets into runs
    block: np.ndarray  # of each run
    top: np.ndarray  # largest weight of each run
    run: np.ndarray  # runs + 1 offsets into postings
    example: np.ndarray
    weight: np.ndarray
    k: int

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest, block by block by falling bound."""
        n = self.of_term[term + 1] - self.of_term[term]
        runs, w = ragged(self.of_term[term], n), np.repeat(weight, n)
        upper = np.bincount(self.block[runs], weights=w * self.top[runs])
        order = np.argsort(-upper, kind="stable")
        at, cosine = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 4
        while done < len(order) and upper[order[done]] > 0 and not (len(at) == self.k and upper[order[done]] < cosine[-1] - 1e-9):
            now = np.zeros(len(upper), bool)
            now[order[done : done + step]] = True
            done, step = done + step, step * 4
            use = np.flatnonzero(now[self.block[runs]])
            size = self.run[runs[use] + 1] - self.run[runs[use]]
            place = ragged(self.run[runs[use]], size)
            c = np.bincount(self.example[place], weights=self.weight[place] * np.repeat(w[use], size))
            some = np.flatnonzero(c > 0)
            at, cosine = np.concatenate((at, some)), np.concatenate((cosine, c[some]))
            best = np.lexsort((at, -cosine))[: self.k]
            at, cosine = at[best], cosine[best]
        return at, cosine


def make_index(vectors: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, ids: np.ndarray, n_terms: int, k: int) -> Index:
    """vectors: (terms, weights) of each example; examples are put in order of their heaviest term, so like ones share blocks."""
    heaviest = np.array([t[w.argmax()] for t, w in vectors])
    order = np.lexsort((np.arange(len(vectors)), -label, heaviest))
    vectors = [vectors[i] for i in order]
    size = [len(t) for t, _ in vectors]
    term, weight = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
    example = np.repeat(np.arange(len(vectors)), size)
    by = np.lexsort((example, term))
    term, weight, example = term[by], weight[by], example[by]
    block = example // _INDEX_BLOCK
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])))
    return Index(label[order].astype(float), ids[order], np.searchsorted(term[first], np.arange(n_terms + 1)), block[first], np.maximum.reduceat(weight, first), np.append(first, len(term)), example, weight, k)


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes
    weight: np.ndarray  # of terms
    index: Index | None
    calibration: np.ndarray
    base: float

    def vector(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
        """(weights of unit length, length before)."""
        w = (1 + np.log(times)) * self.weight[term]
        norm = float(np.sqrt((w * w).sum()))
        return w / norm, norm

    def vote(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, examples, cosines)."""
        w, norm = self.vector(term, times)
        at, cosine = self.index.nearest(term, w)
        share = (cosine @ self.index.label[at]) / max(cosine.sum(), 1e-12)
        return np.array([share, share * np.log1p(norm), cosine.mean() if len(at) else 0.0, np.log1p(norm)]), at, cosine


def term_weights(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, idf: np.ndarray, prior: float, floor: float) -> np.ndarray:
    has = [np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for (t, _), c in zip(vectors, y) if c == k)]), minlength=len(idf)) for k in (0, 1)]
    odds = [np.log((h + prior) / ((y == k).sum() - h + prior)) for k, h in enumerate(has)]
    z = (odds[1] - odds[0]) / np.sqrt(1 / (has[0] + prior) + 1 / (has[1] + prior))
    z = np.maximum(z, 0)
    return idf * (floor + (z / max(z.max(), 1.0)) ** 2)  # relative, so that it doesn't grow with the sample


def _split(text: np.ndarray) -> list[slice]:
    edges = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1, [len(text)])) if len(text) else [0]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents with each term, documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                df += np.bincount(counts(block, vocabulary)[1], minlength=len(vocabulary))
                rows += block.n
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, len(df))), pa.array(np.append(df[some], rows))], names=["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", per_class: int = 1500, max_bytes: int = 65_536, k: int = 25, prior: float = 2.0, floor: float = 0.0001) -> ToxicityModel:
    """per_class, max_bytes: bounds of the labelled sample; prior, floor: of the term weights."""
    sample, sizes = labelled_sample(docs, labels, label, per_class=per_class, max_bytes=max_bytes)
    total = sum(sizes.values())
    base = sizes.get(1, 0) / total if total else 0.0
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(0), base)
    if len({c for _, _, c in sample}) < 2:
        return empty
    texts = pa.array([t.decode() for _, t, _ in sample])
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(terms(b)) for b in blocks(texts))]))
    vectors: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(sample)
    for block in blocks(texts):
        text, term, times = counts(block, vocabulary)
        for s in _split(text):
            vectors[block.first + int(text[s.start])] = (term[s], times[s])
    some = [i for i, v in enumerate(vectors) if v]
    y, ids, vectors = np.array([sample[i][2] for i in some]), np.array([sample[i][0] for i in some]), [vectors[i] for i in some]
    halves = [np.arange(h, len(some), 2) for h in (0, 1)]  # in hash order of the id
    if any(len(set(y[h].tolist())) < 2 for h in halves):
        return empty
    df, rows = _frequencies(docs, vocabulary)
    idf = np.log((rows + 1) / (df + 1)) + 1

    def indexed(of: np.ndarray) -> ToxicityModel:
        model = ToxicityModel(vocabulary, term_weights([vectors[i] for i in of], y[of], idf, prior, floor), None, np.zeros(0), base)
        model.index = make_index([(vectors[i][0], model.vector(*vectors[i])[0]) for i in of], y[of], ids[of], len(vocabulary), k)
        return model

    x = np.zeros((len(some), 4))
    for mine, others in (halves, halves[::-1]):
        model = indexed(others)
        for i in mine:
            x[i] = model.vote(*vectors[i])[0]
    model = indexed(np.arange(len(some)))
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())  # classes as in all training rows
    model.calibration = fit_logistic(x, y.astype(float), weight / weight.mean(), 0.05)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, neighbours, cosines) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "score", "predicted", "neighbours", "cosines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch.column(1))
            score, near, far = np.full(n, model.base), [[]] * n, [[]] * n
            for block in blocks(batch.column(1)):
                text, term, times = counts(block, model.vocabulary)
                for s in _split(text):
                    i = block.first + int(text[s.start])
                    x, at, cosine = model.vote(term[s], times[s])
                    score[i] = logistic(x[None], model.calibration)[0]
                    near[i], far[i] = model.index.ids[at].tolist(), cosine.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held_out_of(batch.column(0).to_pylist())), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(near, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float64()))], names=names
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, neighbours array<long>, cosines array<double>")
