"""Quality by compression: zstandard dictionaries of good and of bad text.

A dictionary is trained on good and one on bad labelled text. A text is cut
into blocks of ``block`` bytes, all of them compressed with either dictionary;
the difference of the two sizes, over their sum and over the text's bytes, says
which kind the text resembles. A text that is bad in parts shows in its worst
blocks, so the least block difference counts besides the whole. Logistic
calibration on labelled rows that no dictionary has seen makes a probability.

The fit uses a bounded sample of labelled rows (``per_class``, ``max_bytes``);
scoring is one pass over whole texts without a shuffle. Labels, language,
source and id are no inputs of a score. Null and empty texts get the share of
label 1 among training rows (1 if there are none), as do all texts when a class
has fewer than 20 distinct training texts; repeated rows score each; an empty
table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import text_buffers
from .models import fit_logistic, held_out_of, labelled_sample, logistic


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    scale: np.ndarray
    base: float
    block: int

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}  # compressors stay in their process

    def features(self, texts: Iterator[bytes]) -> np.ndarray:
        import zstandard

        if not hasattr(self, "_tools"):
            dictionaries = [zstandard.ZstdCompressionDict(d) for d in (self.good, self.bad)]
            for d in dictionaries:
                d.precompute_compress(level=3)
            self._tools = [zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_dict_id=False, write_content_size=False).compress for d in dictionaries]
        good, bad = self._tools
        out = []
        for t in texts:
            n, g, b, worst, best = len(t), 0, 0, 1.0, -1.0
            for o in range(0, n, self.block):
                part = t[o : o + self.block]
                x, y = len(good(part)), len(bad(part))
                g, b = g + x, b + y
                if len(part) >= self.block // 2 or n < self.block:
                    d = (y - x) / (x + y)
                    worst, best = min(worst, d), max(best, d)
            whole = (b - g) / max(1, b + g)
            out.append((whole, (b - g) / max(1, n), worst, best, np.log1p(n) / 10, min(g, b) / max(1, n)))
        x = np.asarray(out, np.float64).reshape(-1, 6)
        logn, ratio = x[:, 4:5], x[:, 5:6]
        return np.column_stack((x, x[:, :4] * logn, x[:, :4] * ratio, np.minimum(x[:, 2:3], 0), np.maximum(x[:, :1], 0), ratio**2, logn**2))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        some = [i for i, t in enumerate(texts) if t]
        if some and len(self.weights):
            out[some] = logistic(self.features(texts[i] for i in some) / self.scale, self.weights)
        return out


def fit_quality(docs: DataFrame, labels: DataFrame, *, label: str = "quality", per_class: int = 3000, max_bytes: int = 65_536, dictionary_bytes: int = 112_640, block: int = 1024) -> QualityModel:
    """per_class, max_bytes: bounds of the labelled sample that is fitted on the driver."""
    import zstandard

    sample, sizes = labelled_sample(docs, labels, label, per_class=per_class, max_bytes=max_bytes)
    sample = [r for r in sample if r[1]]
    base = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 1.0
    if min(sum(y == c for _, _, y in sample) for c in (0, 1)) < 20:
        return QualityModel(b"", b"", np.zeros(0), np.ones(1), base, block)
    learn, rest = sample[::2], sample[1::2]  # in hash order of the id

    def dictionary(c: int) -> bytes:
        parts = [t[o : o + block] for _, t, y in learn if y == c for o in range(0, len(t), block)]
        try:
            return zstandard.train_dictionary(dictionary_bytes, parts).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself
            return b"".join(parts)[-dictionary_bytes:]

    model = QualityModel(dictionary(1), dictionary(0), np.zeros(0), np.ones(1), base, block)
    x, y = model.features(t for _, t, _ in rest), np.array([y for _, _, y in rest], float)
    model.scale = np.maximum(np.abs(x).mean(0), 1e-9)
    taken = [(y == c).sum() for c in (0, 1)]
    weight = np.where(y == 1, sizes[1] / taken[1], sizes[0] / taken[0])
    model.weights = fit_logistic(x / model.scale, y, weight * len(y) / weight.sum())
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text; keep_columns: beside all columns of docs but those named alike."""
    added = ("held_out", "score", "predicted")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added)) if keep_columns else docs.select(id_col, text_col)
    kept = docs.columns if keep_columns else [id_col]
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in kept), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(at_text))
            edges, mem, n = at.tolist(), memoryview(data), batch.num_rows
            score = np.concatenate([np.zeros(0), *(model.score([bytes(mem[edges[i] : edges[i + 1]]) for i in range(k, min(k + 256, n))]) for k in range(0, n, 256))])
            ids = batch.column(at_id)
            old = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(held_out_of(ids.to_pylist())), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, *added])

    return docs.mapInArrow(run, schema)
