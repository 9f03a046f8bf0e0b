"""Benchmark passages in documents, by CGK embedding and edit verification.

A random walk embeds a window of words: at each step the current word is put
out and a random bit of (walk, step, word) says whether to move on. Strings at
small edit distance thus get embeddings at small Hamming distance (the walks
meet again soon after an edit), and sampling coordinates finds them. Walks go
from every STRIDE-th word of a document; items are embedded from STRIDE words in
a row, so some start always lines up. Windows are sized by item: a class of
items of l to l * 1.5 words samples steps up to about 1.5 l, and items beyond
MOST steps have windows of that size. An item is embedded from anchors half a
window apart, the last one reaching its end, so windows cover it whole: however
its edits lie, some window has no more than their average share.

WALKS walks with SAMPLES samples of COORDINATES each lead to candidates, which
are verified exactly: the least word-level edit distance between the item and
any stretch of the document around the window, by a bit-parallel column
algorithm. A document is contaminated by an item if that distance is at most
``edits`` times the item's words.

Items are held in memory in groups of ``group_bytes`` at most, a pass over the
documents for each group, so nothing broadcast grows with the benchmark.
Null and wordless items match nothing; null and empty texts hold nothing;
repeated rows and items are reported each; an empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, make_block, mix

STRIDE, WALKS, SAMPLES, COORDINATES = 4, 6, 3, 4
MOST = 96  # steps of a window; a walk takes about two a word
_U = np.uint64


def normal_hashes(block: Block) -> np.ndarray:
    """Word hashes without punctuation at the ends of words."""
    s, e = block.starts.copy(), block.ends.copy()
    for _ in range(3):
        s[(s < e - 1) & _MARK[block.data[s]]] += 1
        e[(s < e - 1) & _MARK[block.data[e - 1]]] -= 1
    return block.span_hash(s, e)


_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Index:
    """Items by sampled coordinates of their embeddings."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float, seed: int = 17):
        self.edits = edits
        texts = [t for _, t in items]
        block = make_block(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        h = normal_hashes(block)
        self.words = [h[a:b] for a, b in zip(block.word_at[:-1], block.word_at[1:])]
        self.kinds = [frozenset(w.tolist()) for w in self.words]
        self.ids = [i for i, _ in items]
        self.seeds = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, WALKS, dtype=np.uint64)
        classes = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                low = 1
                while low * 1.5 < MOST and (low * 1.5 <= len(w) and int(low * 1.5) > low or low < 2 and len(w) >= 2):
                    low = max(low + 1, int(low * 1.5))
                classes[low].append(k)
        self.classes = []
        rng = np.random.Generator(np.random.PCG64(seed + 1))
        for low, members in sorted(classes.items()):
            shift = min(STRIDE, max(1, low // 4))  # starts at an anchor that are embedded
            steps = max(1, min(int(low * 1.5), MOST))
            pick = [[np.sort(rng.choice(steps, min(COORDINATES, steps), replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
            self.classes.append((shift, steps, pick, members))
        self.steps = max((c[1] for c in self.classes), default=0)
        self.tables = []  # per class, walk and sample: sorted keys, and (item, shift) of each
        for shift, steps, pick, members in self.classes:
            flat = np.concatenate([np.concatenate((self.words[k], np.zeros(self.steps + 1, np.uint64))) for k in members])
            at = np.cumsum([0, *(len(self.words[k]) + self.steps + 1 for k in members)])[:-1]
            skips = [self.skips(len(self.words[k]), shift, steps) for k in members]
            starts = np.concatenate([a + x for a, x in zip(at, skips)])
            who = np.concatenate([np.column_stack((np.full(len(x), k), x)) for k, x in zip(members, skips)])
            per = []
            for w in range(WALKS):
                (keys,) = self.embed(flat, [starts], [pick[w]], w)
                for x in keys:
                    order = np.argsort(x, kind="stable")
                    seen = np.zeros(1 << 16, bool)
                    seen[(x & _U(0xFFFF)).astype(np.int64)] = True
                    per.append((x[order], who[order], seen))
            self.tables.append(per)

    def skips(self, n: int, shift: int, steps: int) -> np.ndarray:
        """Words of an item of n words from which it is embedded."""
        last = max(0, n - shift - steps // 2) if n * self.edits >= 1 else 0  # a copy without edits has its opening
        anchors = np.append(np.arange(0, last, max(1, steps // 4)), last)
        return np.unique((anchors[:, None] + np.arange(min(shift, n))).ravel())

    def embed(self, words: np.ndarray, starts: list[np.ndarray], picks: list[list[np.ndarray]], walk: int) -> list[list[np.ndarray]]:
        """Sampled keys of walks from ``starts`` (an array per set of picks); words end in a margin."""
        out = []
        noise = mix(words ^ self.seeds[walk])
        for begin, pick in zip(starts, picks):
            at = begin.astype(np.int64)
            keys = [np.full(len(at), 1, np.uint64) for _ in pick]
            want = defaultdict(list)
            for k, steps in enumerate(pick):
                for s in steps.tolist():
                    want[s].append(k)
            with np.errstate(over="ignore"):
                for step in range(max(want) + 1):
                    v = noise[at]
                    for k in want.get(step, ()):
                        keys[k] = (keys[k] ^ v) * _U(0x9FB21C651E98DF25)
                        keys[k] ^= keys[k] >> _U(28)
                    turn = step % 64
                    if turn == 63:
                        noise = mix(noise)
                    at += ((v >> _U(turn)) & _U(1)).astype(np.int64)
            out.append(keys)
            if max(want) >= 63:
                noise = mix(words ^ self.seeds[walk])
        return out

    def candidates(self, block: Block, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, word where the item would start)."""
        found = set()
        words = np.concatenate((h, np.zeros(self.steps + 1, np.uint64)))
        every: dict[int, np.ndarray] = {}
        for shift, *_ in self.classes:
            if shift not in every:
                n = np.diff(block.word_at)
                per = -(-n // shift)
                doc = np.repeat(np.arange(block.n), per)
                every[shift] = block.word_at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * shift
        groups = defaultdict(list)
        for c, (shift, _, pick, _) in enumerate(self.classes):
            groups[shift].append(c)
        for walk in range(WALKS):
            for shift, members in groups.items():
                starts = every[shift]
                picks = [p for c in members for p in self.classes[c][2][walk]]
                (keys,) = self.embed(words, [starts], [picks], walk)
                for n, x in enumerate(keys):
                    table, who, seen = self.tables[members[n // SAMPLES]][walk * SAMPLES + n % SAMPLES]
                    some = np.flatnonzero(seen[(x & _U(0xFFFF)).astype(np.int64)])
                    if not len(some):
                        continue
                    low, high = np.searchsorted(table, x[some]), np.searchsorted(table, x[some], "right")
                    for i in np.flatnonzero(low < high).tolist():
                        start = int(starts[some[i]])
                        doc = int(np.searchsorted(block.word_at, start, "right") - 1)
                        for item, skip in who[low[i] : high[i]].tolist():
                            found.add((doc, item, start - skip))
        return found

    def distance(self, item: int, text: np.ndarray) -> tuple[int, int]:
        """(least edit distance of the item to any stretch of text, where that ends)."""
        pattern = self.words[item]
        m = len(pattern)
        where: dict[int, int] = defaultdict(int)
        for i, w in enumerate(pattern.tolist()):
            where[w] |= 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        best, end = m, 0
        for j, w in enumerate(text.tolist()):
            eq = where.get(w, 0)
            x = eq | down
            diagonal = ((((eq & up) + up) ^ up) | eq) & full
            plus, minus = down | (full & ~(diagonal | up)), up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(x | plus)), plus & x
            if score < best:
                best, end = score, j + 1
        return best, end

    def leaks(self, block: Block) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first and last word + 1 of the best place), one per text and item."""
        h = normal_hashes(block)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for doc, item, start in sorted(self.candidates(block, h)):
            m = len(self.words[item])
            room = max(STRIDE, int(m * self.edits) + 1)
            if (doc, item, start // (room + 1)) in tried:
                continue
            tried.add((doc, item, start // (room + 1)))
            a = max(int(block.word_at[doc]), start - 2 * room)
            b = min(int(block.word_at[doc + 1]), start + m + 2 * room)
            if len(self.kinds[item].difference(h[a:b].tolist())) > m * self.edits:  # each word that is missing takes an edit
                continue
            d, end = self.distance(item, h[a:b])
            if d <= m * self.edits and (d, a + end) < best.get((doc, item), (m + 1, 0, 0))[:2]:
                best[doc, item] = (d, a + end, max(a, a + end - m))
        return [(doc, item, d, first - int(block.word_at[doc]), end - int(block.word_at[doc])) for (doc, item), (d, end, first) in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: float = 0.2, group_bytes: int = 16 << 20) -> DataFrame:
    """(id, item_id, distance, item_words, first_word, end_word) of every document and benchmark item in it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, distance int, item_words int, first_word int, end_word int"
    parts, group, size = [], [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        group.append((r.item_id, r.text.encode()))
        size += len(group[-1][1])
        if size >= group_bytes:
            parts.append(_pass(docs, group, id_col, text_col, edits, schema))
            group, size = [], 0
    parts.append(_pass(docs, group, id_col, text_col, edits, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("id", id_col)


_indexes: dict[int, Index] = {}


def _pass(docs: DataFrame, items: list[tuple[int, bytes]], id_col: str, text_col: str, edits: float, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # group_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((tuple(shared.value), edits))
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = Index(shared.value, edits)
        index = _indexes[key]
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows = index.leaks(block)
                doc, item, distance, first, end = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([block.first + i for i in doc], pa.int64())), pa.array([index.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int32()) for x in (distance, [len(index.words[i]) for i in item], first, end))],
                    names=["id", "item_id", "distance", "item_words", "first_word", "end_word"],
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
