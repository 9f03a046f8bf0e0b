"""Tokenizer pieces of words, each distinct word tokenised once per worker.

White space outside words never joins pieces in word-level vocabularies, so a
text's ids are the ids of its words end to end. Words are looked up by hash in
a bounded memo; only words not met before go to the tokenizer, joined by a
special token that marks where each ends. Words with ``<|`` may hold special
strings, whose case counts; they are always tokenised by themselves. Words are
hashed with A-Z folded, so a vocabulary that tells case apart is refused.
"""

from __future__ import annotations

import os

import numpy as np

from .blocks import Block, ragged

MEMO_WORDS = 1_500_000
DEFAULT_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def special_words(block: Block) -> np.ndarray:
    """Numbers of the words that hold ``<|``, rising."""
    data = block.data
    odd = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
    return np.unique(np.searchsorted(block.starts, odd, "right") - 1) if len(odd) else odd


class Pieces:
    """Memo of a worker process: word hash -> ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        if self.tokenizer.encode(plain, add_special_tokens=False).ids != self.tokenizer.encode(plain.lower(), add_special_tokens=False).ids:
            raise ValueError(f"{path} tells upper from lower case; its pieces can't be looked up by case-folded words")
        special = {i: t for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip and not t.single_word}
        self.mark = max(special, default=None)
        self.mark_text = special[self.mark].content if special else None
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_535
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32 if self.wide else np.uint16)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids end to end) of words without special strings."""
        if self.mark is None:
            found = [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
            return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((i for x in found for i in x), self.ids.dtype)
        text = self.mark_text.encode().join(words).decode("utf-8", "replace")
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        marks = np.flatnonzero(ids == self.mark)
        edges = np.concatenate(([-1], marks, [len(ids)]))
        return np.diff(edges) - 1, np.delete(ids, marks).astype(self.ids.dtype)

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """keys: sorted, not yet known."""
        lengths, ids = self.encode(words)
        slots = len(self.at) - 1 + np.arange(len(keys))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(lengths)))
        self.ids = np.concatenate((self.ids, ids))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, where, keys), np.insert(self.slots, where, slots)

    def unknown(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), bool)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[k] != keys

    def look_up(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """(distinct hashes' slots, each word's distinct number, (unused), special words with their ids)."""
        data, odd = block.data, special_words(block)
        hashes = block.hashes
        if len(odd):
            hashes = hashes.copy()
            hashes[odd] = 0  # a word of its own kind, set apart below
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = self.unknown(distinct)
        if new.any() and len(self.keys) + int(new.sum()) > MEMO_WORDS:
            self.clear()
            new = np.ones(len(distinct), bool)
        if new.any():
            mem, s, e = data.tobytes(), block.starts[first[new]].tolist(), block.ends[first[new]].tolist()
            self.learn(distinct[new], [b"" if h == 0 else mem[a:b] for h, a, b in zip(distinct[new].tolist(), s, e)])
        k = np.searchsorted(self.keys, distinct)
        special = []
        for w in odd.tolist():
            ids = self.tokenizer.encode(block.word(w).decode("utf-8", "replace"), add_special_tokens=False).ids
            special.append((w, np.asarray(ids, self.ids.dtype)))
        return self.slots[k], inverse, distinct, special

    def one(self, word: bytes) -> int:
        """Pieces of a word that may hold special strings."""
        return len(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def tokens(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, ids of all words end to end)."""
        slots, word, _, special = self.look_up(block)
        slots = slots[word]
        lengths = self.at[slots + 1] - self.at[slots]
        if not special:
            return lengths, self.ids[ragged(self.at[slots], lengths)]
        pool, start = [self.ids], self.at[slots].copy()
        base = len(self.ids)
        lengths = lengths.copy()
        for w, ids in special:
            start[w], lengths[w] = base, len(ids)
            pool.append(ids)
            base += len(ids)
        return lengths, np.concatenate(pool)[ragged(start, lengths)]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The memo of this worker process for a vocabulary file."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]
