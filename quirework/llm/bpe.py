"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up the keys
of all neighbouring pairs by binary search over the sorted keys of the merge
table, finds the lowest rank in every word at once, and merges all its
occurrences. Words that have no pair left leave the array.

Cases: null and empty texts give no ids and decode to the empty string; equal
texts give equal rows; texts of any length are encoded whole, a few MB of text
at a time; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, steps
from .pretoken import Splitter, pieces

_NONE = np.int32(2**31 - 1)
#: Distinct words that a Python worker keeps encoded.
WORDS_KEPT = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of ragged rows, row after row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Vocabulary:
    """A byte-level BPE vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.byte_ids[b] = vocab[ch]
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.byte_len = np.array([len(x) for x in raw], np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.splitter = Splitter(self.special)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        data = [w.encode() for w in words]
        lengths = np.array([len(d) for d in data], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        done_sym, done_word = [], []
        while sym.size:
            pair = sym[:-1].astype(np.int64) << 32 | sym[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == self.keys.size] = 0
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(sym.size, _NONE, np.int32)
            rank[:-1][hit] = self.ranks[at[hit]]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, sym.size))
            low_of = np.repeat(low, count)
            over = low_of == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                sym, word, rank, low_of = sym[live], word[live], rank[live], low_of[live]
                if not sym.size:
                    break
            merge = rank == low_of
            # Overlapping pairs (aaa): of neighbours that could merge, every second one does, from the left.
            place = np.arange(sym.size)
            start = merge & ~np.concatenate([[False], merge[:-1]])
            run = np.maximum.accumulate(np.where(start, place, 0))
            merge &= (place - run) % 2 == 0
            sym = sym.copy()
            sym[merge] = self.made[rank[merge]]
            keep = ~np.concatenate([[False], merge[:-1]])
            sym, word = sym[keep], word[keep]
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; special tokens stay, bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        return self.bytes[expand(self.byte_at[ids], self.byte_len[ids])].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts; words seen before come from a table of bounded size."""

    def __init__(self, vocabulary: Vocabulary, kept: int = WORDS_KEPT):
        self.v, self.kept = vocabulary, kept
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        if len(self.index) + len(words) > self.kept:
            self._clear()
        new = [w for w in words if w not in self.index]
        if not new:
            return
        ids, counts = self.v.encode_words(new)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.start = np.concatenate([self.start, self.ids.size + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split: list[list[str]] = []
        fixed: dict[str, int] = {}
        for text in texts:
            if self.v.splitter.plain(text):
                split.append(pieces(text))
                continue
            row: list[str] = []
            for part, i in self.v.splitter.parts(text):
                if i < 0:
                    row += pieces(part)
                else:  # no pre-token holds NUL beside a special string
                    row.append(key := "\0" + part)
                    fixed[key] = i
            split.append(row)
        words = set().union(*split) - fixed.keys() if split else set()
        if not words <= self.index.keys():
            self._learn(words)
        index = self.index
        if fixed:
            index = dict(index)
            for key, i in fixed.items():
                index[key] = -1 - i
        out = []
        for row in split:
            at = np.fromiter(map(index.__getitem__, row), np.int64, len(row))
            if fixed and (special := at < 0).any():
                cuts, got = np.flatnonzero(special), []
                for a, b in zip(np.append(-1, cuts), np.append(cuts, at.size), strict=True):
                    own = at[a + 1 : b]
                    got.append(self.ids[expand(self.start[own], self.length[own])])
                    if b < at.size:
                        got.append(np.array([-1 - at[b]], np.int32))
                out.append(np.concatenate(got))
            else:
                out.append(self.ids[expand(self.start[at], self.length[at])])
        return out


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary; tasks that follow find its words."""
    return Encoder(Vocabulary(path or default_path()))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encode(path: str | None, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in steps(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = own.encode(texts)
            decoded = [own.v.decode(x) for x in ids]
            if digests:
                cols = [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                cols = [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", *names])

    return run


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every text; map-only."""
    kind = dict(docs.dtypes)[id_col]
    return only(docs, id_col, text_col).mapInArrow(_encode(path, False), f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_decode, with ids and text reduced where they are made."""
    kind = dict(docs.dtypes)[id_col]
    return only(docs, id_col, text_col).mapInArrow(_encode(path, True), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
