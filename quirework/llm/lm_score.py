"""Cross-entropy difference scoring: matched target and background n-gram models over one vocabulary.

Words are lower-cased (A-Z) and parted by ASCII white space. Every word of the corpus is in the vocabulary of both models,
and every pair of neighbouring words in their counts, the first word of a text as one that follows its begin. What is
gathered grows with the corpus and stays distributed.

1. Words are counted for target and background (map-side combine), and how often each ends a text; what is left is how often
   it is followed. The ``WORDS`` most frequent ones at most go to all tasks.
2. P(w | v) = (c(v, w) + PRIOR * P1(w)) / (c(v) + PRIOR), where P1(w) is (c(w) + 1) / (N + V) for the words that all tasks have;
   the others are one class and share its part evenly. Both models sum to one over the vocabulary, and after a word that a model
   has never seen followed it falls back to P1. A pair's loss is log P_background - log P_target.
3. Pairs of the ``DENSE`` most frequent words are counted with map-side combine and go to all tasks, too.
4. A text sums the losses of these where it stands, and what frequent words give as the first of a pair. All other pairs are dealt
   out once, by pair, or by first word where that is rare; so all places of a pair, and of a rare first word, meet
   in one task, are counted there for both models, and their losses summed by text. A step of texts packs what goes to
   one bucket as arrays, ten bytes a pair.

The score is the mean loss over the tokens of a text: the lower, the more like the target. What is sent to all tasks has a
fixed bound (some 5 MB). Words are named by 62 bits of hash; pairs by 48 bits within their bucket.

Cases: null and blank texts have no tokens and a null score; without target or background rows that model is uniform;
repeated rows are scored, and counted, each; texts of any length are whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, most_frequent, rest, steps
from .shingles import mix, word_hashes

WORDS, DENSE = 65_535, 512
#: Weight of the first order: as if each word had been followed so many times more, by words as frequent as they are.
PRIOR = 4.0
#: Distinct keys that a task holds before it gives them on.
HELD = 1_000_000
#: Pairs in one task, about, if none has more.
ROWS = 1_500_000
#: Bytes of text in one step, and in one whose pairs are packed together.
_STEP, _PACKED = 2 << 20, 6 << 20
#: Bytes of text that are hashed at once.
_HASHED = 1 << 20
#: Names of words that all tasks have are numbers by falling frequency, then BEGIN; others have this bit.
_RARE = 1 << 62
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Models:
    """First order and contexts of the words that all tasks have (last places: the class of all others, the begin of texts), and pairs of the most frequent."""

    names: np.ndarray  # sorted
    number: np.ndarray  # of each name
    first: np.ndarray  # (2, n + 1) of target and background: P1
    followed: np.ndarray  # (2, n + 1): how often a word is followed, texts at last
    dense: int
    pairs: np.ndarray  # (2, dense, dense)

    @property
    def begin(self) -> int:
        return self.names.size

    def numbers(self, names: np.ndarray) -> np.ndarray:
        if not self.names.size:
            return names
        at = np.minimum(np.searchsorted(self.names, names), self.names.size - 1)
        return np.where(self.names[at] == names, self.number[at], names)

    def context(self, v: np.ndarray) -> np.ndarray:
        """What words that all tasks have give to the loss as the first of a pair."""
        return np.log(self.followed[0, v] + PRIOR) - np.log(self.followed[1, v] + PRIOR)

    def pair(self, counts: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What counts (2, n) of pairs with the second words ``w`` (or -1) give to the loss."""
        p = counts + PRIOR * self.first[:, w]
        return np.log(p[1]) - np.log(p[0])


def names_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts in a row, and how many each text has.

    Hashing holds some 30 bytes for each byte of text, so it takes ``_HASHED`` bytes at a time, or one text.
    """
    parts, at = [], 0
    data = [(t or "").encode() for t in texts]
    while at < len(data):
        end, held = at + 1, len(data[at])
        while end < len(data) and held + len(data[end]) <= _HASHED:
            held += len(data[end])
            end += 1
        parts.append(word_hashes(data[at:end]))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, counts = (np.concatenate([part[k] for part in parts]) for k in range(2))
    return (h >> np.uint64(2)).astype(np.int64) | _RARE, np.asarray(counts, np.int64)


def _ends(counts: np.ndarray) -> np.ndarray:
    """Places of the last word of each text that has any."""
    return np.cumsum(counts)[counts > 0] - 1


class _Tally:
    """Counts by key, summed whenever too many are held."""

    def __init__(self, width: int):
        self.keys, self.counts, self.held, self.width = [], [], 0, width

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros((0, self.width), np.int64), np.zeros((0, 4), np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.lexsort(keys.T)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else np.zeros(0, np.int64)
        counts = np.add.reduceat(counts[order], first) if len(keys) else counts
        self.keys, self.counts, self.held = [], [], 0
        return keys[first], counts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally(1)

    def rows() -> pa.RecordBatch:
        keys, counts = tally.take()
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), *[pa.array(counts[:, k]) for k in range(4)]], names=["w", "t", "b", "te", "be"])

    for batch in steps(batches, most=_STEP):
        names, counts = names_of(batch.column("text").to_pylist())
        target = np.repeat(np.array(batch.column("target").to_pylist(), bool), counts)
        ends = np.zeros(names.size, bool)
        ends[_ends(counts)] = True
        distinct, at = np.unique(names, return_inverse=True)
        sides = [np.bincount(at[m], minlength=distinct.size) for m in (target, ~target, target & ends, ~target & ends)]
        tally.add(distinct[:, None], np.stack(sides, 1))
        if tally.held > HELD:
            yield rows()
    yield rows()


def _read(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of texts the word before (a number, BEGIN or a name), the word, and the text; and the tokens of each text."""
    names, counts = names_of(texts)
    w = models.numbers(names)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[(np.cumsum(counts) - counts)[counts > 0]] = models.begin
    return v, w, np.repeat(np.arange(counts.size), counts), counts


def _dense_counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = sent.value
        d = models.dense
        held = np.zeros((2, d * d), np.int64)
        for batch in steps(batches, most=_STEP):
            v, w, row, _ = _read(models, batch.column("text").to_pylist())
            both = (v < d) & (w < d)
            target = np.array(batch.column("target").to_pylist(), bool)[row[both]]
            key = v[both] * d + w[both]
            held += np.stack([np.bincount(key[m], minlength=d * d) for m in (target, ~target)])
        some = np.flatnonzero(held.any(axis=0))
        yield pa.RecordBatch.from_pydict({"pair": pa.array(some), "t": pa.array(held[0, some]), "b": pa.array(held[1, some])})

    return run


_LOW = np.uint64(2**48 - 1)
#: A place of a pair: the pair's name, its second word, the text in its step and, in the top bit, whether that is of the target.
_PAIR = np.dtype([("pair", "<u8"), ("w", "<u2"), ("text", "<u2")])
#: The same after a rare word, with that word's name.
_AFTER_RARE = np.dtype([("v", "<u8"), *_PAIR.descr])
_TARGET, _TEXTS = np.uint16(1 << 15), (1 << 15) - 1


def _narrow(names: np.ndarray) -> np.ndarray:
    """Six bytes of each."""
    return np.ascontiguousarray(names.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _pack(known: np.ndarray, rare: np.ndarray) -> bytes:
    """Places of pairs column by column: how many of each kind, and their fields."""
    return b"".join([np.array([known.size, rare.size], "<i8").tobytes(), *(x.tobytes() for part in (known, rare) for x in (_narrow(part["pair"]), part["w"], part["text"])), _narrow(rare["v"]).tobytes()])


def _wide(data: np.ndarray) -> np.ndarray:
    out = np.zeros((data.size // 6, 8), np.uint8)
    out[:, :6] = data.reshape(-1, 6)
    return out.view("<u8").ravel()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, r = np.frombuffer(data, "<i8", 2)
    at = 16
    out = []
    for size, kind in ((int(n), _PAIR), (int(r), _AFTER_RARE)):
        part = np.zeros(size, kind)
        part["pair"] = _wide(np.frombuffer(data, np.uint8, 6 * size, at))
        part["w"] = np.frombuffer(data, "<u2", size, at + 6 * size)
        part["text"] = np.frombuffer(data, "<u2", size, at + 8 * size)
        at += 10 * size
        out.append(part)
    out[1]["v"] = _wide(np.frombuffer(data, np.uint8, 6 * int(r), at))
    return out[0], out[1]


def _dealt(sent, bits: int):
    """(step, bucket, data): of each step what its texts sum themselves (bucket -1), and its other pairs by bucket, of which there are 2 ** bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, task = sent.value, TaskContext.get().partitionId()
        d = models.dense
        small = (batch.slice(at, _TEXTS) for batch in steps(batches, most=_PACKED) for at in range(0, batch.num_rows, _TEXTS))
        for k, batch in enumerate(small):
            n = batch.num_rows
            v, w, row, counts = _read(models, batch.column("text").to_pylist())
            known = v < _RARE
            loss = np.zeros(v.size)
            loss[known] = models.context(v[known])
            both = (v < d) & (w < d)
            loss[both] += models.pair(models.pairs[:, v[both], w[both]], w[both])
            own = np.bincount(row, loss, n).astype(np.float64)
            rest = np.flatnonzero(~both)
            v, w, known, row = v[rest], w[rest], known[rest], row[rest]
            pair = mix(v.view(np.uint64) * _MIX + mix(w.view(np.uint64)))
            word = np.where(w < _RARE, w, models.begin).astype(np.uint16)
            text = row.astype(np.uint16) | np.where(np.array(batch.column("target").to_pylist(), bool)[row], _TARGET, np.uint16(0))
            first = mix(v.view(np.uint64))
            bucket = (np.where(known, pair, first) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(v.size, np.int64)
            order = np.lexsort((~known, bucket))
            edges = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            places = np.zeros(v.size, _AFTER_RARE)
            places["v"], places["pair"], places["w"], places["text"] = (first & _LOW)[order], (pair & _LOW)[order], word[order], text[order]
            known = known[order]
            out = []
            for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                middle = at + int(known[at:end].sum())
                out.append(_pack(places[at:middle], places[middle:end]) if end > at else None)
            some = [i for i, x in enumerate(out) if x is not None]
            table = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(own)], names=["doc_id", "n_tokens", "own"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_batch(table)
            data = [sink.getvalue().to_pybytes(), *(out[i] for i in some)]
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k] * len(data), pa.int64()), pa.array([-1, *some], pa.int64()), pa.array(data, pa.binary())], names=["step", "bucket", "data"])

    return run


def losses(known: np.ndarray, rare: np.ndarray, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each place, of all places of pairs with a known first word, and of all after rare words."""

    def counts(order: np.ndarray, begins: np.ndarray, target: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(begins)
        size, t = np.diff(np.append(first, order.size)), np.add.reduceat(target[order].astype(np.int64), first)
        out = np.empty((2, order.size))
        out[:, order] = np.repeat(np.stack([t, size - t]), size, axis=1)
        return out

    def begins(*keys: np.ndarray) -> np.ndarray:
        return np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))

    out = []
    for part in (known, rare):
        if not part.size:
            out.append(np.zeros(0))
            continue
        target = (part["text"] & _TARGET) > 0
        by_v = "v" in part.dtype.names
        order = np.lexsort((part["pair"], part["v"])) if by_v else np.argsort(part["pair"], kind="stable")
        pair = part["pair"][order]
        first = begins(part["v"][order]) if by_v else None
        loss = models.pair(counts(order, begins(pair) | first if by_v else begins(pair), target), part["w"])
        if by_v:
            followed = counts(order, first, target)
            loss += np.log(followed[0] + PRIOR) - np.log(followed[1] + PRIOR)
        out.append(loss)
    return out[0], out[1]


def _summed(sent):
    """(step, bucket, data): sums by text of the pairs of the buckets that one task has, whole; other rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [], []
        for batch in batches:
            own = pa.compute.less(batch.column("bucket"), 0)
            yield batch.filter(own)
            packed = batch.filter(pa.compute.invert(own))
            names += packed.column("step").to_pylist()
            held += [_unpack(x.as_buffer()) for x in packed.column("data")]
        if not held:
            return
        steps_, of = np.unique(np.array(names, np.int64), return_inverse=True)
        parts = [[p[k] for p in held] for k in range(2)]
        del held
        text = np.concatenate([np.int64(s) << 15 | (x["text"] & ~_TARGET).astype(np.int64) for part in parts for s, x in zip(of.tolist(), part, strict=True)])
        loss = np.concatenate(losses(*(np.concatenate(part) for part in parts), sent.value))
        del parts
        distinct, at = np.unique(text, return_inverse=True)
        sums = np.bincount(at, loss, distinct.size)
        edges = np.searchsorted(distinct >> 15, np.arange(steps_.size + 1))
        data = [(distinct[a:b] & (2**15 - 1)).astype("<u2").tobytes() + sums[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(steps_), pa.array(np.zeros(len(data), np.int64)), pa.array(data, pa.binary())], names=["step", "bucket", "data"])

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the texts of whole steps, from rows in the order of (step, bucket): what texts sum themselves comes first."""
    table, total = None, np.zeros(0)

    def rows() -> pa.RecordBatch:
        n = table.column("n_tokens").to_numpy()
        score = pa.array(np.round(total / np.maximum(n, 1), 9), mask=n == 0)
        return pa.RecordBatch.from_arrays([table.column("doc_id"), table.column("n_tokens"), score], names=["doc_id", "n_tokens", "score"])

    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
            if bucket < 0:
                if table is not None:
                    yield rows()
                with pa.ipc.open_stream(data.as_buffer()) as reader:
                    table = reader.read_next_batch()
                total = table.column("own").to_numpy().copy()
                continue
            raw = data.as_py()
            n = len(raw) // 10
            total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<f8", n, 2 * n)
    if table is not None:
        yield rows()


def fit(corpus: DataFrame, words: int = WORDS, dense: int = DENSE) -> tuple[Models, int]:
    """What goes to all tasks, and how many tokens there are, from (text, target)."""
    spark = corpus.sparkSession
    counted = corpus.mapInArrow(_word_counts, "w long, t long, b long, te long, be long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("t", "b", "te", "be")])
    counted = cut(counted, "words")
    vocabulary, *sums = (int(x or 0) for x in counted.agg(F.count("*"), *[F.sum(c) for c in ("t", "b", "te", "be")]).first())
    totals, texts = np.array(sums[:2])[:, None], np.array(sums[2:])[:, None]
    top = most_frequent(counted, F.col("t") + F.col("b"), words).toArrow()
    drop(counted)
    names, (t, b, te, be) = top["w"].to_numpy(), (top[c].to_numpy() for c in ("t", "b", "te", "be"))
    rank = np.lexsort((names, -(t + b)))
    number = np.empty(names.size, np.int64)
    number[rank] = np.arange(names.size)
    by_name = np.argsort(names)
    count = np.stack([t, b])[:, rank]
    # All other words are one class that shares evenly what the frequent ones leave.
    others = max(vocabulary - names.size, 1)
    rest = (totals - count.sum(axis=1, keepdims=True) + vocabulary - names.size) / others
    first = np.concatenate([count + 1, rest], axis=1) / np.maximum(totals + vocabulary, 1)
    followed = np.concatenate([np.stack([t - te, b - be])[:, rank], texts], axis=1).astype(np.float64)
    dense = min(dense, names.size)
    models = Models(names[by_name], number[by_name], first, followed, dense, np.zeros((2, dense, dense)))
    if dense:
        sent = spark.sparkContext.broadcast(models)
        found = corpus.mapInArrow(_dense_counts(sent), "pair long, t long, b long").groupBy("pair").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        sent.unpersist()
        models.pairs.reshape(2, -1)[:, found["pair"].to_numpy()] = np.stack([found["t"].to_numpy(), found["b"].to_numpy()])
    return models, sum(sums[:2])


def score(corpus: DataFrame, models: Models, tokens: int) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of the corpus (doc_id, text, target), a table that ``cut`` wrote, that the models were fitted on."""
    spark = corpus.sparkSession
    sent = spark.sparkContext.broadcast(models)
    kind = dict(corpus.dtypes)["doc_id"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // ROWS))
    packed = corpus.mapInArrow(_dealt(sent, tasks.bit_length()), "step long, bucket long, data binary")
    at = F.when(F.col("bucket") < 0, F.xxhash64("step")).otherwise(F.col("bucket"))
    summed = packed.repartition(tasks, at).mapInArrow(_summed(sent), "step long, bucket long, data binary")
    return summed.repartition("step").sortWithinPartitions("step", "bucket").mapInArrow(_scored, f"doc_id {kind}, n_tokens long, score double")


def score_against(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, dense: int = DENSE) -> DataFrame:
    """Scores of ``docs`` where the rows with an id in ``target`` (one column) are the target and all others the background."""
    ids = target.toDF("target_id").filter("target_id is not null").distinct().withColumn("target", F.lit(True))
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # Ids are as many as the labels, so the join is by shuffle at every size, and done once.
    corpus = base.join(ids.hint("merge"), base.doc_id == ids.target_id, "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    corpus = cut(corpus, "corpus")
    models, tokens = fit(corpus, words, dense)
    rest(docs.sparkSession)  # the Python workers of the next stages hold most, on top of what the executors' heaps have grown to
    return score(corpus, models, tokens)
