"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams (letters
only, word boundaries as one space); a linear layer and softmax give languages.
Embeddings and layer are trained together by stochastic gradient descent in
numpy, on a bounded sample: at most ``SAMPLE`` labelled rows, shared
out evenly over the languages and chosen by a hash of the id, each as its whole text and as
short windows, so that short texts are known too. A fifth of the
sample fits the softmax temperature and the score under which a text is
rejected: that below which ``LOST`` of the right predictions on it lie. For use, embeddings and layer fold into one score per n-gram bucket
and language, so that every text is scored whole in one pass, map-only.

Cases: a null text or one without a letter is ``und`` with score 0 and rejected;
ties go to the language that sorts first; equal texts get equal results; empty
tables, and tables without labels, give no or only ``und`` rows; other columns
are ignored. The label, source and id are no inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, steps

UND = "und"
#: Labelled rows that the classifier is fitted on, at most and in all languages together.
SAMPLE = 1000
BUCKET_BITS = 16
DIM = 16
NGRAMS = (2, 3, 4)
#: Words in the windows of a sampled row that are trained on besides its whole text.
WINDOWS = (2, 6, 20, 60)
#: Epochs at least; with few rows so many that there are STEPS batches.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 800, 64, 1.0, 7
#: Share of right predictions on held-back examples that may fall under the rejecting score.
LOST = 0.001

_GAP = b"    "
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text[:64])) or any(m[0].isalpha() for m in _LETTER.finditer(text))


def buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram that starts at each byte (the last three bytes are a gap)."""
    x = data.astype(np.uint32)
    m = x.size - 3
    word = x[:m] | x[1 : m + 1] << np.uint32(8)
    out = []
    for n in NGRAMS:
        if n > 2:
            word = word | x[n - 1 : n - 1 + m] << np.uint32(8 * (n - 1))
        h = word * np.uint32(2654435761) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    return out


def fold(text: str) -> bytes:
    """The bytes that n-grams are taken from."""
    return b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" "


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Languages, their probabilities, and whether they are too low to trust."""
        good = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        langs, score, rejected = [UND] * len(texts), [0.0] * len(texts), [True] * len(texts)
        at = 0
        while at < len(good):  # about half a MB at a time
            held, size = [], 0
            while at < len(good) and (not held or size < 1 << 19):
                data = fold(texts[good[at]])
                held.append((good[at], data))
                size += len(data)
                at += 1
            flat = np.frombuffer(b"".join(d + _GAP for _, d in held), np.uint8)
            lengths = np.array([len(d) for _, d in held])
            starts = np.cumsum(lengths + len(_GAP)) - lengths - len(_GAP)
            # Sums up to each text's end and from its gap on; every other one is a text's.
            edges = np.stack([starts, starts + lengths], 1).ravel()
            total = np.zeros((len(held), len(self.langs)))
            for ids in buckets(flat):
                for k in range(len(self.langs)):
                    total[:, k] += np.add.reduceat(self.scores[:, k][ids], edges, dtype=np.float64)[::2]
            p = softmax(total / (len(NGRAMS) * lengths[:, None]) / self.temperature)
            for (i, _), row in zip(held, p, strict=True):
                k = int(row.argmax())
                langs[i], score[i], rejected[i] = self.langs[k], round(float(row[k]), 6), bool(row[k] < self.threshold)
        return langs, score, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _windows(text: str, salt: int) -> Iterator[bytes]:
    whole = fold(text)
    yield whole
    words = whole.split()
    for k, n in enumerate(WINDOWS):
        start = (salt * (2 * k + 1)) % max(1, len(words) - n + 1)
        yield b" " + b" ".join(words[start : start + n]) + b" "


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        langs, salts, ids = [], [], []
        for lang, salt, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "salt", "text")), strict=True):
            if not text or not has_letter(text):
                continue
            for data in _windows(text, salt):
                n = len(data)
                got = np.concatenate([x[:n] for x in buckets(np.frombuffer(data + _GAP, np.uint8))])
                langs.append(lang)
                salts.append(salt)
                ids.append(got.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(salts, pa.int64()), pa.array(ids, pa.binary())], names=["lang", "salt", "ids"])


def train(examples: list[tuple[str, int, np.ndarray]]) -> Model:
    """Fit on (language, salt, bucket ids); rows with salt % 5 == 0 calibrate."""
    langs = sorted({lang for lang, _, _ in examples})
    size = 1 << BUCKET_BITS
    if not langs:
        return Model([], np.zeros((size, 0), np.float32), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    layer = np.zeros((DIM, len(langs)), np.float32)
    fit = [e for e in examples if e[1] % 5] or examples
    held = [e for e in examples if not e[1] % 5] or examples
    label = np.array([langs.index(e[0]) for e in fit])
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(fit)))
    total, done = epochs * len(fit), 0
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            ids = [fit[r][2] for r in rows]
            count = np.array([x.size for x in ids])
            flat, doc = np.concatenate(ids), np.repeat(np.arange(len(rows)), count)
            mean = np.add.reduceat(emb[flat], np.cumsum(count) - count) / count[:, None]
            g = softmax(mean @ layer)
            g[np.arange(len(rows)), label[rows]] -= 1
            rate = RATE * (1 - done / total)
            back = (g @ layer.T / count[:, None]).astype(np.float32)
            layer -= rate / 4 * (mean.T @ g).astype(np.float32)
            by = np.argsort(flat, kind="stable")
            at = flat[by]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            emb[at[first]] -= rate * np.add.reduceat(back[doc[by]], first)
            done += len(rows)
    scores = (emb @ layer).astype(np.float32)
    z = np.array([scores[ids].mean(axis=0) for _, _, ids in held])
    truth = np.array([langs.index(e[0]) for e in held])
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = float(np.quantile(right, LOST)) if right.size else 0.0
    return Model(langs, scores, temperature, threshold)


def held_out(id_col) -> F.Column:
    """Rows that no classifier here learns from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    labelled = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.col("lang") != UND))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([])
    each = max(1, sample // len(counts))
    salt = F.abs(F.xxhash64("doc_id") % F.lit(1_000_003))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int(1_000_003 * min(1.0, each / n))))])
    chosen = labelled.withColumn("salt", salt).filter(F.col("salt") <= share[F.col("lang")])
    rows = chosen.select("lang", "salt", "text").mapInArrow(_sampled, "lang string, salt long, ids binary").toArrow()
    examples = list(zip(rows["lang"].to_pylist(), rows["salt"].to_pylist(), (np.frombuffer(x.as_py(), "<u2") for x in rows["ids"]), strict=True))
    return train(sorted(examples, key=lambda e: (e[1], e[0], e[2].size, zlib.crc32(e[2]))))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            langs, score, rejected = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = dict(docs.dtypes)[id_col]
    return only(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, all columns as they are; map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rejected = sent.value.predict(batch.column("text").to_pylist())[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
