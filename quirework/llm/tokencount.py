"""Token counts without ids: each distinct pre-token is merged once, and documents sum its piece count.

1. Distinct pre-tokens of all texts, with map-side combine; each is merged once (numpy rounds of ``bpe``).
2. The ``hot`` most frequent ones, at most a fixed number, go to all tasks: about nine tenths of all occurrences, so
   that no frequent key is ever shuffled.
3. Each document sums the hot ones where it stands and gives a (pre-token, document, frequency) row for each
   other one; these join with the piece counts and are summed by document.

Cases: null and empty texts count 0; special strings inside a text count 1 each, as the library finds them;
equal texts give equal counts; texts of any length are whole; empty tables give empty results; other columns
are ignored. Every row gives one, repeated ones too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, most_frequent, only, steps
from .pretoken import pieces

#: Pre-tokens sent to all tasks: about 1 MB.
HOT = 65_536
#: Distinct pre-tokens that a task holds before it gives them on.
HELD = 300_000


def _split(splitter, text: str) -> tuple[list[str], int]:
    """Pre-tokens of a text, and how many special strings it has."""
    if splitter.plain(text):
        return pieces(text), 0
    words: list[str] = []
    special = 0
    for part, i in splitter.parts(text):
        if i < 0:
            words += pieces(part)
        else:
            special += 1
    return words, special


def _distinct(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = bpe.encoder(path).v.splitter
        held: Counter[str] = Counter()
        for batch in steps(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(_split(splitter, text)[0])
            if len(held) > HELD:
                yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
                held = Counter()
        yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    return run


def _pieces(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.encoder(path).v
        for batch in steps(batches, "word", 1 << 20):
            words = batch.column("word").to_pylist()
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "n": batch.column("n"), "pieces": pa.array(v.encode_words(words)[1], pa.int32())})

    return run


def _frequencies(path: str | None, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = bpe.encoder(path).v.splitter, hot.value
        for batch in steps(batches):
            rows, words, freq = [], [], []
            totals, sizes = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                all_words, total = _split(splitter, text or "")
                for word, n in Counter(all_words).items():
                    if (k := known.get(word)) is not None:
                        total += n * k
                    else:
                        rows.append(at)
                        words.append(word)
                        freq.append(n)
                totals.append(total)
                sizes.append(len((text or "").encode()))
            row_id = batch.column("row_id")
            n = batch.num_rows
            ids = pa.concat_arrays([row_id, row_id.take(pa.array(rows, pa.int64()))])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.concat_arrays([pa.array(sizes, pa.int64()), pa.nulls(len(rows), pa.int64())]), pa.array([None] * n + words, pa.string()), pa.array(totals + freq, pa.int64())],
                names=["row_id", "n_bytes", "word", "n"],
            )

    return run


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    spark = docs.sparkSession
    base = only(docs, id_col, text_col)
    words = base.select("text").mapInArrow(_distinct(path), "word string, n long")
    counted = words.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_pieces(path), "word string, n long, pieces int")
    counted = cut(counted, "pieces")
    top = most_frequent(counted, F.col("n"), hot).select("word", "pieces").toPandas()
    known = spark.sparkContext.broadcast(dict(zip(top["word"], top["pieces"].tolist(), strict=True)))
    kind = dict(base.dtypes)["doc_id"]
    rows = base.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("row_id"), "text").mapInArrow(
        _frequencies(path, known), f"row_id struct<doc_id:{kind},digest:bigint>, n_bytes long, word string, n long"
    )
    # A row without a word holds what its document summed itself; equal rows came in as often as there are of these, and go out so.
    own = F.col("word").isNull()
    worth = F.when(own, F.col("n")).otherwise(F.col("n") * F.col("pieces"))
    summed = rows.join(counted.select("word", "pieces"), "word", "left").groupBy("row_id").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum(worth).alias("total"), F.sum(own.cast("long")).alias("copies")
    )
    summed = summed.select("row_id", "n_bytes", (F.col("total") / F.col("copies")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return summed.select("row_id.doc_id", "n_bytes", "n_tokens")
