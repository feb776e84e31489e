"""Fixed-layout pages: runs to blocks and back, page files from runs, and what they could not keep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import writers
from . import layout


def clamped(runs: DataFrame) -> DataFrame:
    """Runs with confidence between 0 and 1."""
    return runs.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))


def to_semantic(runs: DataFrame) -> DataFrame:
    """(doc_id, block_idx, type, level, text) of runs (doc_id, page, x, y, h, text) whose y grows upward.

    Runs within half their height of a line's first run are the line; lines are then grouped page by page.
    """
    held = layout.line_numbers(runs.select("doc_id", "page", "x", "y", "h", "text"), "doc_id", "page")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda r: F.trim(r.text)), " ")
    lines = held.groupBy("doc_id", "page", "pos").agg(text.alias("text"), F.max("y").alias("y"), F.max("h").alias("h"))
    blocks = layout.page_blocks(lines, "doc_id", "page")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block")) - 1
    return blocks.select("doc_id", place.alias("block_idx"), "type", "level", "text")


def from_semantic(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, h, text): one run per block, from the top down."""
    size = F.when(F.col("type") == "heading", 26 - 2 * F.coalesce("level", F.lit(1))).otherwise(12).cast("double")
    placed = layout.vertical_cursor(blocks.withColumn("h", size), F.col("h"), "doc_id")
    return placed.select("doc_id", F.lit(1).alias("page"), F.lit(writers.MARGIN).alias("x"), F.col("y").cast("double").alias("y"), "h", "text")


def page_files(runs: DataFrame, font: str = "STSong-Light") -> DataFrame:
    """(doc_id, data, fonts): page files with every run where it was; ``fonts`` are those that were replaced."""
    kind = dict(runs.dtypes)["doc_id"]
    lost = F.array_sort(F.filter(F.collect_set("font"), lambda f: f != font))
    docs = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "y", "x", "h", "text"))).alias("runs"), lost.alias("fonts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for rows in batch.column("runs").to_pylist():
                pages: dict[int, list] = {}
                for r in rows:
                    pages.setdefault(r["page"], []).append((r["text"], r["h"], r["x"], r["y"]))
                data.append(writers.pdf_file([pages[k] for k in sorted(pages)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary()), batch.column("fonts")], names=["doc_id", "data", "fonts"])

    return docs.mapInArrow(run, f"doc_id {kind}, data binary, fonts array<string>")


def summary(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_runs, n_chars)."""
    a = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    b = runs.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.sum(F.length("text")).alias("n_chars"))
    return a.join(b, "doc_id", "left").fillna(0)
