"""Audit of documents: warnings, quality, schema errors, places in the source, assets."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import BLOCK_TYPES, SEVERITIES
from .verify import fingerprint

#: Fixed value: what a message about lost text says.
TEXT_LOST = re.compile("text|content|字符|编码")


def distinct_warnings(warnings: DataFrame, *keys: str) -> DataFrame:
    """The first of warnings with equal code and message; rows have ``pos``."""
    first = Window.partitionBy(*keys, "code", "message").orderBy("pos")
    return warnings.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def by_severity(warnings: DataFrame, *keys: str) -> DataFrame:
    return warnings.groupBy(*keys, "severity").agg(F.count("*").alias("n"))


def quality(docs: DataFrame, blocks: DataFrame, warnings: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One row per document of ``docs`` (doc_id): what a conversion kept, from its blocks, warnings and assets."""
    tables = blocks.groupBy("doc_id").agg(F.bool_or(F.col("type") == "table").alias("has_table"), F.count("*").alias("n_blocks"))
    lossy = F.col("severity") == "lossy"
    noted = warnings.groupBy("doc_id").agg(
        F.bool_or(lossy).alias("lossy"),
        F.bool_or(lossy & F.col("message").rlike(TEXT_LOST.pattern)).alias("text_lost"),
        F.count("*").alias("n_warnings"),
        F.count_if(F.col("severity").isin("lossy", "unsupported")).alias("downgrades"),
    )
    out = docs.select("doc_id").join(tables, "doc_id", "left").join(noted, "doc_id", "left")
    if assets is not None:
        out = out.join(assets.groupBy("doc_id").agg(F.count("*").alias("n_assets")), "doc_id", "left")
    else:
        out = out.withColumn("n_assets", F.lit(0))
    grade = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "medium").otherwise("high")
    tracked = lambda c: F.when(F.coalesce(c, F.lit(False)), "tracked").otherwise("not-applicable")
    return out.select(
        "doc_id", grade("lossy").alias("structure_fidelity"), grade("text_lost").alias("text_fidelity"), tracked(F.col("has_table")).alias("table_fidelity"),
        tracked(F.col("n_assets") > 0).alias("asset_fidelity"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_blocks", "n_warnings", "downgrades")],
    )


#: Quality of one conversion, as ``quality`` gives it for tables of blocks and warnings.
QUALITY_FIELDS = {"structure_fidelity": "string", "text_fidelity": "string", "table_fidelity": "string", "asset_fidelity": "string", "n_blocks": "bigint", "n_warnings": "bigint", "downgrades": "bigint"}
QUALITY_DDL = "struct<" + ",".join(f"{k}:{v}" for k, v in QUALITY_FIELDS.items()) + ">"
QUALITY = pa.struct([(k, pa.int64() if v == "bigint" else pa.string()) for k, v in QUALITY_FIELDS.items()])


def once(warnings: list[dict]) -> list[dict]:
    """The first of warnings with equal code and message."""
    return list({(w["code"], w["message"]): w for w in reversed(warnings)}.values())[::-1]


def quality_of(blocks: list[dict], warnings: list[dict]) -> dict:
    """The row of ``quality`` for one document in hand."""
    lossy = [w for w in warnings if w["severity"] == "lossy"]
    kinds = {b["type"] for b in blocks}
    grade = lambda bad: "medium" if bad else "high"
    tracked = lambda kind: "tracked" if kind in kinds else "not-applicable"
    values = (grade(lossy), grade(any(TEXT_LOST.search(w["message"] or "") for w in lossy)), tracked("table"), tracked("asset"), len(blocks), len(warnings), sum(w["severity"] in ("lossy", "unsupported") for w in warnings))
    return dict(zip(QUALITY_FIELDS, values, strict=True))


def identified(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``id``: their own, or their place and a hash of what they hold."""
    made = F.concat(F.lit("block-"), F.col("block_idx") + 1, F.lit("-"), fingerprint())
    return blocks.withColumn("id", F.coalesce("id", made) if "id" in blocks.columns else made)


def schema_errors() -> Column:
    """What is wrong with a block row, as an array of messages."""
    kind = F.col("type")
    bad = lambda when, message: F.when(when, F.lit(message))
    checks = [
        bad(~F.coalesce(kind.isin(*BLOCK_TYPES), F.lit(False)), "type is unknown"),
        bad((kind == "heading") & ~F.coalesce(F.col("level").between(1, 6), F.lit(False)), "level is not 1 to 6"),
        bad(kind.isin("heading", "paragraph", "quote") & F.col("text").isNull(), "text is missing"),
        bad((kind == "list") & F.col("items").isNull(), "items are missing"),
        bad((kind == "code") & F.col("code").isNull(), "code is missing"),
        bad((kind == "table") & (F.col("headers").isNull() | F.col("rows").isNull()), "headers or rows are missing"),
        bad((kind == "image") & F.col("src").isNull(), "src is missing"),
        bad((kind == "asset") & F.col("asset_id").isNull(), "asset_id is missing"),
        bad((kind == "raw") & F.col("content").isNull(), "content is missing"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def warning_errors() -> Column:
    known = F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    return F.filter(F.array(F.when(~known, F.lit("severity is unknown")), F.when(F.col("code").isNull(), F.lit("code is missing"))), lambda x: x.isNotNull())


def search_text() -> Column:
    """The text by which a block is found in its source."""
    kind = F.col("type")
    rows = F.array_join(F.concat(F.array(F.array_join("headers", " ")), F.transform("rows", lambda r: F.array_join(r, " "))), "\n")
    named = F.coalesce(F.nullif("alt", F.lit("")), F.nullif("title", F.lit("")))
    return F.coalesce(
        F.when(kind.isin("heading", "paragraph", "quote"), F.col("text")).when(kind == "code", F.col("code")).when(kind == "list", F.array_join("items", "\n"))
        .when(kind == "table", rows).when(kind == "image", F.coalesce(named, "src")).when(kind == "asset", F.coalesce(named, "asset_id")).when(kind == "raw", F.substring("content", 1, 80)),
        F.lit(""),
    )


def plain_text() -> Column:
    """The text of a block; list items are numbered by their place, nested ones as well."""
    kind = F.col("type")
    depth = lambda i: F.greatest(F.coalesce(F.get("depths", i), F.lit(0)), F.lit(0))
    mark = lambda i: F.when(F.col("ordered") & (depth(i) == 0), F.concat((i + 1).cast("string"), F.lit("."))).otherwise("-")
    items = F.array_join(F.transform("items", lambda x, i: F.concat(F.repeat(F.lit("  "), depth(i)), mark(i), F.lit(" "), x)), "\n")
    rows = F.filter(F.concat(F.array(F.array_join("headers", "\t")), F.transform("rows", lambda r: F.array_join(r, "\t"))), lambda x: x != "")
    named = F.coalesce(F.nullif("alt", F.lit("")), F.nullif("title", F.lit("")))
    return F.coalesce(
        F.when(kind.isin("heading", "paragraph", "quote"), F.col("text")).when(kind == "list", items).when(kind == "code", F.col("code")).when(kind == "table", F.array_join(rows, "\n"))
        .when(kind == "image", F.coalesce(named, "src")).when(kind == "asset", F.coalesce(named, "asset_id")).when((kind == "raw") & (F.col("format") != "html"), F.col("content")),
        F.lit(""),
    )


def document_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): blocks without empty ones, a blank line between."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "t"))), lambda x: x.t)
    return blocks.withColumn("t", plain_text()).groupBy("doc_id").agg(F.array_join(F.filter(ordered, lambda t: t != ""), "\n\n").alias("text"))


class SpanFinder:
    """Places of blocks in their source, each looked for from where the block before ended."""

    def __init__(self, source: str):
        self.source = newlines(source)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.source))]
        self.at = 0

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)

    def find(self, wanted: str) -> tuple[int, int, int, int] | None:
        """(start, end, start line, end line), lines from 1: the text, or else its first line, from the cursor on."""
        needle = newlines(wanted).strip()
        if not needle:
            return None
        first = next((x for x in needle.split("\n") if x), needle)
        start = self.source.find(needle, self.at)
        if start < 0 and first != needle:
            start = self.source.find(first, self.at)
        if start < 0:
            return None
        self.at = start + max(len(first), len(needle))
        return start, self.at, self.line(start), self.line(self.at)


def newlines(text: str | None) -> str:
    return (text or "").replace("\r\n", "\n").replace("\r", "\n")


def source_spans(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, block_idx, start, end, start_line, end_line) of each block's place in its source, offsets from 0; null where it isn't there.

    The search goes on where the block before ended, so a document's blocks meet in one row with their source, once.
    """
    held = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", search_text().alias("wanted")))).alias("blocks"))
    both = held.join(sources.select("doc_id", "content"), "doc_id")
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, spans = [], [], []
            for row, (content, wanted) in enumerate(zip(batch.column("content").to_pylist(), batch.column("blocks").to_pylist(), strict=True)):
                finder = SpanFinder(content)
                docs += [row] * len(wanted)
                places += [b["block_idx"] for b in wanted]
                spans += [finder.find(b["wanted"]) or (None, None, None, None) for b in wanted]
            cols = [pa.array([s[k] for s in spans], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(places, pa.int64()), *cols], names=["doc_id", "block_idx", "start", "end", "start_line", "end_line"])

    out = both.select("doc_id", "content", "blocks").mapInArrow(run, f"doc_id {kinds['doc_id']}, block_idx long, start long, end long, start_line long, end_line long")
    return out.withColumn("block_idx", F.col("block_idx").cast(kinds["block_idx"]))


def line_index(sources: DataFrame) -> DataFrame:
    """(doc_id, line, first, next): offsets at which the lines of a source begin, for range joins."""
    lines = sources.select("doc_id", F.posexplode(F.split(tx.normalize_newlines(F.col("content")), "\n")).alias("pos", "text"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long")
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), first.alias("first"), (first + F.length("text") + 1).alias("next"))


def assets_once(assets: DataFrame) -> DataFrame:
    """(hash, asset_id, refs, n): assets with equal data are one, named by the first; all that refer to them are kept."""
    return assets.groupBy("hash").agg(F.min_by("asset_id", "pos").alias("asset_id"), F.array_sort(F.collect_set("ref")).alias("refs"), F.count("*").alias("n"))
