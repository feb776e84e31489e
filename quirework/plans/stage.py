"""The verification stage: which pairs can be checked, the comparison layers, and the repair cycle around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import audit, images, repair, verify
from ..sources import readers
from . import catalog, convert

#: Formats that are written and read as text, pairs that are read across, formats that can be drawn.
TEXTUAL = ("md", "html", "txt", "json", "xml", "csv")
ACROSS = (("md", "html"), ("html", "md"))
DRAWN = ("pdf", "png", "html", "docx", "pptx")


def gate(source: Column, target: Column) -> Column:
    """Why a pair isn't compared block by block; null where it is."""
    return F.when(~source.isin(*TEXTUAL) | ~target.isin(*TEXTUAL), F.lit("writer-not-text-canonical"))


def drawing_gate(source: Column, target: Column) -> Column:
    return F.when(~source.isin(*DRAWN) | ~target.isin(*DRAWN), F.lit("format-not-drawn"))


def rule_diff(docs: DataFrame, source: str, target: str) -> DataFrame:
    """(doc_id, eligible, reason, score, fidelity, warning) of documents as ``read`` gives them, against their written form read again.

    Markdown and HTML are read across: the written form goes back to the source's format before it is compared.
    """
    if source not in TEXTUAL or target not in TEXTUAL:
        none = F.lit(None)
        return docs.select("doc_id", F.lit(False).alias("eligible"), F.lit("writer-not-text-canonical").alias("reason"), none.cast("double").alias("score"), none.cast("string").alias("fidelity"), none.cast("string").alias("warning"))
    back = convert.read_back(docs, target)
    if (source, target) in ACROSS:
        back = convert.read_back(back.drop("error"), source)
    found = verify.diff(readers.blocks_of(docs), readers.blocks_of(back))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    fidelity = F.coalesce("fidelity", F.lit("exact"))  # nothing in, nothing out
    return out.select("doc_id", F.lit(True).alias("eligible"), F.lit("completed").alias("reason"), F.coalesce("score", F.lit(1.0)).alias("score"), fidelity.alias("fidelity"), F.when(fidelity != "exact", F.lit("ROUND_TRIP_DRIFT")).alias("warning"))


def visual(pixels: DataFrame, least: float = images.SIMILAR) -> DataFrame:
    """(doc_id, score, passed, warning) of page images drawn from source and result: rows (doc_id, x, y, a, b) on one grid."""
    found = images.ssim(pixels, "doc_id").withColumnRenamed("ssim", "score")
    passed = F.col("score") >= least
    return found.select("doc_id", "score", passed.alias("passed"), F.when(~passed, F.lit("SSIM_VISUAL_DRIFT")).alias("warning"))


def read_text(pairs: DataFrame, least: float = verify.SIMILAR_ENOUGH) -> DataFrame:
    """(doc_id, f1, passed, warning) of rows (doc_id, expected, read): text that recognition reads off the result."""
    found = verify.overlap(pairs, "expected", "read", "doc_id")
    passed = F.col("f1") >= least
    return found.select("doc_id", "f1", passed.alias("passed"), F.when(~passed, F.lit("OCR_READBACK_DRIFT")).alias("warning"))


def envelope(*layers: tuple[str, DataFrame]) -> DataFrame:
    """(doc_id, layers, warnings): results of several layers in one row per document."""
    rows = None
    for name, df in layers:
        part = df.select("doc_id", F.lit(name).alias("layer"), "warning")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"), F.array_sort(F.collect_set("warning")).alias("warnings"))


def repair_cycle(docs: DataFrame, target: str, actions: DataFrame) -> DataFrame:
    """(doc_id, attempted, decision): text repairs done, the repaired documents written and read again, and the verdict."""
    blocks = readers.blocks_of(docs)
    done = repair.replace_runs(blocks, actions)
    tried = done.groupBy("doc_id").agg(F.max("changed").alias("attempted"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", F.struct(*[c for c in blocks.columns if c not in ("doc_id", "block_idx")]).alias("b")))), lambda x: x.b)
    repaired = done.groupBy("doc_id").agg(whole.alias("blocks")).join(docs.select("doc_id", "title"), "doc_id")
    back = readers.blocks_of(convert.read_back(repaired, target))
    marks = verify.model_fingerprint(readers.blocks_of(repaired)).select("doc_id", "fingerprint").join(verify.model_fingerprint(back).select("doc_id", F.col("fingerprint").alias("read_back")), "doc_id", "left")
    noted = docs.select("doc_id", F.posexplode_outer("warnings").alias("pos", "w")).select("doc_id", "pos", "w.*").filter("code is not null")
    before = audit.quality(docs, blocks, noted).select("doc_id", "n_warnings", "downgrades")
    after = before.join(marks, "doc_id", "left")
    found = repair.verdict(before.withColumns({"fingerprint": F.lit(""), "read_back": F.lit("")}), after)
    return docs.select("doc_id").join(tried, "doc_id", "left").join(found, "doc_id", "left").select("doc_id", F.coalesce("attempted", F.lit(False)).alias("attempted"), F.coalesce("decision", F.lit("degraded")).alias("decision"))


def gates(pairs: DataFrame) -> DataFrame:
    """Pairs (source, target) with the reasons for which layers leave them out."""
    return catalog.allowed(pairs).select("source", "target", gate(F.col("source"), F.col("target")).alias("rule_diff"), drawing_gate(F.col("source"), F.col("target")).alias("visual"))
