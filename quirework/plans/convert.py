"""Conversion of a DataFrame of documents: gate, read, map, audit, write, verify; errors stay in their rows."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SCHEMA_VERSION, WARNING_DDL
from ..operators import audit, verify
from ..sources import readers
from . import catalog

_NOTE = {
    "generated": ("lossy", "PATH_GENERATED", "The target is made up from the text; layout is not kept."),
    "restricted": ("lossy", "PATH_NOT_RECOMMENDED", "The source is read in part only."),
}


def route_warnings(route: catalog.Route) -> list[tuple[str, str, str]]:
    out = [("lossy", w, f"Mapping {m.source} to {m.target}.") for m in route.executed for w in m.warnings]
    return [*out, *([_NOTE[route.route_class]] if route.route_class in _NOTE else [])]


def convert(docs: DataFrame, source: str, target: str, content: str = "content", id_col: str = "doc_id", title: str | None = None, max_input_bytes: int | None = None) -> DataFrame:
    """(doc_id, format, data, title, temperature, route_class, warnings, error, quality, conversion) of every document.

    A pair outside the matrix gives rows with the error UNSUPPORTED_CONVERSION_PATH, content beyond its format's budget (or ``max_input_bytes``)
    INPUT_BUDGET_EXCEEDED, unreadable content the reader's error; none of them fails the job.
    """
    source, target = catalog.normalize(source), catalog.normalize(target)
    kind = dict(docs.dtypes)[id_col]
    route = catalog.Planner().route(source, target)
    error = lambda cat, code, message: F.struct(F.lit(cat).alias("category"), F.lit(code).alias("code"), F.lit(message).alias("message"))
    if route is None:
        known = catalog.FORMATS.get(target)
        code = "UNSUPPORTED_CONVERSION_PATH" if known and known.writable else "UNSUPPORTED_OUTPUT_FORMAT"
        none = F.lit(None).cast("string")
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(target).alias("format"), none.alias("data"), none.alias("title"), none.alias("temperature"), none.alias("route_class"), F.array().cast(f"array<{WARNING_DDL}>").alias("warnings"), error("validate", code, f"{source} to {target}").alias("error"), F.lit(None).cast(audit.QUALITY_DDL).alias("quality"), F.lit(None).cast("struct<reader:string,writer:string,schema_version:string,models:array<string>,executed:array<string>>").alias("conversion"))
    limit = max_input_bytes or catalog.FORMATS[source].max_input_bytes
    notes = [{"severity": s, "code": c, "message": x} for s, c, x in route_warnings(route)]
    reader, writer = readers.READERS[source], readers.WRITERS[target]
    binary = target in readers.writers.BINARY_WRITERS
    named = F.col(title).cast("string") if title else F.lit("document")
    # Content over its budget isn't sent to be read; whether it was is part of the row, so nothing is joined.
    over = F.coalesce(F.octet_length(F.col(content)) > limit, F.lit(False))
    base = docs.select(F.col(id_col).alias("doc_id"), named.alias("title"), F.when(~over, F.col(content)).alias("content"), over.alias("over"))
    beyond = {"category": "validate", "code": "INPUT_BUDGET_EXCEEDED", "message": f"over {limit} bytes"}

    def one(content, title: str | None, over: bool) -> tuple:
        """What is read is written at once, so blocks never leave their step."""
        if over:
            return None, title, notes, beyond, None
        title, blocks, found, error = readers.parse(content, source, title or "", reader)
        if error:
            return None, title, [*found, *notes], error, None
        warnings = audit.once([*found, *notes, *(w for b in blocks for w in b.get("warnings") or ())])
        return writer(title, blocks), title, warnings, None, audit.quality_of(blocks, warnings)

    def run(batches):
        # Blocks are many small objects without cycles, which the collector would walk again and again.
        gc.disable()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in ("content", "title", "over")), strict=True)]
                data, titles, warnings, errors, quality = zip(*rows, strict=True)
                cols = [part.column("doc_id"), pa.array(data, pa.binary() if binary else pa.string()), pa.array(titles, pa.string()), pa.array(warnings, pa.list_(readers.m.WARNING)), pa.array(errors, readers._ERROR), pa.array(quality, audit.QUALITY)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "data", "title", "warnings", "error", "quality"])
        gc.enable()

    done = base.mapInArrow(run, f"doc_id {kind}, data {'binary' if binary else 'string'}, title string, warnings array<{WARNING_DDL}>, error {readers.ERROR}, quality {audit.QUALITY_DDL}")
    made = F.struct(F.lit(source).alias("reader"), F.lit(target).alias("writer"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.array(*map(F.lit, route.models)).alias("models"), F.array(*[F.lit(m.name) for m in route.executed]).cast("array<string>").alias("executed"))
    return done.select("doc_id", F.lit(target).alias("format"), "data", "title", F.lit(route.temperature).alias("temperature"), F.lit(route.route_class).alias("route_class"), "warnings", "error", "quality", made.alias("conversion"))


def with_fallback(docs: DataFrame, source: str, target: str, content: str = "content", id_col: str = "doc_id", apply: bool = True) -> DataFrame:
    """``convert``, and where the route is generated or restricted, to the safer target that repair proposes; ``fallback_from`` names the other.

    Without ``apply`` the safer target is only named, in ``fallback_to``.
    """
    source, target = catalog.normalize(source), catalog.normalize(target)
    route = catalog.Planner().route(source, target)
    risky = route is not None and route.route_class in _NOTE
    safe = next((t for t in catalog.MATRIX.get(source, ()) if catalog.Planner().route(source, t).route_class == "recommended"), None) if risky else None
    done = convert(docs, source, safe if safe and apply else target, content, id_col)
    return done.withColumns({"fallback_from": F.lit(target if safe and apply else None).cast("string"), "fallback_to": F.lit(safe).cast("string")})


def audited(docs: DataFrame, source: str, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """One row per block of documents in a text format: (doc_id, block_idx, id, start, end, start_line, end_line, fields of the block)."""
    blocks = readers.blocks_of(readers.read(docs, catalog.normalize(source), content, id_col))
    spans = audit.source_spans(blocks, docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content")))
    return audit.identified(blocks).join(spans, ["doc_id", "block_idx"], "left")


def read_back(docs: DataFrame, fmt: str) -> DataFrame:
    """Documents as ``read`` gives them, written to a format and read again."""
    written = readers.write(docs, fmt)
    return readers.read(written, fmt, "data")


def round_trip(docs: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, n_blocks, ..., score, fidelity) of documents against what reading their written form gives."""
    return verify.diff(readers.blocks_of(docs), readers.blocks_of(read_back(docs, fmt)))


def report(docs: DataFrame) -> DataFrame:
    """Quality of documents as ``read`` gives them."""
    warnings = docs.select("doc_id", F.posexplode("warnings").alias("pos", "w")).select("doc_id", "pos", "w.*")
    return audit.quality(docs, readers.blocks_of(docs), audit.distinct_warnings(warnings, "doc_id"))
