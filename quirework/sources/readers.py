"""Readers and writers over DataFrames: content to blocks and back, one row per document, errors as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as m
from ..functions import inline
from ..functions import text as tx
from . import containers, parsers, writers

ERROR = "struct<category:string,code:string,message:string>"
_ERROR = pa.struct([(k, pa.string()) for k in ("category", "code", "message")])
#: Readers that others may add: (content, title) -> (title, blocks, warnings).
READERS: dict[str, Callable] = dict(parsers.TEXT_PARSERS) | dict(containers.BINARY_PARSERS)
#: Writers that others may add: (title, blocks) -> text or bytes.
WRITERS: dict[str, Callable] = dict(writers.TEXT_WRITERS) | dict(writers.BINARY_WRITERS)


def register_reader(name: str, read: Callable) -> None:
    READERS[name] = read


def register_writer(name: str, write: Callable) -> None:
    WRITERS[name] = write


def parse(content, fmt: str, title: str, reader: Callable | None = None) -> tuple[str, list[dict], list[dict], dict | None]:
    """(title, blocks, warnings, error) of one document; nothing raises."""
    read = reader or READERS[fmt]
    try:
        if fmt in containers.BINARY_PARSERS:
            got = read(containers.binary(content), title)
        else:
            text = content if isinstance(content, str) or content is None else containers.decode_bytes(bytes(content))[0]
            got = read(text or "", title)
        return (*got, None)
    except parsers.ParseError as e:
        return title, [], [], {"category": e.category, "code": e.code, "message": str(e)}
    except (ValueError, KeyError, IndexError, TypeError, RecursionError) as e:
        return title, [], [], {"category": "parse", "code": f"{fmt.upper()}_PARSE_ERROR", "message": f"{type(e).__name__}: {e}"}


def read(docs: DataFrame, fmt: str, content: str = "content", id_col: str = "doc_id", title: str | None = None) -> DataFrame:
    """(doc_id, title, source_format, blocks, warnings, error) of every document."""
    kind = dict(docs.dtypes)[id_col]
    reader = READERS[fmt]
    named = F.col(title).cast("string") if title else F.lit("document")
    base = docs.select(F.col(id_col).alias("doc_id"), named.alias("title"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [parse(c, fmt, t or "", reader) for c, t in zip(part.column("content").to_pylist(), part.column("title").to_pylist(), strict=True)]
                titles, blocks, notes, errors = zip(*rows, strict=True)
                cols = [part.column("doc_id"), pa.array(titles, pa.string()), pa.array([fmt] * len(rows)), pa.array(blocks, pa.list_(m.BLOCK)), pa.array(notes, pa.list_(m.WARNING)), pa.array(errors, _ERROR)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "title", "source_format", "blocks", "warnings", "error"])

    return base.mapInArrow(run, f"doc_id {kind}, title string, source_format string, blocks array<{m.BLOCK_DDL}>, warnings array<{m.WARNING_DDL}>, error {ERROR}")


def write(docs: DataFrame, fmt: str) -> DataFrame:
    """(doc_id, format, data): documents as ``read`` gives them in one format; binary where the format is."""
    kind = dict(docs.dtypes)["doc_id"]
    writer = WRITERS[fmt]
    out = pa.binary() if fmt in writers.BINARY_WRITERS else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [writer(t or "", b or []) for t, b in zip(part.column("title").to_pylist(), part.column("blocks").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([fmt] * len(data)), pa.array(data, out)], names=["doc_id", "format", "data"])

    return docs.select("doc_id", "title", "blocks").mapInArrow(run, f"doc_id {kind}, format string, data {'binary' if pa.types.is_binary(out) else 'string'}")


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row per block: (doc_id, block_idx, fields of the block)."""
    return docs.select("doc_id", F.posexplode("blocks").alias("block_idx", "b")).select("doc_id", "block_idx", "b.*")


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, href) of the links in documents as ``read`` gives them, in order."""
    kind = dict(docs.dtypes)["doc_id"]

    def hrefs(tokens) -> Iterator[str]:
        for t in tokens:
            if t.kind == "link":
                yield t.value
            yield from hrefs(t.children)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[h for b in blocks or [] for s in (writers._sources(b) or [writers._source(b)]) for h in hrefs(inline.parse(s))] for blocks in batch.column("blocks").to_pylist()]
            rows = [(k, at, h) for k, hs in enumerate(found) for at, h in enumerate(hs)]
            if rows:
                place, at, href = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(place, pa.int64())), pa.array(at, pa.int32()), pa.array(href, pa.string())], names=["doc_id", "pos", "href"])

    return docs.select("doc_id", "blocks").mapInArrow(run, f"doc_id {kind}, pos int, href string")


def read_text(docs: DataFrame, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """The plain-text reader in generated code: (doc_id, block_idx, type, text)."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.paragraphs(F.col(content))).alias("block_idx", "text"))
    return parts.select("doc_id", "block_idx", F.lit("paragraph").alias("type"), "text")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder as documents: (doc_id = path, file_name, format, content binary)."""
    from ..plans import catalog

    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.col("path").alias("doc_id"), name.alias("file_name"), catalog.format_of(name).alias("format"), "content")


def save(written: DataFrame, path: str) -> None:
    """Written documents as Parquet, one folder per format."""
    written.write.mode("overwrite").partitionBy("format").parquet(path)
