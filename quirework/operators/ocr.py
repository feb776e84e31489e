"""Text recognition around engines that are plugged in: languages, engine choice, recognition, results, pages, blocks.

No model comes with the library. Without an engine, pages get an OCR_UNAVAILABLE warning instead of made-up text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import images

#: Languages and their other names, codes of recognition data, and what counts as a low confidence.
LANGUAGES = ("zh-CN", "zh-TW", "en", "ja", "ko", "auto")
OTHER_NAMES = {"zh-CN": "chi_sim zh zh-cn zh_cn zh-hans", "zh-TW": "chi_tra zh-tw zh_tw zh-hant", "en": "eng en en-us", "ja": "jpn ja", "ko": "kor ko", "auto": "auto"}
DATA_CODES = {"zh-CN": "chi_sim", "zh-TW": "chi_tra", "en": "eng", "ja": "jpn", "ko": "kor"}
LOW = 0.6


def language(c: Column, strict: bool = False) -> Column:
    """Canonical language; unknown names stay as they are, or are ``auto`` if ``strict``."""
    names = {n: k for k, names in OTHER_NAMES.items() for n in names.split()}
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(c)))
    given = F.when(c.isNull() | (c == ""), F.lit("auto"))
    return F.coalesce(given, known, F.lit("auto") if strict else c)


def data_code(c: Column) -> Column:
    """Code of the recognition data of a language; null for ``auto`` and unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DATA_CODES.items() for x in pair]), language(c))


@dataclass(frozen=True)
class Engine:
    """Something that reads an image: (pixels, language) -> rows of (text, confidence, x, y, w, h)."""

    name: str
    recognise: Callable[[np.ndarray, str], list[tuple]]
    priority: int = 0
    available: Callable[[], bool] = lambda: True


ENGINES: list[Engine] = []


def register(engine: Engine) -> None:
    ENGINES[:] = [e for e in ENGINES if e.name != engine.name] + [engine]


def choose() -> Engine | None:
    """The available engine of highest priority; of equal ones the last that was registered."""
    good = [(e.priority, k, e) for k, e in enumerate(ENGINES) if e.available()]
    return max(good, key=lambda x: x[:2])[2] if good else None


#: Models that a Python worker has loaded, by name and options; each is made once a worker, whatever the number of pages.
SESSIONS: dict[tuple, object] = {}


def session(make: Callable[[], object], *key) -> object:
    """What ``make`` gives for ``key``, made once a worker."""
    if key not in SESSIONS:
        SESSIONS[key] = make()
    return SESSIONS[key]


@dataclass(frozen=True)
class Rasteriser:
    """Something that draws the pages of a file: bytes and dots an inch -> gray images; and tells how many there are."""

    draw: Callable[[bytes, int], list[np.ndarray]]
    count: Callable[[bytes], int]


#: Fixed value: dots an inch at which pages are drawn.
DPI = 200


def page_images(docs: DataFrame, rasteriser: Rasteriser | None, most: int | None = None, dpi: int = DPI) -> DataFrame:
    """(doc_id, page, pixels, width, height, language, n_pages, warning) of files (doc_id, content, language), page by page.

    Without a rasteriser a file is one row with the warning OCR_RASTERIZER_UNAVAILABLE, one that can't be drawn is one with
    OCR_RASTERIZE_FAILED. ``most`` bounds the pages of a file that are drawn, as a caller may ask; the row of the last has then
    the warning OCR_PAGES_TRUNCATED.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def pages_of(data: bytes | None) -> list[tuple]:
        if rasteriser is None:
            return [(None, None, None, None, 0, "OCR_RASTERIZER_UNAVAILABLE")]
        try:
            total, drawn = rasteriser.count(bytes(data or b"")), rasteriser.draw(bytes(data or b""), dpi)
        except (ValueError, TypeError, RuntimeError, OSError):
            return [(None, None, None, None, 0, "OCR_RASTERIZE_FAILED")]
        kept = drawn[:most]
        last = "OCR_PAGES_TRUNCATED" if len(kept) < len(drawn) else None
        return [(k, np.ascontiguousarray(p, np.uint8).tobytes(), p.shape[1], p.shape[0], total, last if k + 1 == len(kept) else None) for k, p in enumerate(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # the pages of one file at a time
                rows = pages_of(batch.column("content")[at].as_py())
                place = pa.array([at] * len(rows), pa.int64())
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(place), *values[:4], batch.column("language").take(place), *values[4:]], names=["doc_id", "page", "pixels", "width", "height", "language", "n_pages", "warning"])

    return docs.select("doc_id", "content", "language").mapInArrow(run, f"doc_id {kind}, page int, pixels binary, width int, height int, language string, n_pages int, warning string")


def review_tasks(done, *tasks: str):
    """An array column of tasks with more of them, each once, in the order in which they came."""
    return F.array_union(F.coalesce(done, F.array().cast("array<string>")), F.array(*map(F.lit, tasks)))


_LINE = pa.struct([("text", pa.string()), ("confidence", pa.float64()), *((k, pa.float64()) for k in "xywh"), ("orientation", pa.string())])


def recognise(pages: DataFrame, engine: Engine | None, denoise_above: float = 0.02) -> DataFrame:
    """(doc_id, page, engine, lines, warning) of pages (doc_id, page, pixels binary, width, height, language): gray bytes row by row.

    Noisy images are filtered; a page whose lines are surer when turned keeps the best of three orientations.
    """
    kind = dict(pages.dtypes)["doc_id"]

    def best(image: np.ndarray, lang: str) -> tuple[list[tuple], str]:
        tried = []
        for name, turned in (("0", image), ("90", np.rot90(image, -1)), ("270", np.rot90(image))):
            rows = engine.recognise(turned, lang)
            tried.append((float(np.mean([r[1] for r in rows])) if rows else 0.0, rows, name))
            if name == "0" and tried[0][0] >= LOW:
                break
        return max(tried, key=lambda t: t[0])[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, notes = [], []
            for row in batch.to_pylist():
                if engine is None:
                    lines.append([])
                    notes.append("OCR_UNAVAILABLE")
                    continue
                try:
                    image = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                    if images.noise_level(image) > denoise_above:
                        image = images.median_filter(image)
                    rows, turn = best(image, row["language"] or "auto")
                    lines.append([dict(zip(("text", "confidence", "x", "y", "w", "h"), r, strict=True)) | {"orientation": turn} for r in rows])
                    notes.append("OCR_LOW_CONFIDENCE" if rows and np.mean([r[1] for r in rows]) < LOW else None)
                except (ValueError, TypeError, RuntimeError):
                    lines.append([])
                    notes.append("OCR_FAILED")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("page"), pa.array([engine.name if engine else None] * batch.num_rows, pa.string()), pa.array(lines, pa.list_(_LINE)), pa.array(notes, pa.string())],
                names=["doc_id", "page", "engine", "lines", "warning"],
            )

    ddl = "array<struct<text:string,confidence:double,x:double,y:double,w:double,h:double,orientation:string>>"
    return pages.select("doc_id", "page", "pixels", "width", "height", "language").mapInArrow(run, f"doc_id {kind}, page int, engine string, lines {ddl}, warning string")


def summary(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_lines, average, least, low, turned, grade) of lines (confidence, orientation)."""
    c = F.greatest(F.lit(0), F.least(F.lit(1), F.col("confidence")))
    out = lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.avg(c).alias("average"), F.min(c).alias("least"), F.count_if(F.col("confidence") < LOW).alias("low"), F.count_if(F.coalesce("orientation", F.lit("0")) != "0").alias("turned")
    )
    grade = F.when((F.col("average") >= 0.9) & (F.col("low") == 0), "high").when(F.col("average") >= 0.7, "medium").otherwise("low")
    return out.withColumn("grade", grade)


def merge_pages(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, pages, runs, average, runtime_ms): results of pages (average, n_lines, runtime_ms) as one."""
    return results.groupBy(*keys).agg(F.count("*").alias("pages"), F.sum("n_lines").alias("runs"), F.coalesce(F.avg("average"), F.lit(0.0)).alias("average"), F.sum("runtime_ms").alias("runtime_ms"))


def line_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, line, block_id) of lines (doc_id, line, text): the block whose text holds the line's.

    The search goes on from the block of the line before, then from the first block on; so each document is folded in order.
    """
    held = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", F.trim(F.col("text")).alias("text")))).alias("ls"))
    parts = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "block_id", F.trim(F.col("text")).alias("text")))).alias("bs"))
    both = held.join(parts, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, numbers, found = [], [], []
            for row in batch.to_pylist():
                blocks_, at = row["bs"] or [], 0
                for ln in row["ls"]:
                    order = [*range(at, len(blocks_)), *range(at)] if ln["text"] else []
                    hit = next((j for j in order if blocks_[j]["text"] and ln["text"] in blocks_[j]["text"]), None)
                    at = max(at, hit) if hit is not None else at
                    docs.append(row["doc_id"])
                    numbers.append(ln["line"])
                    found.append(blocks_[hit]["block_id"] if hit is not None else "")
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, batch.column("doc_id").type), "line": pa.array(numbers, pa.int64()), "block_id": pa.array(found, pa.string())})

    return both.select("doc_id", "ls", "bs").mapInArrow(run, f"doc_id {dict(lines.dtypes)['doc_id']}, line long, block_id string")
