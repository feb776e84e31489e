"""Formats, models, allowed conversions and the route planner."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, models, limits and warnings of the formats, the matrix of conversions, and the mappers.
ALIASES = {"markdown": "md", "mdown": "md", "mkd": "md", "htm": "html", "text": "txt", "plain": "txt", "plaintext": "txt"}

SEMANTIC, WORKBOOK, SLIDES, FIXED = "SemanticDoc", "WorkbookModel", "SlideModel", "FixedLayoutModel"
MIB = 1 << 20


@dataclass(frozen=True)
class Format:
    name: str
    mime: str
    produces: tuple[str, ...] = (SEMANTIC,)
    accepts: tuple[str, ...] = (SEMANTIC,)
    max_input_bytes: int = 10 * MIB
    max_memory_mb: int = 256
    grade: str = "core"
    warnings: tuple[str, ...] = ()

    @property
    def writable(self) -> bool:
        return bool(self.accepts)


FORMATS = {
    f.name: f
    for f in (
        Format("md", "text/markdown;charset=utf-8"),
        Format("html", "text/html;charset=utf-8"),
        Format("txt", "text/plain;charset=utf-8"),
        Format("json", "application/json;charset=utf-8"),
        Format("csv", "text/csv;charset=utf-8", (WORKBOOK, SEMANTIC), (SEMANTIC,)),
        Format("xml", "application/xml;charset=utf-8"),
        Format("png", "image/png", (SEMANTIC,), (), 25 * MIB, 512, "basic", ("PNG_INPUT_ASSET_ONLY", "PNG_OCR_CORE_LIMITED")),
        Format("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", (SEMANTIC,), (SEMANTIC,), 50 * MIB, 768, "enhanced", ("DOCX_COMPLEX_LAYOUT_APPROXIMATED", "DOCX_FLOATING_OBJECTS_DEGRADED")),
        Format("doc", "application/msword", (SEMANTIC,), (), 50 * MIB, 256, "basic", ("DOC_TEXT_EXTRACTED", "DOC_LAYOUT_APPROXIMATED")),
        Format("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", (WORKBOOK, SEMANTIC), (WORKBOOK, SEMANTIC), 30 * MIB, 512, "enhanced", ("XLSX_FORMULA_CACHE_ONLY", "XLSX_MERGED_CELLS_APPROXIMATED")),
        Format("epub", "application/epub+zip", (SEMANTIC,), (SEMANTIC,), 80 * MIB, 768, "enhanced", ("EPUB_CSS_APPROXIMATED", "EPUB_MEDIA_REFERENCED")),
        Format("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", (SLIDES, SEMANTIC), (SEMANTIC,), 80 * MIB, 1024, "enhanced", ("PPTX_LAYOUT_APPROXIMATED", "PPTX_ANIMATION_IGNORED")),
        Format("pdf", "application/pdf", (FIXED, SEMANTIC), (FIXED, SEMANTIC), 50 * MIB, 1024, "enhanced", ("PDF_TEXT_ORDER_APPROXIMATED", "PDF_SCAN_OCR_CORE_LIMITED")),
        Format("ofd", "application/ofd", (SEMANTIC,), (), 80 * MIB, 1024, "basic", ("OFD_L1_CORE_LIMITED", "OFD_RENDER_CORE_LIMITED")),
    )
}

MATRIX = {
    "md": "md html txt json csv xml docx xlsx pdf epub pptx".split(),
    "html": "md html txt json csv xml docx xlsx pdf epub pptx".split(),
    "txt": "md html txt json xml docx pdf epub".split(),
    "json": "md html txt json csv xml docx xlsx pdf epub pptx".split(),
    "xml": "md html txt json xml pdf".split(),
    "csv": "md csv xlsx html txt json xml pdf".split(),
    "xlsx": "md csv xlsx html txt json xml pdf".split(),
    "doc": "md html txt json xml docx pdf".split(),
    "docx": "md html txt json xml docx pdf".split(),
    "epub": "md html txt json xml docx pdf epub".split(),
    "pdf": "md html txt json xml docx pdf".split(),
    "pptx": "md html txt json xml pdf pptx".split(),
    "png": "html txt json pdf".split(),
    "ofd": "md html txt json xml pdf".split(),
}
GENERATED = {("md", "pptx"), ("html", "pptx"), ("json", "pptx"), ("pptx", "pptx")}
RESTRICTED = {("ofd", to) for to in MATRIX["ofd"]}


@dataclass(frozen=True)
class Mapper:
    source: str
    target: str
    loss: str
    executable: bool
    warnings: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.source}To{self.target}"


MAPPERS = (
    Mapper(WORKBOOK, SEMANTIC, "low", True, ("MODEL_STYLE_DROPPED", "MODEL_FORMULA_AS_VALUE")),
    Mapper(SEMANTIC, WORKBOOK, "low", True, ("MODEL_NO_FORMULA_INFO",)),
    Mapper(SLIDES, SEMANTIC, "medium", False, ("MODEL_VISUAL_LAYOUT_DROPPED",)),
    Mapper(SEMANTIC, SLIDES, "medium", False, ("MODEL_LAYOUT_AUTO_GENERATED",)),
    Mapper(FIXED, SEMANTIC, "high", False, ("MODEL_VISUAL_FIDELITY_LOST", "MODEL_TEXT_ORDER_HEURISTIC")),
    Mapper(SEMANTIC, FIXED, "medium", False, ("MODEL_PAGINATION_AUTO_GENERATED",)),
    Mapper(WORKBOOK, FIXED, "medium", False, ("MODEL_SHEET_TO_PAGE_PRINT_ONLY",)),
    Mapper(SLIDES, FIXED, "medium", False, ("MODEL_ANIMATION_DROPPED",)),
)


@dataclass(frozen=True)
class Route:
    temperature: str
    models: tuple[str, ...]
    mappers: tuple[Mapper, ...] = ()
    route_class: str = "recommended"

    @property
    def executed(self) -> tuple[Mapper, ...]:
        """Mappers that run: those before the first that can't."""
        out = []
        for m in self.mappers:
            if not m.executable:
                break
            out.append(m)
        return tuple(out)


def register_mapper(mapper: Mapper, mappers: tuple[Mapper, ...] = MAPPERS) -> tuple[Mapper, ...]:
    """``mappers`` with one more, in place of one between the same models; ``Planner(mappers)`` plans with them."""
    for model in (mapper.source, mapper.target):
        if model not in (SEMANTIC, WORKBOOK, SLIDES, FIXED):
            raise ValueError(f"unknown model {model!r}")
    kept = tuple(m for m in mappers if (m.source, m.target) != (mapper.source, mapper.target))
    return (*kept, mapper)


def normalize(name: str | None) -> str:
    key = (name or "").strip().lower()
    return ALIASES.get(key, key)


def detect(file_name: str) -> str:
    m = re.search(r"\.([^.]+)$", file_name or "")
    return normalize(m[1]) if m else ""


@dataclass
class Planner:
    """Cheapest way from a reader's primary model to one that a writer accepts, in the writer's order of preference."""

    mappers: tuple[Mapper, ...] = field(default=MAPPERS)

    def _shortest(self, start: str, goal: str) -> tuple[Mapper, ...] | None:
        seen, queue = {start}, deque([(start, ())])
        while queue:
            at, path = queue.popleft()
            for m in self.mappers:
                if m.source == at and m.target not in seen:
                    if m.target == goal:
                        return (*path, m)
                    seen.add(m.target)
                    queue.append((m.target, (*path, m)))
        return None

    def between(self, start: str, accepts: tuple[str, ...]) -> Route | None:
        fallback = None
        for goal in accepts:
            if goal == start:
                return Route("hot", (start,))
            path = self._shortest(start, goal)
            if path is None:
                continue
            warm = len(path) == 1 and path[0].loss == "low"
            route = Route("warm" if warm else "cold", (start, *(m.target for m in path)), path)
            if all(m.executable for m in path):
                return route
            fallback = fallback or route
        return fallback

    def route(self, source: str, target: str) -> Route | None:
        """None where a pair isn't allowed or can't be reached."""
        source, target = normalize(source), normalize(target)
        if target not in MATRIX.get(source, ()) or not FORMATS[target].writable:
            return None
        found = self.between(FORMATS[source].produces[0], FORMATS[target].accepts)
        if found is None:
            return None
        kind = "generated" if (source, target) in GENERATED else "restricted" if (source, target) in RESTRICTED else "degraded" if found.mappers else "recommended"
        heat = "cold" if kind == "generated" and found.temperature == "hot" else found.temperature
        return Route(heat, found.models, found.mappers, kind)


def matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, to in MATRIX.items() for t in to], "source string, target string")


def routes(spark: SparkSession) -> DataFrame:
    rows = []
    for s, to in MATRIX.items():
        for t in to:
            r = Planner().route(s, t)
            rows.append((s, t, r.temperature, r.route_class, list(r.models), [m.name for m in r.executed], sorted({w for m in r.executed for w in m.warnings})))
    return spark.createDataFrame(rows, "source string, target string, temperature string, route_class string, models array<string>, executed array<string>, warnings array<string>")


def capabilities(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.mime, f.writable, f.produces[0], f.max_input_bytes, f.max_memory_mb, f.grade, list(f.warnings)) for f in FORMATS.values()]
    return spark.createDataFrame(rows, "format string, mime string, writable boolean, primary_model string, max_input_bytes long, max_memory_mb int, grade string, warnings array<string>")


def mappers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.source, m.target, m.loss, m.executable, list(m.warnings)) for m in MAPPERS], "source string, target string, loss string, executable boolean, warnings array<string>")


def format_of(file_name: Column) -> Column:
    """Format by extension, with aliases."""
    extension = F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension), extension)


def allowed(pairs: DataFrame) -> DataFrame:
    """Rows of (source, target, ...) that the matrix allows."""
    return pairs.join(F.broadcast(matrix(pairs.sparkSession)), ["source", "target"], "left_semi")


def within_budget(docs: DataFrame, fmt: str, content: str = "content") -> DataFrame:
    """``docs`` with error_code INPUT_BUDGET_EXCEEDED where content is larger than its format may be."""
    over = F.octet_length(F.col(content)) > FORMATS[normalize(fmt)].max_input_bytes
    return docs.withColumn("error_code", F.when(over, F.lit("INPUT_BUDGET_EXCEEDED")))
