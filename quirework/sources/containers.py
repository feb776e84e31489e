"""Parsers of binary formats: archives of XML parts, PDF, old word-processor files. Bytes in, blocks out."""

from __future__ import annotations

import base64
import codecs
import functools
import io
import posixpath
import re
import statistics
import struct
import zipfile
import zlib
from collections import Counter
from xml.etree import ElementTree as ET

from .. import model as m
from ..operators import layout
from .parsers import Parsed, ParseError, _html_blocks, _squeezed, html_tree

# Limits of archives and of inflated PDF streams.
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 10_000, 256 << 20, 200
PDF_STREAM, PDF_TOTAL = 64 << 20, 128 << 20


def binary(content) -> bytes:
    """Bytes of a payload that is binary, a data URL or text."""
    if isinstance(content, (bytes, bytearray, memoryview)):
        return bytes(content)
    text = str(content or "")
    if m_ := re.match(r"data:[^,]*;base64,", text):
        return base64.b64decode(text[m_.end() :])
    return text.encode("latin-1", "replace")


def unzip(data: bytes) -> dict[str, bytes]:
    """Entries of an archive within the limits."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > MAX_ENTRIES:
                raise ParseError("ZIP_TOO_MANY_ENTRIES", f"{len(infos)} entries")
            if sum(i.file_size for i in infos) > MAX_BYTES:
                raise ParseError("ZIP_TOO_LARGE", "the entries are too large")
            out = {}
            for i in infos:
                name = i.filename.replace("\\", "/")
                if name.startswith("/") or ".." in name.split("/"):
                    raise ParseError("ZIP_UNSAFE_PATH", name)
                if i.file_size > MAX_RATIO * max(1, i.compress_size):
                    raise ParseError("ZIP_RATIO", name)
                out[name] = z.read(i)
            return out
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        raise ParseError("ZIP_PARSE_ERROR", str(e)) from e


# --- text of unknown encoding -------------------------------------------------------------------------------

_CANDIDATES = ("utf-8", "gb18030", "big5", "shift_jis", "euc-kr", "utf-16-le", "utf-16-be", "windows-1252")
# What counts against and for a decoding, each time it occurs or as a whole.
_AGAINST = {"\ufffd": 100, "[ÃÂ¤åæçèéï¿½]": 8, "[\ue000-\uf8ff]": 40, "[\x00-\x08\x0b\x0c\x0e-\x1f]": 20}
_PRINTABLE, _PRINTABLE_SHARE, _PRINTABLE_WORTH = "[\t\n\r\x20-\x7e]", 0.75, 20
_CLEAN_WORTH = 5
_HAN, _HAN_SHARE, _HAN_WORTH = "[\u3400-\u9fff]", 0.6, 10


def decode_score(text: str, encoding: str = "") -> int:
    """The lower, the more it reads as text that was in ``encoding``."""
    count = lambda pattern: len(re.findall(pattern, text))
    score = sum(weight * count(pattern) for pattern, weight in _AGAINST.items())
    units = len(text) + count("[\U00010000-\U0010ffff]")
    if units and count(_PRINTABLE) > _PRINTABLE_SHARE * units:
        score -= _PRINTABLE_WORTH
    if encoding == "utf-8" and "\ufffd" not in text:
        score -= _CLEAN_WORTH
    if encoding.startswith("utf-16") and units and count(_HAN) > _HAN_SHARE * units:
        score -= _HAN_WORTH
    return score


def decode_bytes(data: bytes, declared: str = "") -> tuple[str, str]:
    """(text, encoding): a byte-order mark, then a declaration, then strict UTF-8, then the candidate that reads best."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name
    head = data[:4096].decode("latin-1")
    found = re.search(r"charset\s*=\s*[\"']?([\w.-]+)", declared) or re.search(r"<\?xml[^>]*encoding=[\"']([\w.-]+)", head) or re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w.-]+)", head, re.I)
    if found:
        try:
            return data.decode(found[1]), codecs.lookup(found[1]).name
        except (LookupError, UnicodeDecodeError):
            pass
    try:
        text = data.decode("utf-8")
        if "\0" not in text:
            return text, "utf-8"
    except UnicodeDecodeError:
        pass
    texts = [(data.decode(name, "replace"), name) for name in _CANDIDATES]
    return min(texts, key=lambda t: decode_score(*t))


# --- OOXML --------------------------------------------------------------------------------------------------


def _xml(parts: dict[str, bytes], name: str) -> ET.Element | None:
    if name not in parts:
        return None
    try:
        return ET.fromstring(parts[name])
    except ET.ParseError as e:
        raise ParseError("XML_PARSE_ERROR", f"{name}: {e}") from e


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element | None, name: str, default: str = "") -> str:
    return next((v for k, v in (e.attrib.items() if e is not None else ()) if k.rpartition("}")[2] == name), default)


def _all(e: ET.Element | None, *names: str) -> list[ET.Element]:
    return [x for x in e.iter() if _local(x) in names] if e is not None else []


def relations(parts: dict[str, bytes], part: str) -> dict[str, str]:
    """Relationship id -> path of its target, or its address."""
    folder, name = posixpath.split(part)
    root = _xml(parts, f"{folder}/_rels/{name}.rels".lstrip("/"))
    out = {}
    for r in _all(root, "Relationship"):
        target = _attr(r, "Target")
        out[_attr(r, "Id")] = target if _attr(r, "TargetMode") == "External" else posixpath.normpath(posixpath.join(folder, target)).lstrip("/")
    return out


def _runs(p: ET.Element) -> str:
    return "".join("\t" if _local(x) == "tab" else "\n" if _local(x) == "br" else x.text or "" for x in p.iter() if _local(x) in ("t", "tab", "br"))


def parse_docx(data: bytes, title: str) -> Parsed:
    parts = unzip(data)
    body = _xml(parts, "word/document.xml")
    if body is None:
        raise ParseError("DOCX_PARSE_ERROR", "no word/document.xml")
    names = {_attr(s, "styleId"): _attr(next(iter(_all(s, "name")), None), "val") for s in _all(_xml(parts, "word/styles.xml"), "style")}
    numbering = _xml(parts, "word/numbering.xml")
    decimal = {_attr(a, "abstractNumId") for a in _all(numbering, "abstractNum") if any(_attr(f, "val") == "decimal" for f in _all(a, "numFmt")[:1])}
    ordered = {_attr(n, "numId") for n in _all(numbering, "num") if any(_attr(a, "val") in decimal for a in _all(n, "abstractNumId"))}
    blocks: list[dict] = []

    def put(block: dict) -> None:
        last = blocks[-1] if blocks else {}
        if block["type"] == last.get("type") == "list" and block["ordered"] == last["ordered"]:
            for k in ("items", "depths", "markers"):
                last[k] = last[k] + block[k]
        else:
            blocks.append(block)

    def para(p: ET.Element) -> None:
        text = _runs(p).strip()
        style = _attr(next(iter(_all(p, "pStyle")), None), "val")
        level = re.search(r"heading\s*([1-6])", f"{names.get(style, '')} {style}", re.I)
        num = next(iter(_all(p, "numPr")), None)
        if text and num is not None:
            depth = int(_attr(next(iter(_all(num, "ilvl")), None), "val", "0") or 0)
            is_ordered = _attr(next(iter(_all(num, "numId")), None), "val") in ordered
            put(m.list_block([text], is_ordered, [depth], ["1." if is_ordered else "-"]))
        elif text:
            put(m.heading(int(level[1]), text) if level else m.quote(text) if "quote" in f"{names.get(style, '')} {style}".lower() else m.code(text) if style.lower() == "code" else m.paragraph(text))

    def story(name: str) -> None:
        for p in _all(_xml(parts, name), "p"):
            if text := _runs(p).strip():
                blocks.append(m.paragraph(text))

    for name in sorted(n for n in parts if re.fullmatch(r"word/header\d*\.xml", n)):
        story(name)
    for e in body.find("{*}body") if body.find("{*}body") is not None else ():
        if _local(e) == "p":
            para(e)
        elif _local(e) == "tbl":
            rows = [["\n".join(filter(None, (_runs(p).strip() for p in _all(c, "p")))) for c in _all(r, "tc")] for r in _all(e, "tr")]
            if rows:
                blocks.append(m.table(rows[0], rows[1:]))
    for part, tag in (("word/footnotes.xml", "footnote"), ("word/comments.xml", "comment")):
        known = {_attr(n, "id"): " ".join(filter(None, (_runs(p).strip() for p in _all(n, "p")))) for n in _all(_xml(parts, part), tag)}
        for ref in _all(body, f"{tag}Reference"):
            if text := known.get(_attr(ref, "id")):
                blocks.append(m.quote(f"[{_attr(ref, 'id')}] {text}"))
    for name in sorted(n for n in parts if re.fullmatch(r"word/footer\d*\.xml", n)):
        story(name)
    return title, blocks, [m.warning("lossy", "DOCX_COMPLEX_LAYOUT_APPROXIMATED", "Layout is approximated.")] if _all(body, "drawing", "pict") else []


# --- workbook -----------------------------------------------------------------------------------------------

#: Numbers of built-in formats with a day or a year.
_DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 32), 34, 35, 36, *range(50, 59)}


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref.upper())[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def serial_to_iso(value: str) -> str:
    from datetime import date, timedelta

    return (date(1899, 12, 30) + timedelta(days=int(float(value)))).isoformat()


def shows_date(code: str) -> bool:
    return bool(re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def workbook(data: bytes) -> list[dict]:
    """Sheets with their cells: (row, column, reference, shown value, formula)."""
    parts = unzip(data)
    book = _xml(parts, "xl/workbook.xml")
    if book is None:
        raise ParseError("XLSX_PARSE_ERROR", "no xl/workbook.xml")
    shared = ["".join(t.text or "" for t in _all(si, "t")) for si in _all(_xml(parts, "xl/sharedStrings.xml"), "si")]
    styles = _xml(parts, "xl/styles.xml")
    custom = {_attr(f, "numFmtId"): _attr(f, "formatCode") for f in _all(styles, "numFmt")}
    xfs = [x for holder in _all(styles, "cellXfs") for x in holder]
    dated = [int(_attr(x, "numFmtId", "0")) in _DATE_FORMATS or shows_date(custom.get(_attr(x, "numFmtId"), "")) for x in xfs]
    paths = relations(parts, "xl/workbook.xml")
    sheets = []
    for s in _all(book, "sheet"):
        root = _xml(parts, paths.get(_attr(s, "id"), ""))
        cells = []
        for c in _all(root, "c"):
            ref, kind = _attr(c, "r"), _attr(c, "t")
            value = next((x.text or "" for x in c if _local(x) == "v"), "")
            formula = next((x.text or "" for x in c if _local(x) == "f"), None)
            style = int(_attr(c, "s", "0") or 0)
            if kind == "s":
                shown = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
            elif kind == "inlineStr":
                shown = "".join(t.text or "" for t in _all(c, "t"))
            elif kind == "b":
                shown = "TRUE" if value == "1" else "FALSE"
            elif value and not kind and style < len(dated) and dated[style]:
                shown = serial_to_iso(value)
            else:
                shown = value
            cells.append({"row": int(re.search(r"\d+", ref)[0]) - 1, "col": column_number(ref), "ref": ref, "value": shown, "formula": formula})
        sheets.append({"name": _attr(s, "name"), "cells": cells, "merges": [_attr(x, "ref") for x in _all(root, "mergeCell")]})
    return sheets


def grid(cells: list[dict]) -> list[list[str]]:
    rows: dict[int, dict[int, str]] = {}
    for c in cells:
        shown = c["value"] if c["formula"] is None else f"={c['formula']} => {c['value']}" if c["value"] else f"={c['formula']}"
        rows.setdefault(c["row"], {})[c["col"]] = shown
    width = max((max(r) for r in rows.values()), default=-1) + 1
    return [[rows[r].get(k, "") for k in range(width)] for r in sorted(rows)]


def parse_xlsx(data: bytes, title: str) -> Parsed:
    blocks, notes = [], []
    for sheet in workbook(data):
        rows = grid(sheet["cells"])
        blocks.append(m.heading(2, sheet["name"]))
        if rows:
            blocks.append(m.table(rows[0], rows[1:]))
        if sheet["merges"]:
            notes.append(m.warning("lossy", "XLSX_MERGED_CELLS_APPROXIMATED", f"Merged cells of {sheet['name']} keep the first value."))
        if any(c["formula"] is not None for c in sheet["cells"]):
            notes.append(m.warning("info", "XLSX_FORMULA_CACHE_ONLY", f"Formulas of {sheet['name']} show their stored values."))
    return title, blocks, notes


def parse_epub(data: bytes, title: str) -> Parsed:
    parts = unzip(data)
    opf = _attr(next(iter(_all(_xml(parts, "META-INF/container.xml"), "rootfile")), None), "full-path")
    package = _xml(parts, opf)
    if package is None:
        raise ParseError("EPUB_PARSE_ERROR", "no package document")
    items = {_attr(i, "id"): _attr(i, "href") for i in _all(package, "item")}
    blocks, notes = [], []
    for ref in _all(package, "itemref"):
        href = items.get(_attr(ref, "idref"))
        part = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href)) if href else ""
        if part not in parts:
            continue
        root = html_tree(parts[part].decode("utf-8", "replace"))
        body = (root.find({"body"}) or [root])[0]
        got = _html_blocks(body.children)
        if not got and (bare := _squeezed(body.text())):
            got = [m.paragraph(bare)]
            notes.append(m.warning("lossy", "EPUB_MARKUP_SIMPLIFIED", f"{part} became one paragraph."))
        blocks += got
    named = next((e.text for e in _all(package, "title") if e.text), None)
    return (named or title).strip(), blocks, notes


def natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


def slides(data: bytes) -> list[dict]:
    parts = unzip(data)
    out = []
    for name in sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=natural):
        root, links = _xml(parts, name), relations(parts, name)
        in_tables = {id(p) for t in _all(root, "tbl") for p in _all(t, "p")}
        texts = [t for p in _all(root, "p") if id(p) not in in_tables and (t := _runs(p).strip())]
        tables = [[[" ".join(filter(None, (_runs(p).strip() for p in _all(c, "p")))) for c in _all(r, "tc")] for r in _all(t, "tr")] for t in _all(root, "tbl")]
        pictures = [links.get(_attr(b, "embed"), "") for b in _all(root, "blip")]
        notes = [t for target in links.values() if "notesSlide" in target for p in _all(_xml(parts, target), "p") if (t := _runs(p).strip())]
        out.append({"title": texts[0] if texts else "", "texts": texts[1:], "tables": tables, "pictures": pictures, "notes": " ".join(notes)})
    if not out:
        raise ParseError("PPTX_PARSE_ERROR", "no slides")
    return out


def parse_pptx(data: bytes, title: str) -> Parsed:
    blocks = []
    for n, s in enumerate(slides(data), 1):
        blocks.append(m.heading(2, s["title"] or f"Slide {n}"))
        blocks += [m.paragraph(t) for t in s["texts"]]
        blocks += [m.asset(p.rpartition("/")[2], p.rpartition("/")[2]) for p in s["pictures"] if p]
        blocks += [m.table(t[0], t[1:]) for t in s["tables"] if t]
        if s["notes"]:
            blocks.append(m.paragraph(f"Notes: {s['notes']}"))
    return title, blocks, [m.warning("lossy", "PPTX_LAYOUT_APPROXIMATED", "Slide layout is approximated.")]


# --- PDF ----------------------------------------------------------------------------------------------------

_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_literal(raw: bytes) -> bytes:
    """Bytes of a string between parentheses."""

    def one(x: re.Match) -> bytes:
        s = x[1]
        if s[:1] in b"01234567":
            return bytes([int(s, 8) & 255])
        return b"" if s in (b"\n", b"\r", b"\r\n") else _ESCAPED.get(s, s)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|[\s\S])", one, raw)


class CMap(dict[bytes, str]):
    """Codes of a font and their texts."""

    @functools.cached_property
    def widths(self) -> list[int]:
        """Bytes of a code, the most first."""
        return sorted({len(k) for k in self}, reverse=True)


def pdf_text(data: bytes, cmap: CMap | None = None) -> str:
    if cmap:
        out, at, widths = [], 0, cmap.widths
        if len(widths) == 1:
            return "".join([cmap.get(data[k : k + widths[0]], "") for k in range(0, len(data), widths[0])])
        while at < len(data):
            for w in widths:
                if (got := cmap.get(data[at : at + w])) is not None:
                    out.append(got)
                    at += w
                    break
            else:
                at += widths[-1]
        return "".join(out)
    if data.startswith(codecs.BOM_UTF16_BE):
        return data[2:].decode("utf-16-be", "replace")
    if len(data) >= 2 and len(data) % 2 == 0 and data[::2].count(0) > len(data) // 3:
        return data.decode("utf-16-be", "replace")
    return data.decode("latin-1")


@functools.lru_cache(maxsize=2)
def cmap_of(texts: tuple[str, ...]) -> CMap:
    """Maps of a file's fonts in one. Files of one writer often have the same ones, of up to 65,536 codes, so the last are kept."""
    out = CMap()
    for text in texts:
        out |= read_cmap(text)
    return out


def read_cmap(text: str) -> CMap:
    out = CMap()
    uni = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    for body in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        out |= {bytes.fromhex(a): uni(b) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body)}
    for body in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for a, b, c in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", body):
            low, high, first = int(a, 16), int(b, 16), int(c, 16)
            for k in range(min(high - low, 65_535) + 1):
                out[(low + k).to_bytes(len(a) // 2, "big")] = (first + k).to_bytes(max(2, len(c) // 2), "big").decode("utf-16-be", "replace")
    return out


def pdf_streams(data: bytes) -> list[bytes]:
    """Streams, inflated within the limits."""
    out, total = [], 0
    for found in re.finditer(rb"<<((?:[^<>]|<[^<]|>[^>]|<<[^<>]*>>)*)>>\s*stream\r?\n", data):
        end = data.find(b"endstream", found.end())
        body = data[found.end() : end if end >= 0 else len(data)]
        if b"FlateDecode" in found[1]:
            try:
                body = zlib.decompressobj().decompress(body, PDF_STREAM)
            except zlib.error:
                continue
        total += len(body)
        if total > PDF_TOTAL:
            break
        out.append(body)
    return out


_NUMBER = re.compile(rb"-?\d*\.?\d+")
_TOKEN = re.compile(rb"\((?:\\[\s\S]|[^\\()]|\((?:\\[\s\S]|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|-?\d*\.?\d+|[A-Za-z'\"*]+")


def pdf_runs(stream: bytes, cmap: CMap | None) -> list[tuple[str, float, float, float]]:
    """(text, x, y, font size) of a content stream."""
    out, stack, array = [], [], None
    x = y = line_x = line_y = 0.0
    size, leading = 12.0, 0.0

    def value(token: bytes) -> bytes:
        if token[:1] == b"(":
            return pdf_literal(token[1:-1])
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def number(k: int) -> float:
        try:
            return float(stack[k])
        except (IndexError, ValueError):
            return 0.0

    for found in _TOKEN.finditer(stream):
        t = found[0]
        if t == b"[":
            array = []
        elif t == b"]":
            stack.append(array or [])
            array = None
        elif array is not None:
            array.append(t)
        elif t[:1] in b"(</" or _NUMBER.fullmatch(t):
            stack.append(t)
        else:
            if t == b"BT":
                x = y = line_x = line_y = 0.0
            elif t == b"Tf":
                size = number(-1) or size
            elif t == b"TL":
                leading = number(-1)
            elif t in (b"Td", b"TD"):
                line_x, line_y = line_x + number(-2), line_y + number(-1)
                leading = -number(-1) if t == b"TD" else leading
                x, y = line_x, line_y
            elif t == b"Tm" and len(stack) >= 6:
                line_x, line_y = number(-2), number(-1)
                size = abs(number(-3)) * (1 if abs(number(-3)) > 4 else size) or size
                x, y = line_x, line_y
            elif t in (b"T*", b"'", b'"'):
                line_y -= leading or size * 1.2
                x, y = line_x, line_y
            if t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes) and stack[-1][:1] in b"(<":
                out.append((pdf_text(value(stack[-1]), cmap), x, y, size))
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                words = ""
                for part in stack[-1]:
                    if part[:1] in b"(<":
                        words += pdf_text(value(part), cmap)
                    elif _NUMBER.fullmatch(part) and float(part) <= -180:
                        words += " "
                out.append((words, x, y, size))
            stack = []
    return [r for r in out if r[0].strip()]


def credible(text: str) -> bool:
    n = len(text)
    if not n or n > 2000 or "\ufffd" in text:
        return False
    control = sum(ord(c) < 32 and c not in "\t\n\r" for c in text)
    return control <= 0.02 * n and sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.85 * n and any(c.isalnum() for c in text)


def glyph_noise(texts: list[str]) -> bool:
    """Whether strings look like glyph numbers of fonts without a map: the rule of ``operators.layout``."""
    texts = [t for t in map(str.strip, texts) if t]
    if len(texts) < layout.NOISE_STRINGS:
        return False
    share = lambda ok: sum(map(ok, texts)) / len(texts)
    solid = share(lambda t: re.fullmatch(r"[\x21-\x7e]+", t) is not None)
    chars = Counter("".join(texts))
    short = share(lambda t: len(t) <= layout.SHORT) >= layout.SHORT_SHARE
    no_word = solid >= layout.SOLID_SHARE and max(map(len, texts)) <= layout.LONGEST
    return short or no_word or solid >= layout.ONLY_SHARE and max(chars.values()) >= layout.TOP_SHARE * chars.total()


def layout_lines(runs: list[tuple[str, float, float, float]]) -> list[tuple[str, float, float]]:
    """(text, y, height) of lines: from the top down, runs within half their own height of a line's first one are in it."""
    lines: list[list] = []
    for run in sorted(runs, key=lambda r: (-r[2], r[1])):
        if lines and abs(lines[-1][0][2] - run[2]) < layout.NEAR * (run[3] or layout.NO_HEIGHT):
            lines[-1].append(run)
        else:
            lines.append([run])
    return [(" ".join(r[0].strip() for r in sorted(line, key=lambda r: r[1])), line[0][2], max(r[3] for r in line)) for line in lines]


_BULLET = re.compile(r"(?:[-*•·]|(\d+)[.)])\s+(.+)")


def structure(lines: list[tuple[str, float, float]]) -> list[dict]:
    """Headings by size, lists by their marks, paragraphs by the gaps between lines."""
    if not lines:
        return []
    weight: Counter[float] = Counter()
    for text, _, h in lines:
        weight[round(h * 2) / 2] += len(text)
    body = max(weight, key=weight.get)
    blocks: list[dict] = []
    above = None
    for text, y, h in lines:
        gap = above is not None and above[1] - y > 1.6 * above[2]
        bullet = _BULLET.match(text)
        last = blocks[-1] if blocks else {}
        if h > 1.15 * body and len(text) <= 200:
            ratio = h / body
            blocks.append(m.heading(1 if ratio >= 1.8 else 2 if ratio >= 1.4 else 3 if ratio >= 1.2 else 4, text))
        elif bullet:
            ordered = bool(bullet[1])
            if last.get("type") == "list" and last["ordered"] == ordered and not gap:
                last["items"].append(bullet[2])
                last["depths"].append(0)
                last["markers"].append(f"{bullet[1]}." if ordered else "-")
            else:
                blocks.append(m.list_block([bullet[2]], ordered, [0], [f"{bullet[1]}." if ordered else "-"]))
        elif last.get("type") == "paragraph" and not gap and above[2] <= 1.15 * body:
            last["text"] += " " + text
        else:
            blocks.append(m.paragraph(text))
        above = (text, y, h)
    return blocks


def parse_pdf(data: bytes, title: str) -> Parsed:
    if not data.lstrip()[:5].startswith(b"%PDF"):
        raise ParseError("PDF_PARSE_ERROR", "no PDF header")
    if b"/Encrypt" in data:
        return title, [], [m.warning("unsupported", "PDF_ENCRYPTED", "The file is encrypted; no text is read.")]
    streams = pdf_streams(data)
    cmap = cmap_of(tuple(s.decode("latin-1") for s in streams if b"begincmap" in s))
    lines = []
    for s in streams:
        if b"BT" in s:
            runs = [r for r in pdf_runs(s, cmap or None) if credible(r[0])]
            lines.append(layout_lines(runs))
    texts = [t for page in lines for t, _, _ in page]
    if glyph_noise(texts):
        return title, [], [m.warning("lossy", "PDF_FONT_UNMAPPED", "The fonts give glyph numbers only; no text is read.")]
    blocks = [b for page in lines for b in structure(page)]
    notes = [] if blocks else [m.warning("lossy", "PDF_NO_TEXT", "No text is in the file; it may be a scan.")]
    return title, blocks, notes


# --- old word processor, fixed-layout container ---------------------------------------------------------------


def runs_of(data: bytes) -> list[str]:
    """Candidate texts: the whole as it decodes, ASCII runs, and UTF-16 runs of either order at either alignment, apart and merged."""
    groups = [[decode_bytes(data)[0]], [r.decode() for r in re.findall(rb"[\x20-\x7e\t\r\n]{12,}", data)]]
    for name in ("utf-16-le", "utf-16-be"):
        for shift in (0, 1):
            part = data[shift : len(data) - (len(data) - shift) % 2]
            text = part.decode(name, "replace")
            groups.append(re.findall(r"[\t\r\n\x20-\x7e\u00a0-\u024f\u3000-\u30ff\u4e00-\u9fff\uff00-\uffef]{8,}", text))
    out = [x for g in groups for x in (*g, "\n".join(g)) if x.strip()]
    return list(dict.fromkeys(re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x.replace("\r", "\n"))).strip() for x in out))


def run_score(text: str) -> float:
    good = len(re.findall(r"[A-Za-z0-9\u00c0-\u024f\u4e00-\u9fff]", text))
    return 2 * good + text.count(" ") - 6 * len(re.findall(r"[^\w\s.,;:!?'\"()\-\u3000-\u303f\uff00-\uffef]", text)) - 100 * text.count("\ufffd")


def parse_doc(data: bytes, title: str) -> Parsed:
    best = sorted(runs_of(data), key=lambda t: (-run_score(t), -len(t)))
    note = m.warning("lossy", "DOC_TEXT_EXTRACTED", "Text is taken from the binary file as far as it reads; layout is lost.")
    if not best or run_score(best[0]) < -500:
        return title, [], [note]
    return title, [m.paragraph(" ".join(p.split())) for p in re.split(r"\n{2,}", best[0]) if p.strip()], [note]


def parse_ofd(data: bytes, title: str) -> Parsed:
    parts = unzip(data)
    root = _xml(parts, "OFD.xml")
    if root is None:
        raise ParseError("OFD_PARSE_ERROR", "no OFD.xml")
    named = next((e.text for e in _all(root, "Title") if e.text), None)
    docs = len(_all(root, "DocBody"))
    notes = [m.warning("unsupported", c, "Pages of this format are not read.") for c in ("OFD_L1_CORE_LIMITED", "OFD_RENDER_CORE_LIMITED")]
    return named or title, [m.paragraph(f"OFD container with {len(parts)} entries."), m.paragraph(f"Documents: {docs}.")], notes


BINARY_PARSERS = {"docx": parse_docx, "xlsx": parse_xlsx, "epub": parse_epub, "pptx": parse_pptx, "pdf": parse_pdf, "doc": parse_doc, "ofd": parse_ofd}


def scanned(page_texts: list[str]) -> bool:
    """Whether pages hold so little text that they are images: under 300 characters a page on average."""
    return not page_texts or statistics.fmean(len(re.sub(r"\s", "", t)) for t in page_texts) < 300


def png_size(data: bytes) -> tuple[int, int]:
    return struct.unpack(">II", data[16:24])
