"""Parsers of text formats: content in, (title, blocks, warnings) out. Plain Python over one document."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from html.parser import HTMLParser
from xml.parsers import expat

from .. import model as m
from ..functions import inline

Parsed = tuple[str, list[dict], list[dict]]


class ParseError(ValueError):
    def __init__(self, code: str, message: str, category: str = "parse"):
        super().__init__(message)
        self.code, self.category = code, category


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def parse_text(text: str, title: str) -> Parsed:
    parts = re.split(r"\n{2,}", text.replace("\r\n", "\n"))
    return title, [m.paragraph(p.strip().replace("\n", " ")) for p in parts if p.strip()], []


# --- Markdown -----------------------------------------------------------------------------------------------

_FENCE = re.compile(r"(`{3,})([^`]*)$")
_FOOTNOTE = re.compile(r"\[\^([^\]]+)\]:\s+(.+)$")
_RULE_CELL = r"\s*:?-{3,}:?\s*"
_TABLE_RULE = re.compile(rf"\s*\|?{_RULE_CELL}(?:\|{_RULE_CELL})+\|?\s*$")
_HEADING = re.compile(r"(#{1,6})\s+(.+)$")
_IMAGE = re.compile(r"!\[((?:\\.|[^\\\]])*)\]\(((?:\\.|[^\\)])+)\)$")
_ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])\s+(.+)$")
_UNESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def split_row(line: str) -> list[str]:
    """Cells of a table row; an escaped pipe is part of its cell."""
    bare = line.strip().removeprefix("|")
    cells = re.split(r"(?<!\\)\|", bare)
    if len(cells) > 1 and not cells[-1].strip() and bare.endswith("|"):
        cells.pop()
    return [c.strip().replace("\\|", "|") for c in cells]


def _alignment(cell: str) -> str:
    return {(True, True): "center", (False, True): "right", (True, False): "left"}.get((cell.startswith(":"), cell.endswith(":")), "")


class _Markdown:
    """Each kind of block takes the lines that are its own, from the cursor on; what none takes is a paragraph."""

    def __init__(self, text: str):
        self.lines, self.at = lines_of(text), 0
        self.blocks: list[dict] = []
        self.warnings: list[dict] = []
        self.words: list[str] = []

    def parse(self) -> list[dict]:
        takers = (self._fenced, self._footnote, self._table, self._heading, self._image, self._list, self._quote)
        while self.at < len(self.lines):
            if not self.lines[self.at].strip():
                self._end_paragraph()
                self.at += 1
            elif not any(take() for take in takers):
                self.words.append(self.lines[self.at].strip())
                self.at += 1
        self._end_paragraph()
        return self.blocks

    def _end_paragraph(self) -> None:
        if self.words:
            self.blocks.append(m.paragraph(" ".join(self.words)))
            self.words = []

    def _put(self, block: dict, lines: int = 1) -> bool:
        self._end_paragraph()
        self.blocks.append(block)
        self.at += lines
        return True

    def _fenced(self) -> bool:
        opened = _FENCE.match(self.lines[self.at])
        if not opened:
            return False
        closing = re.compile(rf"`{{{len(opened[1])},}}\s*$")
        end = next((i for i in range(self.at + 1, len(self.lines)) if closing.match(self.lines[i])), len(self.lines))
        language = (opened[2].split() or [""])[0]
        return self._put(m.code("\n".join(self.lines[self.at + 1 : end]), language), end + 1 - self.at)

    def _footnote(self) -> bool:
        found = _FOOTNOTE.match(self.lines[self.at])
        if not found:
            return False
        note = m.warning("info", "MARKDOWN_FOOTNOTE", "The footnote is kept as a quote and a reference in the text.")
        self.warnings.append(note)
        return self._put(m.quote(f"[{found[1]}] {found[2]}") | {"warnings": [note]})

    def _table(self) -> bool:
        rule = self.lines[self.at + 1] if self.at + 1 < len(self.lines) else ""
        if "|" not in self.lines[self.at] or not _TABLE_RULE.match(rule):
            return False
        end = self.at + 2
        while end < len(self.lines) and "|" in self.lines[end]:
            end += 1
        body = [split_row(x) for x in self.lines[self.at + 2 : end]]
        return self._put(m.table(split_row(self.lines[self.at]), body, [_alignment(c) for c in split_row(rule)]), end - self.at)

    def _heading(self) -> bool:
        found = _HEADING.match(self.lines[self.at])
        return bool(found) and self._put(m.heading(len(found[1]), found[2]))

    def _image(self) -> bool:
        found = _IMAGE.match(self.lines[self.at])
        return bool(found) and self._put(m.image(_UNESCAPE.sub(r"\1", found[2]), _UNESCAPE.sub(r"\1", found[1])))

    def _list(self) -> bool:
        found = []
        while self.at + len(found) < len(self.lines) and (item := _ITEM.match(self.lines[self.at + len(found)])):
            found.append(item)
        if not found:
            return False
        depths = [len(i[1].replace("\t", "    ")) // 2 for i in found]
        return self._put(m.list_block([i[3] for i in found], found[0][2][0].isdigit(), depths, [i[2] for i in found]), len(found))

    def _quote(self) -> bool:
        end = self.at
        while end < len(self.lines) and self.lines[end].startswith(">"):
            end += 1
        if end == self.at:
            return False
        parts = [re.sub(r"^>\s?", "", x) for x in self.lines[self.at : end]]
        merged = " ".join(p for p in parts if p.strip())
        if merged:
            return self._put(m.quote(merged), end - self.at)
        self._end_paragraph()
        self.at = end
        return True


def parse_markdown(text: str, title: str) -> Parsed:
    parser = _Markdown(text)
    return title, parser.parse(), parser.warnings


# --- HTML ---------------------------------------------------------------------------------------------------

_VOID = {"img", "br", "hr", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_HIDDEN = ("script", "style", "noscript")
_TEXTUAL = {"p", "li", "thead", "tbody", "tfoot", "tr", "th", "td", "figcaption", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
_BOXES = {"div", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "form", "body", "html", "address", "details", "summary", "dl", "dt", "dd", "fieldset"}


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def text(self, skip: tuple[str, ...] = ()) -> str:
        out = []
        for c in self.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append("\n")
            elif c.tag not in skip:
                out.append(c.text(skip))
        return "".join(out)

    def find(self, tags: set[str], inside: tuple[str, ...] = ()) -> list[Node]:
        """Descendants with one of the tags, in order, not looking into those found or into tags of ``inside``."""
        out = []
        for c in self.children:
            if not isinstance(c, str):
                out += [c] if c.tag in tags else [] if c.tag in inside else c.find(tags, inside)
        return out


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def _squeezed(text: str) -> str:
    return " ".join(text.split())


#: Elements that are kept inside a text, and what they are there.
_INLINE = {"strong": "strong", "b": "strong", "em": "em", "i": "em", "del": "del", "s": "del", "strike": "del"}


def _tokens(nodes: list, skip: tuple[str, ...] = ()) -> tuple[inline.Token, ...]:
    out: list[inline.Token] = []
    for node in nodes:
        if isinstance(node, str):
            out.append(inline.Token("text", re.sub(r"\s+", " ", node)))
        elif node.tag == "br":
            out.append(inline.Token("text", " "))
        elif node.tag == "code" and node.text().strip():
            out.append(inline.Token("code", _squeezed(node.text())))
        elif node.tag == "a" and node.attrs.get("href", "").strip() and node.text().strip():
            out.append(inline.Token("link", node.attrs["href"].strip(), _tokens(node.children, skip), node.attrs.get("title", "").replace('"', "'")))
        elif node.tag in _INLINE and node.text().strip():
            out.append(inline.Token(_INLINE[node.tag], "", _tokens(node.children, skip)))
        elif node.tag not in skip:
            out += _tokens(node.children, skip)
    return tuple(out)


def _marked(nodes: list, text: str, skip: tuple[str, ...] = ()) -> str | None:
    """Inline Markdown of nodes whose plain text is ``text``, if it says more."""
    source = re.sub(" {2,}", " ", inline.markdown(_tokens(nodes, skip))).strip()
    return source if source != text else None


def _with_marks(block: dict, nodes: list) -> dict:
    marked = _marked(nodes, block["text"])
    return block | {"marked": marked} if marked else block


def _list_items(node: Node, depth: int, ordered: bool) -> list[tuple[str, int, str, str | None]]:
    out = []
    for li in node.find({"li"}, ("ul", "ol")):
        text = _squeezed(li.text(("ul", "ol")))
        out.append((text, depth, f"{len(out) + 1}." if ordered else "-", _marked(li.children, text, ("ul", "ol"))))
        for nested in li.find({"ul", "ol"}):
            out += _list_items(nested, depth + 1, nested.tag == "ol")
    return out


def _html_blocks(nodes: list) -> list[dict]:
    out: list[dict] = []
    prose: list[str | Node] = []

    def flush() -> None:
        if text := _squeezed("".join(x if isinstance(x, str) else x.text() for x in prose)):
            out.append(_with_marks(m.paragraph(text), prose))
        prose.clear()

    for node in nodes:
        if isinstance(node, str):
            prose.append(node)
            continue
        tag = node.tag
        if tag == "br":
            prose.append("\n")
        elif tag == "img":
            flush()
            if node.attrs.get("src"):
                out.append(m.image(node.attrs["src"], node.attrs.get("alt", ""), node.attrs.get("title", "")))
        elif tag == "hr":
            flush()
            out.append(m.paragraph("---"))
        elif tag == "pre":
            flush()
            codes = node.find({"code"})
            if (body := (codes[0] if codes else node).text()).strip():
                out.append(m.code(body.strip("\n")))
        elif tag in ("ul", "ol"):
            flush()
            if items := _list_items(node, 0, tag == "ol"):
                texts, depths, markers, marked = map(list, zip(*items, strict=True))
                block = m.list_block(texts, tag == "ol", depths, markers)
                out.append(block | {"marked_items": [x or inline.markdown((inline.Token("text", t),)) for x, t in zip(marked, texts, strict=True)]} if any(marked) else block)
        elif tag == "table":
            flush()
            rows = [r.find({"th", "td"}) for r in node.find({"tr"}, ("table",))]
            rows = [r for r in rows if r]
            if rows:
                cells = [[_squeezed(c.text()) for c in r] for r in rows]
                headed = any(c.tag == "th" for c in rows[0])
                # Fixed value: the prefix of made-up headers.
                headers = cells[0] if headed else [f"列{i + 1}" for i in range(len(cells[0]))]
                out.append(m.table(headers, cells[1:] if headed else cells))
        elif tag in _TEXTUAL:
            flush()
            if text := _squeezed(node.text()):
                block = m.heading(int(tag[1]), text) if re.fullmatch("h[1-6]", tag) else m.quote(text) if tag == "blockquote" else m.paragraph(text)
                out.append(_with_marks(block, node.children))
        elif tag in _BOXES:
            flush()
            out += _html_blocks(node.children)
        elif tag not in _VOID:
            prose.append(node)
    flush()
    return out


def html_tree(text: str) -> Node:
    bare = re.sub(r"<!--[\s\S]*?-->", "", text)
    for tag in _HIDDEN:
        bare = re.sub(rf"(?i)<{tag}\b[\s\S]*?(?:</{tag}\s*>|$)", "", bare)
    tree = _Tree()
    tree.feed(bare)
    tree.close()
    return tree.stack[0]


def parse_html(text: str, title: str) -> Parsed:
    root = html_tree(text)
    body = (root.find({"body"}) or [root])[0]
    heads = root.find({"title"})
    blocks = _html_blocks([c for c in body.children if isinstance(c, str) or c.tag not in ("head", "title")])
    if not blocks and (bare := _squeezed(body.text(("head", "title")))):
        blocks = [m.paragraph(bare)]
    return (_squeezed(heads[0].text()) if heads else "") or title, blocks, []


# --- CSV ----------------------------------------------------------------------------------------------------

_CSV = re.compile(r'"(?:[^"]|"")*(?:"|$)|[^",\n]+|[,\n]')


def csv_rows(text: str) -> tuple[list[list[str]], bool]:
    """Rows as ragged as they are, and whether a quoted cell held a line end; quotes may open anywhere in a cell."""
    body = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    rows, row, cell, fresh, inner = [], [], "", True, False
    for token in _CSV.finditer(body):
        t = token[0]
        if t == ",":
            row.append(cell)
            cell, fresh = "", False
        elif t == "\n":
            rows.append([*row, cell])
            row, cell, fresh = [], "", True
        elif t[0] == '"':
            quoted = t[1:-1] if len(t) > 1 and t.endswith('"') else t[1:]
            inner |= "\n" in quoted
            cell, fresh = cell + quoted.replace('""', '"'), False
        else:
            cell, fresh = cell + t, False
    if not fresh:
        rows.append([*row, cell])
    return [r for r in rows if r != [""]], inner


def parse_csv(text: str, title: str) -> Parsed:
    rows, inner = csv_rows(text)
    notes = [m.warning("info", "CSV_MULTILINE_CELL", "Line ends inside quoted cells are kept as LF.")] if inner else []
    return title, [m.table(rows[0], rows[1:])] if rows else [], notes


# --- JSON ---------------------------------------------------------------------------------------------------


def json_cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def parse_json(text: str, title: str) -> Parsed:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise ParseError("JSON_PARSE_ERROR", f"not a JSON document: {e}") from e
    if isinstance(data, dict) and data.get("schemaVersion") and isinstance(data.get("blocks"), list):
        return str(data.get("title") or title), [own_block(b, i) for i, b in enumerate(data["blocks"])], []
    if isinstance(data, list) and data and all(isinstance(x, dict) for x in data):
        keys = list(dict.fromkeys(k for row in data for k in row))
        return title, [m.table(keys, [[json_cell(row.get(k)) for k in keys] for row in data])], []
    if isinstance(data, list) and data and not any(isinstance(x, (dict, list)) for x in data):
        return title, [m.table(["value"], [[json_cell(x)] for x in data])], []
    return title, [m.heading(1, "JSON Document"), m.code(json.dumps(data, ensure_ascii=False, indent=2), "json")], []


def own_block(block, place: int) -> dict:
    """A block of a stored document, checked."""
    wrong = None
    if not isinstance(block, dict) or block.get("type") not in m.BLOCK_TYPES:
        wrong = "type"
    elif block["type"] == "list" and not isinstance(block.get("items"), list):
        wrong = "items"
    elif block["type"] == "table" and not (isinstance(block.get("headers"), list) and isinstance(block.get("rows"), list)):
        wrong = "headers or rows"
    elif block["type"] == "code" and not isinstance(block.get("code"), str):
        wrong = "code"
    if wrong:
        raise ParseError("DOCUMENT_MODEL_SCHEMA_ERROR", f"blocks[{place}] has no good {wrong}", "validate")
    names = {f.name for f in m.BLOCK}
    out = {k: v for k, v in block.items() if k in names and k != "warnings"}
    if "assetId" in block:
        out["asset_id"] = block["assetId"]
    if meta := block.get("itemMeta"):
        out["depths"], out["markers"] = [int(x.get("depth") or 0) for x in meta], [str(x.get("marker") or "-") for x in meta]
    return out


# --- XML ----------------------------------------------------------------------------------------------------


def xml_facts(text: str) -> tuple[list[str], dict[str, dict[str, str]], dict[str, str]]:
    """Texts of leaves in order, attributes by tag (the last one wins), and namespaces."""
    parser = expat.ParserCreate()
    texts: list[str] = []
    attributes: dict[str, dict[str, str]] = {}
    spaces: dict[str, str] = {}
    held: list[str] = []

    def flush() -> None:
        if got := "".join(held).strip():
            texts.append(got)
        held.clear()

    def start(tag: str, attrs: dict[str, str]) -> None:
        flush()
        for k, v in attrs.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                spaces[k.partition(":")[2]] = v
            else:
                attributes.setdefault(tag, {})[k] = v

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: flush(), held.append
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise ParseError("XML_PARSE_ERROR", f"not well formed: {e}") from e
    return texts, attributes, spaces


def parse_xml(text: str, title: str) -> Parsed:
    body = re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", text)
    texts, _, _ = xml_facts(body.strip())
    return title, [*map(m.paragraph, texts), m.raw("xml", text)], []


_PNG_URL = re.compile(r"data:image/png;base64,[A-Za-z0-9+/=\s]*$")


def parse_png(text: str, title: str) -> Parsed:
    if not _PNG_URL.match(text.strip()):
        raise ParseError("PNG_PARSE_ERROR", "not a PNG data URL")
    note = m.warning("lossy", "OCR_UNAVAILABLE", "The image is kept as an asset; its text is not read, as no engine is there.")
    return title, [m.heading(1, title), m.asset("asset-1", title, title)], [note]


def unescape(text: str) -> str:
    return html.unescape(text)


TEXT_PARSERS: dict[str, Callable[[str, str], Parsed]] = {
    "txt": parse_text,
    "md": parse_markdown,
    "html": parse_html,
    "csv": parse_csv,
    "json": parse_json,
    "xml": parse_xml,
    "png": parse_png,
}
