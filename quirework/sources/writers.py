"""Writers: blocks to text formats and packages. Plain Python over one document; results depend on nothing else."""

from __future__ import annotations

import base64
import functools
import io
import json
import re
import zipfile
import zlib
from itertools import zip_longest

from ..functions import inline
from ..functions.inline import escape
from ..functions.text import MARKS
from ..model import EQUALITY, SCHEMA_VERSION
from .parsers import lines_of

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def xml_text(text: str) -> str:
    return escape(_ILLEGAL.sub("", text))


def strip_marks(text: str) -> str:
    """Text without inline Markdown."""
    for pattern, group in MARKS:
        text = re.sub(pattern, rf"\{group}", text)
    return text


def _depth(block: dict, k: int) -> int:
    depths = block.get("depths") or []
    return max(0, depths[k] or 0) if k < len(depths) else 0


def _cells(b: dict) -> list[list[str]]:
    return [b.get("headers") or [], *(b.get("rows") or [])]


def _first(b: dict, *fields: str) -> str:
    return next((b[f] for f in fields if b.get(f)), "")


def _source(b: dict) -> str:
    """Inline Markdown of a block."""
    return _first(b, "marked", "text")


def _sources(b: dict) -> list[str]:
    items = b.get("items") or []
    return b["marked_items"] if len(b.get("marked_items") or []) == len(items) else items


def _items(b: dict, texts: list[str], mark) -> str:
    """Items of a list, each with its mark, two blanks deeper for every level."""
    depths = [_depth(b, k) for k in range(len(texts))]
    return "\n".join(f"{'  ' * d}{mark(k, d, depths)} {x}" for k, (x, d) in enumerate(zip(texts, depths, strict=True)))


def _by_place(b: dict):
    return lambda k, d, depths: f"{k + 1}." if b.get("ordered") and d == 0 else "-"


def _by_count(b: dict):
    return lambda k, d, depths: f"{depths[: k + 1].count(0)}." if b.get("ordered") and d == 0 else "-"


#: How each kind of block is written as plain text.
PLAIN = dict.fromkeys(("heading", "paragraph", "quote"), lambda b: _first(b, "text")) | {
    "list": lambda b: _items(b, b.get("items") or [], _by_place(b)),
    "code": lambda b: _first(b, "code"),
    "table": lambda b: "\n".join(filter(None, map("\t".join, _cells(b)))),
    "image": lambda b: _first(b, "alt", "title", "src", "asset_id"),
    "asset": lambda b: _first(b, "alt", "title", "src", "asset_id"),
    "raw": lambda b: "" if b.get("format") == "html" else _first(b, "content"),
}


def plain_block(b: dict) -> str:
    return PLAIN[b["type"]](b)


def plain_text(blocks: list[dict]) -> str:
    return "\n\n".join(filter(None, map(plain_block, blocks)))


def to_text(title: str, blocks: list[dict]) -> str:
    return strip_marks(plain_text(blocks)).strip() + "\n"


def _fence(text: str) -> str:
    return "`" * max(3, max(map(len, re.findall("`+", text)), default=0) + 1)


def _md_cell(cell: str) -> str:
    return re.sub(r"\r?\n", " ", cell).replace("|", "\\|")


_RULES = {"left": ":---", "center": ":---:", "right": "---:"}


def _md(text: str | None) -> str:
    return inline.markdown(inline.parse(text or ""))


def _fenced(body: str, info: str) -> str:
    return f"{_fence(body)}{info}\n{body}\n{_fence(body)}"


def _md_table(b: dict) -> str:
    headers, *rows = _cells(b)
    sides = [*(b.get("alignments") or []), *[""] * len(headers)]
    rule = [_RULES.get(side, "---") for side in sides[: len(headers)]]
    return "\n".join(f"| {' | '.join(r)} |" for r in [[*map(_md_cell, headers)], rule, *([*map(_md_cell, r)] for r in rows)])


def _escaped(text: str, marks: str) -> str:
    return re.sub(f"([{marks}])", r"\\\1", text)


def _md_raw(b: dict) -> str:
    form, body = _first(b, "format"), _first(b, "content")
    if form == "html":
        return ""
    return body if form in ("md", "markdown") else _fenced(body, re.sub("[^a-zA-Z0-9_+-]", "", form))


#: How each kind of block is written as Markdown.
MARKDOWN = {
    "heading": lambda b: f"{'#' * b['level']} {_md(_source(b))}",
    "paragraph": lambda b: _md(_source(b)),
    "quote": lambda b: f"> {_md(_source(b))}",
    "list": lambda b: _items(b, [*map(_md, _sources(b))], _by_count(b)),
    "code": lambda b: _fenced(_first(b, "code"), (_first(b, "language").split() or [""])[0].replace("`", "")),
    "table": _md_table,
    "image": lambda b: f"![{_escaped(_first(b, 'alt'), r'\[\]\\')}]({_escaped(_first(b, 'src'), r'()\\')})",
    "asset": lambda b: f"![{_first(b, 'alt', 'title') or 'asset'}](asset:{_first(b, 'asset_id')})",
    "raw": _md_raw,
}


def md_block(b: dict) -> str:
    return MARKDOWN[b["type"]](b)


def to_markdown(title: str, blocks: list[dict], profile: str = "ai-ready", warnings: list[dict] | None = None, source: str = "md") -> str:
    body = "\n\n".join(filter(None, map(md_block, blocks))).strip()
    codes = [w["code"] for w in warnings or []]
    if profile == "archive":
        body += "\n" + "\n".join(["---", f"title: {title}", f"source-format: {source}", f"blocks: {len(blocks)}", f"warnings: {len(codes)}", "---"])
    elif profile == "strict-round-trip":
        body += "\n" + "\n".join([f"<!-- round-trip: {source} -->", *(f"<!-- warning:{c} -->" for c in codes)])
    return body + "\n"


def _html_list(b: dict) -> str:
    items = [(inline.to_html(inline.parse(t)), _depth(b, k)) for k, t in enumerate(_sources(b))]

    def level(at: int, depth: int, pad: int) -> tuple[list[str], int]:
        tag = "ol" if b.get("ordered") and depth == 0 else "ul"
        out = [f"{'  ' * pad}<{tag}>"]
        while at < len(items) and items[at][1] >= depth:
            if items[at][1] > depth:
                inner, at = level(at, items[at][1], pad + 1)
                out += inner
                continue
            body, at = items[at][0], at + 1
            if at < len(items) and items[at][1] > depth:
                inner, at = level(at, items[at][1], pad + 2)
                body = "\n".join([body, *inner, "  " * (pad + 1)])
            out.append(f"{'  ' * (pad + 1)}<li>{body}</li>")
        return [*out, f"{'  ' * pad}</{tag}>"], at

    return "\n".join(level(0, 0, 0)[0])


def _html(text: str | None) -> str:
    return inline.to_html(inline.parse(text or ""))


def _html_code(body: str, language: str) -> str:
    return f"<pre><code{f' class="language-{escape(language)}"' if language else ''}>{escape(body)}</code></pre>"


def _html_table(b: dict) -> str:
    headers, *rows = _cells(b)
    styles = [f' style="text-align:{side}"' if side else "" for side in b.get("alignments") or []]
    row = lambda cells, tag: "    <tr>" + "".join(f"<{tag}{style}>{escape(c)}</{tag}>" for c, style in zip_longest(cells, styles[: len(cells)], fillvalue="")) + "</tr>"
    return "\n".join(["<table>", "  <thead>", row(headers, "th"), "  </thead>", "  <tbody>", *(row(r, "td") for r in rows), "  </tbody>", "</table>"])


def _html_raw(b: dict) -> str:
    form, body = _first(b, "format"), _first(b, "content")
    if form == "html":
        return body
    return "" if form in ("", "md", "markdown") else _html_code(body, re.sub("[^a-zA-Z0-9_+-]", "", form))


#: How each kind of block is written as HTML.
HTML = {
    "heading": lambda b: f"<h{b['level']}>{_html(_source(b))}</h{b['level']}>",
    "paragraph": lambda b: f"<p>{_html(_source(b))}</p>",
    "quote": lambda b: f"<blockquote>{_html(_source(b))}</blockquote>",
    "list": _html_list,
    "code": lambda b: _html_code(_first(b, "code"), _first(b, "language")),
    "table": _html_table,
    "image": lambda b: f'<img src="{escape(_first(b, "src"))}" alt="{escape(_first(b, "alt"))}" />',
    "asset": lambda b: f'<figure data-asset-id="{escape(_first(b, "asset_id"))}"><figcaption>{escape(_first(b, "title", "alt", "asset_id"))}</figcaption></figure>',
    "raw": _html_raw,
}


def html_block(b: dict) -> str:
    return HTML[b["type"]](b)


def to_html(title: str, blocks: list[dict]) -> str:
    body = "\n".join(filter(None, map(html_block, blocks)))
    return f'<!doctype html>\n<html>\n<head>\n<meta charset="utf-8" />\n<title>{escape(title)}</title>\n</head>\n<body>\n{body}\n</body>\n</html>\n'


def stored_block(b: dict) -> dict:
    """A block without its empty fields, as JSON keeps it."""
    out = {k: v for k, v in b.items() if v is not None and k not in ("depths", "markers", "asset_id", "warnings")}
    if b.get("asset_id") is not None:
        out["assetId"] = b["asset_id"]
    if b["type"] == "list":
        out["itemMeta"] = [{"depth": _depth(b, k), "marker": (b.get("markers") or ["-"] * len(b["items"]))[k]} for k in range(len(b["items"]))]
    return out


def to_json(title: str, blocks: list[dict], source: str = "") -> str:
    data = {"schemaVersion": SCHEMA_VERSION, "title": title, "sourceFormat": source, "blocks": [stored_block(b) for b in blocks], "plainText": plain_text(blocks), "markdown": to_markdown(title, blocks)}
    return json.dumps(data, ensure_ascii=False, indent=2) + "\n"


def csv_cell(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if re.search('[",\n\r]', text) else text


def to_csv(title: str, blocks: list[dict]) -> str:
    tables = [[b.get("headers") or [], *(b.get("rows") or [])] for b in blocks if b["type"] == "table"]
    if not tables:
        tables = [[["Text"], *([p] for p in re.split(r"\n{2,}", plain_text(blocks)) if p.strip())]]
    return "\n\n".join("\n".join(",".join(csv_cell(strip_marks(c)) for c in row) for row in t) for t in tables) + "\n"


def _xml_inline(tokens) -> str:
    names = {"strong": "strong", "em": "em", "del": "del"}
    out = []
    for t in tokens:
        if t.kind == "link":
            out.append(f'<link href="{xml_text(t.value)}">{_xml_inline(t.children)}</link>')
        elif t.children:
            out.append(f"<{names[t.kind]}>{_xml_inline(t.children)}</{names[t.kind]}>")
        elif t.kind == "code":
            out.append(f"<code>{xml_text(t.value)}</code>")
        elif t.kind == "break":
            out.append("<br/>")
        else:
            out.append(xml_text(inline.plain((t,)) or t.value))
    return "".join(out)


def _cdata(text: str) -> str:
    return "<![CDATA[" + _ILLEGAL.sub("", text).replace("]]>", "]]]]><![CDATA[>") + "]]>"


def _xml(tag: str, inner: str | None = None, **attributes: str) -> str:
    """An element; without ``inner`` an empty one."""
    opened = "".join([tag, *(f' {k}="{xml_text(v)}"' for k, v in attributes.items())])
    return f"<{opened}/>" if inner is None else f"<{opened}>{inner}</{tag}>"


def _xml_run(text: str | None) -> str:
    return _xml_inline(inline.parse(text or ""))


def _xml_table(b: dict) -> str:
    headers, *rows = _cells(b)
    row = lambda cells, tag: _xml("row", "".join(_xml(tag, xml_text(c)) for c in cells))
    return _xml("table", row(headers, "header") + "".join(row(r, "cell") for r in rows))


#: How each kind of block is written as XML.
XML = {
    "heading": lambda b: _xml("heading", _xml_run(_source(b)), level=str(b["level"])),
    "paragraph": lambda b: _xml("paragraph", _xml_run(_source(b))),
    "quote": lambda b: _xml("quote", _xml_run(_source(b))),
    "list": lambda b: _xml("list", "".join(_xml("item", _xml_run(t), depth=str(_depth(b, k))) for k, t in enumerate(_sources(b))), ordered=str(bool(b.get("ordered"))).lower()),
    "code": lambda b: _xml("code", _cdata(_first(b, "code")), language=_first(b, "language")),
    "table": _xml_table,
    "image": lambda b: _xml("image", src=_first(b, "src"), alt=_first(b, "alt")),
    "asset": lambda b: _xml("asset", id=_first(b, "asset_id"), alt=_first(b, "alt")),
    "raw": lambda b: _xml("raw", _cdata(_first(b, "content")), format=_first(b, "format")),
}


def xml_block(b: dict) -> str:
    return XML[b["type"]](b)


def to_xml(title: str, blocks: list[dict]) -> str:
    return '<?xml version="1.0" encoding="UTF-8"?>\n<document title="' + xml_text(title) + '">\n' + "".join(f"  {xml_block(b)}\n" for b in blocks) + "</document>\n"


# --- packages -----------------------------------------------------------------------------------------------


def pack(parts: dict[str, str | bytes], first_stored: str | None = None) -> bytes:
    """An archive whose bytes depend on its parts only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == first_stored else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _types(overrides: dict[str, str]) -> str:
    parts = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for p, t in overrides.items())
    return f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}</Types>'


def _rels(rows: list[tuple[str, str, str, bool]]) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{_OFFICE}/{kind}" Target="{xml_text(target)}"{" TargetMode=" + chr(34) + "External" + chr(34) if external else ""}/>' for i, kind, target, external in rows)
    return f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{body}</Relationships>'


def to_docx(title: str, blocks: list[dict]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    addresses: dict[str, str] = {}

    def runs(text: str) -> str:
        out = []
        for r in inline.flat(inline.parse(text)):
            props = "".join(p for k, p in (("strong", "<w:b/>"), ("em", "<w:i/>"), ("del", "<w:strike/>"), ("code", '<w:rFonts w:ascii="Courier New"/>')) if k in r["style"])
            body = "<w:br/>" if r["text"] == "\n" else f'<w:t xml:space="preserve">{xml_text(r["text"])}</w:t>'
            run = f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{body}</w:r>"
            if r["href"]:
                rid = addresses.setdefault(r["href"], f"rId{10 + len(addresses)}")
                run = f'<w:hyperlink r:id="{rid}">{run}</w:hyperlink>'
            out.append(run)
        return "".join(out)

    def para(text: str, props: str = "") -> str:
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{runs(text)}</w:p>"

    def bare(text: str, props: str = "") -> str:
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{xml_text(x)}</w:t>' for x in lines_of(text))
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}<w:r>{lines}</w:r></w:p>"

    body = []
    for b in blocks:
        kind = b["type"]
        if kind == "heading":
            body.append(para(_source(b), f'<w:pStyle w:val="Heading{b["level"]}"/>'))
        elif kind == "paragraph":
            body.append(para(_source(b)))
        elif kind == "quote":
            body.append(para(_source(b), '<w:pStyle w:val="Quote"/>'))
        elif kind == "list":
            for k, item in enumerate(_sources(b)):
                body.append(para(item, f'<w:numPr><w:ilvl w:val="{_depth(b, k)}"/><w:numId w:val="{2 if b.get("ordered") else 1}"/></w:numPr>'))
        elif kind == "code":
            body.append(bare(b.get("code") or "", '<w:pStyle w:val="Code"/>'))
        elif kind == "table":
            rows = "".join(f"<w:tr>{''.join(f'<w:tc>{bare(c)}</w:tc>' for c in r)}</w:tr>" for r in [b.get("headers") or [], *(b.get("rows") or [])])
            body.append(f"<w:tbl>{rows}</w:tbl>")
        elif text := plain_block(b):
            body.append(bare(text))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 7)) + "".join(f'<w:style w:type="paragraph" w:styleId="{n}"><w:name w:val="{n}"/></w:style>' for n in ("Quote", "Code"))
    kinds = "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:numFmt w:val="{f}"/></w:lvl></w:abstractNum>' for k, f in ((1, "bullet"), (2, "decimal")))
    numbers = "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in (1, 2))
    return pack(
        {
            "[Content_Types].xml": _types({"/word/document.xml": "wordprocessingml.document.main", "/word/styles.xml": "wordprocessingml.styles", "/word/numbering.xml": "wordprocessingml.numbering"}),
            "_rels/.rels": _rels([("rId1", "officeDocument", "word/document.xml", False)]),
            "word/document.xml": f'{_XML}<w:document xmlns:w="{w}" xmlns:r="{_OFFICE}"><w:body>{"".join(body)}</w:body></w:document>',
            "word/_rels/document.xml.rels": _rels([("rId1", "styles", "styles.xml", False), ("rId2", "numbering", "numbering.xml", False), *((i, "hyperlink", a, True) for a, i in addresses.items())]),
            "word/styles.xml": f'{_XML}<w:styles xmlns:w="{w}">{styles}</w:styles>',
            "word/numbering.xml": f'{_XML}<w:numbering xmlns:w="{w}">{kinds}{numbers}</w:numbering>',
        }
    )


def sheet_names(names: list[str]) -> list[str]:
    """Legal names that differ without regard to case; a repeated one gets a number and stays within 31 characters."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"[\\/?*\[\]:]", " ", name).strip()[:31] or "Sheet1"
        got, k = base, 2
        while got.lower() in taken:
            tail = f" {k}"
            got, k = base[: 31 - len(tail)] + tail, k + 1
        taken.add(got.lower())
        out.append(got)
    return out


def letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, d = divmod(k - 1, 26)
        out = chr(65 + d) + out
    return out


_NUMBER = re.compile(r"-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?$")


def sheets_of(title: str, blocks: list[dict]) -> list[tuple[str, list[list[str]]]]:
    """Tables as sheets, named by the heading before each; without a table the text is one column."""
    out, name = [], ""
    for b in blocks:
        if b["type"] == "heading":
            name = b.get("text") or ""
        elif b["type"] == "table":
            out.append((name or f"Sheet{len(out) + 1}", [b.get("headers") or [], *(b.get("rows") or [])]))
            name = ""
    return out or [(title or "Sheet1", [["Text"], *([p] for p in plain_text(blocks).split("\n\n") if p)])]


def to_xlsx(title: str, blocks: list[dict]) -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheets = sheets_of(title, blocks)
    names = sheet_names([n for n, _ in sheets])
    shared: dict[str, int] = {}
    pages = []
    for _, rows in sheets:
        body = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, value in enumerate(row):
                ref = f"{letters(c)}{r}"
                formula = re.fullmatch(r"=(.+?) => (.*)", value, re.S)
                if formula:
                    cells.append(f'<c r="{ref}" t="str"><f>{xml_text(formula[1])}</f><v>{xml_text(formula[2])}</v></c>')
                elif _NUMBER.match(value):
                    cells.append(f'<c r="{ref}"><v>{value}</v></c>')
                elif value:
                    cells.append(f'<c r="{ref}" t="s"><v>{shared.setdefault(value, len(shared))}</v></c>')
            body.append(f'<row r="{r}">{"".join(cells)}</row>')
        pages.append(f'{_XML}<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    n = range(1, len(pages) + 1)
    listed = "".join(f'<sheet name="{xml_text(x)}" sheetId="{k}" r:id="rId{k}"/>' for k, x in zip(n, names, strict=True))
    strings = "".join(f'<si><t xml:space="preserve">{xml_text(s)}</t></si>' for s in shared)
    return pack(
        {
            "[Content_Types].xml": _types({"/xl/workbook.xml": "spreadsheetml.sheet.main", "/xl/sharedStrings.xml": "spreadsheetml.sharedStrings", **{f"/xl/worksheets/sheet{k}.xml": "spreadsheetml.worksheet" for k in n}}),
            "_rels/.rels": _rels([("rId1", "officeDocument", "xl/workbook.xml", False)]),
            "xl/workbook.xml": f'{_XML}<workbook xmlns="{main}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _rels([*((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml", False) for k in n), (f"rId{len(pages) + 1}", "sharedStrings", "sharedStrings.xml", False)]),
            "xl/sharedStrings.xml": f'{_XML}<sst xmlns="{main}" uniqueCount="{len(shared)}">{strings}</sst>',
            **{f"xl/worksheets/sheet{k}.xml": p for k, p in zip(n, pages, strict=True)},
        }
    )


def to_epub(title: str, blocks: list[dict]) -> bytes:
    body = "\n".join(filter(None, map(html_block, blocks)))
    chapter = f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{xml_text(title)}</title></head><body>\n{_ILLEGAL.sub("", body)}\n</body></html>'
    name = f"urn:crc32:{zlib.crc32(chapter.encode()):08x}"  # no clock: equal documents give equal files
    opf = f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{name}</dc:identifier><dc:title>{xml_text(title)}</dc:title><dc:language>en</dc:language></metadata><manifest><item id="c1" href="chapter.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c1"/></spine></package>'
    box = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return pack({"mimetype": "application/epub+zip", "META-INF/container.xml": box, "OEBPS/content.opf": opf, "OEBPS/chapter.xhtml": chapter}, "mimetype")


def to_pptx(title: str, blocks: list[dict]) -> bytes:
    """One slide with the title and the first ten lines."""
    lines = [x for x in re.split(r"\n+", strip_marks(plain_text(blocks))) if x.strip()][:10]
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    box = lambda k, rows: f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="Text {k}"/></p:nvSpPr><p:txBody>{"".join(f"<a:p><a:r><a:t>{xml_text(x)}</a:t></a:r></a:p>" for x in rows)}</p:txBody></p:sp>'
    return pack(
        {
            "[Content_Types].xml": _types({"/ppt/presentation.xml": "presentationml.presentation.main", "/ppt/slides/slide1.xml": "presentationml.slide"}),
            "_rels/.rels": _rels([("rId1", "officeDocument", "ppt/presentation.xml", False)]),
            "ppt/presentation.xml": f'{_XML}<p:presentation xmlns:p="{p}" xmlns:r="{_OFFICE}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _rels([("rId1", "slide", "slides/slide1.xml", False)]),
            "ppt/slides/slide1.xml": f'{_XML}<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree>{box(2, [title])}{box(3, lines)}</p:spTree></p:cSld></p:sld>',
        }
    )


# --- PDF ----------------------------------------------------------------------------------------------------

_SIZES = {1: 22.0, 2: 18.0, 3: 15.0, 4: 13.0, 5: 12.0, 6: 12.0}
PAGE_W, PAGE_H, MARGIN = 595.0, 842.0, 56.0


def advance(ch: str) -> float:
    """Width of a character in ems."""
    return 1.0 if ord(ch) > 0x2E7F else 0.5


def wrap(text: str, size: float, width: float) -> list[str]:
    """Greedy lines; a word wider than a line is cut."""
    out, line, used = [], "", 0.0
    for word in re.findall(r"\S+\s*|\s+", text):
        w = sum(map(advance, word.rstrip())) * size
        if line and used + w > width:
            out.append(line.rstrip())
            line, used = "", 0.0
        if used + w <= width:
            line, used = line + word, used + w + sum(map(advance, word[len(word.rstrip()) :])) * size
            continue
        for ch in word:
            step = advance(ch) * size
            if used + step > width and not ch.isspace():
                out.append(line)
                line, used = "", 0.0
            line, used = line + ch, used + step
    return [*out, line.rstrip()] if line.strip() or not out else out


def pdf_lines(blocks: list[dict]) -> list[tuple[str, float]]:
    out = []
    for b in blocks:
        size = _SIZES[b["level"]] if b["type"] == "heading" else 10.0 if b["type"] in ("code", "table") else 12.0
        text = plain_block(b)
        text = text if b["type"] == "code" else strip_marks(text)
        for row in lines_of(text.replace("\t", "  |  ")):
            out += [(x, size) for x in wrap(row, size, PAGE_W - 2 * MARGIN)]
        out.append(("", 6.0))
    return out


def paginate(lines: list[tuple[str, float]]) -> list[list[tuple[str, float, float]]]:
    """(text, size, y) by page: a page ends where the next line would fall below the margin."""
    pages, y = [[]], PAGE_H - MARGIN
    for text, size in lines:
        lead = size * 1.4
        if y - lead < MARGIN and pages[-1]:
            pages.append([])
            y = PAGE_H - MARGIN
        y -= lead
        if text:
            pages[-1].append((text, size, y))
    return pages


@functools.cache
def _pdf_cmap() -> bytes:
    cmap = "/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def 1 begincodespacerange <0000> <FFFF> endcodespacerange\n"
    cmap += "100 beginbfrange\n" + "".join(f"<{k:02X}00> <{k:02X}FF> <{k:02X}00>\n" for k in range(256) if not 0xD8 <= k < 0xE0) + "endbfrange endcmap end end"
    return _pdf_stream(cmap.encode())


def pdf_file(pages: list[list[tuple[str, float, float, float]]]) -> bytes:
    """A file of text runs (text, size, x, y) with one composite font; the map of its codes is the text itself in UTF-16."""
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{6 + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode(),
        b"<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UCS2-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 2 >> /DW 1000 >>",
        _pdf_cmap(),
    ]
    for k, page in enumerate(pages):
        body = "\n".join(f"BT /F1 {size:g} Tf 1 0 0 1 {x:g} {y:.2f} Tm <{text.encode('utf-16-be', 'replace').hex().upper()}> Tj ET" for text, size, x, y in page)
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_W:g} {PAGE_H:g}] /Resources << /Font << /F1 3 0 R >> >> /Contents {7 + 2 * k} 0 R >>".encode())
        objects.append(_pdf_stream(body.encode()))
    parts, places, at = [b"%PDF-1.7\n"], [], 9
    for k, o in enumerate(objects, 1):
        places.append(at)
        parts.append(f"{k} 0 obj\n".encode() + o + b"\nendobj\n")
        at += len(parts[-1])
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return b"".join(parts) + f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode()


def _pdf_stream(data: bytes) -> bytes:
    body = zlib.compress(data)
    return f"<< /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream"


def to_pdf(title: str, blocks: list[dict]) -> bytes:
    return pdf_file([[(t, s, MARGIN, y) for t, s, y in page] for page in paginate(pdf_lines(blocks))])


TEXT_WRITERS = {"txt": to_text, "md": to_markdown, "html": to_html, "json": to_json, "csv": to_csv, "xml": to_xml}
BINARY_WRITERS = {"docx": to_docx, "xlsx": to_xlsx, "epub": to_epub, "pptx": to_pptx, "pdf": to_pdf}


def data_url(data: bytes, mime: str) -> str:
    return f"data:{mime};base64,{base64.b64encode(data).decode()}"


def equal_fields(b: dict) -> dict:
    """What counts for equality of blocks."""
    return {"type": b["type"]} | {k: b.get(k) for k in EQUALITY[b["type"]]}

