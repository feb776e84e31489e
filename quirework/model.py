"""The block model: one wide nullable struct per block, with ``type`` as its tag.

``marked`` and ``marked_items`` hold inline Markdown where it says more than the plain ``text`` or ``items``: links and emphasis
that a reader of another format has found. Writers show it; comparison and plain text don't look at it.
"""

from __future__ import annotations

import pyarrow as pa

#: Kinds of blocks, severities of warnings, the fields of each kind that count for equality.
BLOCK_TYPES = ("heading", "paragraph", "list", "code", "table", "quote", "image", "asset", "raw")
SEVERITIES = ("info", "lossy", "unsupported", "security", "performance")
EQUALITY = {
    "heading": ("level", "text"),
    "paragraph": ("text",),
    "quote": ("text",),
    "code": ("language", "code"),
    "list": ("ordered", "items"),
    "table": ("headers", "rows"),
    "image": ("src", "alt"),
    "asset": ("asset_id", "alt"),
    "raw": ("format", "content"),
}
SCHEMA_VERSION = "1.0.0"

WARNING_DDL = "struct<severity:string,code:string,message:string>"
BLOCK_DDL = (
    "struct<type:string,level:int,text:string,ordered:boolean,items:array<string>,depths:array<int>,markers:array<string>,"
    "code:string,language:string,headers:array<string>,rows:array<array<string>>,alignments:array<string>,src:string,alt:string,"
    f"title:string,asset_id:string,format:string,content:string,marked:string,marked_items:array<string>,warnings:array<{WARNING_DDL}>>"
)

_S, _SS = pa.string(), pa.list_(pa.string())
WARNING = pa.struct([(k, _S) for k in ("severity", "code", "message")])
BLOCK = pa.struct(
    [
        ("type", _S), ("level", pa.int32()), ("text", _S), ("ordered", pa.bool_()), ("items", _SS), ("depths", pa.list_(pa.int32())), ("markers", _SS),
        ("code", _S), ("language", _S), ("headers", _SS), ("rows", pa.list_(_SS)), ("alignments", _SS), ("src", _S), ("alt", _S),
        ("title", _S), ("asset_id", _S), ("format", _S), ("content", _S), ("marked", _S), ("marked_items", _SS), ("warnings", pa.list_(WARNING)),
    ]
)


def warning(severity: str, code: str, message: str) -> dict:
    return {"severity": severity if severity in SEVERITIES else "info", "code": code, "message": message}


def heading(level: int, text: str) -> dict:
    return {"type": "heading", "level": level, "text": text}


def paragraph(text: str) -> dict:
    return {"type": "paragraph", "text": text}


def quote(text: str) -> dict:
    return {"type": "quote", "text": text}


def code(text: str, language: str = "") -> dict:
    return {"type": "code", "code": text, "language": language}


def list_block(items: list[str], ordered: bool = False, depths: list[int] | None = None, markers: list[str] | None = None) -> dict:
    n = len(items)
    return {"type": "list", "ordered": ordered, "items": items, "depths": depths or [0] * n, "markers": markers or ["-"] * n}


def table(headers: list[str], rows: list[list[str]], alignments: list[str] | None = None) -> dict:
    return {"type": "table", "headers": headers, "rows": rows, "alignments": alignments or []}


def image(src: str, alt: str = "", title: str = "") -> dict:
    return {"type": "image", "src": src, "alt": alt, "title": title}


def asset(asset_id: str, alt: str = "", title: str = "") -> dict:
    return {"type": "asset", "asset_id": asset_id, "alt": alt, "title": title}


def raw(kind: str, content: str) -> dict:
    return {"type": "raw", "format": kind, "content": content}
