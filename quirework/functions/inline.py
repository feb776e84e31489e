"""Inline Markdown as nested tokens, and tokens as plain text, Markdown, HTML and XML.

A token is (kind, value, children): text, code, math and display hold a value; strong, em, del and link hold
children (a link's value is its address and title); break and note stand alone.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str
    value: str = ""
    children: tuple[Token, ...] = ()
    title: str = ""


_RULES = re.compile(
    r"(?P<display>\$\$(?P<dm>[^$]+)\$\$)"
    r"|(?P<math>\$(?P<im>(?=\S)[^$\n]*[^\s$\\])\$(?!\d))"
    r"|(?P<escape>\\(?P<ch>[!-/:-@\[-`{-~]))"
    r"|(?P<note>\[\^(?P<id>[^\]]+)\])"
    r"|(?P<code>(?P<tick>`+)(?P<cv>.+?)(?<!`)(?P=tick)(?!`))"
    r"|(?P<image>!\[(?P<alt>[^\]]*)\]\([^)]*\))"
    r"|(?P<link>\[(?P<label>(?:\\.|[^\]\\])+)\]\((?P<href>(?:\\.|[^()\s\\]|\([^()]*\))+)(?:\s+\"(?P<title>[^\"]*)\")?\))"
    r"|(?P<del>~~(?P<dv>.+?)~~)"
    r"|(?P<both>\*\*\*(?P<bv>\S.*?)\*\*\*)"
    r"|(?P<strong>(?P<sm>\*\*|__)(?P<sv>\S.*?)(?P=sm)(?!\*))"
    r"|(?P<em>(?P<emk>\*|_)(?P<ev>\S.*?)(?P=emk))"
    r"|(?P<break>  \n|\n)",
    re.S,
)
_CURRENCY = re.compile(r"^\d[\d,.]*(?:\s|$)")
_PUNCTUATION = re.compile(r"([\\`*_\[\]<>~$])")


_MARK = re.compile(r"[$\\\[`*_~\n]")


def parse(text: str) -> tuple[Token, ...]:
    if not _MARK.search(text):
        return (Token("text", text),) if text else ()
    out: list[Token] = []
    plain: list[str] = []

    def flush() -> None:
        if plain:
            out.append(Token("text", "".join(plain)))
            plain.clear()

    at = 0
    while found := _RULES.search(text, at):
        plain.append(text[at : found.start()])
        kind, at = found.lastgroup, found.end()
        kind = next(k for k in ("display", "math", "escape", "note", "code", "image", "link", "del", "both", "strong", "em", "break") if found[k] is not None)
        if kind == "escape":
            plain.append(found["ch"])
            continue
        if kind == "image":
            plain.append(found["alt"])
            continue
        if kind == "math" and _CURRENCY.match(found["im"]):  # amounts of money in one sentence are no formula
            plain.append("$")
            at = found.start() + 1
            continue
        flush()
        if kind in ("display", "math"):
            out.append(Token(kind, found["dm"] or found["im"]))
        elif kind == "note":
            out.append(Token("note", found["id"]))
        elif kind == "code":
            out.append(Token("code", found["cv"].strip() or found["cv"]))
        elif kind == "link":
            out.append(Token("link", re.sub(r"\\(.)", r"\1", found["href"]), parse(found["label"]), found["title"] or ""))
        elif kind == "both":
            out.append(Token("strong", "", (Token("em", "", parse(found["bv"])),)))
        elif kind == "break":
            out.append(Token("break"))
        else:
            out.append(Token(kind, "", parse(found[{"del": "dv", "strong": "sv", "em": "ev"}[kind]])))
    plain.append(text[at:])
    plain[:] = [p for p in plain if p]
    flush()
    return tuple(out)


def plain(tokens: tuple[Token, ...]) -> str:
    out = []
    for t in tokens:
        if t.kind in ("text", "code"):
            out.append(t.value)
        elif t.kind in ("math", "display"):
            mark = "$" if t.kind == "math" else "$$"
            out.append(f"{mark}{t.value}{mark}")
        elif t.kind == "break":
            out.append("\n")
        else:
            out.append(plain(t.children))
    return "".join(out)


_MARKS = {"strong": "**", "em": "*", "del": "~~"}
_TAGS = {"strong": "strong", "em": "em", "del": "del"}


def markdown(tokens: tuple[Token, ...]) -> str:
    out = []
    for t in tokens:
        if t.kind == "text":
            out.append(_PUNCTUATION.sub(r"\\\1", t.value))
        elif t.kind == "code":
            tick = "`" * (max(map(len, re.findall("`+", t.value)), default=0) + 1)
            out.append(f"{tick}{t.value}{tick}")
        elif t.kind in ("math", "display"):
            mark = "$" if t.kind == "math" else "$$"
            out.append(f"{mark}{t.value}{mark}")
        elif t.kind == "link":
            title = f' "{t.title}"' if t.title else ""
            out.append(f"[{markdown(t.children)}]({re.sub(r'([()\s])', r'\\\1', t.value)}{title})")
        elif t.kind == "note":
            out.append(f"[^{t.value}]")
        elif t.kind == "break":
            out.append("  \n")
        else:
            out.append(f"{_MARKS[t.kind]}{markdown(t.children)}{_MARKS[t.kind]}")
    return "".join(out)


def escape(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


def to_html(tokens: tuple[Token, ...]) -> str:
    out = []
    for t in tokens:
        if t.kind == "text":
            out.append(escape(t.value))
        elif t.kind == "code":
            out.append(f"<code>{escape(t.value)}</code>")
        elif t.kind in ("math", "display"):
            mark = "$" if t.kind == "math" else "$$"
            out.append(f'<span class="math">{escape(mark + t.value + mark)}</span>')
        elif t.kind == "link":
            title = f' title="{escape(t.title)}"' if t.title else ""
            safe = not re.match(r"\s*(?:javascript|vbscript|data):", t.value, re.I)
            out.append(f'<a href="{escape(t.value) if safe else "#"}"{title}>{to_html(t.children)}</a>')
        elif t.kind == "note":
            out.append(f"<sup>[{escape(t.value)}]</sup>")
        elif t.kind == "break":
            out.append("<br />")
        else:
            out.append(f"<{_TAGS[t.kind]}>{to_html(t.children)}</{_TAGS[t.kind]}>")
    return "".join(out)


def flat(tokens: tuple[Token, ...], style: frozenset = frozenset(), href: str = "") -> list[dict]:
    """Runs without nesting, as engines without recursive types and page formats want them."""
    out = []
    for t in tokens:
        if t.children:
            out += flat(t.children, style | ({t.kind} - {"link"}), t.value if t.kind == "link" else href)
        elif t.kind == "break":
            out.append({"text": "\n", "style": style, "href": href})
        elif t.kind == "note":
            out.append({"text": f"[{t.value}]", "style": style, "href": href})
        else:
            mark = {"math": "$", "display": "$$"}.get(t.kind, "")
            out.append({"text": f"{mark}{t.value}{mark}", "style": style | ({"code"} if t.kind == "code" else set()), "href": href})
    return out
