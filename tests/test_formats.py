import json
import random
import re

import pytest

from quirework import model as m
from quirework.sources import containers as c
from quirework.sources import parsers as p
from quirework.sources import writers as w


def kinds(blocks):
    return [b["type"] for b in blocks]


def test_markdown_blocks():
    text = "# T\n\nline one\nline two\n\n- a\n  - b\n- c\n\n1. x\n2. y\n\n| h1 | h\\|2 |\n|:--|--:|\n| a | b |\n\n````js\n```\ncode\n````\n\n> q1\n>\n> q2\n\n![alt](src.png)\n\n[^1]: note\n"
    _, blocks, notes = p.parse_markdown(text.replace("|:--|--:|", "|:---|---:|"), "t")
    assert kinds(blocks) == ["heading", "paragraph", "list", "list", "table", "code", "quote", "image", "quote"]
    assert blocks[1]["text"] == "line one line two"
    assert (blocks[2]["items"], blocks[2]["depths"], blocks[2]["ordered"], blocks[3]["ordered"]) == (["a", "b", "c"], [0, 1, 0], False, True)
    assert (blocks[4]["headers"], blocks[4]["rows"], blocks[4]["alignments"]) == (["h1", "h|2"], [["a", "b"]], ["left", "right"])
    assert (blocks[5]["code"], blocks[5]["language"]) == ("```\ncode", "js")
    assert blocks[6]["text"] == "q1 q2" and blocks[8]["text"] == "[1] note" and notes[0]["code"] == "MARKDOWN_FOOTNOTE"


def test_markdown_round_trip():
    text = "# T\n\npara one\n\n- a\n- b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |\n\n```py\nprint(1)\n```\n\n> quoted\n"
    _, blocks, _ = p.parse_markdown(text, "t")
    assert w.to_markdown("t", blocks) == text
    assert w.to_markdown("t", blocks, "archive").endswith("---\n")


def test_html_blocks():
    text = "<html><head><title>N</title><style>p{}</style></head><body>loose<h1>A <b>b</b></h1><p>x<br>y</p><ul><li>1<ol><li>n</li></ol></li><li>2</li></ul><table><tr><td>a</td></tr></table><pre><code>c\n d</code></pre><div><blockquote>q</blockquote></div><img src=s alt=t><script>never closed"
    title, blocks, _ = p.parse_html(text, "t")
    assert title == "N"
    assert kinds(blocks) == ["paragraph", "heading", "paragraph", "list", "table", "code", "quote", "image"]
    assert blocks[1]["text"] == "A b" and blocks[2]["text"] == "x y" and blocks[3]["items"] == ["1", "n", "2"] and blocks[3]["depths"] == [0, 1, 0]
    assert blocks[4]["rows"] == [["a"]] and blocks[5]["code"] == "c\n d"


def test_csv():
    rows, inner = p.csv_rows('﻿a,"b ""q"" c"\r\n"x\ny",\nlone\n')
    assert rows == [["a", 'b "q" c'], ["x\ny", ""], ["lone"]] and inner
    assert p.parse_csv("", "t")[1] == []
    assert w.to_csv("t", [m.table(["Name", "D"], [["a,b", 'say "x"']])]) == 'Name,D\n"a,b","say ""x"""\n'


def test_json():
    assert p.parse_json('[{"b":1,"a":null},{"c":[1]}]', "t")[1] == [m.table(["b", "a", "c"], [["1", "", ""], ["", "", "[1]"]])]
    assert p.parse_json("[1.0,true]", "t")[1] == [m.table(["value"], [["1"], ["true"]])]
    assert kinds(p.parse_json('{"a":1}', "t")[1]) == ["heading", "code"]
    with pytest.raises(p.ParseError, match="not a JSON") as e:
        p.parse_json("{", "t")
    assert e.value.code == "JSON_PARSE_ERROR"
    with pytest.raises(p.ParseError) as e:
        p.parse_json('{"schemaVersion":"1","blocks":[{"type":"list"}]}', "t")
    assert e.value.code == "DOCUMENT_MODEL_SCHEMA_ERROR"


def test_xml():
    texts, attributes, spaces = p.xml_facts('<r xmlns:n="u" id="1"><n:a k="1">x</n:a><n:a k="2"> y </n:a></r>')
    assert (texts, attributes, spaces) == (["x", "y"], {"r": {"id": "1"}, "n:a": {"k": "2"}}, {"n": "u"})
    with pytest.raises(p.ParseError):
        p.parse_xml("<a><b></a>", "t")
    p.xml_facts(w.to_xml("t", [m.code("a ]]> b\x00"), m.paragraph("x **y** <z>")]))


BLOCKS = [m.heading(1, "Title"), m.paragraph("Some plain text."), m.list_block(["one", "two"]), m.table(["Name", "Value"], [["a", "1.5"], ["b", "x"]]), m.quote("Quoted")]


@pytest.mark.parametrize("fmt", ["md", "html", "json"])
def test_text_round_trips(fmt):
    data = w.TEXT_WRITERS[fmt]("Title", BLOCKS)
    _, back, _ = p.TEXT_PARSERS[fmt](data, "Title")
    assert [w.equal_fields(b) for b in back] == [w.equal_fields(b) for b in BLOCKS]


@pytest.mark.parametrize("fmt", ["docx", "xlsx", "epub", "pptx", "pdf"])
def test_packages(fmt):
    data = w.BINARY_WRITERS[fmt]("Title", BLOCKS)
    assert data == w.BINARY_WRITERS[fmt]("Title", BLOCKS)
    _, back, _ = c.BINARY_PARSERS[fmt](data, "Title")
    text = w.plain_text(back)
    assert "Name" in text and back
    if fmt in ("docx", "epub"):
        assert [w.equal_fields(b) for b in back] == [w.equal_fields(b) for b in BLOCKS]
    if fmt == "xlsx":
        assert back[1]["rows"] == [["a", "1.5"], ["b", "x"]]
    if fmt == "pdf":
        assert back[0]["type"] == "heading" and "中文" in w.plain_text(c.parse_pdf(w.to_pdf("t", [m.paragraph("中文 text")]), "t")[1])


def test_bad_containers():
    for parse in c.BINARY_PARSERS.values():
        if parse is not c.parse_doc:
            with pytest.raises(p.ParseError):
                parse(b"junk", "t")
    with pytest.raises(p.ParseError) as e:
        c.unzip(w.pack({"../x": "y"}))
    assert e.value.code == "ZIP_UNSAFE_PATH"
    with pytest.raises(p.ParseError) as e:
        c.unzip(w.pack({"x": "0" * 10_000_000}))
    assert e.value.code == "ZIP_RATIO"


def test_decoding():
    assert c.decode_bytes("中文".encode("utf-16-le")) == ("中文", "utf-16-le")
    assert c.decode_bytes("中文内容".encode("gb18030"))[0] == "中文内容"
    assert c.decode_bytes("é".encode("latin-1"), "text/html; charset=iso-8859-1")[0] == "é"
    assert c.decode_bytes(b"\xef\xbb\xbfx") == ("x", "utf-8")


def test_doc_and_pdf_text():
    body = b"\xd0\xcf\x11\xe0" + bytes(40) + "Hello world, this is the text of an old document.".encode("utf-16-le") + bytes(9)
    assert "old document" in c.parse_doc(body, "t")[1][0]["text"]
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 60 >>\nstream\nBT /F1 24 Tf 72 700 Td (Head\\051) Tj 0 -40 Td /F1 12 Tf [(wo) -20 (rd) -300 (two)] TJ ET\nendstream\nendobj"
    assert [(b["type"], b["text"]) for b in c.parse_pdf(pdf, "t")[1]] == [("heading", "Head)"), ("paragraph", "word two")]
    assert c.glyph_noise(["gg", "g1", "g2", "gg", "gg", "gg", "g3", "gg"]) and not c.glyph_noise(["words of a text"] * 9) and c.glyph_noise(["word"] * 9) and c.glyph_noise(["abcdef"] * 9) and c.glyph_noise(["Xa1XXbXXcX"] * 9) and not c.glyph_noise(["gg"] * 7 + [" "])


def test_sheet_names_and_wrap():
    assert w.sheet_names(["A", "a", "A 2", "x" * 40, "x" * 40]) == ["A", "a 2", "A 2 2", "x" * 31, "x" * 29 + " 2"]
    assert w.wrap("aaa bbb ccc", 10, 40) == ["aaa bbb", "ccc"] and w.wrap("a" * 10, 10, 20) == ["aaaa", "aaaa", "aa"]
    assert len(w.paginate([("x", 12.0)] * 100)) == 3
    assert json.loads(w.to_json("t", BLOCKS))["blocks"][2]["itemMeta"][0] == {"depth": 0, "marker": "-"}


def test_html_keeps_links_and_emphasis():
    from quirework.sources import parsers, writers

    html = '<h2>A <em>b</em></h2><p>see <a href="/x(1)" title="t">the <b>y</b></a>, <code>z*</code> and 2*3*4</p>in <i>the</i> open<ul><li>one <a href="/q">q</a><ul><li>plain *</li></ul></li></ul>'
    blocks = parsers.parse_html(html, "t")[1]
    assert [b.get("text") or b.get("items") for b in blocks] == ["A b", "see the y, z* and 2*3*4", "in the open", ["one q", "plain *"]]
    md = writers.to_markdown("t", blocks)
    assert md == '## A *b*\n\nsee [the **y**](/x\\(1\\) "t"), `z*` and 2\\*3\\*4\n\nin *the* open\n\n- one [q](/q)\n  - plain \\*\n'
    out = writers.to_html("t", parsers.parse_markdown(md, "t")[1])
    assert '<p>see <a href="/x(1)" title="t">the <strong>y</strong></a>, <code>z*</code> and 2*3*4</p>' in out and "<h2>A <em>b</em></h2>" in out
    again = parsers.parse_html(writers.to_html("t", blocks), "t")[1]
    assert again == blocks and writers.to_text("t", blocks).startswith("A b\n")


def test_pdf_font_maps_are_read_once(monkeypatch):
    first, second = (w.to_pdf("t", [m.paragraph(text)]) for text in ("Alpha beta 中文 gamma", "Another text of words"))
    own = b"%PDF-1.7\n<< /Length 60 >>\nstream\n1 begincmap 1 beginbfchar <01> <0058> <0002> <0059> endbfchar endcmap\nendstream\n<< /Length 40 >>\nstream\nBT /F1 12 Tf 1 0 0 1 9 9 Tm <010002> Tj ET\nendstream\n"
    calls, real = [], c.read_cmap
    monkeypatch.setattr(c, "read_cmap", lambda text: calls.append(text) or real(text))
    got = [[b["text"] for b in c.parse_pdf(x, "t")[1]] for x in (first, second, own, first)]
    assert got == [["Alpha beta 中文 gamma"], ["Another text of words"], ["XY"], ["Alpha beta 中文 gamma"]]
    assert len(calls) <= 2


def test_wrap_as_character_by_character():
    def plain(text, size, width):
        out, line, used = [], "", 0.0
        for word in re.findall(r"\S+\s*|\s+", text):
            if line and used + sum(map(w.advance, word.rstrip())) * size > width:
                out.append(line.rstrip())
                line, used = "", 0.0
            for ch in word:
                step = w.advance(ch) * size
                if used + step > width and not ch.isspace():
                    out.append(line)
                    line, used = "", 0.0
                line, used = line + ch, used + step
        return [*out, line.rstrip()] if line.strip() or not out else out

    pick = random.Random(5)
    for _ in range(300):
        text = "".join(pick.choice("ab中　  x") for _ in range(pick.randrange(60)))
        for size, width in ((12.0, 60.0), (15.0, 483.0), (13.0, 40.0)):
            assert w.wrap(text, size, width) == plain(text, size, width)
