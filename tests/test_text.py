from pyspark.sql import functions as F

from quirework.functions import inline
from quirework.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("o")).first()["o"]


def test_scalars(spark):
    cases = [
        ("abc", tx.fnv1a, "007aigaz"),
        (None, tx.escape_html, ""),
        ("<a href='x'>&\"", tx.escape_html, "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"),
        ("&lt;&amp;lt;&nbsp;", tx.decode_entities, "<< "),
        ("a\r\nb\rc", tx.normalize_newlines, "a\nb\nc"),
        ("**bold** _em_ `c` [t](u) ![i](v) ~~x~~", tx.strip_markdown, "bold em c t i x"),
        ("<style>p{}</style><p>a<br>b</p><script>x", tx.strip_html, "a\nb\n\nx"),
        ("a,b", tx.csv_cell, '"a,b"'),
        ('x"y', tx.csv_cell, '"x""y"'),
        ("plain", tx.csv_cell, "plain"),
        ("a|b\nc", tx.table_cell, "a\\|b c"),
        ("x ```` y", tx.fence, "`````"),
        ("a !b", tx.loose_key, "ab"),
        ("a/b:c*" + "x" * 40, tx.sheet_name, "a b c " + "x" * 25),
        ("  one two  three", lambda c: tx.first_words(c, 2), "one two"),
        ("a\x00b", tx.strip_illegal_xml, "ab"),
        ("中", tx.utf16be_hex, "4E2D"),
        ("yyyy-mm-dd", tx.is_date_format, True),
        ('h:mm:ss "day"', tx.is_date_format, False),
    ]
    for value, expr, want in cases:
        assert one(spark, value, expr) == want, (value, want)
    for value, want in [("1.5", True), ("-2e3", True), (".5", True), ("5.", False), ("0x10", False), (" 100 ", False), ("", False)]:
        assert one(spark, value, tx.is_strict_number) is want, value


def test_astral_hash_counts_utf16_units(spark):
    h = 2166136261
    for unit in (0xD83D, 0xDE00):
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, d = divmod(h, 36)
        out = digits[d] + out
    assert one(spark, "😀", tx.fnv1a) == out.rjust(8, "0")


def test_serials_letters_paths(spark):
    row = spark.range(1).select(
        tx.excel_serial_to_iso(F.lit(45292.5)).alias("iso"), F.array(*[tx.column_letters(F.lit(k)) for k in (0, 25, 26, 27, 702)]).alias("names"), tx.column_index(F.lit("AAA")).alias("back"),
        tx.resolve_path(F.lit("word/document.xml"), F.lit("../media/./a.png")).alias("path"), tx.resolve_path(F.lit("a/b.xml"), F.lit("/c/d")).alias("root"), tx.file_size(F.lit(2048)).alias("size"),
    ).first()
    assert (row.iso, row.names, row.back, row.path, row.root, row["size"]) == ("2024-01-01", ["A", "Z", "AA", "AB", "AAA"], 702, "media/a.png", "c/d", "2.0 KB")


def test_paragraphs(spark):
    assert one(spark, " a\nb \r\n\r\n\n\n c \n\n", tx.paragraphs) == ["a b", "c"]
    assert one(spark, None, tx.paragraphs) == []


def test_inline():
    t = inline.parse("a **b *c*** `d` [e](http://f \"g\") ~~h~~ $x^2$ cost $5 and $6 [^1] \\*")
    assert inline.plain(t) == "a b c d e h $x^2$ cost $5 and $6  *"
    assert inline.to_html(inline.parse("<b> **x**")) == "&lt;b&gt; <strong>x</strong>"
    assert 'href="#"' in inline.to_html(inline.parse("[x](javascript:alert)"))
    assert inline.plain(inline.parse(inline.markdown(t))) == inline.plain(t)
    assert inline.flat(inline.parse("**a [b](c)**"))[-1] == {"text": "b", "style": frozenset({"strong"}), "href": "c"}
