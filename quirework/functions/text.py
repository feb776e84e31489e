"""Scalar text functions as Column expressions; all of them stay in generated code.

Null goes in as the empty string, as the block model has no null text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers trim it, illegal XML characters, entities.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ILLEGAL_XML = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{FFFE}\x{FFFF}]"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _chain(c: Column, pairs) -> Column:
    return functools.reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text(c))


def _subs(c: Column, pairs) -> Column:
    return functools.reduce(lambda out, p: F.regexp_replace(out, p[0], p[1]), pairs, text(c))


def escape_html(c: Column) -> Column:
    return _chain(c, ESCAPES)


def decode_entities(c: Column) -> Column:
    return _chain(c, ENTITIES)


def strip_illegal_xml(c: Column) -> Column:
    return F.regexp_replace(text(c), ILLEGAL_XML, "")


def escape_xml(c: Column) -> Column:
    return escape_html(strip_illegal_xml(c))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(text(c), "\r\n?", "\n")


def trim(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^{SPACE}+|{SPACE}+$", "")


def strip_html(c: Column) -> Column:
    """Visible text: style and script bodies go, breaks become line ends, other tags vanish, entities are decoded."""
    bare = _subs(
        c,
        [
            (r"(?i)<style[\s\S]*?</style>", ""),
            (r"(?i)<script[\s\S]*?</script>", ""),
            (r"(?i)<\s*br\s*/?>", "\n"),
            (r"(?i)<\s*/p\s*>", "\n\n"),
            (r"(?i)<\s*/div\s*>", "\n"),
            (r"<[^>]+>", ""),
        ],
    )
    return trim(F.regexp_replace(decode_entities(bare), "\n{3,}", "\n\n"))


#: Inline marks, in the order in which they are taken off, and the group that stays of each.
MARKS = (
    (r"!\[([^\]]*)\]\([^)]*\)", 1),
    (r"\[([^\]]+)\]\([^)]*\)", 1),
    (r"`([^`]+)`", 1),
    (r"(\*\*|__)(.*?)\1", 2),
    (r"(\*|_)(.*?)\1", 2),
    (r"~~(.*?)~~", 1),
)


def strip_markdown(c: Column) -> Column:
    """Text without inline marks."""
    return _subs(c, [(pattern, f"${group}") for pattern, group in MARKS])


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(trim(c), rf"{SPACE}+"), 1, n), " ")


def loose_key(c: Column) -> Column:
    """Text without white space and punctuation, in lower case: equal for texts that differ in nothing else."""
    return F.lower(F.regexp_replace(text(c), rf"(?:{SPACE}|\p{{P}})+", ""))


def csv_cell(c: Column) -> Column:
    t = text(c)
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def table_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(text(c), "\r?\n", " "), F.lit("|"), F.lit("\\|"))


def fence(c: Column) -> Column:
    """Back ticks for a code block: one more than the longest run inside, three at least."""
    runs = F.transform(F.regexp_extract_all(text(c), F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def sheet_name(c: Column) -> Column:
    """A legal sheet name: forbidden characters become spaces, 31 characters at most, never empty."""
    bare = F.substring(trim(F.regexp_replace(text(c), r"[\\/?*\[\]:]", " ")), 1, 31)
    return F.when(bare == "", F.lit("Sheet1")).otherwise(bare)


def column_letters(index: Column) -> Column:
    """Spreadsheet column name of a place from 0: 25 is Z, 26 is AA."""
    n = index.cast("long") + 1
    step = lambda v: F.struct(F.concat(F.char(65 + (v.n - 1) % 26), v.s).alias("s"), F.floor((v.n - 1) / 26).cast("long").alias("n"))
    start = F.struct(F.lit("").alias("s"), n.alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda v, _: F.when(v.n > 0, step(v)).otherwise(v), lambda v: v.s)


def column_index(name: Column) -> Column:
    """Place from 0 of a spreadsheet column name."""
    return F.aggregate(F.split(F.upper(name), "(?<=.)(?=.)"), F.lit(0).cast("long"), lambda n, ch: n * 26 + F.ascii(ch) - 64) - 1


def excel_serial_to_iso(serial: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")), "yyyy-MM-dd")


def is_date_format(code: Column) -> Column:
    """Whether a number format shows a year or a day; times of day alone do not count. Quoted and bracketed parts don't either."""
    bare = F.regexp_replace(F.lower(text(code)), r'"[^"]*"|\[[^\]]*\]|\\.', "")
    return bare.rlike("[yd]")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units in base 36, eight digits."""
    units = F.regexp_extract_all(F.hex(F.encode(text(c), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    values = F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(values, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.conv(h.cast("string"), 10, 36), 8, "0"))


def utf16be_hex(c: Column) -> Column:
    return F.upper(F.hex(F.encode(text(c), "UTF-16BE")))


def file_size(n: Column) -> Column:
    unit = lambda x, u: F.concat(F.format_string("%.1f", x), F.lit(u))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(n / 1024, " KB")).otherwise(unit(n / (1 << 20), " MB"))


def is_strict_number(c: Column) -> Column:
    """Cells that a workbook keeps as numbers."""
    return text(c).rlike(r"^-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?$")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return round_half_up(0.299 * r + 0.587 * g + 0.114 * b)


def links(c: Column) -> Column:
    """Web addresses in a text."""
    return F.regexp_extract_all(text(c), F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Paragraphs of plain text: parts between two or more line ends, each on one line, without empty ones."""
    parts = F.split(F.replace(text(c), F.lit("\r\n"), F.lit("\n")), "\n{2,}")
    return F.filter(F.transform(parts, lambda p: F.replace(trim(p), F.lit("\n"), F.lit(" "))), lambda p: p != "")


def resolve_path(base: Column, target: Column) -> Column:
    """A relationship's target as a path in its package; ``base`` is the part that holds the relationship."""
    folder = F.regexp_replace(text(base), "[^/]*$", "")
    joined = F.when(F.startswith(target, F.lit("/")), F.substring(target, 2, 1 << 20)).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p))
    return F.array_join(F.aggregate(steps, empty, up), "/")
