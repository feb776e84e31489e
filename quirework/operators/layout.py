"""Layout analysis of text runs and recognised lines as windows and aggregations.

Runs are (doc_id, page, text, x, y, h); y grows downward for recognised lines and upward for page runs, as ``up`` says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Ratios that make a heading or a new paragraph.
HEADING, GAP_RUNS, GAP_LINES, OCR_HEADING = 1.15, 1.6, 0.7, 1.35
SCANNED_BELOW = 300
#: Share of a run's height by which it may be off its line, and the height of runs that have none.
NEAR, NO_HEIGHT = 0.5, 12.0


def reading_order(runs: DataFrame, *keys: str, ties: tuple[str, ...] = ("text",)) -> DataFrame:
    """``place`` of each run, from the top down and from the left; ``ties`` order runs at one place."""
    return runs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("y", "x", *ties)))


def line_numbers(runs: DataFrame, *keys: str) -> DataFrame:
    """``runs`` with ``pos``, the number of their line: from the top down (y falls), a run within half its height of a line's first one is in it.

    The rule looks at the first run of a line and not at the run before, so each page is folded in order.
    """
    cols = [c for c in runs.columns if c not in keys]
    order = F.struct((-F.col("y")).alias("down"), "x", "text", *[c for c in cols if c not in ("y", "x", "text")])
    page = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("runs"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, run: Column) -> Column:
        height = F.when(F.coalesce(run.h, F.lit(0.0)) > 0, run.h).otherwise(NO_HEIGHT)
        same = F.coalesce(F.abs(state.top + run.down) < NEAR * height, F.lit(False))
        line = F.when(same, state.line).otherwise(state.line + 1)
        return F.struct(F.when(same, state.top).otherwise(-run.down).cast("double").alias("top"), line.alias("line"), F.concat(state.lines, F.array(line)).alias("lines"))

    held = page.withColumn("lines", F.aggregate("runs", start, step, lambda state: state.lines))
    each = held.select(*keys, F.explode(F.arrays_zip("runs", "lines")).alias("r"))
    return each.select(*keys, *[(-F.col("r.runs.down")).alias("y") if c == "y" else F.col(f"r.runs.{c}").alias(c) for c in cols], F.col("r.lines").alias("pos"))


def body_size(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, body): the size, in halves, with most characters; ties go to the one met first."""
    bucket = F.floor(F.col("h") * 2 + 0.5) / 2
    weighed = lines.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(F.length("text")).alias("weight"), F.min("pos").alias("first"))
    return weighed.groupBy(*keys).agg(F.max_by("bucket", F.struct("weight", -F.col("first"), -F.col("bucket"))).alias("body"))


def heading_level(ratio: Column) -> Column:
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.2, 3).otherwise(4)


def page_blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, type, level, text): lines from the top down (y falls) joined to headings, list items and paragraphs."""
    w = Window.partitionBy(*keys).orderBy("pos")
    sized = lines.join(body_size(lines, *keys), list(keys))
    is_heading = (F.col("h") > HEADING * F.col("body")) & (F.length("text") <= 200)
    is_item = ~is_heading & F.col("text").rlike(r"^(?:[-*•·]|\d+[.)])\s+\S")
    kind = F.when(is_heading, "heading").when(is_item, "list").otherwise("paragraph")
    held = sized.withColumn("type", kind).withColumn("gap", F.lag("y").over(w) - F.col("y") > GAP_RUNS * F.lag("h").over(w))
    new = F.coalesce(F.col("gap") | (F.col("type") != F.lag("type").over(w)) | (F.col("type") == "heading"), F.lit(True))
    held = held.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text), " ")
    out = held.groupBy(*keys, "block").agg(F.min("type").alias("type"), F.max(F.when(F.col("type") == "heading", heading_level(F.col("h") / F.col("body")))).alias("level"), text.alias("text"))
    return out


#: Fixed value: characters that join without a blank.
UNSPACED = "[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def joined_lines(out: Column, line: Column) -> Column:
    """Text so far and one more line: with a blank unless both sides are characters that are written without one."""
    return F.when(out == "", line).when(out.rlike(UNSPACED + "$") & line.rlike("^" + UNSPACED), F.concat(out, line)).otherwise(F.concat(out, F.lit(" "), line))


def recognised_blocks(lines: DataFrame, *keys: str, ties: tuple[str, ...] = ("text", "h")) -> DataFrame:
    """(keys, block, type, level, text) of recognised lines: tall ones are headings, wide gaps begin paragraphs.

    Blank lines don't count. Lines without a height don't either where two or more have one; where fewer do, all lines of a
    page are one paragraph, line by line.
    """
    named = lines.withColumn("text", tx.trim(F.col("text"))).filter(F.col("text") != "")
    tall = F.coalesce(F.col("h") > 0, F.lit(False))
    per = named.groupBy(*keys).agg(F.count_if(tall).alias("boxes"), F.median(F.when(tall, F.col("h"))).alias("mid"))
    sized = named.join(per, list(keys)).filter(tall | (F.col("boxes") < 2))
    w = Window.partitionBy(*keys).orderBy("y", "x", *ties)
    plain = F.col("boxes") < 2
    ratio = F.col("h") / F.col("mid")
    held = sized.withColumns({"is_head": ~plain & (ratio >= OCR_HEADING), "ratio": ratio, "pos": F.row_number().over(w)})
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(w) > GAP_LINES * F.col("mid")
    new = F.when(F.col("pos") == 1, True).when(plain, False).otherwise(gap | F.col("is_head") | F.lag("is_head").over(w))
    held = held.withColumn("block", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x.text)
    text = F.when(F.max("boxes") < 2, F.array_join(parts, "\n")).otherwise(F.aggregate(parts, F.lit(""), joined_lines))
    out = held.groupBy(*keys, "block").agg(F.max("is_head").alias("is_head"), F.max("ratio").alias("ratio"), text.alias("text"))
    level = F.when(F.col("ratio") >= 2.0, 1).when(F.col("ratio") >= 1.6, 2).otherwise(3)
    return out.select(*keys, "block", F.when(F.col("is_head"), "heading").otherwise("paragraph").alias("type"), F.when(F.col("is_head"), level).alias("level"), "text")


def is_scanned(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, scanned): fewer than 300 characters a page on average."""
    return pages.groupBy(*keys).agg((F.avg(F.length(F.regexp_replace("text", r"\s", ""))) < SCANNED_BELOW).alias("scanned"))


#: Strings and shares that make glyph noise. ``sources.containers`` uses them too.
NOISE_STRINGS, SHORT, SHORT_SHARE, LONGEST, SOLID_SHARE, ONLY_SHARE, TOP_SHARE = 8, 4, 0.6, 6, 0.85, 0.9, 0.25


def glyph_noise(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, noise): whether the strings of a document look like glyph numbers, if it has eight that are not blank.

    They do if most are short, or if they are visible ASCII without a long one, or if they are so and one character prevails.
    """
    named = texts.withColumn("text", tx.trim(F.col("text"))).filter(F.col("text") != "")
    solid = F.col("text").rlike(r"^[\x21-\x7e]+$").cast("int")
    rows = named.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.length("text") <= SHORT).cast("int")).alias("short"), F.avg(solid).alias("solid"), F.max(F.length("text")).alias("longest"))
    chars = named.select(*keys, F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).groupBy(*keys, "c").agg(F.count("*").alias("k"))
    top = chars.groupBy(*keys).agg((F.max("k") / F.sum("k")).alias("top"))
    noise = (F.col("short") >= SHORT_SHARE) | ((F.col("solid") >= SOLID_SHARE) & (F.col("longest") <= LONGEST)) | ((F.col("solid") >= ONLY_SHARE) & (F.col("top") >= TOP_SHARE))
    every = texts.select(*keys).distinct()
    found = rows.join(top, list(keys)).select(*keys, ((F.col("n") >= NOISE_STRINGS) & noise).alias("noise"))
    return every.join(found, list(keys), "left").select(*keys, F.coalesce("noise", F.lit(False)).alias("noise"))


def credible(c: Column) -> Column:
    """Whether a string of a page is text."""
    n = F.length(c)
    control = F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    shown = F.regexp_count(c, F.lit(r"[\P{C}\t\n\r]"))
    return (n > 0) & (n <= 2000) & ~c.contains("�") & (control <= 0.02 * n) & (shown >= 0.85 * n) & c.rlike(r"[\p{L}\p{N}]")


def vertical_cursor(blocks: DataFrame, size: Column, *keys: str) -> DataFrame:
    """Place of each block on a page: from 800 down by 1.6 of the sizes before."""
    before = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("y", 800 - F.coalesce(F.sum(1.6 * size).over(before), F.lit(0.0)))
