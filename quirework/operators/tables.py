"""Workbook, slide and list operators: cells, names, dictionaries, grouping at headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def cells(rows: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """(sheet, row, col, ref, value, is_number) of a table; row 0 holds the first data row."""
    row = F.row_number().over(Window.partitionBy(sheet).orderBy(order)) - 1
    values = F.posexplode(F.array(*[tx.text(F.col(c)) for c in columns])).alias("col", "value")
    out = rows.withColumn("row", row).select(F.col(sheet).alias("sheet"), "row", values)
    return out.select("sheet", "row", "col", F.concat(tx.column_letters(F.col("col")), (F.col("row") + 2).cast("string")).alias("ref"), "value", tx.is_strict_number(F.col("value")).alias("is_number"))


def dictionary(values: DataFrame, value: str, pos: str) -> DataFrame:
    """(value, idx): distinct values numbered from 0 by their first place.

    Numbers are dealt within ranges of places and offset by the ranges before, so no task sorts all values.
    """
    first = values.groupBy(value).agg(F.min(pos).alias("first"))
    size = 1 << 16
    held = first.withColumn("range", F.floor(F.col("first") / size))
    counts = held.groupBy("range").agg(F.count("*").alias("n"))
    offset = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("first")) - 1
    return held.withColumn("inside", inside).join(offset, "range").select(value, (F.col("offset") + F.col("inside")).alias("idx"))


def sheet_names(sheets: DataFrame, name: str, order: str, *keys: str) -> DataFrame:
    """Legal sheet names; the n-th of equal ones, without regard to case, gets n and stays within 31 characters.

    A name that is given as another's numbered form can collide; packages resolve those while writing.
    """
    legal = sheets.withColumn("legal", tx.sheet_name(F.col(name)))
    nth = F.row_number().over(Window.partitionBy(*keys, F.lower("legal")).orderBy(order))
    tail = F.concat(F.lit(" "), F.col("nth").cast("string"))
    out = F.when(F.col("nth") == 1, F.col("legal")).otherwise(F.concat(F.substr("legal", F.lit(1), 31 - F.length(tail)), tail))
    return legal.withColumn("nth", nth).withColumn("sheet_name", out).drop("legal", "nth")


def key_union(docs: DataFrame, json: str, order: str) -> DataFrame:
    """(key, place): all keys of JSON objects in the order in which they come first."""
    keys = docs.select(F.col(order).alias("row"), F.posexplode(F.json_object_keys(json)).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("row", "pos")).alias("first"))
    return first.select("key", F.row_number().over(Window.orderBy("first")).alias("place"))


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[tx.csv_cell(v) for v in values])


def list_counter(items: DataFrame, *keys: str) -> DataFrame:
    """Numbers of ordered items: those of depth 0 count up, nested ones don't."""
    w = Window.partitionBy(*keys).orderBy("item_idx").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("number", F.when(F.col("depth") == 0, F.sum((F.col("depth") == 0).cast("int")).over(w)))


def merge_lists(blocks: DataFrame, *keys: str) -> DataFrame:
    """Neighbouring lists of one kind as one; rows are (keys, block_idx, type, ordered, items)."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    same = (F.col("type") == "list") & (F.lag("type").over(w) == "list") & (F.col("ordered") == F.lag("ordered").over(w))
    held = blocks.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    items = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "items"))), lambda x: x["items"]))
    return held.groupBy(*keys, "run").agg(F.min("block_idx").alias("block_idx"), F.first("type").alias("type"), F.first("ordered").alias("ordered"), items.alias("items")).drop("run")


def slides(blocks: DataFrame, is_title: Column, *keys: str) -> DataFrame:
    """Blocks with the number of the slide that they are on: a title begins one; what comes before the first is on slide 1."""
    w = Window.partitionBy(*keys).orderBy("block_idx")
    return blocks.withColumn("slide", F.greatest(F.sum(is_title.cast("int")).over(w), F.lit(1)))


def slide_summary(shapes: DataFrame, notes: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_slides, n_shapes, n_notes) of shapes (keys, slide, ...) and notes (keys, slide, notes), one row a slide; empty notes don't count."""
    count = shapes.groupBy(*keys).agg(F.count("*").alias("n_shapes"))
    held = notes.groupBy(*keys).agg(F.count("*").alias("n_slides"), F.count_if(F.coalesce("notes", F.lit("")) != "").alias("n_notes"))
    return held.join(count, list(keys), "left").select(*keys, "n_slides", F.coalesce("n_shapes", F.lit(0)).cast("long").alias("n_shapes"), "n_notes")


def semantic_to_workbook(blocks: DataFrame) -> DataFrame:
    """(doc_id, sheet_idx, name, headers, rows): tables of a document as its sheets."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_idx"))
    return blocks.filter("type = 'table'").withColumn("sheet_idx", place).select("doc_id", "sheet_idx", F.concat(F.lit("Sheet "), F.col("sheet_idx").cast("string")).alias("name"), "headers", "rows")


def workbook_to_semantic(sheets: DataFrame) -> DataFrame:
    """(doc_id, block_idx, type, level, text, headers, rows): each sheet as a heading and a table."""
    head = F.struct(F.lit("heading").alias("type"), F.lit(2).alias("level"), F.col("name").alias("text"), F.lit(None).cast("array<string>").alias("headers"), F.lit(None).cast("array<array<string>>").alias("rows"))
    body = F.struct(F.lit("table").alias("type"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("text"), F.col("headers"), F.col("rows"))
    return sheets.select("doc_id", "sheet_idx", F.posexplode(F.array(head, body)).alias("k", "b")).select("doc_id", (2 * (F.col("sheet_idx") - 1) + F.col("k")).alias("block_idx"), "b.*")


def slides_to_semantic(shapes: DataFrame) -> DataFrame:
    """(doc_id, block_idx, type, level, text) of (doc_id, slide, shape, text): first shapes are headings."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("slide", "shape")) - 1
    first = F.row_number().over(Window.partitionBy("doc_id", "slide").orderBy("shape")) == 1
    return shapes.withColumn("first", first).select("doc_id", place.alias("block_idx"), F.when(F.col("first"), "heading").otherwise("paragraph").alias("type"), F.when(F.col("first"), 2).alias("level"), "text")


def chunk_lines(docs: DataFrame, content: str = "content", most: int = 120) -> DataFrame:
    """(doc_id, chunk, start_line, end_line, text): pieces of at most ``most`` lines."""
    lines = docs.select("doc_id", F.split(tx.normalize_newlines(F.col(content)), "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(0), F.size("lines") - 1, F.lit(most))
    held = lines.select("doc_id", "lines", F.posexplode(starts).alias("chunk", "start"))
    end = F.least(F.col("start") + most, F.size("lines"))
    return held.select("doc_id", "chunk", (F.col("start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("start") + 1, F.lit(most)), "\n").alias("text"))


def merge_chunks(parts: DataFrame) -> DataFrame:
    """Blocks of chunks (doc_id, chunk, block_idx, ...) under one numbering per document."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk", "block_idx")) - 1
    return parts.withColumn("block_idx", place).drop("chunk")


def best(rows: DataFrame, value: Column, order: Column, *keys: str) -> DataFrame:
    """(keys, best): the value that ranks highest: engines by priority, rotations by confidence, encodings by score."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias("best"))
