"""Lookups between parts of packages as joins: relationships, shared strings, styles, notes, numbering, spines, fonts, assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def by_relationship(refs: DataFrame, relations: DataFrame) -> DataFrame:
    """Parts that references (doc_id, part, rel_id) point to, by relations (doc_id, part, rel_id, target): (…, path)."""
    return refs.join(relations, ["doc_id", "part", "rel_id"]).withColumn("path", tx.resolve_path(F.col("part"), F.col("target")))


def by_index(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells (doc_id, idx) with the shared string (doc_id, idx, text) of their number; none is empty text."""
    return cells.join(strings.select("doc_id", "idx", F.col("text").alias("value")), ["doc_id", "idx"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def dated(cells: DataFrame, styles: DataFrame, formats: DataFrame) -> DataFrame:
    """Cells (doc_id, style) with is_date: style -> number format -> its code shows a year or a day."""
    codes = styles.join(formats, ["doc_id", "format_id"], "left").select("doc_id", "style", tx.is_date_format(F.col("code")).alias("is_date"))
    return cells.join(codes, ["doc_id", "style"], "left").withColumn("is_date", F.coalesce("is_date", F.lit(False)))


def notes(refs: DataFrame, texts: DataFrame) -> DataFrame:
    """References (doc_id, note_id) that have a note (doc_id, note_id, text), with it."""
    return refs.join(texts.filter(F.col("text") != ""), ["doc_id", "note_id"])


def ordered_numbers(numbers: DataFrame, abstract: DataFrame) -> DataFrame:
    """Numberings (doc_id, num_id, abstract_id) whose abstract one (doc_id, abstract_id, format) is decimal."""
    return numbers.join(abstract.filter("format = 'decimal'"), ["doc_id", "abstract_id"], "left_semi")


def spine(refs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, place, href): a book's references (doc_id, pos, item_id) that are in its manifest (doc_id, item_id, href), in order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return refs.join(items, ["doc_id", "item_id"]).select("doc_id", place.alias("place"), "href")


def with_default(rows: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """Rows (doc_id, key) with the map of that name; a document with one map only has it for all names."""
    single = maps.groupBy("doc_id").agg(F.when(F.count("*") <= 1, F.first("map")).alias("only"))
    return rows.join(maps, ["doc_id", key], "left").join(single, "doc_id", "left").withColumn("map", F.coalesce("map", "only")).drop("only")


def with_assets(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Blocks with the data of the asset that they name; others keep null. Data stay unread unless selected."""
    return blocks.join(assets.select("doc_id", "asset_id", "mime", "data"), ["doc_id", "asset_id"], "left")


def with_formulas(cells: DataFrame, formulas: DataFrame) -> DataFrame:
    """Cells with the formula (doc_id, ref, formula) of their reference, whatever its case."""
    named = formulas.select("doc_id", F.upper("ref").alias("_ref"), "formula")
    return cells.withColumn("_ref", F.upper("ref")).join(named, ["doc_id", "_ref"], "left").drop("_ref")


def directory_errors(entries: DataFrame, central: DataFrame) -> DataFrame:
    """(doc_id, name, missing_in): names that either an archive's entries or its central directory lacks."""
    a, b = entries.select("doc_id", "name", F.lit(1).alias("e")).distinct(), central.select("doc_id", "name", F.lit(1).alias("c")).distinct()
    both = a.join(b, ["doc_id", "name"], "full").filter("e is null or c is null")
    return both.select("doc_id", "name", F.when(F.col("e").isNull(), "entries").otherwise("directory").alias("missing_in"))


def dropped_characters(texts: DataFrame, kept: str, *keys: str, most: int = 10) -> DataFrame:
    """(keys, ch, n): characters outside a class (a regular expression) and how often they are; the most frequent of each key."""
    found = texts.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(f"[^{kept}]"), F.lit(0))).alias("ch")).groupBy(*keys, "ch").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "ch"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
