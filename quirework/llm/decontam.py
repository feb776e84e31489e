"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A benchmark item gives windows of ``width`` consecutive words; an item of fewer
words is one window. A window can only occur where its rarest word does, so
that word alone, with its offset, is the necessary prefix: windows order their
words by frequency over all documents, document words join with the rarest
ones, window length and offset bound the place, and the words at that place
are compared with the window. (Words are exploded by the outer variant: for the
inner one the optimizer adds a filter on their number, which splits each text twice.)

Cases: null and empty texts have no words and no hits; an item without words
has no window; repeated rows get equal results; rows with one id and other
texts are judged apart; windows that several items share count for each; empty
tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTH = 10
#: Fixed value: what parts words after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of all windows up to which the benchmark's side of a join is sent to all tasks; beyond, both sides are shuffled.
SENT_BYTES = 40 << 20
#: A word is hot if it is over one in so many of all words of the documents, so there are no more hot words than that.
SHARE = 1000


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item_id): distinct windows of all items."""
    own = items.select(items[id_col].alias("item_id"), words(items[text_col].cast("string")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    return own.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))).select(F.slice("w", F.col("at"), size).alias("window"), "item_id").distinct()


def _sent(small: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(small) if fits else small


def prefixes(docs: DataFrame, win: DataFrame, fits: bool) -> DataFrame:
    """(word, offset, window, len): the rarest word of each distinct window over ``docs`` (a column ``w`` of words)."""
    distinct = win.select("window").distinct()
    parts = distinct.select("window", F.posexplode("window").alias("offset", "word"))
    words_ = docs.select(F.explode_outer("w").alias("word"))
    if fits:
        seen = words_.join(F.broadcast(parts.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:  # counted first, so that no frequent word is shuffled by each of its places
        seen = words_.groupBy("word").agg(F.count("*").alias("n"))
    rare = parts.join(seen, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p"))
    # A word that no document has rules its window out.
    return rare.filter("p.n > 0").select("p.word", "p.offset", "window", F.size("window").alias("len"))


def _candidates(docs: DataFrame, prefix: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, word): places of the prefixes' words. Hot words are told apart before anything is shuffled."""
    named = cut(prefix.select("word").distinct().withColumn("prefix", F.lit(True)), "prefix-words")
    counts = docs.select(F.explode_outer("w").alias("word")).filter("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") > total // SHARE).join(named, "word", "left").select("word", F.coalesce("prefix", F.lit(False)).alias("hot_prefix"))
    places = docs.select("doc_id", "digest", F.posexplode_outer("w").alias("pos", "word")).join(F.broadcast(hot), "word", "left")
    at = ["doc_id", "digest", "pos", "word"]
    return places.filter("hot_prefix is null").join(named, "word", "left_semi").select(*at).union(places.filter("hot_prefix").select(*at))


def hits(docs: DataFrame, prefix: DataFrame, fits: bool, width: int = WIDTH) -> DataFrame:
    """(key columns of docs, window, start, len) of every occurrence; ``docs`` has doc_id, digest and words ``w``."""
    start = F.col("pos") - F.col("offset")
    if fits:
        at = docs.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("pos", "word")).join(F.broadcast(prefix), "word")
        bounded = at.filter((start >= 0) & (start + F.col("len") <= F.size("w")))
        found = bounded.filter(F.slice("w", start + 1, F.col("len")) == F.col("window"))
        return found.select("doc_id", "digest", "window", start.alias("start"), "len")
    # Both sides are shuffled: words alone at first, then the places of prefixes with as many neighbours as a window reaches.
    places = _candidates(docs, prefix).groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("places"))
    places = places.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "places")
    here = docs.join(places, docs.doc_id.eqNullSafe(F.col("d")) & (docs.digest == F.col("g"))).select("doc_id", "digest", "w", F.explode("places").alias("pos"))
    first = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    near = here.select("doc_id", "digest", "pos", F.get("w", F.col("pos")).alias("word"), first.alias("first"), F.slice("w", first + 1, F.lit(2 * width - 1)).alias("near"))
    at = near.join(prefix, "word").filter((start >= F.col("first")) & (start + F.col("len") <= F.col("first") + F.size("near")))
    found = at.filter(F.slice("near", start - F.col("first") + 1, F.col("len")) == F.col("window"))
    return found.select("doc_id", "digest", "window", start.alias("start"), "len")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, sent: int = SENT_BYTES) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, item_ids sorted as strings) of every distinct row."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    keyed = base.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    split = keyed.select("doc_id", "digest", words(F.col("text")).alias("w"))
    win = cut(windows(items, item_col, item_text, width), "windows")
    size = F.octet_length(F.array_join("window", " ")) + F.octet_length(F.col("item_id").cast("string"))
    fits = (win.agg(F.sum(size)).first()[0] or 0) <= sent
    prefix = cut(prefixes(split, win, fits), "prefixes")
    found = cut(hits(split, prefix, fits, width), "hits")
    places = found.select("doc_id", "digest", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos"))
    covered = places.distinct().groupBy("doc_id", "digest").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "digest", "window").distinct().join(_sent(win, fits), "window")
    listed = named.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    tally = covered.join(listed, (covered.doc_id.eqNullSafe(listed.doc_id)) & (covered.digest == listed.digest)).select(covered.doc_id, covered.digest, "n_hit", "item_ids")
    rows = split.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"))
    joined = rows.join(tally, rows.doc_id.eqNullSafe(tally.doc_id) & (rows.digest == tally.digest), "left")
    return joined.select(rows.doc_id, rows.digest, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` occurs, all columns as they are."""
    bad = contamination(docs, items).filter("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest"))
    same = docs.doc_id.eqNullSafe(bad.bad_id) & (F.xxhash64(docs.text.cast("string")) == bad.bad_digest)
    return docs.join(bad, same, "left_anti")
