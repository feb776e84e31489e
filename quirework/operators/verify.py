"""Comparison of documents block by block, and of texts by their characters, as joins and aggregations."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import EQUALITY

# Weights of differences, the share of blocks beyond which a document is broken.
MAJOR, MINOR, STRUCTURAL, BROKEN = 0.4, 0.05, 0.5, 0.3
MAJOR_FIELDS = {"level", "ordered", "headers", "rows", "code", "language", "src", "asset_id", "format"}
SIMILAR_ENOUGH = 0.7


def equality_json(prefix: str = "") -> Column:
    """The fields of a block that count for equality, as JSON."""
    col = lambda c: F.col(f"{prefix}{c}")
    out = F.lit(None).cast("string")
    for kind, fields in EQUALITY.items():
        out = F.when(col("type") == kind, F.to_json(F.struct(col("type").alias("type"), *[col(f).alias(f) for f in fields]))).otherwise(out)
    return out


def fingerprint(prefix: str = "") -> Column:
    return tx.fnv1a(equality_json(prefix))


def model_fingerprint(blocks: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, keyed): the fingerprints of a document's blocks run together, and the same with lengths before."""
    held = blocks.select("doc_id", "block_idx", fingerprint().alias("f"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "f"))), lambda x: x.f)
    return held.groupBy("doc_id").agg(F.array_join(ordered, "").alias("fingerprint"), F.array_join(F.transform(ordered, lambda f: F.concat(F.length(f), F.lit(":"), f)), "").alias("keyed"))


def head(prefix: str = "") -> Column:
    """The first words of a block, by which a changed block is found again."""
    col = lambda c: F.col(f"{prefix}{c}")
    return F.coalesce(
        F.when(col("text").isNotNull(), tx.first_words(col("text"), 8)),
        F.when(F.size(col("items")) > 0, tx.first_words(F.get(col("items"), 0), 8)),
        F.when(F.size(col("headers")) > 0, tx.first_words(F.array_join(col("headers"), " "), 8)),
        F.when(col("code").isNotNull(), tx.first_words(F.get(F.split(col("code"), "\r?\n"), 0), 8)),
        F.when(col("src").isNotNull(), tx.first_words(col("src"), 8)),
        col("asset_id"),
        F.when(col("content").isNotNull(), tx.first_words(col("content"), 8)),
        F.lit(""),
    )


def _ranked(blocks: DataFrame, *keys: Column) -> DataFrame:
    """The n-th of equal blocks of a document has rank n: greedy matching in order is a join on it."""
    named = blocks.withColumns({f"k{i}": k for i, k in enumerate(keys)})
    w = Window.partitionBy("doc_id", *[f"k{i}" for i in range(len(keys))]).orderBy("block_idx")
    return named.withColumn("rank", F.row_number().over(w))


def align(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (doc_id, l_idx, r_idx), and the blocks of either side without a partner.

    Equal blocks pair first, n-th with n-th; then blocks of one type with equal first words, likewise. Blocks that
    carry an id of their own pair by it instead of by content.
    """
    has_id = "id" in left.columns and "id" in right.columns
    exact = F.when(F.col("id").isNotNull() & ~F.col("id").rlike("(?i)^block-[0-9]+-[a-z0-9]{8}$"), F.concat(F.lit("id:"), "id")).otherwise(F.concat(F.lit("content:"), equality_json())) if has_id else equality_json()
    keys = ["doc_id", "k0", "rank"]
    l1, r1 = _ranked(left, exact), _ranked(right, exact)
    same = l1.select(*keys, F.col("block_idx").alias("l_idx")).join(r1.select(*keys, F.col("block_idx").alias("r_idx")), keys).select("doc_id", "l_idx", "r_idx")
    rest = lambda side, pairs, name: side.join(pairs.select("doc_id", F.col(name).alias("block_idx")), ["doc_id", "block_idx"], "left_anti")
    l2, r2 = (_ranked(rest(side, same, n), F.col("type"), head()) for side, n in ((left, "l_idx"), (right, "r_idx")))
    keys = ["doc_id", "k0", "k1", "rank"]
    near = l2.select(*keys, F.col("block_idx").alias("l_idx")).join(r2.select(*keys, F.col("block_idx").alias("r_idx")), keys).select("doc_id", "l_idx", "r_idx")
    pairs = same.union(near)
    return pairs, rest(left, pairs, "l_idx"), rest(right, pairs, "r_idx")


def _severity(name: str, before: Column, after: Column) -> Column:
    if name in ("headers", "rows"):
        return F.when(F.size(before) != F.size(after), "major").otherwise("minor")
    if name in MAJOR_FIELDS:
        return F.lit("major")
    if name == "text":
        return F.when(tx.loose_key(before) == tx.loose_key(after), "minor").otherwise("major")
    return F.lit("minor")


def changes(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, l_idx, r_idx, field, severity) of every field that differs in a pair."""
    fields = sorted({f for fs in EQUALITY.values() for f in fs})
    pick = lambda side, p: side.select("doc_id", F.col("block_idx").alias(f"{p}_idx"), F.col("type").alias(f"{p}_type"), *[F.col(f).alias(f"{p}_{f}") for f in fields])
    both = pairs.join(pick(left, "l"), ["doc_id", "l_idx"]).join(pick(right, "r"), ["doc_id", "r_idx"])
    found = []
    for f in fields:
        counts = F.col("l_type").isin([k for k, fs in EQUALITY.items() if f in fs])
        before, after = F.col(f"l_{f}"), F.col(f"r_{f}")
        found.append(F.when(counts & ~before.eqNullSafe(after), F.struct(F.lit(f).alias("field"), _severity(f, before, after).alias("severity"))))
    return both.select("doc_id", "l_idx", "r_idx", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("d")).select("doc_id", "l_idx", "r_idx", "d.field", "d.severity")


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, major, minor, removed, added, score, fidelity) of documents on either side."""
    pairs, removed, added = align(left, right)
    count = lambda df, name, *keys: df.groupBy("doc_id").agg(*(keys or [F.count("*").alias(name)]))
    graded = count(changes(pairs, left, right), "", F.count_if(F.col("severity") == "major").alias("major"), F.count_if(F.col("severity") == "minor").alias("minor"))
    out = count(left, "n_blocks").join(count(right, "n_after"), "doc_id", "full").join(graded, "doc_id", "left").join(count(removed, "removed"), "doc_id", "left").join(count(added, "added"), "doc_id", "left").fillna(0)
    n = F.greatest(F.col("n_blocks"), F.lit(1))
    moved = F.col("removed") + F.col("added")
    score = tx.clamp(1 - (MAJOR * F.col("major") + MINOR * F.col("minor") + STRUCTURAL * moved) / n, 0.0, 1.0)
    same = (F.col("major") + F.col("minor") + moved) == 0
    fidelity = F.when(same, "exact").when((moved / n > BROKEN) | (F.col("n_after") == 0), "broken").when(F.col("major") > 0, "major-drift").otherwise("minor-drift")
    return out.select("doc_id", "n_blocks", "major", "minor", "removed", "added", F.round(score, 9).alias("score"), fidelity.alias("fidelity"))


def _histogram(text: str | None) -> Counter:
    """Characters of a text in compatibility form and lower case, without white space."""
    return Counter("".join(unicodedata.normalize("NFKC", text or "").lower().split()))


def overlap(pairs: DataFrame, left: str, right: str, *keys: str) -> DataFrame:
    """(keys, left_len, right_len, common, recall, precision, f1): texts of a row as multisets of characters.

    Texts are put in compatibility form (NFKC), which has no built-in; white space and case do not count. Both histograms are made
    and compared in one Arrow step, row by row, so nothing is shuffled.
    """
    rows = pairs.select(*keys, F.col(left).cast("string").alias("_l"), F.col(right).cast("string").alias("_r"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(_histogram(a), _histogram(b)) for a, b in zip(batch.column("_l").to_pylist(), batch.column("_r").to_pylist(), strict=True)]
            sums = [[a.total() for a, _ in both], [b.total() for _, b in both], [(a & b).total() for a, b in both]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x, pa.int64()) for x in sums)], names=[*keys, "left_len", "right_len", "common"])

    out = rows.mapInArrow(run, f"{kinds}, left_len long, right_len long, common long")
    empty = (F.col("left_len") == 0) & (F.col("right_len") == 0)
    share = lambda n: F.when(empty, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("common") / F.col(n))
    out = out.withColumns({"recall": share("left_len"), "precision": share("right_len")})
    total = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("recall") * F.col("precision") / total))


def equivalent(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, equal): whether documents have the same blocks in the same order."""
    whole = lambda side, name: side.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("block_idx", equality_json().alias("j"))))), 256).alias(name))
    return whole(left, "a").join(whole(right, "b"), "doc_id", "full").select("doc_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("equal"))
