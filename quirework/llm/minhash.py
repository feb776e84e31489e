"""MinHash near-dedup by min-max hashing, with exact confirmation on full shingle sets.

Each permutation of the hashed shingles gives its minimum and its maximum, so
128 values cost 64 hash evaluations a shingle. Bands of four values put
documents into buckets; at the similarity of 0.75 a pair shares fewer than two of
32 bands in 8 of 100,000 cases, at 0.8 in one of a million. Documents with equal shingle sets are one class before.

Buckets are resolved without the pairs of their documents: in a round each
bucket names its largest component as the pivot, later some others as well, the other components of the
bucket are compared with them on full shingle sets, and links unite components; in the last round all that are
left are compared. Single documents are compared by sketches of 512 values inside the join of
bucket mates, and only pairs that may be linked come out of it. A bucket ends when every two
of its components have been compared, so no other link between mates is lost. Large
pivots and their partners are cut into blocks of bounded size.

Cases: null, empty or blank texts have no shingles and stand alone; texts with
fewer words than a shingle have one; repeated rows get equal results; rows
with one id and several texts count as one document with all their links; null
ids stay apart from links of their own and are kept only without a twin; ids that are
no whole numbers are compared as they are for the smallest of a component; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, only, steps
from .components import lookup, merge
from .shingles import mix, shingle_sets

WIDTH = 5
#: Link if 100 * common >= LINK * united.
LINK = 75
PERMUTATIONS, BANDS = 64, 32
#: Rounds with one pivot a bucket; then all pairs of components are looked at, if these are at most so many for each
#: place in a bucket, or else those of four times as many pivots in every round.
PIVOT_TURNS, PAIRS_PER_SLOT = 3, 64
#: Shingles of one side in a block of comparisons.
BLOCK = 400_000

_RNG = np.random.default_rng(74_207_281)
_A = _RNG.integers(1, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND = _RNG.integers(1, 2**62, (BANDS, 5), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Values of the wide sketch of documents that share a bucket, and how many of them must agree before two single
#: documents are compared: 4 standard deviations less than at the threshold (31 of 1,000,000 pairs there).
WIDE, AGREE = 512, 353
_WIDE_A = _RNG.integers(1, 2**62, WIDE // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE_B = _RNG.integers(0, 2**63, WIDE // 2, dtype=np.uint64)
_SHINGLES_AT_ONCE = 1024
_BYTES_AT_ONCE = 1 << 20


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of all permutations, then maxima."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, shingles.size, _SHINGLES_AT_ONCE):
        h = _A[:, None] * shingles[None, at : at + _SHINGLES_AT_ONCE] + _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate([low, high])


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    """Four bits of each of WIDE minima and maxima, packed in 64-bit words."""
    values = []
    for part in range(0, WIDE // 2, PERMUTATIONS):
        a, b = _WIDE_A[part : part + PERMUTATIONS, None], _WIDE_B[part : part + PERMUTATIONS, None]
        low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
        for at in range(0, shingles.size, _SHINGLES_AT_ONCE):
            h = a * shingles[None, at : at + _SHINGLES_AT_ONCE] + b
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        values += [low, high]
    nibbles = (mix(np.concatenate(values)) & np.uint64(15)).reshape(-1, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=_BYTES_AT_ONCE):
        sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], WIDTH)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([wide_sketch(s) for s in sets], pa.list_(pa.int64()))], names=["node", "sketch"])


def _agree(x: str, y: str) -> Column:
    """How many of WIDE values two sketches have in common."""
    differ = None
    for k in range(WIDE // 16):
        z = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = F.bit_count(z) if differ is None else differ + F.bit_count(z)
    return F.lit(WIDE) - differ


def bands(values: np.ndarray) -> np.ndarray:
    """Band j: two minima and the maxima of the next two permutations."""
    low, high = values[:PERMUTATIONS].reshape(BANDS, 2), values[PERMUTATIONS:].reshape(BANDS, 2)
    rows = np.concatenate([low, np.roll(high, -1, axis=0)], axis=1)
    return mix((rows * _BAND[:, :4]).sum(axis=1, dtype=np.uint64) + _BAND[:, 4]).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, most=_BYTES_AT_ONCE):
        sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()], WIDTH)
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
        keys = [bands(signature(s)) if s.size else None for s in sets]
        cols = [pa.array([s.size for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_shingles", "digest", "bands"])


def compare(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """For each right set one left set that it is linked with, if there is any."""
    ids = np.array([i for i, _ in left])
    size = np.array([s.size for _, s in left])
    flat = np.concatenate([s for _, s in left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(left)), size)[order]
    out = []
    for i, s in right:
        a, b = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = b - a
        total = int(n.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(a - (np.cumsum(n) - n), n)
        common = np.bincount(owner[at], minlength=len(left))
        linked = np.flatnonzero(100 * common >= LINK * (size + s.size - common))
        if linked.size:
            out.append((int(ids[linked[0]]), i))
    return out


def _compared(key, left: pa.Table, right: pa.Table) -> pa.Table:
    def sets(t: pa.Table) -> list[tuple[int, np.ndarray]]:
        texts = [x.encode() for x in t["text"].to_pylist()]
        return list(zip(t["node"].to_pylist(), shingle_sets(texts, WIDTH), strict=True))

    found = compare(sets(left), sets(right)) if left.num_rows and right.num_rows else []
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _links(pairs: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of the components (c1, c2) of ``pairs``: for each member of c2 one in each block of c1."""
    named = pairs.select(F.col("c1").alias("comp")).union(pairs.select("c2")).distinct()
    members = labels.join(named, "comp").join(texts, "node")
    left = members.withColumnRenamed("comp", "c1").join(pairs.select("c1").distinct(), "c1", "left_semi")
    right = pairs.join(members.withColumnRenamed("comp", "c2"), "c2").select("c1", "node", "text", "n_shingles")
    blocks = lambda side, name: side.groupBy("c1").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias(name))
    size = blocks(left.select("c1", "n_shingles"), "n1").join(blocks(right.select("c1", "n_shingles"), "n2"), "c1")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = left.join(size, "c1").withColumn("b1", own("n1")).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    right = right.join(size, "c1").withColumn("b2", own("n2")).withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
    keys, cols = ["c1", "b1", "b2"], ["c1", "b1", "b2", "node", "text"]
    left, right = (side.select(*[F.col(c).alias(f"{c}_{k}") for c in cols]).toDF(*cols) for k, side in enumerate((left, right)))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    spark = docs.sparkSession
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        return _by_other_ids(docs, id_col, text_col)
    base = only(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut(base.mapInArrow(_signed, "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")
    classes = signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes, "classes")
    slots = classes.filter("rep is not null").select(F.col("rep").alias("node"), F.explode("bands").alias("bucket")).distinct()
    shared = slots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    slots = cut(slots.join(shared, "bucket"), "slots")
    labels = cut(slots.select("node").distinct().select("node", F.col("node").alias("comp")), "labels")
    sizes = signed.groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n_shingles"))
    texts = base.withColumnRenamed("doc_id", "node").filter("text is not null")
    texts = cut(texts.join(labels.select("node"), "node", "left_semi").join(sizes, "node"), "texts")
    done = spark.createDataFrame([], "bucket long, comp long, size long")
    all_slots = slots.count()
    sketches = cut(texts.select("node", "text").mapInArrow(_wide, "node long, sketch array<long>"), "sketches")
    one_text = sketches.groupBy("node").agg(F.first("sketch").alias("sketch"), F.count("*").alias("n")).filter("n = 1")  # others are always compared
    for turn in itertools.count():
        sized = labels.groupBy("comp").agg(F.count("*").alias("size"))
        held = slots.join(labels, "node").select("bucket", "comp").distinct().join(sized, "comp")
        held = held.join(done, ["bucket", "comp", "size"], "left_anti")
        held = cut(held, "held")
        many = held.groupBy("bucket").agg(F.count("*").alias("k"), F.max(F.struct("size", "comp")).alias("top")).filter("k > 1")
        many = cut(many.withColumn("n", F.col("k")), "many")
        left = many.agg(F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()[0]
        if not left:
            drop(held, many)
            break
        ranked = cut(lookup(held, many, ["bucket"], "n"), "ranked")
        last = turn >= PIVOT_TURNS and left <= PAIRS_PER_SLOT * all_slots
        more = 4 ** max(0, turn + 1 - PIVOT_TURNS)
        pivots = ranked
        if not last:
            chosen = F.col("comp") == F.col("top.comp")
            pivots = ranked.filter(chosen | (F.pmod(F.xxhash64(F.lit(turn), "comp"), "k") < more) if more > 1 else chosen)
        pivots = pivots.select("bucket", F.col("comp").alias("c1"), F.col("size").alias("s1"))
        named = lambda c, x: one_text.select(F.col("node").alias(c), F.col("sketch").alias(x))
        # Of two pivots the larger is compared with the other.
        both = F.struct("s1", "c1") > F.struct("size", "comp") if last else F.col("c1") != F.col("comp")
        alike = (F.col("s1") > 1) | (F.col("size") > 1) | F.col("x").isNull() | F.col("y").isNull() | (_agree("x", "y") >= AGREE)
        if last or more > 1:  # sketches are in the join, so that only pairs that may be linked come out of it
            met = pivots.join(named("c1", "x"), "c1", "left").join(ranked.select("bucket", "comp", "size").join(named("comp", "y"), "comp", "left"), "bucket").filter(both & alike)
        else:  # the one pivot of a bucket stands in each of its rows
            met = ranked.select("bucket", "comp", "size", F.col("top.comp").alias("c1"), F.col("top.size").alias("s1")).filter(both)
            met = met.join(named("c1", "x"), "c1", "left").join(named("comp", "y"), "comp", "left").filter(alike)
        pairs = met.select("c1", F.col("comp").alias("c2")).distinct()
        pairs = cut(pairs.select("c1", "c2"), "pairs")
        links = cut(_links(pairs, labels, texts), "links")
        if not links.isEmpty():
            labels = cut(merge(labels, links), "labels")
        if last:
            drop(texts, slots, held, many, ranked, pairs, links, sketches)
            break
        done = cut(done.union(pivots.select("bucket", F.col("c1").alias("comp"), F.col("s1").alias("size"))), "done")
        drop(held, many, ranked, pairs, links)
    known = classes.select("digest", "rep").join(labels.select(F.col("node").alias("rep"), "comp"), "rep", "left")
    found = signed.select("doc_id", "n_shingles", "digest").join(known.select("digest", "rep", "comp"), "digest", "left")
    found = found.withColumn("component_id", F.coalesce("comp", "rep", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _by_other_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates of ids that are no whole numbers: by their hashes, with the smallest id of each component as its name."""
    named = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[id_col]).alias("hash"), docs[text_col].alias("text"))
    found = cut(near_duplicates(named.withColumn("hash", F.when(F.col("doc_id").isNotNull(), F.col("hash"))), "hash", "text"), "by-hash")
    ids = named.filter("doc_id is not null").select("hash", "doc_id").distinct()
    of = found.select(F.col("doc_id").alias("hash"), "component_id").distinct().join(ids, "hash")
    least = of.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    out = found.join(ids, found.doc_id == ids.hash, "left").select(ids.doc_id, "n_shingles", "component_id").join(least, "component_id", "left")
    kept = F.coalesce(F.col("doc_id") == F.col("least"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, all columns as they are.

    Of rows that repeat id and text any one stays; of an id with several texts one text, by its hash; rows without an id stay
    if their text, up to shingles, has no row with an id, and then one of those with that text.
    """
    text = docs.withColumn("_text", F.xxhash64(docs.text.cast("string")))
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    first = text.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_text").alias("_text")).join(kept, "doc_id")
    named = text.filter("doc_id is not null").join(first, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return named.select(*docs.columns)
    # Texts without ids as documents of their own, named by a hash, after all that have one.
    some = docs.filter("doc_id is not null").select(F.lit("0").alias("doc_id"), "text")
    lonely = text.filter("doc_id is null").select(F.concat(F.lit("1"), F.col("_text")).alias("doc_id"), "text")
    stay = near_duplicates(some.union(lonely)).filter("kept and doc_id <> '0'").select(F.expr("try_cast(substring(doc_id, 2) AS bigint)").alias("_text")).distinct()
    stay = text.filter("doc_id is null").join(stay, "_text", "left_semi").dropDuplicates(["_text"])
    return named.select(*docs.columns).unionByName(stay.select(*docs.columns))
