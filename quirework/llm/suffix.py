"""Repeated byte passages: prefix-free parsing into phrases, a dictionary of phrases, and their common contexts.

Every byte inside a string of ``SPAN`` bytes that also starts elsewhere, in the
same text or another, goes. Matches never cross texts.

1. Parse: a rolling hash of ``GRAM`` bytes has its smallest value in each window of SPAN bytes at its trigger.
   Windows with one trigger make a phrase; phrases overlap, so every window is inside one, and equal windows
   have equal triggers at equal offsets, wherever they stand. Equal phrases in a row, as periodic text has them, are one run.
2. Dictionary: phrases whose trigger occurs once in all texts are done. Equal phrases are counted once; one
   that occurs twice is repeated whole.
3. Triggers with several phrases: the suffixes of the parse, each of which begins at a trigger, are sorted, and so are
   the parts of phrases before it, read backwards. A suffix of the corpus that begins o bytes before a trigger is ordered by
   these o bytes of the dictionary and then by the rank of the parse's suffix; a window is repeated if that of a neighbour in
   this order has as much in common as the window is long, which two arrays of common prefixes tell.
4. Repeated windows of a phrase go to all its places, and each text drops its bytes.

The order is made trigger by trigger, as windows with other triggers differ, and to the depth of a window, as nothing
beyond is asked for: so it is partitioned, where one order of all suffixes would not be. Of triggers with over
``MOST`` phrases, whose group has no bound, windows are counted by 128 bits of hash instead, with the same result.

Cases: null and empty texts and those shorter than SPAN lose nothing; repeated rows are copies of one another;
rows with one id and other texts are judged apart; overlaps count; texts of any length are parsed in segments
that overlap by a window; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, only, steps
from .components import lookup
from .shingles import mix

SPAN, GRAM = 200, 64
#: Distinct phrases of a trigger that are sorted in one task; bytes of phrases that are sorted at once.
MOST, AT_ONCE = 4096, 2 << 20
_PLACES = SPAN - GRAM + 1
#: Bytes of a flat array, so that a place in it takes 20 bits; window starts of a segment.
_FLAT, _SEGMENT = 1 << 20, 1 << 18
_LOW = np.uint64(_FLAT - 1)
_RNG = np.random.default_rng(43_112_609)
_BYTE = _RNG.integers(1, 2**62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 4 + 3
_POWER = np.cumprod(np.append(np.uint64(1), np.full(_FLAT, _BASE, np.uint64)))
_INVERSE = np.cumprod(np.append(np.uint64(1), np.full(_FLAT, pow(_BASE, -1, 2**64), np.uint64)))


def phrases(flat: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of the texts that end at ``ends`` in one flat array: first window, windows, trigger, hashes of trigger and phrase."""
    total = flat.size
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[flat] * _POWER[:total], dtype=np.uint64))
    grams = total - GRAM + 1
    n = total - SPAN + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return {"lo": empty, "n": empty, "at": empty, "a": empty, "u": empty}
    h = mix((sums[GRAM:] - sums[:grams]) * _INVERSE[:grams])
    key = (h & ~_LOW) | np.arange(grams, dtype=np.uint64)
    blocks = -(-grams // _PLACES)
    padded = np.full(blocks * _PLACES, 2**64 - 1, np.uint64)
    padded[:grams] = key
    square = padded.reshape(blocks, _PLACES)
    before = np.minimum.accumulate(square, axis=1).ravel()
    after = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[:n], before[_PLACES - 1 : _PLACES - 1 + n])
    at = (low & _LOW).astype(np.int64)
    good = np.ones(n, bool)
    for end in ends[ends < total].tolist():
        good[max(0, end - SPAN + 1) : end] = False
    new = good.copy()
    new[1:] &= ~good[:-1] | (at[1:] != at[:-1])
    lo = np.flatnonzero(new)
    stop = np.append(lo, n)[1:]
    bad = np.append(np.flatnonzero(~good), n)
    stop = np.minimum(stop, bad[np.searchsorted(bad, lo)])
    count = stop - lo
    at = at[lo]
    whole = (sums[stop + SPAN - 1] - sums[lo]) * _INVERSE[lo]
    u = mix(whole + (count * 1024 + (at - lo)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {"lo": lo, "n": count, "at": at, "a": h[at].view(np.int64), "u": u.view(np.int64)}


def _segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, list[int]]]:
    """Flat pieces of up to _FLAT bytes: for each segment its text and offset there, the bytes, and its end."""
    rows, offsets, parts, ends, size = [], [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - SPAN + 1), _SEGMENT):
            part = text[at : at + _SEGMENT + SPAN - 1]
            if len(part) < SPAN:
                continue
            if size + len(part) > _FLAT:
                yield rows, offsets, b"".join(parts), ends
                rows, offsets, parts, ends, size = [], [], [], [], 0
            size += len(part)
            rows.append(row)
            offsets.append(at)
            parts.append(part)
            ends.append(size)
    if parts:
        yield rows, offsets, b"".join(parts), ends


def _parsed(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Phrases of texts: row, first window in the text, windows, offset of the trigger from it, hashes."""
    out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in ("row", "lo", "n", "off", "a", "u")}
    for rows, offsets, data, ends in _segments(texts):
        got = phrases(np.frombuffer(data, np.uint8), np.array(ends))
        segment = np.searchsorted(np.array(ends), got["lo"], "right")
        base = np.append(0, ends)[segment]
        out["row"].append(np.array(rows, np.int64)[segment])
        out["lo"].append(got["lo"] - base + np.array(offsets, np.int64)[segment])
        out["off"].append(got["at"] - got["lo"])
        for k in ("n", "a", "u"):
            out[k].append(got[k])
    return {k: np.concatenate(v) for k, v in out.items()}


def _triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        a, n = np.unique(_parsed([(t or "").encode() for t in batch.column("text").to_pylist()])["a"], return_counts=True)
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "c": pa.array(n, pa.int64())})


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of equal phrases: ``r`` of them, each of ``n`` windows."""
    for batch in steps(batches):
        got = _parsed([(t or "").encode() for t in batch.column("text").to_pylist()])
        new = np.ones(got["a"].size, bool)
        new[1:] = (got["lo"][1:] != got["lo"][:-1] + got["n"][:-1]) | np.any([got[k][1:] != got[k][:-1] for k in ("row", "a", "u", "n", "off")], axis=0)
        first = np.flatnonzero(new)
        runs = np.diff(np.append(first, new.size))
        row = pa.array(got["row"][first])
        cols = [batch.column("doc_id").take(row), batch.column("digest").take(row), *(pa.array(got[k][first], pa.int64()) for k in ("a", "u", "lo"))]
        cols += [*(pa.array(got[k][first], pa.int32()) for k in ("n", "off")), pa.array(runs, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "a", "u", "lo", "n", "off", "r"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with phrases to look at as they are; of others what the result says."""
    for batch in steps(batches):
        texts, some = batch.column("text").to_pylist(), batch.column("some").to_pylist()
        raw = [(t or "").encode() for t in texts]
        cols = [batch.column("doc_id"), batch.column("digest"), pa.array([t if s else None for t, s in zip(texts, some, strict=True)], pa.string())]
        cols += [pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "text", "n_bytes", "sha"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases at places of a text, with their bytes."""
    for batch in steps(batches):
        out: dict[str, list] = {k: [] for k in ("a", "u", "m", "large", "off", "bytes")}
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            data = text.encode()
            for p in places:
                for col, value in zip(out.values(), (p["a"], p["u"], p["m"], p["large"], p["off"], data[p["lo"] : p["lo"] + p["n"] + SPAN - 1]), strict=True):
                    col.append(value)
        kinds = {"a": pa.int64(), "u": pa.int64(), "m": pa.int64(), "large": pa.bool_(), "off": pa.int32(), "bytes": pa.binary()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _sorted(a: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by group and bytes, and what each has in common with the one before it in the order: -1 with another group's."""
    n = len(strings)
    size = np.array([len(x) for x in strings])
    held = np.zeros((n, 8 + width + 2), np.uint8)
    held[:, :8] = a.astype(">u8").view(np.uint8).reshape(n, 8)
    held[:, 8 : 8 + width] = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in strings), np.uint8).reshape(n, width)
    held[:, 8 + width :] = (size + 1).astype(">u2").view(np.uint8).reshape(n, 2)  # of strings that are equal but for zeros at the end, the shorter one first
    order = np.argsort(held.view(f"S{held.shape[1]}").ravel(), kind="stable")
    text, size, a = held[order, 8 : 8 + width], size[order], a[order]
    differ = np.concatenate([text[1:] != text[:-1], np.ones((max(n - 1, 0), 1), bool)], axis=1)
    common = np.full(n, -1)
    common[1:] = np.where(a[1:] == a[:-1], np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1])), -1)
    return order, common


def neighbours(a: np.ndarray, off: np.ndarray, phrases: list[bytes], m: np.ndarray) -> np.ndarray:
    """For each distinct phrase (rows) and offset of a window's start before the trigger (columns), whether that window is repeated."""
    n = len(phrases)
    tails = [x[o:][:SPAN] for x, o in zip(phrases, off.tolist(), strict=True)]
    heads = [x[:o][::-1] for x, o in zip(phrases, off.tolist(), strict=True)]
    windows = np.array([len(x) for x in phrases]) - SPAN + 1
    by_tail, tail_common = _sorted(a, tails, SPAN)
    by_head, head_common = _sorted(a, heads, _PLACES - 1)
    rank = np.empty(n, np.int64)
    rank[by_tail] = np.arange(n)
    again = np.zeros((n, _PLACES), bool)
    head_class = np.empty(n, np.int64)
    for o in range(_PLACES):
        here = np.flatnonzero((off >= o) & (off - windows < o))
        if not here.size:
            continue
        # Equal o bytes before the trigger are one suffix of the dictionary; the rank of what follows orders the rest.
        head_class[by_head] = np.cumsum(head_common < o)
        tail_class = np.cumsum(tail_common < SPAN - o)
        here = here[np.argsort(head_class[here] * n + rank[here])]
        same = (head_class[here[1:]] == head_class[here[:-1]]) & (tail_class[rank[here[1:]]] == tail_class[rank[here[:-1]]])
        again[here, o] = m[here] > 1
        again[here[1:][same], o] = True
        again[here[:-1][same], o] = True
    return again


def _read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of phrases that occur once, from rows in the order of their triggers; triggers are taken whole."""

    def found(t: pa.Table) -> pa.RecordBatch:
        m, off = t["m"].to_numpy(), t["off"].to_numpy().astype(np.int64)
        again = neighbours(t["a"].to_numpy(), off, t["bytes"].to_pylist(), m)
        again[m > 1] = False  # repeated whole, as is known
        padded = np.pad(again[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)  # by falling offset, so by rising start
        edge = np.diff(padded, axis=1)
        row, start = np.nonzero(edge == 1)
        length = np.nonzero(edge == -1)[1] - start
        at = start - (_PLACES - 1) + off[row]
        rows, first = np.unique(row, return_index=True)
        spans = pa.ListArray.from_arrays(pa.array(np.append(first, row.size), pa.int32()), pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(length + SPAN - 1, pa.int64())], names=["at", "n"]))
        return pa.RecordBatch.from_arrays([t["a"].combine_chunks().take(pa.array(rows)), t["u"].combine_chunks().take(pa.array(rows)), spans], names=["a", "u", "spans"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) > AT_ONCE:
            table = pa.Table.from_batches(held)
            a = table["a"].to_numpy()
            whole = int(np.flatnonzero(np.append(True, a[1:] != a[:-1]))[-1])  # the last trigger may go on
            if whole:
                yield found(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
    if held:
        yield found(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, a, u, k, m): 128 bits of hash of each window of phrases."""
    for batch in steps(batches, "bytes", 1 << 19):
        out: list[list] = [[], [], [], []]
        for row, data in enumerate(batch.column("bytes").to_pylist()):
            for k in range(len(data) - SPAN + 1):
                h = xxhash.xxh3_128_intdigest(data[k : k + SPAN])
                for col, value in zip(out, ((h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, row, k), strict=True):
                    col.append(value)
        row = pa.array(out[2], pa.int64())
        cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *(batch.column(c).take(row) for c in ("a", "u")), pa.array(out[3], pa.int64()), batch.column("m").take(row)]
        yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "a", "u", "k", "m"])


def remove(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, int]:
    """``data`` without the bytes of given spans, how many those are, and in how many runs."""
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + lengths, -1)
    mask = np.cumsum(gone[:-1]) > 0
    runs = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (mask[0] if mask.size else 0))
    return np.frombuffer(data, np.uint8)[~mask].tobytes(), int(np.count_nonzero(mask)), runs


def _dropped(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = (text or "").encode()
                starts = np.array([s["at"] for s in spans or ()], np.int64)
                kept, n, runs = remove(data, starts, np.array([s["n"] for s in spans or ()], np.int64)) if starts.size else (data, 0, 0)
                rows.append((n, runs, hashlib.sha256(kept).hexdigest() if digests else kept))
            n, runs, kept = zip(*rows, strict=True)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_removed", "n_spans", "kept_sha256" if digests else "kept"])

    return run


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, spans) of texts with repeated bytes, and all texts as in ``_whole``."""
    kind = dict(docs.dtypes)["doc_id"]
    common = docs.select("text").mapInArrow(_triggers, "a long, c long").groupBy("a").agg(F.sum("c").alias("c")).filter("c > 1")
    common = cut(common.select("a", F.lit(True).alias("common"), "c"), "triggers")
    rows = docs.mapInArrow(_phrase_rows, f"doc_id {kind}, digest long, a long, u long, lo long, n int, off int, r long")
    rows = cut(lookup(rows, common, ["a"], "c").drop("common"), "phrases")
    drop(common)
    named = rows.select("doc_id", "digest").distinct().select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.lit(True).alias("some"))
    texts = docs.join(named, docs.doc_id.eqNullSafe(F.col("d")) & (docs.digest == F.col("g")), "left").select("doc_id", "digest", "text", "some")
    texts = cut(texts.mapInArrow(_whole, f"doc_id {kind}, digest long, text string, n_bytes long, sha string"), "phrase-texts")
    place = F.min(F.struct("doc_id", "digest", "lo", "n", "off"))
    distinct = cut(rows.groupBy("a", "u").agg(F.sum("r").alias("m"), place.alias("p")), "dictionary")
    kinds = cut(distinct.groupBy("a").agg(F.count("*").alias("k")).filter("k > 1").withColumn("large", F.col("k") > MOST), "mixed")
    mixed = lookup(distinct, kinds, ["a"], "k")
    places = mixed.groupBy("p.doc_id", "p.digest").agg(F.collect_list(F.struct("a", "u", "m", "large", "p.lo", "p.n", "p.off")).alias("places"))
    held = texts.filter("text is not null").dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "text")
    spelled = places.join(held, places.doc_id.eqNullSafe(F.col("d")) & (places.digest == F.col("g"))).select("text", "places")
    spelled = cut(spelled.mapInArrow(_spelled, "a long, u long, m long, large boolean, off int, bytes binary"), "spelled")
    some = spelled.filter("not large").repartition("a").sortWithinPartitions("a")
    ordered = some.mapInArrow(_read_off, "a long, u long, spans array<struct<at:long,n:long>>")
    if not kinds.filter("large").isEmpty():
        each = cut(spelled.filter("large").mapInArrow(_windows, "x long, y long, a long, u long, k long, m long"), "windows")
        same = cut(each.groupBy("x", "y").agg(F.sum("m").alias("mm")).filter("mm > 1").withColumn("same", F.lit(True)), "window-counts")
        span = F.struct(F.col("k").alias("at"), F.lit(SPAN).cast("long").alias("n"))
        ordered = ordered.union(lookup(each.filter("m = 1"), same, ["x", "y"], "mm").groupBy("a", "u").agg(F.collect_set(span).alias("spans")))
    ordered = cut(ordered, "ordered")
    once = distinct.filter("m > 1").select("a", "u", F.lit(None).cast("array<struct<at:bigint,n:bigint>>").alias("spans"), "m")
    status = cut(once.union(ordered.select("a", "u", "spans", F.lit(1).cast("long").alias("m"))), "repeats")
    drop(distinct, spelled, ordered, kinds)
    found = lookup(rows, status, ["a", "u"], "m")
    # A run of equal phrases is one span; spans of a phrase count from its first byte.
    whole = F.array(F.struct(F.col("lo").alias("at"), (F.col("n") * F.col("r") + SPAN - 1).cast("long").alias("n")))
    windows = F.when(F.col("spans").isNull(), whole).otherwise(F.transform("spans", lambda s: F.struct((F.col("lo") + s.at).alias("at"), s.n.alias("n"))))
    spans = found.select("doc_id", "digest", F.explode(windows).alias("s")).groupBy("doc_id", "digest").agg(F.collect_set("s").alias("spans"))
    spans = cut(spans, "spans")
    drop(rows, status)
    return spans, texts


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 or, without ``digests``, kept binary) of every row."""
    base = only(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    kind = dict(base.dtypes)["doc_id"]
    spans, texts = repeated(base)
    spans = spans.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "spans")
    last = "kept_sha256" if digests else "kept"
    some = texts.filter("text is not null").join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, {last} {'string' if digests else 'binary'}"
    done = some.select("doc_id", "text", "spans").mapInArrow(_with_size(digests), out)
    if digests:
        return done.union(texts.filter("text is null").select("doc_id", "n_bytes", F.lit(0).cast("long"), F.lit(0).cast("long"), "sha"))
    rest = base.join(texts.filter("text is null").select(F.col("doc_id").alias("d"), F.col("digest").alias("g")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left_semi")
    kept = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    return done.union(rest.select("doc_id", F.length(kept).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), kept))


def _with_size(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sized(bs):
            for b in bs:
                sizes.append(pa.array([len((t or "").encode()) for t in b.column("text").to_pylist()], pa.int64()))
                yield b

        sizes: list[pa.Array] = []
        for out in _dropped(digests)(sized(steps(batches))):
            yield pa.RecordBatch.from_arrays([out.column(0), sizes.pop(0), *out.columns[1:]], names=["doc_id", "n_bytes", *out.schema.names[1:]])

    return run
