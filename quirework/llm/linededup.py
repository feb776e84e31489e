"""Fuzzy line dedup in DataFrame operations only: MinHash of character shingles, exact Jaccard, union-find.

Every line that is not blank takes part, in lower case without outer blanks. Its shingles are all windows of ``WIDTH``
characters (in signatures, of UTF-16 units), told apart by 64 bits of hash; a shorter line is its own one shingle, so that
only an equal line is like it.

1. Equal lines become one distinct line, named by a hash, with its first place (map-side combine). Where they were
   brought together their signatures are made, so that text is shuffled once: 16 shingles a row, 27 minima of their hashes under xor.
2. 9 bands of three minima: a pair at a Jaccard index of 0.8 shares no band in 16 of 10,000 cases, at 0.85 in 2 of 10,000,
   if minima are independent; the tests and the README have what was measured.
3. The lines of each band bucket are compared with two of them; links unite components; then others of the bucket are the
   pivots, and in the last round all lines of a bucket of at most ``BLOCK`` that are not in one component yet meet. Those of
   all larger buckets meet by their shingles, rare ones first: a linked pair's first common shingle stands so early in both
   sets that enough of each is left for the threshold, and only pairs of which that holds meet (prefix and place filter, exact).
   So pivots only save pairs within large groups of copies, and no pair of a bucket that may be linked is left out.
4. Pairs are first held against a bound from bitmaps of their shingles, which no pair at the threshold can miss, where they
   are joined; the others are confirmed on full shingle sets at a Jaccard index of 0.8. Java compiles no method of over 8000
   bytes, and long ones late, so a pair's bits are summed once, in a generator, whose result the bound and the order use.
5. The first place of a component stays, all its other lines go.

Joins look keys up with ``lookup``: a key of over a thousandth of the rows is broadcast, and its rows are spread.

Cases: null texts stay null and empty ones empty; blank lines stay; a text whose lines all go becomes empty; lines of
rows without an id are left alone; ties go to the smaller id, then to the earlier line; rows with equal id and text are
one document and get equal results; rows with one id and other texts are other documents; texts and lines of any length
are read whole; empty tables give empty results; all columns stay as they are but for n_lines and n_removed.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, rest
from .components import LEAST, lookup, merge

WIDTH = 8
#: Link if 100 * common >= LINK * united.
LINK = 80
BANDS, ROWS = 9, 3
#: 64-bit words of a bitmap.
WORDS = 32
#: A line's mark: how many windows it has, how many bits are set, the bits.
MARKS = ["windows", "ones", *[f"b{word}" for word in range(WORDS)]]
#: Rounds with pivots at most; fewer if the pairs of lines left are at most so many for each place in a bucket, or a round left over half of them.
PIVOT_TURNS, PAIRS_PER_SLOT = 4, 64
#: Members of a bucket that all meet in the last round; those of larger ones meet by shingles.
BLOCK = 64
#: Sizes of sets in one grade differ by less than this factor.
GRADE = 1.04
#: Shingles in one row of the signature's aggregation.
AT_ONCE = 16
_NEWLINE = "\n"
_SPACE = " \t\x0b\x0c\r\xa0\u2002\u2003\u2009\u3000\ufeff"


def _constants(n: int) -> list[int]:
    """64-bit constants, of which no two have equal top bits, so that xor moves each minimum elsewhere."""
    out, x = [], 0x9E3779B97F4A7C15
    for k in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        c = (k * 2**64 // n & 0xF800000000000000) | (x >> 5)
        out.append(c - 2**64 if c >= 2**63 else c)
    return out


def trimmed(line: Column) -> Column:
    """``line`` without outer blanks; only lines that have some are trimmed, as that reads a line character by character."""
    ends = [end(line, F.lit(c)) for end in (F.startswith, F.endswith) for c in _SPACE]
    return F.when(functools.reduce(lambda x, y: x | y, ends), F.btrim(line, F.lit(_SPACE))).otherwise(line)


def normal(line: Column) -> Column:
    return F.lower(trimmed(line))


#: Encodings of equal bytes for each unit, so that a window is cut out without counting from the start.
UNITS, CHARACTERS = ("UTF-16BE", 2), ("UTF-32", 4)


def _last(data: Column, size: int) -> Column:
    """First byte (from 1) of the last shingle."""
    return F.greatest(F.octet_length(data) - (WIDTH * size - 1), F.lit(1))


def _shingle(data: Column, at: Column, size: int) -> Column:
    """The shingle from the byte ``at`` (from 1) on."""
    return F.xxhash64(F.substring(data, at, F.lit(size * WIDTH)))


def shingles(line: str) -> Column:
    """Hashes of all shingles as an array, repeated ones too."""
    encoding, size = CHARACTERS
    windows = lambda data: F.transform(F.sequence(F.lit(1), _last(data, size), F.lit(size)), lambda at: _shingle(data, at, size))
    # As a variable of a lambda the line is encoded once; a column of bytes would be copied for each shingle.
    return F.get(F.transform(F.array(F.encode(line, encoding)), windows), F.lit(0))


def _blocks(lines: DataFrame, *key: str, of: tuple[str, int] = UNITS) -> DataFrame:
    """(key, x0, x1, ...): hashes of AT_ONCE shingles a row of the column ``line``; at its end the last one again and again."""
    encoding, size = of
    data = lines.select(*key, F.encode("line", encoding).alias("data"))
    last = _last(F.col("data"), size)
    rows = data.select(*key, "data", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(AT_ONCE * size))).alias("at"))
    return rows.select(*key, *[_shingle(F.col("data"), F.least(F.col("at") + k * size, F.col("last")), size).alias(f"x{k}") for k in range(AT_ONCE)])


def _places(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, pos, h, g, line): the lines that take part; h and g name a line."""
    # The digest is made before the lines are: beside them the whole text would be hashed for each.
    lines = docs.filter("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    lines = lines.select("doc_id", "digest", F.posexplode(F.split("text", _NEWLINE, -1)).alias("pos", "raw"))
    # Blank lines go before the rest are put in lower case, which a filter behind it would do twice.
    lines = lines.select("doc_id", "digest", "pos", trimmed(F.col("raw")).alias("raw")).filter("raw <> ''").withColumn("line", F.lower("raw"))
    return lines.select("doc_id", "digest", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line")


def signed(docs: DataFrame) -> DataFrame:
    """(h, g, n, doc_id, digest, pos, keys): distinct lines, how often and where first they stand, and the keys of their bands."""
    place = F.min(F.struct("doc_id", "digest", "pos"))
    lines = _places(docs).groupBy("h", "g").agg(F.first("line").alias("line"), F.count("*").alias("n"), place.alias("p"))
    least = [F.min(F.least(*[F.col(f"x{k}").bitwiseXOR(F.lit(c)) for k in range(AT_ONCE)])).alias(f"m{j}") for j, c in enumerate(_constants(BANDS * ROWS))]
    signs = _blocks(lines, "h", "g", "n", "p").groupBy("h", "g", "n", "p").agg(*least)
    keys = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{ROWS * b + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return signs.select("h", "g", "n", "p.doc_id", "p.digest", "p.pos", keys.alias("keys"))


def _marked(lines: DataFrame) -> DataFrame:
    """(id, n, bits): how many windows a line has, and a bitmap of their hashes."""
    rows = _blocks(lines, "id", of=CHARACTERS)
    of = [(F.shiftrightunsigned(f"x{k}", 6).bitwiseAND(F.lit(WORDS - 1)), F.expr(f"shiftleft(1L, CAST(x{k} & 63 AS INT))")) for k in range(AT_ONCE)]
    rows = rows.select("id", *[c.alias(f"{name}{k}") for k, pair in enumerate(of) for name, c in zip("wb", pair, strict=True)])
    # Which words the row's bits are in, so that no others are sought.
    held = functools.reduce(lambda x, y: x.bitwiseOR(y), [F.expr(f"shiftleft(1L, CAST(w{k} AS INT))") for k in range(AT_ONCE)])
    rows = rows.withColumn("held", held)
    one = lambda k, word: F.when(F.col(f"w{k}") == word, F.col(f"b{k}")).otherwise(F.lit(0).cast("long"))
    some = lambda word: F.when(F.col("held").bitwiseAND(F.lit(1 << word)) != 0, functools.reduce(lambda x, y: x.bitwiseOR(y), [one(k, word) for k in range(AT_ONCE)]))
    words = [F.coalesce(F.bit_or(some(word)), F.lit(0).cast("long")).alias(f"b{word}") for word in range(WORDS)]
    ones = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(word)) for word in MARKS[2:]])
    return rows.groupBy("id").agg(*words).withColumn("ones", ones)


def _compared(x: str, y: str) -> list[Column]:
    """(most, ones, alone) of two lines whose marks have the prefixes ``x`` and ``y``, for ``_may_link``.

    At most so many windows of the line that has fewer share their bits with others; bits of both lines; bits that one line
    alone has. The last is summed in a generator: in a filter it would be summed again for each use.
    """
    most = F.least(F.col(f"{x}windows") - F.col(f"{x}ones"), F.col(f"{y}windows") - F.col(f"{y}ones")).cast("long")
    alone = functools.reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}b{k}").bitwiseXOR(F.col(f"{y}b{k}"))) for k in range(WORDS)])
    return [most.alias("most"), (F.col(f"{x}ones") + F.col(f"{y}ones")).alias("ones"), F.explode(F.array(alone)).alias("alone")]


def _may_link() -> Column:
    """A bound on the columns of ``_compared`` that holds for every linked pair.

    A bit of one line alone is a shingle of that line alone. So of a line's windows at most those less such bits are common;
    what is common must be LINK / (100 - LINK) times what is not. Bits in both are half of all those less the ones alone,
    which leaves one sum.
    """
    return (100 + LINK) * F.col("alone") <= (100 - LINK) * (2 * F.col("most") + F.col("ones"))


def _as(prefix: str, of: str = "") -> list[Column]:
    return [F.coalesce(F.col(f"{of}{c}"), F.lit(0)).alias(f"{prefix}{c}") for c in MARKS]


def _members(lines: DataFrame) -> DataFrame:
    """(bucket, id) of the buckets with two lines or more.

    One line in 64 is counted before: buckets that seem to hold a thousandth of all lines or more (at most 16,000, as each
    line is in 16) are dealt out in parts, of which every line is kept.
    """
    slots = lines.select(F.col("h").alias("id"), F.explode("keys").alias("bucket"))
    seen = slots.filter(F.pmod(F.xxhash64("id"), F.lit(64)) == 0).groupBy("bucket").agg(F.count("*").alias("n"))
    large = seen.filter(F.col("n") >= max(16, lines.count() // 64_000)).select("bucket", F.col("n").alias("parts"))
    slots = slots.join(F.broadcast(large), "bucket", "left").withColumn("part", F.coalesce(F.pmod("id", "parts"), F.lit(-1)))
    mates = Window.partitionBy("bucket", "part").orderBy("id")
    slots = slots.select("bucket", "id", "part", F.lag("id").over(mates).alias("before"), F.lead("id").over(mates).alias("after"))
    return slots.filter("part >= 0 or before is not null or after is not null").select("bucket", "id")


def _texts(docs: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """(id, line, MARKS): the lines that have mates, read from their first places, with their marks."""
    first = members.select("id").distinct().join(lines.select(F.col("h").alias("id"), "doc_id", "digest", "pos"), "id")
    first = first.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("id", "pos")).alias("first"))
    here = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    here = here.join(first, ["doc_id", "digest"]).select(F.split("text", _NEWLINE, -1).alias("lines"), "first")
    here = here.select("lines", F.explode("first").alias("f")).select("f.id", normal(F.get("lines", F.col("f.pos"))).alias("line"))
    here = cut(here.groupBy("id").agg(F.first("line").alias("line")), "line-read")  # rows that repeat id and text give a line more than once
    windows = F.greatest(F.length("line") - WIDTH + 1, F.lit(1))
    return here.join(_marked(here), "id").withColumn("windows", windows).select("id", "line", *MARKS)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are alike; a may be in many of them."""
    named = lambda end: texts.select(F.col("id").alias(end), F.col("line").alias(f"{end}_line"), *_as(f"{end}_"))
    rows, ends = pairs.count(), named("a").withColumn("n", F.lit(1))
    if rows > LEAST:
        ends = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).join(named("a"), "a"), "line-ends")
    known = ends if rows <= LEAST else ends.select("a", "n", "a_line", *_as("a_", "a_"))
    size = lambda of: (F.col(f"a_{of}") + F.col(f"b_{of}")).alias(of)
    both = lookup(pairs, known, ["a"], "n", rows=rows).join(named("b"), "b")
    both = both.select("a", "b", "a_line", "b_line", size("windows"), *_compared("a_", "b_")).filter(_may_link())
    # Sets and what they have in common are made in generators, so that a filter takes columns and not their expressions.
    sets = both.select("a", "b", "windows", "ones", F.inline(F.array(F.struct(shingles("a_line").alias("x"), shingles("b_line").alias("y")))))
    sets = sets.select("a", "b", "windows", "ones", "x", "y", F.inline(F.array(F.struct(F.size(F.array_intersect("x", "y")).cast("long").alias("common")))))
    # Both sets have at least as many shingles as bits and at most as many as windows; what that leaves open is counted.
    alike = lambda united: 100 * F.col("common") >= LINK * united
    exact = alike(F.col("ones") - F.col("common")) & (alike(F.col("windows") - F.col("common")) | alike(F.size(F.array_union("x", "y"))))
    found = cut(sets.filter(exact).select("a", "b"), "line-links")
    if rows > LEAST:
        drop(ends)
    return found


def _apart(pairs: DataFrame) -> DataFrame:
    """(a, b, ca, cb, alike) of the pairs, with both lines' marks, that may be linked."""
    met = pairs.select("a", "b", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), *_compared("x_", "y_")).filter(_may_link())
    return met.select("a", "b", "ca", "cb", (-F.col("alone") / F.col("ones")).alias("alike"))


def _met(held: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b, ca, cb, alike): pairs of all lines of a bucket that are in different components and may be linked."""
    held = held.select("bucket", "id", "comp").join(marks, "id")
    x = held.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca"), *_as("x_"))
    y = held.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"), *_as("y_"))
    # The bits are compared in the task of the join, so only pairs that may be linked come out of it.
    return _apart(x.join(y, "bucket").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))))


def _grade(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(GRADE)).cast("int")


def _early(lines: DataFrame) -> DataFrame:
    """(id, comp, token, most, n, reach) of lines (id, comp, line): shingles that two components have, where a linked pair may first meet.

    A line's shingles are in one order for all lines, rare ones first. If the pair's first common one is at place p (from 0)
    of the n of a line, they have n - p in common at most, so the other line has ``reach`` shingles at most. most is the
    component that has the shingle in most lines.
    """
    tokens = lines.select("id", "comp", F.explode(F.array_distinct(shingles("line"))).alias("token"))
    each = tokens.groupBy("token", "comp").agg(F.count("*").alias("k"))
    known = each.groupBy("token").agg(F.sum("k").alias("n"), F.sum("k").alias("lines"), F.max(F.struct("k", "comp")).comp.alias("most"), (F.count("*") > 1).alias("shared"))
    known = cut(known, "line-tokens")
    line = Window.partitionBy("id")
    rows = lookup(tokens, known, ["token"], "n").withColumns({"place": F.row_number().over(line.orderBy("lines", "token")) - 1, "n": F.count("*").over(line)})
    rows = rows.withColumn("reach", F.floor((100 * F.col("n") - (100 + LINK) * F.col("place")) / LINK))
    out = cut(rows.filter(F.col("shared") & (100 * F.col("reach") >= LINK * F.col("n"))).select("id", "comp", "token", "most", "n", "reach"), "line-early")
    drop(known)
    return out


def _near(early: DataFrame) -> DataFrame:
    """(a, b, ca, cb): pairs of lines in different components that share a row of ``_early`` within each other's reach.

    Rows are joined by the grades of both sizes, too, the smaller set at the left; and those of a shingle's largest component
    only with other components, so that what is joined is at most some two times the pairs of different components.
    """
    grades = lambda low, high: F.explode(F.sequence(_grade(low), _grade(high)))
    n, reach = F.col("n"), F.col("reach")
    x = early.filter(reach >= n).select("token", "most", F.col("id").alias("a"), F.col("comp").alias("ca"), n.alias("x_n"), reach.alias("x_reach"), _grade(n).alias("x_grade"), grades(n, reach).alias("y_grade"))
    least = F.ceil(LINK * n / 100)
    y = early.select("token", F.col("most").alias("y_most"), F.col("id").alias("b"), F.col("comp").alias("cb"), n.alias("y_n"), reach.alias("y_reach"), _grade(n).alias("y_grade"), grades(least, F.least(n, reach)).alias("x_grade"))
    fits = F.expr("ca <> cb and y_n <= x_reach and x_n <= y_reach and (x_n < y_n or x_n = y_n and a < b)")
    on, most = ["token", "x_grade", "y_grade"], F.col("ca") == F.col("most")
    met = [left.join(right, on).filter(fits).select("a", "b", "ca", "cb") for left, right in ((x.filter(~most), y), (x.filter(most), y.filter("cb <> y_most")))]
    turned = F.col("a") > F.col("b")
    ends = {"a": F.least("a", "b"), "b": F.greatest("a", "b"), "ca": F.when(turned, F.col("cb")).otherwise(F.col("ca")), "cb": F.when(turned, F.col("ca")).otherwise(F.col("cb"))}
    return met[0].union(met[1]).select(*[c.alias(name) for name, c in ends.items()]).distinct()


def _all_met(mixed: DataFrame, texts: DataFrame, large: bool) -> DataFrame:
    """What ``_met`` gives for the buckets of (bucket, id, comp, size), those of over BLOCK lines, if there are any, by ``_near``."""
    marks = texts.select("id", *MARKS)
    small = _met(mixed.filter(F.col("size") <= BLOCK), marks)
    if not large:
        return cut(small.distinct(), "line-met")
    lines = mixed.filter(F.col("size") > BLOCK).select("id", "comp").distinct().join(texts.select("id", "line"), "id")
    early = _early(lines)
    end = lambda name, prefix: marks.select(F.col("id").alias(name), *_as(prefix))
    near = cut(_near(early), "line-near")
    met = cut(small.union(_apart(near.join(end("a", "x_"), "a").join(end("b", "y_"), "b"))).distinct(), "line-met")
    drop(early, near)
    return met


def _with_pivots(mixed: DataFrame) -> DataFrame:
    """(a, b): lines of a bucket with those of its two pivots, at the left, that are in other components.

    Two that meet in both orders, as pivots do, are one pair; a line is b at most twice for each of its buckets.
    """
    met = mixed.select("id", "comp", F.explode(F.array("low", "high")).alias("end")).filter("end.comp <> comp").select(F.col("end.id").alias("a"), F.col("id").alias("b"))
    met = met.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a"))
    return met.select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def _linked(pairs: DataFrame, texts: DataFrame, labels: DataFrame, keep: bool = False) -> DataFrame:
    """``labels`` with what the confirmed ones of ``pairs``, a table that goes unless ``keep``, unite."""
    found = _confirmed(pairs, texts)
    nodes = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    out = cut(merge(labels.union(nodes.select("node", F.col("node").alias("comp"))), found), "line-labels")
    drop(found, *([] if keep else [pairs]))
    return out


def components(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, comp): the linked ones of the distinct lines of ``signed`` and the smallest name of those they are linked with."""
    spark = lines.sparkSession
    members = cut(_members(lines), "line-members")
    texts = cut(_texts(docs, lines, members), "line-texts")
    all_slots = members.count()
    # From a range, as rows of Python's own, even none, would start Python workers in the executors.
    labels, before = cut(spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("comp")), "line-labels"), 0
    for turn in itertools.count():
        rest(spark)
        held = members.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        held = cut(held, "line-held")
        order = F.struct(F.xxhash64(F.lit(turn), "id").alias("order"), "id", "comp")
        each = held.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high"))
        n = F.col("n")
        apart = each.groupBy("bucket").agg(F.sum("n").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"), ((F.sum("n") * F.sum("n") - F.sum(n * n)) / 2).cast("long").alias("apart"))
        apart = cut(apart.filter("apart > 0").withColumn("n", F.col("size")), "line-apart")
        left = apart.agg(F.sum("apart")).first()[0]
        if not left:
            break
        last = turn and (left <= PAIRS_PER_SLOT * all_slots or 2 * left > before) or turn >= PIVOT_TURNS
        before = left
        mixed = lookup(held, apart, ["bucket"], "n")
        if not last:
            labels = _linked(cut(_with_pivots(mixed), "line-pairs"), texts, labels)
            drop(held, apart)
            continue
        met = _all_met(mixed, texts, not apart.filter(F.col("size") > BLOCK).isEmpty())
        # Of two components the two lines that are most alike come first: where these are linked, the others needn't be compared.
        best = cut(met.groupBy("ca", "cb").agg(F.max(F.struct("alike", "a", "b")).alias("p")).select("p.a", "p.b"), "line-best")
        labels = _linked(best, texts, labels, keep=True)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        more = met.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b"))
        labels = _linked(cut(more.select("a", "b").join(best, ["a", "b"], "left_anti"), "line-rest"), texts, labels)
        drop(held, apart, met, best)
        break
    drop(members, texts)
    return labels


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, gone array of line numbers from 0): places that repeat an earlier line."""
    lines = cut(signed(docs), "line-signed")
    rest(docs.sparkSession)  # the rounds below write many small tables; their heap starts from what is in use
    labels = components(docs, lines).withColumnRenamed("node", "h")
    # Lines that stand once and are linked with none stay anyway.
    linked = lines.join(labels, "h", "left").filter("n > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "h"))
    linked = cut(linked.select("h", "g", "n", "comp", F.struct("doc_id", "digest", "pos").alias("place")), "line-linked")
    drop(lines)
    stays = cut(linked.groupBy("comp").agg(F.min("place").alias("stays"), F.count("*").alias("lines")), "line-stays")
    known = cut(lookup(linked.select("h", "g", "n", "comp"), stays, ["comp"], "lines").select("h", "g", "n", "stays"), "line-known")
    drop(linked, stays)
    rest(docs.sparkSession)
    here = lookup(_places(docs).select("doc_id", "digest", "pos", "h", "g"), known, ["h", "g"], "n")
    gone = here.filter(F.struct("doc_id", "digest", "pos") != F.col("stays"))
    return gone.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines that repeat an earlier one taken out of ``text``, and _n_lines, _n_removed."""
    gone = cut(removals(docs.select("doc_id", "text")), "line-gone").toDF("_gone_id", "_gone_digest", "_gone")
    named = docs.filter("doc_id is not null")
    joined = named.join(gone, (named.doc_id == gone["_gone_id"]) & (F.xxhash64(named.text) == gone["_gone_digest"]), "left")
    joined = joined.select(*docs.columns, "_gone").union(docs.filter("doc_id is null").select(*docs.columns, F.lit(None).cast("array<int>")))
    joined = joined.withColumn("_lines", F.split("text", _NEWLINE, -1))  # a column of its own, so that it is made once and not at every line
    lines = F.col("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, _NEWLINE))
    others = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return joined.select(*others, n_lines.cast("long").alias("_n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``without_repeats`` with its counts as n_lines and n_removed, in place of such columns of the table's own."""
    out = without_repeats(docs.drop("n_lines", "n_removed"))
    return out.withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed"})
