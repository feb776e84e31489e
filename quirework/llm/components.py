"""Connected components of a link table as DataFrame rounds, and joins that hot keys don't slow; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: A key is hot if it has over one in so many of the rows, so there are no more hot keys than that; and at least so many rows.
SHARE, LEAST = 1000, 50_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], n: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left`` (of at most ``rows``, if given) with the columns of ``right`` at equal ``keys``, of which the first is a long.

    ``right`` is a table that ``cut`` wrote, with one row a key and the count ``n`` of rows of ``left`` that have it. Rows of
    hot keys get theirs from a broadcast of at most SHARE rows and are dealt out by a hash of themselves, all others by shuffle.
    """
    if rows is not None and rows <= LEAST:
        return left.join(right.drop(n), keys, how)
    total, most = right.agg(F.sum(n), F.max(n)).first()
    bar = max((total or 0) // SHARE, LEAST)
    if (most or 0) <= bar:
        return left.join(right.drop(n), keys, how)
    rest = F.struct(*[c for c in right.columns if c not in (*keys, n)])
    hot = F.broadcast(right.filter(F.col(n) > bar).select(*keys, rest.alias("_hot")))
    cold = right.filter(F.col(n) <= bar).select(*[F.col(k).alias(f"_{k}") for k in keys], rest.alias("_cold"))
    marked = left.join(hot, keys, "left").withColumn("_first", F.when(F.col("_hot").isNotNull(), F.xxhash64(*left.columns)).otherwise(F.col(keys[0])))
    on = [F.col("_first") == F.col(f"_{keys[0]}"), *[F.col(k) == F.col(f"_{k}") for k in keys[1:]]]
    found = marked.join(cold, on, "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.filter("_found is not null")
    return found.select(*left.columns, "_found.*")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) with the components of linked nodes united under the smallest label.

    ``links`` has (a, b), nodes of ``labels``. Each round takes the smallest
    label among neighbours and then follows labels one step further, so paths
    halve; rounds end when no label changes.
    """
    own = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    other = labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    edges = links.join(own, "a").join(other, "b").filter("ca <> cb").select("ca", "cb")
    edges = cut(edges.union(edges.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct().toDF("u", "v"), "edges")
    rows = edges.count()
    if not rows:
        drop(edges)
        return labels
    roots = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root"), F.count("*").alias("n")), "roots")
    while True:
        near = lookup(edges, roots.select(F.col("node").alias("v"), "root", "n"), ["v"], "n", rows=rows).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", "n", F.least("root", "near").alias("next"), F.col("root").alias("was"))
        beyond = roots.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        if rows > LEAST:
            step = cut(step, "steps")
            beyond = cut(step.groupBy("next").agg(F.count("*").alias("m")).join(beyond, "next"), "jumps")
        else:
            beyond = beyond.withColumn("m", F.lit(1))
        new = lookup(step, beyond, ["next"], "m", rows=rows).select("node", F.least("next", "beyond").alias("root"), "n", (F.col("was") != F.least("next", "beyond")).alias("moved"))
        new = cut(new, "roots")
        drop(roots, *([step, beyond] if rows > LEAST else []))
        roots = new
        if roots.filter("moved").isEmpty():
            break
    moved = roots.select(F.col("node").alias("comp"), "root")
    nodes = labels.count()
    if nodes > LEAST:
        moved = cut(labels.groupBy("comp").agg(F.count("*").alias("m")).join(moved, "comp"), "moved")
        drop(roots)
    else:
        moved = moved.withColumn("m", F.lit(1))
    drop(edges)
    return lookup(labels, moved, ["comp"], "m", "left", rows=nodes).select("node", F.coalesce("root", "comp").alias("comp"))
