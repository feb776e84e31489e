"""The entry's queries of the subpackage on the driver's small tables, and the pipeline stage by stage."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import langid, queries

from .test_operators import dedup_lines, hits_by_force, library, near_components

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_all_documents(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    assert got.count() == got.select("doc_id").distinct().count() == 200


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    (_, a), (_, b), (_, c), (_, d), (_, e) = corpus_pipeline.STAGES
    known = a(spark, docs, DIR)
    assert known.columns == columns and known.count() >= 195
    model = langid.fit(docs)
    want = {r.doc_id for r in langid.identify(docs, model).filter("not rejected").collect()}
    assert {r.doc_id for r in known.collect()} == want
    rows = sorted((r.doc_id, r.text) for r in known.collect())
    lines = {r.doc_id: r for r in b(spark, known, DIR).collect()}
    forced = dedup_lines(rows)
    assert {i: r.text for i, r in lines.items()} == {i: t for i, t in forced.items() if t.strip() or t == dict(rows)[i]}
    assert all(r.n_chars == len(r.text) for r in lines.values())
    table = spark.createDataFrame(list(lines.values()), docs.schema)
    near = c(spark, table, DIR)
    found = near_components([(i, r.text) for i, r in lines.items()])
    assert near.columns == columns and {r.doc_id for r in near.collect()} == {i for i, comp in found.items() if comp == i}
    clean = d(spark, near, DIR)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    hits = hits_by_force(10, [(r.doc_id, r.text) for r in near.collect()], items)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {i for i, (_, n, _) in hits.items() if not n}
    tokens = library()
    for r in e(spark, clean, DIR).collect():
        ids = tokens.encode(lines[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokens.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    """Repeated rows, null ids and texts, and columns with names that the stages use go through all stages."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    known = docs.filter("lang is not null").limit(40)
    odd = known.union(known.limit(3)).union(known.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).union(known.limit(1).withColumn("text", F.lit(None).cast("string")))
    odd = odd.withColumns({c: F.lit(c) for c in ("comp", "h", "digest", "bucket", "word", "_text", "n_lines")})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, odd, DIR)
        assert k == 4 or (got.columns == odd.columns and got.filter("comp <> 'comp' or n_lines <> 'n_lines'").count() == 0)
        odd = odd if k == 4 else spark.createDataFrame(got.collect(), odd.schema)
        if k == 2:
            ids = [r.doc_id for r in odd.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


def full_collections(spark):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_executors_collect_garbage_before_a_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    before = full_collections(spark)
    corpus_pipeline.encode(spark, docs, DIR)  # made, not run, so nothing else collects
    assert full_collections(spark) > before
