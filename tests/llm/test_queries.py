"""The registered corpus queries on the smallest tables, and the pipeline stage by stage."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docforge.llm import registry
from docforge.llm.common import written

from . import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(want.select(*columns).fetchall())


def test_whole_texts(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    queries = registry.queries()
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries["op6_near_duplicates"](spark, DATA).collect()}
    assert near == brute.near_duplicates(rows)
    found = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in queries["op7_secret_scan"](spark, DATA).collect()}
    assert found == {i: brute.secrets(t) for i, t in rows}
    cut = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries["op10_suffix_dedup"](spark, DATA).collect()}
    assert cut == dict(zip([i for i, _ in rows], brute.repeated_bytes([t for _, t in rows]), strict=True))


def test_recall(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    plain = {(q, i) for q, _, i, _ in brute.nearest(rows)}
    got = {(r["query_id"], r["vec_id"]) for r in registry.queries()["op1_nearest_neighbours"](spark, DATA).collect()}
    assert len(got & plain) >= 0.9 * len(plain)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, _, kept) in brute.near_duplicates(before.items()).items() if kept}
        if name == "secrets":
            assert set(after) == set(before)
            assert all(brute.secrets(t)[:3] == (0, 0, 0) for t in after.values())
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.count() and mixed.where("taken <= 0").count() == 0


@pytest.mark.parametrize("n", [0, 40])
def test_pipeline_edges(spark, n):
    """Empty tables, null ids and texts, equal ids and columns whose names clash pass every stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(n)
    odd = docs.select(F.lit(None).cast("long").alias("doc_id"), *[F.col(c) if c != "text" else F.lit(None).cast("string").alias(c) for c in docs.columns[1:]]).limit(2)
    docs = docs.unionByName(odd).unionByName(docs.limit(1)).withColumns({"Size": F.lit(1), "KEPT": F.lit("x"), "_Score": F.lit(0.5)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter(r["doc_id"] for r in docs.collect())
        docs = written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        after = Counter(r["doc_id"] for r in docs.collect())
        assert after <= before and (name == "quality" or after[None] == before[None])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() <= docs.count()
