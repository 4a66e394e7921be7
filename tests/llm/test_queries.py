"""Registered queries against their SQL, and the pipeline against row-by-row versions of its stages."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from llm_support import SF, library  # noqa: F401
from test_duplicates import bag, classes

import corpus_pipeline
from starloom.llm import line_rules
from starloom.llm.queries import ORACLES, QUERIES

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def documents() -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


@needs_tables
def test_every_query_covers_all_documents(spark):
    ids = sorted(d for d, _ in documents())
    for name in ("op2_compression_quality", "op3_token_file", "op4_line_rules", "op6_ppm_language", "op7_skip_chain_pii",
                 "op9_toxicity_neighbours", "op13_importance_resampling"):
        assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids, name
    assert len(QUERIES) == 13 and len({n.split("_")[0] for n in QUERIES}) == 13


@needs_tables
def test_classes_of_the_documents(spark):
    docs = documents()
    want = classes([t for _, t in docs])
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op5_dart_minhash"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert [got[d] for d, _ in docs] == [docs[i][0] for i in want]


@needs_tables
def test_stages(spark, tmp_path):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    docs, results = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        results[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    kept = line_rules.clean_lines(spark.read.parquet(f"{SF}/documents.parquet")).where("kept").collect()
    clean = sorted((r["doc_id"], r["clean_text"]) for r in kept)
    assert sorted((r["doc_id"], r["text"]) for r in results["quality_rules"]) == clean
    first = {c: clean[c][0] for c in classes([t for _, t in clean])}
    single = sorted(r["doc_id"] for r in results["near_dedup"])
    assert single == sorted(first.values()) and len(single) < len(clean)
    items = [set(bag(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    texts = dict(clean)
    dirty = {d for d in single if any(q and len(q & set(bag(texts[d]))) >= 0.8 * len(q) for q in items)}
    assert {r["doc_id"] for r in results["decontamination"]} == set(single) - dirty and dirty
    assert {r["doc_id"] for r in results["pii"]} == set(single) - dirty
    assert any("<EMAIL>" in r["text"] or "<CARD>" in r["text"] or "<IP>" in r["text"] for r in results["pii"])
    tokens: Counter = Counter()
    for r in results["packing"]:
        assert r["length"] * 4 == len(r["ids"])
        tokens[r["doc_id"]] += r["length"]
    assert set(tokens) == set(single) - dirty
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in results["packing"])
