"""The pipeline and the queries against brute force and SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from test_decontamination import brute as contaminated
from test_jaccard import brute as groups
from test_plain_operators import jump

import corpus_pipeline
from tessera.llm import toxicity
from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES
from tessera.llm.tables import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    score = {r["doc_id"]: r["score"] for r in toxicity.toxic_scores(docs, table(spark, SF, "labels")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if score[r["doc_id"]] < 0.7]
    rows = [rows[i] for i, (_, c) in enumerate(groups([t for _, t in rows], 5, 80)) if c == i]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    rows = [r for r, (_, hit, _) in zip(rows, contaminated([t for _, t in rows], items), strict=True) if not hit]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in rows} and 0 < len(got) < docs.count()
    assert all(got[i]["shard"] == jump(i, corpus_pipeline.SHARDS) and got[i]["size"] == 16 + len(t.encode()) for i, t in rows)


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, expected = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, got.select(*columns).toArrow().to_pylist())) == sorted(map(str, expected.select(*columns).to_arrow_table().to_pylist()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))
