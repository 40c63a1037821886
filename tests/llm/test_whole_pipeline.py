"""The mixing stage reaches the pipeline's rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.sharding import shard_documents
from tessera.llm.tables import cut, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_slots_follow_the_mixed_order(spark, monkeypatch):
    rows = {r["doc_id"]: (r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect()}
    docs = table(spark, SF, "documents").where(F.col("doc_id").isin(list(rows)))
    position = {r["doc_id"]: r["position"] for r in mixing.mixed(docs).collect()}
    expected, taken = {}, {}
    for i in sorted(rows, key=position.get):
        expected[i] = (rows[i][0], taken.get(rows[i][0], 0))
        taken[rows[i][0]] = expected[i][1] + 1
    assert rows == expected
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] != "mixing"])
    without = {r["doc_id"]: (r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(without) == set(rows) and without != rows


def test_a_given_order_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "RUN", 16)
    docs = cut(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (-F.col("id")).alias("o")).repartitionByRange(7, "o").sortWithinPartitions("o"))
    out = corpus_pipeline.shard(spark, docs, SF).collect()
    for shard in range(corpus_pipeline.SHARDS):
        own = sorted((r["slot"], r["doc_id"]) for r in out if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted((i for _, i in own), reverse=True)
    with pytest.raises(ValueError, match="together"):
        shard_documents(docs, 4, run=F.lit("a"))
