"""The registered queries and the pipeline over the smallest tables."""

import corpus_pipeline
import pytest
from oracle import by_duckdb, by_spark

from waymark.llm import decontaminate, jaccard, pieces, quality, registry, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    assert by_spark(registry.QUERIES[name](spark, FOLDER)) == by_duckdb(registry.SQL[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_whole_tables(spark, name):
    got = registry.QUERIES[name](spark, FOLDER)
    if name == "op11_whitening":
        n = registry.table(spark, FOLDER, "embeddings").count()
        assert got.count() == 32 * n and got.select("vec_id").distinct().count() == n
        return
    n = registry.table(spark, FOLDER, "documents").count()
    assert got.count() == n or name == "op3_decontaminate"
    assert "doc_id" in got.columns


def test_pipeline(spark):
    docs = registry.table(spark, FOLDER, "documents")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], FOLDER).persist())
    assert all(s.columns == docs.columns for s in seen[:-1])
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in seen]
    toxic = toxicity.score(docs, toxicity.train(docs, registry.table(spark, FOLDER, "labels"))).filter("is_toxic")
    assert set(ids[0]) - set(ids[1]) == {r["doc_id"] for r in toxic.collect()}
    assert set(ids[2]) <= set(ids[1]) and ids[4] == ids[5]
    classes = jaccard.near_duplicates(seen[2])
    assert ids[3] == sorted({r["class_id"] for r in classes.collect()})
    leaks = {r["doc_id"] for r in decontaminate.overlaps(seen[3], registry.table(spark, FOLDER, "benchmark")).collect()}
    assert set(ids[3]) - set(ids[4]) == leaks
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()) == ids[5]
    assert pieces and quality
