"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import brute


@pytest.fixture(scope="module")
def folder(spark, docs, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{at}/documents.parquet")
    long = next(r[1] for r in rows if r[1] and len(r[1].split()) > 100)
    spark.createDataFrame([(1, " ".join(long.split()[5:50]))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(i % 2), 0) for i, r in enumerate(rows[:20])], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, docs, rows, folder):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    stage = dict(cp.STAGES)
    scored = stage["quality"](spark, docs, folder)
    assert scored.columns == docs.columns and scored.count() <= len(rows)
    lined = stage["line_dedup"](spark, docs, folder)
    assert lined.columns == docs.columns
    want = {(k, x[2]) for (k, _), x in brute.lines([(r[0], r[1]) for r in rows]).items() if not x[1] or x[2].strip()}
    assert {(r.doc_id, r.text or "") for r in lined.collect()} == want
    single = stage["near_duplicates"](spark, docs.where("doc_id IS NOT NULL"), folder)
    assert single.columns == docs.columns and single.groupBy("doc_id").count().where("count > 1").isEmpty()
    clean = stage["decontamination"](spark, docs, folder)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    found = brute.contamination([(r[0], r[1]) for r in rows], items)
    assert clean.columns == docs.columns and clean.count() == sum(not found[r[0], r[1]][3] for r in rows)
    packed = stage["packing"](spark, docs, folder)
    assert packed.where("start = 0").count() == len(rows)


def test_run_and_empty(spark, none, folder, tmp_path):
    out = cp.run(spark, folder)
    assert out.agg(F.count("*")).first()[0] > 0
    for name, f in cp.STAGES:
        assert f(spark, none, folder).count() == 0, name
