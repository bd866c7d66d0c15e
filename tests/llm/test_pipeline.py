import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.cases import awkward, empty, prose

SF = "/root/testdata/sf0.001"


def test_stage_list_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    names = contract.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_on_awkward_rows(spark, tmp_path, make):
    spark.createDataFrame([(1, prose(12, 50))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[:len(docs.columns)] == docs.columns and (k == 4 or len(out.columns) == len(docs.columns)), name
        out.write.parquet(path := str(tmp_path / name))
        before, docs = docs, spark.read.parquet(path)
        assert docs.count() <= before.count()
    if make is awkward:
        # What has no letter, the copies and the leaked text are gone; all else is there.
        texts = {r["text"] for r in docs.collect()}
        assert prose(12, 50) not in texts and prose(9, 40) in texts and prose(7, 6000) in texts and "word" in texts
        assert sum(r["text"].startswith(prose(8, 60)[:100]) for r in docs.collect()) <= 2


def test_run_agrees_with_its_stages_one_by_one(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r["doc_id"], r["text"], r["mix_position"])
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))


def test_audit_query_agrees_with_its_sql(spark):
    import duckdb
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF.replace('0.001', '0.01')}/pages.parquet'")
    name = next(n for n in contract.queries() if n.startswith("op5_"))
    frame = contract.queries()[name](spark, os.path.dirname(SF) + "/sf0.01")
    cursor = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in frame.collect()) == sorted(cursor.fetchall()) and frame.count() > 0
