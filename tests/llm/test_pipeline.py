"""The pipeline against its operators one by one, and the registered SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from spanloom.llm import registry
from spanloom.llm.common import documents, saved

TABLES = ("documents", "pages")


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert docs.select("doc_id").distinct().count() == docs.count()
    by_stage = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in by_stage.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == by_stage.count()


def test_stages_keep_what_is_clean(spark):
    texts = [(i, " ".join(f"plain{i}w{j}" for j in range(80))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert sorted(map(tuple, stage(spark, docs, "").collect())) == sorted(map(tuple, docs.collect())), name


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    wanted = con.execute(registry.ORACLE_SQL[name]).df()
    found = registry.QUERIES[name](spark, sf).toPandas()[list(wanted.columns)]
    key = list(wanted.columns)
    assert found.sort_values(key).astype(str).values.tolist() == wanted.sort_values(key).astype(str).values.tolist()
