"""The registered queries on the smallest table, with DuckDB where SQL can express them, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from voltlake.llm import decontaminate, fuzzy_lines, queries, simhash, toxicity
from voltlake.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    with duckdb.connect() as connection:
        for name in ("documents", "conversations", "benchmark", "labels", "pages", "embeddings"):
            path = f"{SF}/{name}.parquet"
            source = path if os.path.isfile(path) else f"{path}/*.parquet"
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        yield connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, database, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    want = database.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_has_every_row(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    n = frame.count()
    if name.startswith("op8"):
        assert 0 < n < 200
    else:
        assert n == table(spark, SF, "pages" if name.startswith("op7") else "documents").count()


def test_pipeline_is_its_stages(spark):
    """Each stage by its own definition, over what the one before kept."""
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    civil = docs.join(toxicity.score(docs, model).where("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    lines = fuzzy_lines.line_report(civil, min_chars=1).selectExpr("doc_id", "dedup_text as text")
    single = simhash.near_copies(lines).where("doc_id = component_id").select("doc_id")
    lines = lines.join(single, "doc_id", "left_semi")
    dirty = decontaminate.contamination(lines, table(spark, SF, "benchmark")).select("doc_id")
    want = {r["doc_id"] for r in lines.join(dirty, "doc_id", "left_anti").collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want) and all(r["round_trip"] for r in rows)
