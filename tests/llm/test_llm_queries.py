"""Registered queries against their SQL, and the pipeline stage by stage."""

from collections import Counter

import pytest
from cases import VECTORS, kept_vectors, odd_rows, odd_table, odd_vectors
from check import compare

import __spark_entry__ as entry
import corpus_pipeline
from corpusweave.llm.oracle import ORACLE_SQL
from corpusweave.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = compare(spark, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert got == want


def odd_folder(spark, folder, rows=None):
    table = odd_table(spark) if rows is None else spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(24)] if rows is None else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(odd_vectors() if rows is None else [], VECTORS).write.parquet(f"{folder}/embeddings.parquet")
    conversations = [(1, 0, "user", "<|x"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, None, None, None)]
    spark.createDataFrame(conversations if rows is None else [], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
@pytest.mark.parametrize("rows", [None, []])
def test_query_equals_sql_on_odd_tables(spark, tmp_path, monkeypatch, name, rows):
    import check

    folder = odd_folder(spark, tmp_path / "odd", rows)
    monkeypatch.setattr(check, "TABLES", [])
    sql = ORACLE_SQL[name]
    for table in ("documents", "conversations", "embeddings"):
        sql = sql.replace(f"FROM {table}", f"FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = compare(spark, QUERIES[name], sql, folder)
    assert got == want


@pytest.mark.parametrize("name", list(QUERIES))
def test_every_query_gives_a_row_per_row(spark, tmp_path, name):
    folder = odd_folder(spark, tmp_path / "odd")
    vectors = len(kept_vectors())
    rows = {"op10": 3, "chat": 2, "op11": 32 * vectors, "op13": vectors}.get(name.split("_")[0], len(odd_rows()))
    assert QUERIES[name](spark, folder).count() == rows


def test_all_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    folder = odd_folder(spark, tmp_path / "odd")
    docs = odd_table(spark, clashes=True)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.select("doc_id", "text").collect()
        if name != "bpe":
            assert docs.columns == before.columns
    ids = {name: Counter(r["doc_id"] for r in rows) for name, rows in kept.items()}
    assert ids["simhash"].keys() <= ids["toxicity"].keys() and max(ids["simhash"].values()) == 1
    assert ids["pii"] == ids["simhash"] and ids["mixing"].keys() <= ids["pii"].keys()
    assert ids["bpe"] == ids["mixing"]


def test_pipeline_runs_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_folder(spark, tmp_path / "none", [])).collect() == []


def test_pipeline_equals_its_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 0
    assert {"doc_id", "text", "input_ids", "decoded"} <= set(rows.columns)
