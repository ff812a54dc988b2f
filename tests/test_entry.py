"""The driver's contract, also without the optional subpackage."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from telar.operators import catalogue, catalogue_sources, dedup  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.SQL)


@pytest.fixture(scope="module")
def sql():
    import glob
    import os

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(queries) and set(sql) <= set(queries)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sql, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cursor = sql.execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_fuzzy_dedup_of_texts(spark):
    texts = catalogue._records(spark, FOLDER).select("id", catalogue.curators.curate(F.col("text"), "rapidfuzz").alias("text"))
    kept = {}
    for i, t in sorted((r.id, r.text) for r in texts.collect() if r.text):
        if not any(dedup.token_set_ratio(t, u) >= 95 for u in kept.values()):
            kept[i] = t
    assert sorted(r.id for r in catalogue.QUERIES["fuzzy_dedup"](spark, FOLDER).collect()) == list(kept)


def test_minhash_dedup_of_cleaned_texts(spark, tmp_path):
    rows = [(1, "<p>la gente de la guagua</p>"), (2, "la  gente de la <b>guagua</b>"), (3, "otra cosa"), (4, "<br>"), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in catalogue.QUERIES["minhash_lsh_dedup"](spark, str(tmp_path)).collect()) == [1, 3]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "rank", "chunk_id", "score"]
