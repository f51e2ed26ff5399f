"""Retrieval queries ask every question of their table."""

import pytest
from pyspark.sql import functions as F

from ferrywork.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    base = spark.read.parquet("/root/testdata/sf0.001/chunks_v3.parquet")
    base.where("level = 'child'").orderBy("chunk_id").limit(30).write.parquet(f"{d}/chunks_v3.parquet")
    q = spark.read.parquet("/root/testdata/sf0.001/questions_v3.parquet")
    q.where("cast(regexp_extract(qid, '([0-9]+)$', 1) as bigint) % 20 in (0, 1, 7)").withColumn("question", F.concat("question", F.lit(" duct gallbladder"))).write.parquet(f"{d}/questions_v3.parquet")
    return str(d)


def asked(spark, tables):
    return {r.qid for r in spark.read.parquet(f"{tables}/questions_v3.parquet").select("qid").collect()}


def test_hybrid_hits_asks_all_questions(spark, tables):
    assert {r.qid for r in QUERIES["hybrid_hits"](spark, tables).select("qid").collect()} == asked(spark, tables)


def test_mock_results_asks_all_questions(spark, tables):
    assert {r.qid for r in QUERIES["mock_results"](spark, tables).select("qid").collect()} == asked(spark, tables)


def test_retrieval_recall_asks_all_questions(spark, tables):
    assert QUERIES["retrieval_recall"](spark, tables).first().n_queries == len(asked(spark, tables))
