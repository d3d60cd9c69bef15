"""Block-max search against scores of all pairs, and where its rows go."""

import random

import pytest
from pyspark.sql import functions as F

from dossier_spark.operators import blockmax as M
from dossier_spark.operators import retrieval as R


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(6)
    words = [f"mot{i}" for i in range(150)]
    text = lambda n: " ".join(words[min(149, int(r.expovariate(0.04)))] for _ in range(n))
    rows = [(f"c{i % 3 if i % 2 else 0}", f"p{i:04d}", None if i % 5 else i, i % 4, text(r.randrange(1, 60))) for i in range(700)]
    rows += [("c0", "same", None, i, "mot140 mot141") for i in range(40)] + [("c4", "alone", None, 0, "rien"), ("c0", "leer", None, 0, ""), ("c0", "null", None, 0, None)]
    chunked = spark.createDataFrame(rows, "client_id string, path string, page int, chunk_no int, chunk string").repartition(4)
    queries = spark.createDataFrame([(i, text(r.randrange(1, 25))) for i in range(30)] + [(90, "mot140 mot141 mot141"), (91, "inconnu"), (92, "")], "query_id long, text string")
    return chunked, queries


def rows_of(df):
    return sorted((r.client_id, r.query_id, r["rank"], r.path, str(r.page), r.chunk_no, r.score) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"size": 40}, {"size": 150, "block": 50}])
def test_best_passages_are_those_of_all_scores(data, options):
    chunked, queries = data
    want = R.top_passages(R.bm25(chunked, queries, size=64), 4)
    assert rows_of(R.best_passages(chunked, queries, 4, **options)) == rows_of(want)


def test_few_pairs_are_scored(data):
    chunked, queries = data
    found = R._search(chunked, queries, 3, R.K1, R.B, 1 << 20, 64)
    every = R.bm25(chunked, queries).count()
    assert found.agg(F.sum("pairs")).first()[0] < every / 2


def test_no_posting_is_shuffled(spark, data):
    """Without broadcasts by size, what is exchanged is keyed by client, or by client and term after counting a block's own."""
    chunked, queries = data
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    write = M.written
    try:
        M.written = lambda df, name, *a: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), write(df, name, *a))[1]
        R.best_passages(chunked, queries, 3)
    finally:
        M.written = write
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    by_name = dict(plans)
    assert "hashpartitioning" not in by_name["blocks"]
    assert "tokens" not in by_name["index"] and "hashpartitioning(client_id" in by_name["index"]


def test_empty(spark, data):
    chunked, queries = data
    assert R.best_passages(chunked.limit(0), queries, 3).count() == 0
    assert R.best_passages(chunked, queries.limit(0), 3).count() == 0
