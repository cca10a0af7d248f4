import numpy as np
import pytest
from pyspark.sql import functions as F

from weirwork.operators import search as S
from weirwork.operators import vector_index as V

from .conftest import SMALL


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall_on_the_given_vectors(spark, tmp_path, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    V.build(vectors, str(tmp_path / "ivf"))
    queries = vectors.filter("vec_id % 20 = 0")
    exact = S.nearest(queries, vectors, 10)
    lists = spark.read.parquet(str(tmp_path / "ivf" / "centres")).count()
    found = V.search(spark, str(tmp_path / "ivf"), queries, 10)
    assert spark.read.parquet(str(tmp_path / "ivf" / "probes")).first()["probes"] < lists
    assert V.recall(found, exact) >= 0.9
    every = V.search(spark, str(tmp_path / "ivf"), queries, 10, lists)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))


def test_every_row_is_indexed_and_odd_ones_find_nothing(spark, tmp_path):
    rnd = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rnd.normal(size=(300, 6)))] + [(i, [1.0, 0.0, 0.0, 0.0, 0.0, i / 1000]) for i in range(300, 400)]
    odd = [(400, None), (401, [0.0] * 6), (402, [1.0]), (403, [float("nan")] * 6), (None, [1.0] * 6), (404, [None] * 6)]
    vectors = spark.createDataFrame([(*r, 7) for r in rows + odd], "vec_id long, embedding array<double>, list int").repartition(4)
    V.build(vectors, str(tmp_path / "ivf"), lists=12)
    held = spark.read.parquet(str(tmp_path / "ivf" / "lists"))
    ids = np.concatenate([np.frombuffer(r["v_ids"], np.int64) for r in held.collect()])
    assert sorted(ids.tolist()) == list(range(405))
    found = V.search(spark, str(tmp_path / "ivf"), vectors, 5, 4)
    assert found.filter("query_id >= 400").count() == 0
    assert found.filter("query_id = vec_id").count() == 0
    exact = S.nearest(vectors.filter("vec_id < 400"), vectors, 5)
    assert V.recall(found, exact) > 0.6
    right = found.join(exact.select("query_id", "vec_id", F.col("score").alias("want")), ["query_id", "vec_id"])
    assert right.filter("score <> want").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])]])
def test_next_to_nothing(spark, tmp_path, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    V.build(vectors, str(tmp_path / "ivf"))
    assert V.search(spark, str(tmp_path / "ivf"), vectors, 3, 2).count() == 0


def test_a_search_sends_queries_as_often_whatever_their_probes(spark, tmp_path):
    import random

    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(16)]) for i in range(600)], "vec_id long, embedding array<double>")
    folder = str(tmp_path / "v")
    V.build(rows, folder, lists=20)
    for probes in (1, 20):
        found = V.search(spark, folder, rows, 3, probes)
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # queries were copied for each of 16 lanes
        assert found.filter("rank = 1").count() == 600
    exact = {(r["query_id"], r["vec_id"]) for r in S.nearest(rows, rows, 3).collect()}
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == exact
