import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirwork.llm import mixing, queries, sharding
from weirwork.llm.ngram_join import jaccard_components
from weirwork.llm.quality import quality_rules
from weirwork.llm.toxicity import tag_toxicity, train

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck(queries.ORACLES[name]))


def test_rates_reach_target_weights(spark):
    rows = [(i, "abcd" * (1 + i % 5), "a" if i % 10 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(docs, {"a": 1.0, "b": 3.0}, scale=2.0)
    sums = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(len(t) for _, t, _ in rows)
    assert sums["a"] / (2 * total) == pytest.approx(0.25, abs=0.03)
    assert sums["b"] / (2 * total) == pytest.approx(0.75, abs=0.08)
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.max("copy_no").alias("k")).collect()
    assert all(r["n"] == r["m"] == r["k"] + 1 for r in per)
    again = mixing.mix_sources(docs.repartition(7), {"a": 1.0, "b": 3.0}, scale=2.0)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "copy_no", "shuffle_key").collect()))
    assert key(mixed) == key(again)


def test_counts_follow_the_distribution(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(6000)], "doc_id long, text string, source string")
    for mean in (0.7, 40.0):
        n = [r["c"] for r in mixing.mix_sources(docs, scale=mean).groupBy("doc_id").agg(F.count("*").alias("c")).collect()]
        assert sum(n) / 6000 == pytest.approx(mean, rel=0.05)
        assert 6000 - len(n) == pytest.approx(6000 * math.exp(-mean), rel=0.1, abs=1)


def test_mixing_defined_cases(spark):
    rows = [(1, None, None, 9), (2, "", "z", 9), (None, "abc", "a", 9), (4, "x" * 200000, "a", 9), (5, "y", None, 9), (5, "y", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int")
    out = mixing.mix_sources(docs)
    assert out.columns[:3] == ["doc_id", "text", "source"]
    assert "z" not in {r["source"] for r in out.collect()}
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {}).count() == 0


def plain_capacity(sizes, shards):
    best = None
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1):
        at = [0, *cuts, len(sizes)]
        best = min(x for x in (best, max(sum(sizes[a:b]) for a, b in itertools.pairwise(at))) if x is not None)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_smallest_capacity(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([1, 2, 5, 30]) for _ in range(rnd.randint(1, 9))]
    for shards in (1, 2, 3, 4):
        c = sharding.smallest_capacity(sizes, shards)
        assert c == plain_capacity(sizes, shards)
        at = [0, *sharding.even_cuts(sizes, shards, c), len(sizes)]
        assert at == sorted(at)
        assert max(sum(sizes[a:b]) for a, b in itertools.pairwise(at)) <= c
    assert sharding.smallest_capacity([], 3) == 0


@pytest.mark.parametrize("fetch", [10**6, 60])
def test_shards(spark, monkeypatch, fetch):
    monkeypatch.setattr(sharding, "FETCH_GROUPS", fetch)
    monkeypatch.setattr(sharding, "COARSE_BITS", 4)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["hot", f"text {i} " * rnd.randint(1, 20), None, ""])) for i in range(1500)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, shard int")
    got = sharding.minimax_shards(docs, 6).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    homes, slots, sizes = {}, {}, [0] * 6
    for r in got:
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 8
        assert homes.setdefault(text[r["doc_id"]] or "", r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert (r["law"], r["grown_shard"]) == ("bytes", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in got:
        groups[r["text_crc32"]] = groups.get(r["text_crc32"], 0) + r["size"]
    assert max(sizes) <= sum(sizes) / 6 + max(groups.values())
    assert min(sizes) > 0
    assert sharding.minimax_shards(docs.limit(0), 3).count() == 0
    assert sharding.minimax_shards(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string"), 3).count() == 2


def test_small_groups_give_even_shards(spark):
    rows = [(i, f"text {i} " * (1 + i % 9)) for i in range(2000)]
    got = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 7).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r["n"] for r in got]
    assert len(sizes) == 7
    assert max(sizes) - min(sizes) <= 2 * 110


def test_a_hot_group_leaves_the_others_even(spark):
    rows = [(i, "h" * 100 if i < 500 else f"{i:0100d}") for i in range(1000)]
    got = sharding.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string"), 5).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = sorted(r["n"] for r in got)
    assert sizes[-1] == 500 * 108
    assert len(sizes) == 5
    assert sizes[3] - sizes[0] < 0.5 * sizes[3]


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mixing", "tokens"]
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            raw = spark.read.parquet(f"{SMALL}/documents.parquet")
            model = train(raw, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert ids(out) == ids(tag_toxicity(docs, model).filter("predicted = 0"))
        elif name == "quality":
            assert ids(out) == ids(quality_rules(docs, queries.tokenizer_file("piece_bpe_32k.model")).filter("kept"))
        elif name == "near_duplicates":
            assert ids(out) == ids(jaccard_components(docs, 5, 80).filter("doc_id = component_id"))
        elif name == "mixing":
            assert ids(out) == ids(mixing.mix_sources(docs))
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert sorted(r["doc_id"] for r in out.collect()) == ids(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_thousands_of_shards(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) || id AS text")
    rows = sharding.minimax_shards(docs, shards=5000).collect()
    assert len(rows) == 9000
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r)
    assert min(by_shard) == 0
    assert max(by_shard) <= 4999
    assert len(by_shard) == 5000
    for some in by_shard.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
    sizes = [r["size"] for r in rows]
    assert max(sum(r["size"] for r in some) for some in by_shard.values()) <= max(sizes) + -(-sum(sizes) // 5000)
