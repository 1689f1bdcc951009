"""The inverted file against exact search."""

from __future__ import annotations

import numpy as np
import pytest

from tarn.operators import retrieve, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    """Three thousand vectors around 40 places, equal ones, a zero vector, a null, one of another length."""
    rng = np.random.default_rng(5)
    places = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in places[i % 40] + 0.4 * rng.normal(size=16)]) for i in range(3000)]
    rows += [(4000 + i, rows[7][1]) for i in range(30)] + [(5000, [0.0] * 16), (5001, None), (5002, [1.0, 2.0])]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("ivf") / "index"), lists=40, rows_a_file=200)


def pairs(df):
    return [(r.chunk_id, round(r.score, 9)) for r in df.collect()]


def asked(vectors, n):
    return [r.embedding for r in vectors.filter(f"chunk_id < {n}").orderBy("chunk_id").collect()]


def test_every_vector_is_in_one_list(vectors, index):
    assert index.lists.count() == index.lists.select("ref").distinct().count() == 3031
    assert index.centroids.agg({"n": "sum"}).first()[0] == 3031


def test_exact_when_all_lists_count(vectors, index):
    for q in [*asked(vectors, 3), [1.0] * 16, [0.0] * 16]:
        for k in (1, 10, 45):
            want = pairs(retrieve.search_semantic(vectors, q, k))
            assert pairs(vector_index.search(index, q, k)) == want
            assert pairs(vector_index.search(index, q, k, probe=40)) == want


def test_recall_of_a_few_lists(vectors, index):
    queries = vectors.filter("chunk_id < 3000 and chunk_id % 20 = 0").selectExpr("chunk_id as query_id", "embedding as q")
    exact = {(r.query_id, r.chunk_id) for r in retrieve.search_semantic_batch(vectors, queries, 10).collect()}
    near = {(r.query_id, r.chunk_id) for r in vector_index.search_batch(index, queries, 10, 4).collect()}
    assert len(exact) == len(near) == 1500
    assert len(exact & near) / len(exact) >= 0.95
    every = vector_index.search_batch(index, queries, 10, 99).collect()
    assert {(r.query_id, r.chunk_id) for r in every} == exact


def test_recall_of_the_registered_index(spark, sf):
    from tarn.plans.search import semantic_ivf_recall

    r = semantic_ivf_recall(spark, sf).selectExpr("sum(n_found) / sum(n_exact) as recall", "count(*) as n").first()
    assert r.n == 10 and r.recall >= 0.9


def test_reads_only_probed_lists(vectors, index):
    q = asked(vectors, 1)[0]
    plan = index.lists.filter("list in (1, 2)").select("ref")
    files = len(plan.selectExpr("input_file_name() f").distinct().collect())
    assert 0 < files < index.lists.selectExpr("input_file_name() f").distinct().count() / 4
    out = vector_index.search(index, q, 5, probe=2)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [") >= 1 and "list#" in text.split("PartitionFilters: [", 1)[1].split("]")[0]
    lists = {r.ref: r.list for r in index.lists.select("ref", "list").collect()}
    assert len({lists[r.chunk_id] for r in out.collect()}) <= 2


def test_other_lengths_and_empty(spark, vectors, index, tmp_path):
    assert vector_index.search(index, [1.0, 2.0], 3).count() == 0
    assert vector_index.search(index, [1.0] * 16, 0).count() == 0
    empty = vector_index.build(vectors.limit(0), str(tmp_path / "empty"))
    assert vector_index.search(empty, [1.0] * 16, 3).count() == 0
    few = vector_index.build(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "name string, embedding array<float>"), str(tmp_path / "few"), ref="name")
    assert [tuple(r) for r in vector_index.search(few, [2.0, 0.0], 5).collect()] == [("a", 1.0), ("b", 1.0)]


def test_batch_blocks_are_dealt_out(spark):
    """Blocks of one vector length are in several partitions, whatever the joins are."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(6000)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        places = int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = retrieve.packed_blocks(v.selectExpr("chunk_id as key", "embedding as v", "size(embedding) as n"))
        assert packed.count() >= places
        used = packed.selectExpr(f"pmod(xxhash64(keys[0]), {places}) as p").distinct().count()
        assert used > 1
        got = retrieve.search_semantic_batch(v, v.filter("chunk_id < 3").selectExpr("chunk_id as query_id", "embedding as q"), 2).filter("rank = 1").collect()
        assert sorted((r.query_id, r.chunk_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_batches_of_block_pairs_are_limited_by_bytes(spark):
    """However many pairs of blocks a task has, a worker gets a few megabytes of them at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(1 << 30))
    rows = spark.range(3000).selectExpr("id AS chunk_id", "transform(sequence(0, 63), i -> cast(hash(id, i) % 97 AS double)) AS embedding")
    queries = rows.limit(20).selectExpr("chunk_id AS query_id", "embedding AS q")
    out = retrieve.search_semantic_batch(rows, queries, 3)
    assert int(spark.conf.get(name)) <= 4 << 20
    assert out.filter("rank = 1 and score > 0.999999").count() == 20
