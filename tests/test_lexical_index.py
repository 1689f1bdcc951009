"""The saved text index: dictionary, prefixes without nested loops, searches that end early."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import lexical


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """6,000 chunks; ``rareword`` is dense in a few of them, which stand together."""
    rng = random.Random(2)
    common = [f"w{i}" for i in range(50)] + ["übergabe", "überall", "x"]
    rows = []
    for i in range(6000):
        words = [rng.choice(common) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.3:
            words.append("rareword")
        if 2000 <= i < 2010:
            words = ["rareword"] * 30 + ["focus"]
        rows.append((i - 1000, f"s{i % 7}", " ".join(words)))  # negative ids too
    path = str(tmp_path_factory.mktemp("text") / "index")
    lexical.build_index(spark.createDataFrame(rows, "chunk_id long, symbol string, code string")).save(path)
    return lexical.TextIndex.load(spark, path)


def found(df):
    return [(r.chunk_id, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["rareword", "focus rareword w7", "w1_w2 rareword", "w", "über x", "nothing_here", "zzzz", "", "w4_w5_w6 w1_w"])
def test_early_end_gives_the_same_rows(index, query):
    for k in (10, 300) if " " in query else (10,):
        assert found(lexical.search_top(index, query, k)) == found(lexical.search_one(index, query, k))


def test_early_end_reads_fewer_postings(spark, index):
    """Of the term's postings, the final scan keeps those of blocks that can reach the floor."""
    every = index.postings.filter("term = 'rareword'").count()
    out = lexical.search_top(index, "rareword", 5)
    out.collect()
    blocks = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in blocks
    floor = out.agg(F.min("score")).first()[0]
    some = lexical.term_blocks(index.postings.filter("term = 'rareword'"))
    n, avgdl = index.lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    hit = some.agg(F.sum(F.bit_count(F.col("marks")[0]) + F.bit_count(F.col("marks")[1]))).first()[0]
    idf = math.log((n - hit + 0.5) / (hit + 0.5))
    bound = F.lit(idf) * F.col("most") * 2.2 / (F.col("most") + 1.2 * (0.25 + 0.75 * F.col("least") / avgdl)) / 100
    kept = some.filter(bound >= floor - 1e-12).select("block")
    read = index.postings.filter("term = 'rareword'").join(kept, "block", "left_semi").count()
    assert 0 < read < every / 4


def test_marks_count_chunks(index):
    marks = index.blocks.select("term", F.aggregate("marks", F.lit(0), lambda n, w: n + F.bit_count(w)).alias("n"), "most", "least", "block")
    got = {(r.term, r.block): (r.n, r.most, r.least) for r in marks.collect()}
    want = {}
    for r in index.postings.groupBy("term", "chunk_id", "dl").count().collect():
        n, most, least = want.get((r.term, r.chunk_id // 128), (0, 0, 1 << 30))
        want[r.term, r.chunk_id // 128] = (n + 1, max(most, r["count"]), min(least, r.dl))
    assert got == want


def test_prefixes_meet_the_dictionary_by_equality(spark, index):
    wanted = spark.createDataFrame([("w1", True), ("w1", False), ("ü", True), ("über", True), ("w", True), ("überallhin", True), ("nope", True), ("x", True)], "token string, prefix boolean")
    met = lexical.expand(index.terms, wanted)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    terms = [r.term for r in index.terms.collect()]
    want = {(r.token, r.prefix, t) for r in wanted.collect() for t in terms if (t.startswith(r.token) if r.prefix else t == r.token)}
    assert {tuple(r) for r in met.collect()} == want and len(want) > 10
    queries = spark.createDataFrame([(0, "w1 ü x"), (1, "s1_w1")], "query_id int, query string")
    plan = lexical.search_lexical(index, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("NestedLoop") <= 1  # the one row of corpus totals


@pytest.mark.parametrize("query", ["w1_w2 rareword", "w4_w5 über x"])
def test_postings_stay_in_their_buckets(index, query):
    """What a search groups by chunk is in one bucket; only the counts of phrases are shuffled, and no term's postings come together."""
    plan = lexical.search_one(index, query, None)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    shuffled = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert not [x for x in shuffled if "chunk_id" in x], shuffled


def test_an_index_of_another_session_keeps_its_buckets(spark, index, tmp_path):
    rows = spark.createDataFrame([(i, "s", f"a{i % 3} b") for i in range(500)], "chunk_id long, symbol string, code string")
    lexical.build_index(rows).save(str(tmp_path / "i"))
    want = found(lexical.search_one(lexical.TextIndex.load(spark, str(tmp_path / "i")), "a1_b", 5))
    spark.sql(f"DROP TABLE {lexical._table_of(str(tmp_path / 'i'))}")
    again = lexical.TextIndex.load(spark, str(tmp_path / "i"))
    assert found(lexical.search_one(again, "a1_b", 5)) == want and len(want) == 5
    plan = lexical.search_one(again, "a1_b", None)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "chunk_id" in x]


def test_prefix_counts_join_nothing(index):
    counts = lexical.prefix_counts(index, ["w1", "w", "über", "nope"])
    assert "Join" not in counts._jdf.queryExecution().executedPlan().toString()
    held = {r.term: r.n for r in index.postings.groupBy("term").agg(F.countDistinct("chunk_id").alias("n")).collect()}
    assert {tuple(r) for r in counts.collect()} == {(p, t, n) for p in ("w1", "w", "über", "nope") for t, n in held.items() if t.startswith(p)}
