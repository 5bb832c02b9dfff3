"""Nearest vectors against a plain search in Python, in the arithmetic of the SQL."""

from __future__ import annotations

import math
import random
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.operators.retrieval import cache_hits, nearest
from tessera.plans.queries import catalogue


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return 0.0
    dot = x = y = 0.0
    for i, j in zip(a, b, strict=True):
        dot, x, y = dot + i * j, x + i * i, y + j * j
    if not x * y:
        return 0.0
    got = dot / math.sqrt(x * y)
    return got if math.isnan(got) else max(-1.0, min(1.0, got))


def plain(items, asked, k, least=None, other=False):
    out = []
    for q, v in asked:
        each = [(cosine(v, x), i) for i, x in items if not other or i != q]
        each = sorted(((s, i) for s, i in each if least is None or math.isnan(s) or s >= least), key=lambda p: (not math.isnan(p[0]), 0 if math.isnan(p[0]) else -p[0], p[1]))[:k]
        out += [(q, i, "nan" if math.isnan(s) else s, n + 1) for n, (s, i) in enumerate(each)]
    return sorted(out)


def table(n, seed, key):
    pick = random.Random(seed)
    bases = [[pick.uniform(-1, 1) for _ in range(5)] for _ in range(n // 4)]
    rows = [(key(i), [pick.choice([1.0, 1.0, 3.0, 0.1, -1.0]) * x for x in pick.choice(bases)]) for i in range(n)]
    odd = [[0.0] * 5, None, [1.0, 2.0], [], [1.0, None, 1.0, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0, 1.0], [1e-200] * 5, [1e-90, 0.0, 0.0, 0.0, 0.0], [1e200, 1.0, 1.0, 1.0, 1.0]]
    return rows + [(key(n + i), v) for i, v in enumerate(odd * 2)] + [(key(n + 100 + i), bases[0]) for i in range(60)]


@pytest.mark.parametrize("key", [int, lambda i: f"k{i * 7919 % 1000}"], ids=["numbers", "strings"])
@pytest.mark.parametrize("other", [False, True])
@pytest.mark.parametrize("least", [None, 0.6])
def test_nearest_is_exact(spark, key, other, least):
    rows = table(240, 3, key)
    kind = "long" if key is int else "string"
    df = spark.createDataFrame(rows, f"k {kind}, v array<double>").repartition(3)
    asked = [r for i, r in enumerate(rows) if i % 5 == 0 or i > 240]
    held = spark.createDataFrame(asked, f"q {kind}, w array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        for most in (10_000, 25):
            got = nearest(df, "k", "v", held, "q", "w", 7, least, most, other).select("q", "k", "score", "place").collect()
            assert sorted((q, i, "nan" if math.isnan(s) else s, n) for q, i, s, n in got) == plain(rows, asked, 7, least, other)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_has_no_join_of_pairs(spark):
    df = spark.createDataFrame(table(40, 1, int), "k long, v array<double>")
    found = nearest(df, "k", "v", df.select(F.col("k").alias("q"), F.col("v").alias("w")), "q", "w", 3)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_nothing_to_search(spark):
    df = spark.createDataFrame(table(40, 1, int), "k long, v array<double>")
    asked = df.select(F.col("k").alias("q"), F.col("v").alias("w"))
    assert nearest(df, "k", "v", asked.limit(0), "q", "w", 3).collect() == []
    assert nearest(df.limit(0), "k", "v", asked, "q", "w", 3).collect() == []
    assert cache_hits(df.limit(0), "k", "v", asked, "q", "w").where("k is null").count() == df.count()


@pytest.mark.parametrize("name", ["cosine_top", "semantic_cache"])
def test_scaled_copies_tie_as_in_sql(spark, tmp_path, name):
    pick = random.Random(9)
    bases = [[pick.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x * (1 + i % 7) for x in bases[i % 6]]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    query, sql = catalogue()[name]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    found = query(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(f"select {', '.join(found.columns)} from ({sql})").fetchall(), key=str)


def test_cache_of_copies(spark):
    """A third of all entries are one vector, and keys repeat: each query still gets the first entry of another key."""
    pick = random.Random(4)
    rows = [(i // 2, [1.0, 2.0, 3.0] if i % 3 == 0 else [pick.uniform(-1, 1) for _ in range(3)]) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, v array<float>").repartition(4)
    rows = [(r.k, r.v) for r in df.collect()]
    asked = [(k, [5.0, 1.0 * k, 1.0]) for k in range(0, 450, 9)] + [(0, [2.0, 4.0, 6.0]), (1000, [2.0, 4.0, 6.0]), (1001, None)]
    held = spark.createDataFrame(asked, "q long, w array<float>")
    got = nearest(df, "k", "v", held.where("w is not null"), "q", "w", 1, 0.5, 30, True).select("q", "k", "score").collect()
    want = {}
    for q, k, s, _ in plain(rows, [(q, [float(x) for x in w]) for q, w in asked if w], 1, 0.5, True):
        want[q] = min(want.get(q, (2.0, k)), (-s, k))
    assert {r.q: (-r.score, r.k) for r in got} == want
    hits = {r.q: r.k for r in cache_hits(df, "k", "v", held, "q", "w", 0.5, True).collect()}
    assert hits == {q: want[q][1] if q in want else None for q, _ in asked} and hits[1000] == 0 and hits[1001] is None


def side(rows):
    return vectors.Side((np.full(len(rows), rows.shape[1]), np.arange(len(rows)) * rows.shape[1], rows.reshape(-1)), rows.shape[1])


def test_products_are_made_in_tiles_that_stay_in_cache():
    pick = np.random.default_rng(5)
    asking, items, best = side(pick.standard_normal((2_000, 16))), side(pick.standard_normal((4_000, 16))), vectors.Best(2_000, 1)
    none = np.zeros((0, 2), "int64")
    vectors.meet(asking, items, best, none, 0, None)
    tracemalloc.start()
    vectors.meet(asking, items, best, none, 4_000, None)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6_000_000


@pytest.mark.parametrize("k", [1, 3])
def test_many_tiles_give_what_one_sort_gives(k):
    pick = np.random.default_rng(6)
    pool = pick.standard_normal((500, 6))
    q, x = pool[pick.integers(0, 500, 1_100)], np.concatenate([pool[pick.integers(0, 500, 900)] * pick.choice([1.0, 3.0, 0.1], (900, 1)), pick.standard_normal((900, 6))])
    q[[3, 600]], x[[0, 700, 1_750]] = [[np.nan] + [1.0] * 5, [1e-160] * 6], [[0.0] * 6, [np.nan] + [1.0] * 5, [1e170] * 6]
    never = np.column_stack([np.arange(1_100), pick.integers(0, 1_800, 1_100)])
    asking, items, best = side(q), side(x), vectors.Best(len(q), k)
    for at in range(0, 1_800, 1_300):
        mine = never[(never[:, 1] >= at) & (never[:, 1] < at + 1_300)] - [0, at]
        vectors.meet(asking, side(x[at : at + 1_300]), best, mine, at, 0.2)
    i, j = (a.reshape(-1) for a in np.indices((len(q), len(x))))
    score = vectors.cosines(asking, i, items, j).reshape(len(q), len(x))
    score[never[:, 0], never[:, 1]] = -np.inf
    for row in range(len(q)):
        want = [(s, n) for s, n in sorted(zip(-score[row], range(len(x)), strict=True))[:k] if -s >= 0.2]
        assert [(-s, n) for s, n in zip(best.score[row], best.number[row], strict=True) if n >= 0 and s >= 0.2] == want


def test_tasks_fill_their_last_wave(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.createDataFrame(table(240, 2, int), "k long, v array<double>").repartition(cores + 1)
    found = nearest(df, "k", "v", df.select(F.col("k").alias("q"), F.col("v").alias("w")), "q", "w", 3)
    assert f"RoundRobinPartitioning({2 * cores})" in found._jdf.queryExecution().toString()
