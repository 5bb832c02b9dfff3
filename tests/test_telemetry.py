from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import adaptive as A
from tessera.operators import telemetry as X


def test_sse_blocks(spark):
    raw = spark.createDataFrame([(1, "event: a\r\ndata: x\r\ndata: y\r\n\r\n: note\n\ndata:{}\n\n")], "k int, t string")
    assert [tuple(r)[2:] for r in X.sse_events(raw, "k", "t").orderBy("place").collect()] == [("a", "x\ny"), ("", ""), ("", "{}")]


def test_commands_keys_and_decisions(spark):
    got = spark.createDataFrame([("cat x",), ("FOO=1 pytest tests",), ("git log",), ("sudo rm -r y",), ("weird",)], "c string").select(X.command_class(F.col("c")).alias("k")).collect()
    assert [r.k for r in got] == ["read", "test", "git", "edit", "other"]
    a, b = spark.createDataFrame([('{"b":1,"a":[2]}',), ('{"a":[2],"b":1}',)], "t string").select(X.canonical(F.col("t")).alias("c")).collect()
    assert a.c == b.c
    assert spark.range(1).select(X.id_named(F.array(F.lit("user_id"), F.lit("name"), F.lit("nonce"))).alias("k")).first().k == ["user_id", "nonce"]


def test_best_k_of_small_same_and_different_groups():
    assert A.best_k(["a"] * 5) == 5
    assert A.best_k(["the same line"] * 100) == 3
    assert 15 <= A.best_k([f"entry {i} {'x' * (i % 7)} about {i * 31}" for i in range(40)]) <= 40
