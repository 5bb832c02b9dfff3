"""Streams against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tessera.plans.queries import catalogue


@pytest.mark.parametrize("files", [1, 3])
def test_prefix_state_orders_events_over_batches(spark, tmp_path, files):
    pick, begin = random.Random(5), datetime(2024, 1, 1)
    rows = [(k, begin + timedelta(minutes=pick.randint(0, 60)) if k % 9 else None, pick.choice([1, 1, 1, 2, None]), "view", 1.0, pick.choice(["a", "b", None])) for k in range(300)]
    pick.shuffle(rows)
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").repartition(files).write.parquet(path)
    want = set()
    for user in (1, 2, None):
        props = [r[5] for r in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is None, r[1] or begin, r[0]))]
        want.add((user, len(props), sum(a == b and a is not None for a, b in zip(props, props[1:], strict=False))))
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(held, 7)
    try:
        got = catalogue()["stream_prefix_state"][0](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(held)
    assert len(got) == 3 and {(r.user_id, r.seen, r.hits) for r in got} == want


def test_prefix_state_of_one_file(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=299 - k), 1, "view", 1.0, str(k // 2)) for k in random.Random(3).sample(range(300), 300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(held, 7)
    try:
        assert catalogue()["stream_prefix_state"][0](spark, str(tmp_path)).collect() == [(1, 300, 150)]
    finally:
        spark.conf.unset(held)
