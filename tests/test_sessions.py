"""Replaced reads of small sessions."""

from __future__ import annotations

import hashlib

from tessera.operators.sessions import rewritten


def test_only_long_stale_reads_are_replaced(spark):
    long = "ä" * 256
    rows = [(1, long, "a.py", "stale"), (2, long[:-1] + "b", "a.py", "stale"), (3, long, None, "superseded"), (4, long, "a.py", "fresh"), (5, None, "a.py", "stale"), (6, long, "", "stale"), (7, long, "{key}", "stale")]
    df = spark.createDataFrame(rows, "i int, text string, file string, state string")
    key = hashlib.sha256(long.encode()).hexdigest()[:24]
    note = f"[Read content stale: %s was modified after this read — re-read the file for current content. Retrieve original: hash={key}]"
    got = {r["i"]: (r["text"], r["key"]) for r in rewritten(df, "text", "file", "state").collect()}
    assert got == {1: (note % "a.py", key), 2: (rows[1][1], None), 3: (long, None), 4: (long, None), 5: (None, None), 6: (note % "unknown", key), 7: (note % "{key}", key)}
    both = {r["i"]: r["text"] for r in rewritten(df, "text", "file", "state", superseded=True, frozen=df["i"] < 2).collect()}
    assert both[1] == long and both[3].startswith("[Read content superseded: unknown was re-read later")
