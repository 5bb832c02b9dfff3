from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import detect as D
from tessera.functions import text as T
from tessera.operators import evals as E
from tessera.operators import memory as M
from tessera.operators import metrics
from tessera.operators import retrieval as R
from tessera.sources import stores


def test_ledger_keeps_what_parses_within_retention(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text("\n".join([json.dumps({"ts": "2024-01-01T00:00:00Z", "before": 10, "after": 4, "saved": 6, "model": "m"}), json.dumps({"ts": "2020-01-01T00:00:00Z", "before": 1, "after": 1}), "not json"]))
    got = stores.read_ledger(spark, str(tmp_path), "2024-06-01").collect()
    assert [(r.before, r.after) for r in got] == [(10, 4)]
    stores.compact_ledger(spark, str(tmp_path), str(tmp_path / "out"), "2024-06-01")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_transcripts_name_their_session(spark, tmp_path):
    (tmp_path / "abc.jsonl").write_text(json.dumps({"type": "user", "timestamp": "2024-01-01T00:00:00Z", "message": {"role": "user", "content": "hi"}}) + "\n")
    r = stores.read_transcripts(spark, str(tmp_path)).first()
    assert (r.session_id, r.role, r.content) == ("abc", "user", "hi")


def test_blocks_of_text_and_lists(spark):
    df = spark.createDataFrame([(1, "plain"), (2, json.dumps([{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "Read"}]))], "k int, content string")
    got = {(r.k, r.type, r.text, r.name) for r in stores.message_blocks(df).collect()}
    assert got == {(1, "text", "plain", None), (2, "text", "a", None), (2, "tool_use", None, "Read")}


def test_perf_log_keeps_undated_lines(spark, tmp_path):
    (tmp_path / "p.log").write_text("2024-01-01 00:00:00 model=a before=10 after=5 ms=1.5\n2020-01-01 00:00:00 model=b before=1 after=1 ms=2\nno date model=c before=x after=1 ms=3\nnothing\n")
    got = {(r.model, r.before) for r in stores.scan_perf_log(spark, str(tmp_path), "2024-01-02 00:00:00").collect()}
    assert got == {("a", 10), ("c", None)}


def test_markdown_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("One", "first body"), ("Two", "second")], "title string, body string")
    stores.write_markdown(df, str(tmp_path / "m"))
    assert {(r.title, r.body) for r in stores.read_markdown(spark, str(tmp_path / "m")).collect()} == {("One", "first body"), ("Two", "second")}


def test_detector_chain(spark):
    rows = {'[{"a":1}]': "json_array", "[1]": "json_array", "diff --git a b\n+x": "diff", "<!doctype html><html><head></head>": "html", "a.py:1:x\nb.py:2:y": "search", "2024-01-01 ERROR x\nINFO y": "log", "a,b\n1,2\n3,4": "tabular", "def f():\n  pass\nclass A:\n  x\nimport y": "code", "hello": "text", "": "text"}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.k for r in df.select("t", D.content_type("t")["type"].alias("k")).collect()} == rows


def test_token_estimate(spark):
    df = spark.createDataFrame([("", 0), ("a", 1), ("x" * 400, 100), ("日本語", 2), ("see https://a.b/c?d&e", 5 + 5)], "t string, n long")
    assert all(r.n == r.got for r in df.select("n", T.tokens("t").alias("got")).collect())


def test_upsert_and_supersede(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in metrics.latest(log, "k", "at").collect()} == {("a", "y"), ("b", "z")}
    mem = spark.createDataFrame([("m1", "old", "2024-01-01")], "id string, content string, valid_from string").withColumn("valid_until", F.lit(None).cast("string"))
    new = M.supersede(mem, spark.createDataFrame([("m1", "m2", "2024-02-01", "new")], "old string, new string, at string, content string"), "id", "at")
    assert {(r.id, r.valid_until) for r in new.collect()} == {("m1", "2024-02-01"), ("m2", None)}


def test_paths_and_empty_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    assert {r.node: r.path for r in M.shortest_paths(e, 1, 5).collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 4]}
    assert M.hops(e.limit(0), spark.createDataFrame([(9,)], "n long"), "n", 2).collect() == [(9, 0)]


def test_history_of_long_chains(spark):
    n = 200
    links = [(k, k - 1 if k else None) for k in range(n)] + [(1000, None), (1002, 1001)]
    want = {(k, 0, k) for k in range(n)} | {(1000, 1000, 0), (1002, 1001, 1)}
    df = spark.createDataFrame(links, "k long, p long")
    assert set(map(tuple, M.history(df, "k", "p").collect())) == want
    assert M.history(df.limit(0), "k", "p").count() == 0
    with pytest.raises(ValueError):
        M.history(spark.createDataFrame([(1, 2), (2, 1)], "k long, p long"), "k", "p")


def test_nearest_in_blocks_of_queries(spark):
    vectors = [(k, [float(k * 7 % 11), float(k * 5 % 13), 1.0]) for k in range(40)]
    df = spark.createDataFrame(vectors, "k long, v array<double>")
    asked = df.where("k < 20").select(F.col("k").alias("q"), F.col("v").alias("w"))

    def cos(a, b):
        dot = lambda x, y: sum(i * j for i, j in zip(x, y, strict=True))
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    best = {(q, round(s, 9)) for q, v in vectors[:20] for s in sorted((cos(v, x) for _, x in vectors), reverse=True)[:4]}
    got = R.nearest(df, "k", "v", asked, "q", "w", 4, max_queries=6).collect()
    assert len(got) == 80 and {(r.q, round(r.score, 9)) for r in got} == best
    assert sorted(map(tuple, got)) == sorted(map(tuple, R.nearest(df, "k", "v", asked, "q", "w", 4).collect()))
    assert R.cache_hits(df, "k", "v", asked, "q", "w", 0.5).count() == 20


def test_rouge_and_bleu_score_whole_texts(spark, tmp_path):
    texts = [" ".join(f"w{(k * k + j) % 17}" for k in range(n)) for j, n in enumerate((0, 1, 5, 90, 700))] + [None, " \n "]
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))

    def rouge(x, y):
        p, q = x.split(), y.split()
        row = [0] * (len(q) + 1)
        for w in p:
            new = [0]
            for j, v in enumerate(q):
                new.append(row[j] + 1 if w == v else max(row[j + 1], new[-1]))
            row = new
        return 2 * row[-1] / (len(p) + len(q)) if row[-1] else 0.0

    cases = [(a or "", b or "") for a in texts for b in texts]
    df = spark.createDataFrame(cases, "a string, b string")
    assert all(round(r.got, 9) == round(rouge(r.a, r.b), 9) for r in df.select("a", "b", E.rouge_l("a", "b").alias("got")).collect())
    got = {r.doc_id: r.rouge for r in E.QUERIES["rouge_l"][0](spark, str(tmp_path)).collect()}
    assert got == {k: round(rouge(t or "", (t or "")[: len(t or "") // 2]), 6) for k, t in enumerate(texts)}
    long = {r.doc_id: r.bleu for r in E.QUERIES["bleu"][0](spark, str(tmp_path)).collect()}[4]
    n, m = len(texts[4].split()), len(texts[4][: len(texts[4]) // 2].split())
    assert math.exp(1 - n / m) * 0.98 < long <= math.exp(1 - n / m) * 1.000001


def test_error_categories(spark):
    rows = {"bash: foo: command not found": "command_not_found", "ENOENT: x": "file_not_found", "Traceback (most recent call last)": "runtime_error", "exit code 2": "exit_code", "fine": "unknown"}
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.k for r in df.select("t", D.error_category("t").alias("k")).collect()} == rows
