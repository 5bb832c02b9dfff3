from __future__ import annotations

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import detect as D
from tessera.functions import text as T
from tessera.operators import compressors as C


def test_log_keeps_errors_and_their_context():
    lines = [f"2024-01-01 INFO step {i}" for i in range(200)]
    lines[120] = "2024-01-01 ERROR broken pipe"
    out, how = C.compress_log("\n".join(lines))
    assert how.startswith("log:") and "ERROR broken pipe" in out and lines[117] in out and lines[123] in out
    assert len(out.split("\n")) < 20


def test_short_log_passes_through():
    assert C.compress_log("ERROR x") == ("ERROR x", "passthrough")


def test_search_keeps_first_and_last_match_of_a_file():
    out, _ = C.compress_search("\n".join(f"a.py:{i}:row {i}" for i in range(1, 40)))
    assert "a.py:1:row 1" in out and "a.py:39:row 39" in out and "more matches" in out


def test_diff_keeps_changes_and_trims_context():
    body = [f" line {i}" for i in range(60)]
    body[30] = "-old"
    text = "\n".join(["diff --git a/x b/x", "--- a/x", "+++ b/x", "@@ -1,60 +1,60 @@", *body])
    out, _ = C.compress_diff(text)
    assert "-old" in out and " line 29" in out and " line 10" not in out


def test_prose_keeps_half_and_drops_near_copies():
    text = " ".join(f"Sentence number {i} tells about topic {i % 5} of the story." for i in range(40))
    out, how = C.compress_prose(text, "topic 3")
    assert how == "prose" and 0.3 * len(text) < len(out) < 0.7 * len(text)


def test_table_reader_reads_three_kinds():
    assert C.records(*C.parse_table("| a | b |\n| --- | --- |\n| 1 | 2 |")) == [{"a": "1", "b": "2"}]
    assert C.records(*C.parse_table("a,b\n1,2\n3")) == [{"a": "1", "b": "2"}, {"a": "3", "b": ""}]
    assert C.records(*C.parse_table("name   size\nx y    3")) == [{"name": "x y", "size": "3"}]


def test_code_keeps_signatures():
    text = "def f(a):\n" + "\n".join(f"    x{i} = {i}" for i in range(30)) + "\n    return a\n\ndef g():\n    return 1\n"
    out, how = C.compress_code(text)
    assert how == "code:python" and "def f(a):" in out and "def g():" in out and "lines omitted" in out and "x29" not in out


def test_html_drops_scripts_and_navigation():
    out, _ = C.compress_html("<html><head><title>T</title><script>bad()</script></head><body><nav>menu</nav><p>Hello <b>there</b></p></body></html>")
    assert out == "Hello there"


def test_templates_hold_every_word():
    text = "\n".join(f"user {i} logged in from host {i * 7}" for i in range(30))
    out, how = C.mine_templates(text)
    assert how == "templates" and all(str(i * 7) in out for i in range(30))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.one_of(st.integers(-5, 5), st.text(max_size=5), st.booleans(), st.none()), max_size=3), max_size=60))
def test_kept_items_are_originals_in_order_and_errors_stay(items):
    items = [*items, {"a": "fatal error"}]
    keep = C.kept_items(items)
    assert keep == sorted(set(keep)) and keep[-1] == len(items) - 1


def test_estimate_is_that_of_columns(spark):
    rows = ["", "a", "[1, 2]", "{bad", "def f():\n  return 1;\n" * 9, "日本語テキスト", "https://a.b/c?d&e=1 550e8400-e29b-41d4-a716-446655440000", "x" * 401]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.tokens("t").alias("n")).collect()
    assert all(C.estimate(r.t) == r.n for r in got)


def test_payload_never_grows_and_comes_back(spark):
    rows = [("log", "\n".join(f"2024-01-01 INFO step {i}" for i in range(300)) + "\nERROR end"), ("none", None), ("empty", ""), ("short", "hello"), ("json", json.dumps([{"id": i, "v": i % 3} for i in range(100)]))]
    done = C.compressed(spark.createDataFrame(rows, "k string, text string"))
    got = {r.k: r for r in done.collect()}
    assert all(r.tokens_after <= r.tokens_before for r in got.values())
    assert got["short"].compressed == "hello" and got["short"].key is None and got["none"].compressed is None
    back = C.retrieved(done.where(F.col("key").isNotNull()), C.store_of(done)).collect()
    assert back and all(r.text == r.payload for r in back)


def test_tables_of_nested_items_and_of_several_kinds():
    nested = [{"id": i, "at": {"x": i, "y": 2 * i}, "odd": {"k": i} if i % 2 else 3} for i in range(6)]
    assert C.flattened(nested)[1] == {"id": 1, "at.x": 1, "at.y": 2, "odd": {"k": 1}}
    assert C.table_of(nested[:2]).split("\n")[0] == "[2]{at.x:int,at.y:int,id:int,odd:json}"
    kinds = [{"kind": "file", "path": f"p{i}", "size": i} if i % 2 else {"kind": "call", "tool": "t", "ms": i, "ok": True} for i in range(8)]
    assert C.discriminator(kinds) == "kind"
    assert C.table_of(kinds) == 'kind="call":\n[4]{ms:int,ok:bool,tool:string}\n0,true,t\n2,true,t\n4,true,t\n6,true,t\nkind="file":\n[4]{path:string,size:int}\np1,1\np3,3\np5,5\np7,7'
    assert C.discriminator([{"kind": str(i)} for i in range(5)]) is None and C.flattened([]) == []


def test_tables_lose_nothing_at_any_size():
    items = [{"name": f"n{i}", "value": i, "flag": i % 3 == 0} for i in range(500)]
    out, how = C.compress_json(json.dumps(items))
    header, *rows = out.split("\n")
    assert how == "crush" and header == "[500]{flag:bool,name:string,value:int}"
    assert [dict(name=n, value=int(v), flag=f == "true") for f, n, v in (r.split(",") for r in rows)] == items


def test_mixed_arrays_keep_small_groups_and_name_what_they_omit():
    items = [*range(40), 9999, "error: disk", *["same"] * 20, None, True, [1], {"a": 1}]
    keep = C.mixed_items(items)
    kept = [items[i] for i in keep]
    assert 9999 in kept and "error: disk" in kept and kept[-4:] == [None, True, [1], {"a": 1}] and len(kept) < 40
    assert C.mixed_items(list(range(4)) + ["x"]) == [0, 1, 2, 3, 4]
    side = {}
    out = C.crush_value({"rows": items}, side=side)
    key = out["rows"][-1].split("<<ccr:")[1].split(">>")[0]
    assert json.loads(side[key]) == items


def test_minified_json_keeps_its_tokens():
    text = '{ "a b" : [1.50, "x \\" { y" ,\n null ] }'
    assert C.minified(text) == '{"a b":[1.50,"x \\" { y",null]}' and C.minified("[1]") == "[1]"


def test_arrays_inside_payloads_are_in_the_store(spark):
    rows = [json.dumps([{"log": [f"line {i} {j} " + "x" * j for j in range(60)], "id": i} for i in range(3)])]
    done = C.compressed(spark.createDataFrame([(r,) for r in rows], "text string")).cache()
    store = {r.key: r.payload for r in C.store_of(done).collect()}
    markers = re.findall(r"<<ccr:([0-9a-f]+)>>", done.first().compressed)
    assert len(markers) == 3 and all(json.loads(store[m])[0].startswith("line") for m in markers)


def test_contents_of_every_kind_are_told_apart(spark):
    kinds = {
        "json_array": '[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]',
        "diff": "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n-old\n+new\n",
        "html": "<!DOCTYPE html><html><head><title>t</title></head><body><div>x</div><div>y</div></body></html>",
        "search": "\n".join(f"src/a{i}.py:{i + 1}:def f{i}():" for i in range(6)),
        "log": "\n".join(f"2024-01-0{i + 1} 10:00:00 ERROR something failed {i}" for i in range(6)),
        "tabular": "a,b,c\n" + "\n".join(f"{i},{i + 1},{i + 2}" for i in range(8)),
        "code": "import os\nfrom sys import path\n\n\nclass A:\n    def f(self):\n        return os.name\n\n\ndef g(x):\n    return x\n",
        "text": "A plain sentence about nothing much. Another one follows it.",
    }
    frame = spark.createDataFrame(list(kinds.items()), "kind string, text string")
    got = {r.kind: r.type for r in frame.select("kind", D.content_type("text")["type"].alias("type")).collect()}
    assert got == {k: k for k in kinds}
