"""Each operator on a small table of hard cases against a brute-force version."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import hosts, mixing, phrases, quality, repeats, sentence_pieces, simhash, token_counts, token_files, toxicity
from tessera.llm.graph import components
from tessera.llm.suffixes import common_prefixes, eights, found_in, padded, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
rng = np.random.default_rng(7)
VOCABULARY = ["".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
PASSAGE = " ".join(rng.choice(VOCABULARY, 90))


def prose(n: int, seed: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def texts() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empties, odd characters, a long text."""
    rows = [(i, prose(60 + i, i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(30 + i, rows[3][1], "en", "s0") for i in range(6)]  # copies
    rows += [(40 + i, rows[5][1] + f" tail{i}", "en", "s1") for i in range(6)]  # near copies
    rows += [(50 + i, f"{prose(20, 100 + i)}\n{PASSAGE}\n{prose(10, 200 + i)}", "fr", "s2") for i in range(5)]
    rows += [(60, None, None, None), (61, "", "en", None), (62, " \n\t ", None, "s1"), (63, "éàü 日本語 😀 ﬁ İ <|endoftext|> ▁x", "fr", "s1"), (64, "a" * 1500, "en", "s2"), (65, ("same line here\n" * 40), "en", "s0")]
    rows += [(66, prose(9000, 66), "en", "s0"), (None, prose(40, 67), "en", "s1"), (5, rows[5][1], "en", "s2"), (5, rows[5][1], "en", "s2"), (70, "#$% *&| " * 50, "en", "s0"), (71, "x  y\x0bz\x0cw", "en", "s0")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names clash with those that operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_key", F.lit(1)).withColumn("size", F.lit("x")).withColumn("kept", F.lit(0)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    marks = [(r[0], 0 if r[1] and ("#$%" in r[1] or "same line" in r[1]) else 1, int(bool(r[1]) and "tail" in r[1])) for r in rows]
    return spark.createDataFrame([*marks, (None, 0, 1), (999, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality_statistics_and_empty_tables(spark, docs, rows, labels):
    got = sorted(map(tuple, quality.quality_rules(docs, labels).select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)

    def brute(r):
        text = r[1] or ""
        words = WORD.findall(text)
        lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        inside = {i + k for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for k in range(5)}
        return r[0], len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(words) < 10 or 100 * len(inside) > 20 * len(words)

    assert got == sorted(map(brute, rows), key=str)
    assert quality.kept_documents(docs, labels).columns == docs.columns
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).where("kept <> (not base_failed)").count() == 0


def test_quality_learns_a_separable_rule(spark):
    good = [(i, prose(80, i)) for i in range(150)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(80, 5000 + i).split())) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 2], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.kept_documents(docs, labels).collect()}
    assert kept == {i for i, _ in good}


def test_hosts_split_rules_and_bounds(spark):
    urls = {0: "http://A.Example.org/es/x?y", 1: "https://b.com/fr/", 2: None, 3: "no scheme", 4: "ftp://x.com", 5: "http://example.org/en/12#z", 6: "s://u://v/w", 7: "http://bad.net/1", 8: "http://good.net/2"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    seen = spark.createDataFrame([("bad.net", 0)] * 40 + [("good.net", 1)] * 40 + [("z.org", None)], "host string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, seen).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[1] == ("b.com", "/fr/", "com/fr/", "allow")
    assert got[2][:3] == ("", "", None) and got[3][:3] == ("", "", None) and got[4][:3] == ("x.com", "", None)
    assert got[5] == ("example.org", "/en/12", "example.org/en/1", "block") and got[6][:2] == ("u:", "//v/w")
    assert got[7][3] == "block" and got[8][3] == "allow"
    # repeated rows, ties of rules' lengths and columns that clash
    clash = pages.unionAll(pages).withColumn("host", F.lit("h")).withColumn("rule", F.lit(1)).withColumn("_k", F.lit(2))
    twice = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in hosts.judge(clash, seen).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(twice) == 2 * len(urls) and {x[0]: tuple(x[1:]) for x in twice} == got
    assert hosts.judge(pages.limit(0), seen).count() == 0 and {r.verdict for r in hosts.judge(pages.where("page_id >= 7"), seen.limit(0)).collect()} == {"allow"}


def test_simhash_against_all_pairs(spark, docs, rows):
    def print_of(t):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [print_of(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            up[find(b)] = find(a)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    want = sorted(((r[0], prints[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r._fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    first = simhash.first_of_groups(docs)
    assert first.columns == docs.columns and first.count() == len(groups) and first.where("_key = 1 and size = 'x' and kept = 0").count() == len(groups)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_keeps_components_apart_that_share_an_id(spark):
    one, two, three, four = (prose(60, 900 + k) for k in range(4))
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (8, four)]
    kept = simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(None, one), (None, two), (7, three), (7, four)], key=str)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    base = int(rng.integers(0, 2**62))
    values = {base}
    for _ in range(400):
        x = base
        for b in rng.integers(0, 64, rng.integers(1, 9)):
            x ^= 1 << int(b)
        values.add(x)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "_fp long")
    root = lambda: sorted(map(tuple, components(simhash.links(df)).collect()))
    want = root()
    monkeypatch.setattr(simhash, "HOT", 10)
    assert root() == want


def test_components_of_chains_and_nothing(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_mix_meets_targets_and_caps(spark, docs, rows):
    got = mixing.mix(docs, block=16, shards=5).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id is not None) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in rows if r[0] is not None)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(t - target) <= 1 for (_, target), t in taken.items())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    aims, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            aims[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        free -= over
    aims |= share
    assert sorted(round(t, 6) for _, t in taken) == sorted(round(v, 6) for v in aims.values())
    assert sorted(map(tuple, mixing.mix(docs, block=16, shards=5).collect()), key=str) == sorted(map(tuple, got), key=str)
    whole = mixing.mixed_documents(docs, block=16, shards=5)
    assert whole.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in whole.collect()) == sum(r.taken for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_token_files_round_trip(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write(docs, path, str(tmp_path / "t"))
    got = [tuple(r) for r in token_files.read_back(spark, str(tmp_path / "t")).orderBy("start").collect()]
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert got == want
    token_files.write(docs.limit(0), path, str(tmp_path / "e"))
    assert token_files.read_back(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_round_trip(top):
    for n in (0, 1, 255, 256, 257, 3000):
        ids = np.where(rng.random(n) < 0.93, rng.integers(0, min(top, 1000), n), rng.integers(0, top, n)).astype(np.uint32)
        starts, data = token_files.encode_blocks(ids)
        assert (token_files.decode_blocks(np.frombuffer(data, np.uint8), starts, n) == ids).all()


def test_suffix_arrays_prefixes_and_search():
    for _ in range(40):
        n = int(rng.integers(1, 300))
        text = bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8))
        words = eights(padded(text))
        order, rank = suffix_array(words)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        got = common_prefixes(eights(padded(text), False), order, 24, lanes=3)
        for k in range(1, n):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert got[k] == min(24, next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))))
        some = order[rng.random(n) < 0.6]  # the least of the prefixes between two listed suffixes
        want = [min(got[rank[x] + 1 : rank[y] + 1]) for x, y in zip(some[:-1], some[1:], strict=True)]
        assert common_prefixes(eights(padded(text), False), some, 24, lanes=3)[1:].tolist() == want
        whole = order[order + 8 <= n]
        asked = np.arange(max(0, n - 7))
        hit = found_in(words, asked, words, whole, 8)
        assert all(text[whole[h] : whole[h] + 8] == text[q : q + 8] for q, h in zip(asked, hit, strict=True))


def cover_of(raw, length):
    """For each text, which bytes a string of `length` bytes covers that starts elsewhere too."""
    times = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone, until = bytearray(len(t)), 0
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                until = max(until, k)
                gone[until : k + length] = b"\x01" * (k + length - until)
                until = k + length
        out.append(gone)
    return out


def n_runs(gone):
    return sum(bool(x) and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone))


def removed_rows(rows, length, passage):
    raw = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, gone, near in zip(rows, raw, cover_of(raw, length), cover_of(raw, passage), strict=True):
        kept = hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()
        out.append((r[0], len(t), sum(gone), n_runs(gone), kept, sum(near), n_runs(near)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "passage", "most"), [(40, 36, 2048), (400, 250, 2048), (400, 250, 1), (60, 60, 1), (60, 40, 3)])
def test_repeats_against_every_window(docs, rows, monkeypatch, length, passage, most):
    monkeypatch.setattr(repeats, "SHARD_RUNS", most)  # 1: every run of an anchor of several lies in a shard of its own
    assert sorted(map(tuple, repeats.removed(docs, length, passage).collect()), key=str) == removed_rows(rows, length, passage)


def test_repeats_of_small_shards_and_pieces(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 3000)
    monkeypatch.setattr(repeats, "PIECE", 2000)
    assert sorted(map(tuple, repeats.removed(docs).collect()), key=str) == removed_rows(rows, 400, 250)
    left = repeats.deduplicated(docs)
    assert left.columns == docs.columns and left.where("_key = 1 and size = 'x' and kept = 0").count() == docs.count()
    assert all(len(r.text or "") == (r.n_chars or 0) for r in left.collect())
    assert repeats.removed(docs.limit(0)).count() == 0 and repeats.deduplicated(docs.limit(0)).count() == 0


def test_repeats_in_texts_over_a_megabyte(spark):
    once, part = prose(30_000, 1), prose(200, 2)
    assert len(part) > 1000
    rows = [(1, prose(150_000, 3) + " " + part + " " + once), (2, part + " end"), (3, "a" * 1_200_000), (4, once), (5, "b" * 399)]
    assert len(rows[0][1]) > 1_000_000
    got = {r.doc_id: r for r in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (len(part) + 1 + len(once), 1) and got[2].n_removed == len(part) + 1
    assert got[3].n_removed == 1_200_000 and got[3].n_spans == 1
    assert got[4].n_removed == len(once) and (got[5].n_removed, got[5].n_repeated, got[5].n_repeated_spans) == (0, 399, 1)


def test_an_anchor_with_ten_thousand_versions(spark):
    """A sentence that 10,000 texts share, each in words of its own; pairs of texts share 450 bytes around it."""
    middle = prose(25, 4)
    rows = []
    for i in range(10_000):
        before, after = prose(25, 20_000 + i), prose(25, 40_000 + i // 2)
        rows.append((i, f"{before} {middle} {after}" if i < 9_000 else f"{prose(45, 90_000 + i // 2)} {middle} {after}"))
    got = sorted(map(tuple, repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == removed_rows(rows, 400, 250)


def unigram(text):
    """The serialized model with its kind set to unigram, so that the library's lattice is the reference."""
    from sentencepiece import SentencePieceProcessor

    raw = open(PIECES, "rb").read()

    def fields(b):
        k = 0
        while k < len(b):
            a, tag, s = k, 0, 0
            while True:
                tag |= (b[k] & 127) << s
                s, k = s + 7, k + 1
                if b[k - 1] < 128:
                    break
            if tag & 7 == 5:
                yield tag >> 3, b[a : k + 4], None
                k += 4
                continue
            value, s = 0, 0
            while True:
                value |= (b[k] & 127) << s
                s, k = s + 7, k + 1
                if b[k - 1] < 128:
                    break
            end = k + value if tag & 7 == 2 else k
            yield tag >> 3, b[a:end], b[k:end]
            k = end

    out = b""
    for f, whole, body in fields(raw):
        if f == 2:
            body = b"".join(b"\x18\x01" if g == 3 else w for g, w, _ in fields(body))
            n, head = len(body), b"\x12"
            while n > 127:
                head, n = head + bytes([n & 127 | 128]), n >> 7
            whole = head + bytes([n]) + body
        out += whole
    return SentencePieceProcessor(model_proto=out)


def best_path(segment, score, unknown):
    """(score, pieces) of the best path over every cut of a segment; of equal paths, that with the longer last piece."""
    best = [(0.0, 0)]
    for end in range(1, len(segment) + 1):
        found = (-np.inf, 0)
        for start in range(end):
            if segment[start:end] in score and best[start][0] + score[segment[start:end]] > found[0]:
                found = best[start][0] + score[segment[start:end]], best[start][1] + 1
        c = segment[end - 1]
        if c not in score and best[end - 1][0] + unknown > found[0]:
            found = best[end - 1][0] + unknown, best[end - 1][1] + len(c.encode())
        best.append(found)
    return best[-1]


@pytest.mark.parametrize(("deep", "nodes"), [(200, 500_000), (3, 50)])
def test_token_counts_are_best_paths(spark, docs, rows, monkeypatch, deep, nodes):
    monkeypatch.setattr(token_counts, "DEEP", deep)
    monkeypatch.setattr(token_counts, "NODES", nodes)
    words = token_counts.vocabulary(PIECES)
    score = {p: float(words.score[i]) for p, i in words.pieces.items()}
    unknown, known = min(score.values()) - 10, {}

    def count(text):
        n = 0
        for part in re.findall(" *[^ \n\t]+|[\n\t]| +", " " + text.replace("▁", " ")) if text else []:
            if part not in known:
                known[part] = best_path(part, score, unknown)
            n += known[part][1]
        return n

    got = token_counts.token_counts(docs, PIECES)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(((r[0], count(r[1] or "")) for r in rows), key=str)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0
    # the library's lattice over the same pieces finds no better path
    library = unigram(None)
    for word in [*VOCABULARY[:80], "Hello", "日本語", "a-b_c", "12345", "é"]:
        ids = library.nbest_encode(word, nbest_size=2, out_type=int)[0]
        path = sum(score.get(library.id_to_piece(i).replace("▁", " "), unknown) for i in ids)
        assert best_path(" " + word, score, unknown)[0] >= path - 1e-6


def test_token_counts_of_a_five_megabyte_word(spark):
    trie = token_counts.Trie(token_counts.vocabulary(PIECES))
    word = "".join(VOCABULARY[k % 300] for k in range(20_000))
    assert trie.counts(pa.array([word, word[:50_000]]))[0].tolist()[0] > trie.counts(pa.array([word[:50_000]]))[0].tolist()[0] > 5000
    trie.counts(pa.array(["q" * 5_000_000]))
    assert len(trie.best) < 2 * token_counts.NODES


def test_sentence_pieces_are_the_librarys(spark, docs, rows, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r.doc_id, r.ids, r.round_trip) for r in sentence_pieces.encoded(docs, PIECES, "doc_id").collect()), key=str)
    assert got == sorted(((r[0], library.encode(r[1] or ""), True) for r in rows), key=str)
    assert sentence_pieces.encoded(docs.limit(0), PIECES, "doc_id").count() == 0
    encoder = sentence_pieces.Encoder(PIECES)
    odd = ["".join(rng.choice(list("aA eé日😀\n\t\r\x1f▁.,;{}()<"), rng.integers(0, 30))) for _ in range(400)] + [" " * k + "x" for k in range(40)]
    n, flat = encoder.encode(pa.array(odd))
    ends = np.cumsum(n)
    assert all(flat[b - k : b].tolist() == library.encode(t) for t, k, b in zip(odd, n.tolist(), ends.tolist(), strict=True))
    # a long word is relaxed by itself, a stretch after the other, with the same ids
    for word in ["".join(rng.choice(VOCABULARY, 900)), "ab" * 3000, "a" * 5001, "日😀x" * 900, "=" * 4500]:
        assert sentence_pieces.encode_long(encoder.by, " " + word).tolist() == library.encode(word)
    monkeypatch.setattr(sentence_pieces, "LONG", 5)
    monkeypatch.setattr(sentence_pieces, "INDEXED", 64)
    encoder.clear()
    n, flat = encoder.encode(pa.array(odd + VOCABULARY))
    ends = np.cumsum(n)
    assert all(flat[b - k : b].tolist() == library.encode(t) for t, k, b in zip(odd + VOCABULARY, n.tolist(), ends.tolist(), strict=True))
    monkeypatch.undo()
    back = sentence_pieces.decoded(sentence_pieces.encoded(docs, PIECES, "doc_id"), PIECES, "doc_id")
    assert sorted((r.text for r in back.collect())) == sorted((r[1] or "").replace("▁", " ") for r in rows)


def test_toxicity_gradient_and_noisy_or_by_finite_differences():
    """What pulls at a sentence is the slope of the likelihood of the document labels, here in plain numbers."""
    values, row, toxic = rng.normal(0, 1, 9), np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([1, 0, 1, 0])

    def likelihood(z):
        p = 1 / (1 + np.exp(-z))
        total = [1 - np.prod([1 - x for x, r in zip(p, row, strict=True) if r == d]) for d in range(4)]
        return sum(np.log(t if y else 1 - t) for t, y in zip(total, toxic, strict=True))

    p = toxicity._sigmoid(values)
    total = toxicity._noisy_or(p, row, 4)
    assert np.allclose(total, [1 - np.prod(1 - p[row == d]) for d in range(4)])
    pull = np.where(toxic[row] > 0, p * ((1 - total) / total)[row], -p)
    step = 1e-6 * np.eye(9)
    assert np.allclose(pull, [(likelihood(values + e) - likelihood(values - e)) / 2e-6 for e in step], atol=1e-5)


def test_toxicity_of_ties_and_repeated_rows(spark):
    model = toxicity.Model(*[np.array(x) for x in ([], [])], -1.0)
    model = toxicity.fit(pa.array(["fine day here. so it is."] * 40 + ["you vermin scum. bye now."] * 20), np.r_[np.zeros(40), np.ones(20)].astype(np.int64))
    rows = [(1, "x. vermin scum. vermin scum. y"), (1, "x. vermin scum. vermin scum. y"), (2, "..."), (3, "fine day")]
    got = sorted(map(tuple, toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).select("doc_id", "n_offending", "sentence", "predicted").collect()), key=str)
    assert got == [(1, 2, 1, 1), (1, 2, 1, 1), (2, 0, None, 0), (3, 0, 0, 0)]
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_toxic", F.lit(1)).withColumn("y", F.lit("z"))
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.learn(clash, labels, sample=1, sample_bytes=10).bias <= 0


def test_toxicity_learns_from_documents_and_finds_the_sentence(spark):
    words = ["vile", "nasty"]
    docs, marks = [], []
    for i in range(400):
        parts = [prose(12, 10_000 + 7 * i + k) for k in range(6)]
        toxic = i % 4 == 0
        if toxic:
            parts[i % 6] += " " + words[i % 2]
        docs.append((i, ". ".join(parts) + "."))
        marks.append((i, 1, int(toxic)))
    frame, labels = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, labels)
    got = {r.doc_id: r for r in toxicity.scored(frame, model).collect()}
    assert got[900].score == 0 and got[901].score == 0 and got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.95
    where = {r.doc_id: r.sentence for r in toxicity.offending(frame, model).collect()}
    assert all(got[i].sentence == where[i] for i in where if got[i].n_offending == 1)
    assert sum(where.get(i) == i % 6 for i in range(0, 400, 4)) > 90
    assert toxicity.scored(frame, toxicity.learn(frame, labels.limit(0))).where("score > 0").count() == 0
    assert toxicity.scored(frame.limit(0), model).count() == 0


@pytest.mark.parametrize("ranges", [1, 4, 50])
def test_fingerprints_of_neighbours(spark, docs, rows, ranges):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**9)), r[1] or ""))
    like = lambda a, b: float(np.mean([a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)]))
    none = phrases.fingerprint("")
    near = lambda a, b: float(a == b) if none in (a, b) else like(a, b)
    want = []
    for k, r in enumerate(order):
        t, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(phrases.fingerprint, (t, edited, after))
        want.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    assert sorted(map(tuple, phrases.neighbours(docs, ranges).collect()), key=str) == sorted(want, key=str)
    assert phrases.neighbours(docs.limit(0)).count() == 0


def test_phrases_signature_and_likeness_are_as_stated(rows):
    """The parse over tuples of words, minimum hashes in plain integers, and the text form, apart from the operator's code."""
    top = (1 << 64) - 1

    def phrases_of(text):
        known, now = set(), ()
        for word in (w[k : k + 8] for w in text.split() for k in range(0, len(w), 8)):
            now += (word,)
            if now not in known:
                known.add(now)
                now = ()
        return known

    def name_of(phrase):
        state = 0x9E3779B97F4A7C15
        for w in phrase:
            state = (state ^ xxhash.xxh3_64_intdigest(w.encode())) * 0xBF58476D1CE4E5B9 & top
        return state

    for text in [r[1] for r in rows if r[1]] + ["a b a b a b a b", "x" * 100]:
        names = [n ^ n >> 31 for n in map(name_of, phrases_of(text))]
        places = [min((n * int(a) + int(b) & top) for n in names) >> 40 & 0xFFFF if names else 0xFFFF for a, b in zip(phrases.TIMES, phrases.PLUS, strict=True)]
        assert phrases.fingerprint(text) == "".join(f"{p:04x}" for p in places)


def test_fingerprints_of_long_texts_and_words(spark, monkeypatch):
    long = prose(40_000, 5) + "\t" + "q" * 3001 + " " + prose(50, 6)
    want = phrases.fingerprint(long)
    monkeypatch.setattr(phrases, "CHUNK", 1024)
    assert phrases.fingerprint(long) == want and phrases.fingerprint("\u3000" + long) == want
    got = {r.doc_id: r for r in phrases.neighbours(spark.createDataFrame([(2, long), (1, long), (0, "z" * 5_000_000)], "doc_id long, text string")).collect()}
    assert got[2].fingerprint == got[1].fingerprint == want and got[2].near_next == 1 and got[0].n_chars == 5_000_000
    edited = long[: len(long) - len(long) // 2] + long[: len(long) // 2]
    assert got[2].edited_fingerprint == phrases.fingerprint(edited)
