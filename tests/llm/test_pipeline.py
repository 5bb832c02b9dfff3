"""The corpus pipeline on small tables, stage by stage, against brute-force versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tessera.llm import mixing, simhash
from tessera.llm.common import read
from tests.llm.test_operators import WORD, cover_of

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_against_brute_force_and_run_agrees(spark):
    from sentencepiece import SentencePieceProcessor

    given = read(spark, DATA, "documents").withColumn("_key", F.lit("k"))
    columns, stages = given.columns, [f for _, f in corpus_pipeline.STAGES]
    ruled = stages[0](spark, given, DATA).cache()
    assert ruled.columns == columns and not set(rows_of(ruled)) - set(rows_of(given)) and ruled.count() < given.count()

    # near copies: distances of all pairs of fingerprints, the least id of each component stays
    prints = [(r.doc_id, r._fp & (1 << 64) - 1) for r in simhash.fingerprints(ruled, "doc_id").collect()]
    up = {i: i for i, _ in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    single = stages[1](spark, ruled, DATA).cache()
    assert rows_of(single) == rows_of(ruled.where(F.col("doc_id").isin([i for i in up if find(i) == i])))

    # passages: every window of 250 bytes
    before = sorted(single.collect(), key=lambda r: r.doc_id)
    raw = [(r.text or "").encode() for r in before]
    left = [bytes(b for b, x in zip(t, gone, strict=True) if not x).decode(errors="ignore") for t, gone in zip(raw, cover_of(raw, 250), strict=True)]
    cut = stages[2](spark, single, DATA).cache()
    after = sorted(cut.collect(), key=lambda r: r.doc_id)
    assert cut.columns == columns and [r.text for r in after] == left and all(r.n_chars == len(r.text) for r in after)

    # the mix: each source's words come near its target, documents' words are their own, none more than twice
    mixed = stages[3](spark, cut, DATA).cache()
    sizes = {r.doc_id: Counter(WORD.findall(r.text)) for r in after}
    taken = Counter()
    for r in mixed.collect():
        words = Counter(WORD.findall(r.text))
        taken[r.doc_id] += words.total()
        assert not words - sizes[r.doc_id]
    assert mixed.columns == columns and all(n <= 2 * sizes[i].total() for i, n in taken.items())
    aims = {r.source: r.target for r in mixing.targets(cut.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))).collect()}
    by_source = Counter()
    for r in after:
        by_source[r.source] += taken[r.doc_id]
    assert all(abs(by_source[x] - t) <= 1 for x, t in aims.items())

    # ids: the library's
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = stages[4](spark, mixed, DATA)
    assert rows_of(coded.select("doc_id", "ids", "round_trip")) == sorted(((r.doc_id, library.encode(r.text), True) for r in mixed.collect()), key=str)

    out = corpus_pipeline.run(spark, DATA)
    assert out.count() == coded.count() and out.where("not round_trip").count() == 0
    crcs = lambda df: rows_of(df.select("doc_id", "ids_crc32"))
    assert crcs(out) == crcs(coded)


def test_stages_of_an_empty_table_and_nulls(spark):
    given = read(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, given.limit(0), DATA).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], given.schema)
    kept = [stage(spark, nulls, DATA).count() for _, stage in corpus_pipeline.STAGES]
    assert kept == [0, 1, 3, 0, 3]
