"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's score is a logistic function of the weights of its distinct words; a document's is the noisy-or of its
sentences', 1 - product of (1 - score). Only documents are labelled; the noisy-or carries their labels' gradient to the
sentences that explain them, so the same model then says which sentences offend. A word's weight is the sum of its
byte grams', hashed to 2**BITS places, so words not seen before share what is known of their parts; weights are not
negative and sparse. The model is fitted on the driver on a sample of labelled documents of stated size.

Words are runs of letters and digits, lower-cased; sentences end at . ! ? or a line feed.

Defined results: a null or empty text, or one without words, has no sentences and scores 0; labels that are null or
without a document teach nothing, and a document labelled more than once counts once, toxic if any label says so; with
no labels of both kinds, every score is 0; repeated rows score alike; other columns are no input. A null doc_id is not
held out, and has no label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.suffixes import eights, padded
from tessera.llm.words import parts, ragged, split

#: About so many labelled documents at most are fitted on, chosen by a hash of their id.
SAMPLE = 6000
#: Bytes of theirs at most, and of one of them.
SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20
#: A gram needs to be in so many toxic ones to have a weight.
LEAST = 3
FOLDS = 5
STEPS = 120
RATE = 0.15
#: What a weight of 1 costs, in likelihood of all documents.
SPARSE = 0.4
GRAMS = (4, 5, 6, 7, 8)
BITS = 20
END = "\x01"


@dataclass
class Model:
    grams: np.ndarray  # hashed places with a weight
    weights: np.ndarray
    bias: float


@dataclass
class Sentences:
    row: np.ndarray  # of each sentence
    of_word: np.ndarray  # sentence of each word
    words: pa.Array  # distinct
    which: np.ndarray  # number of each word among them


def sentences(texts: pa.Array) -> Sentences:
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[.!?\n]+", f" {END} ")
    rows, words, which = split(pc.replace_substring_regex(clean, rf"[^\p{{L}}\p{{N}}\s{END}]+", " "))
    end = pc.index(words, END).as_py()
    is_end = which == end
    new = np.r_[True, (rows[1:] != rows[:-1]) | is_end[:-1]] if len(rows) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    rows, number, which = rows[~is_end], number[~is_end], which[~is_end]
    # sentences without a word are none
    if len(number):
        first = np.r_[True, number[1:] != number[:-1]]
        return Sentences(rows[first], np.cumsum(first) - 1, words, which)
    return Sentences(rows, number, words, which)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.where(z == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _noisy_or(p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed place) of every gram of a few bytes in distinct words, each word between marks."""
    sizes = np.asarray(pc.binary_length(words)).astype(np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = padded(b"\x02" + b"\x02".join(words.cast(pa.binary()).to_pylist()) + b"\x02")
    eight = eights(text, False)
    ends = np.cumsum(sizes + 1)  # place of the mark behind each word
    starts = ends - sizes - 1
    word, place = [], []
    for n in GRAMS:
        many = np.maximum(sizes + 3 - n, 0)
        at = ragged(starts, many)
        x = (eight[at] & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        word.append(np.repeat(np.arange(len(sizes)), many))
        place.append((x >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(word), np.concatenate(place)


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """Steps of Adam on the likelihood of document labels, each followed by a shrink of the weights towards zero.

    Only grams that are more often in toxic documents than their share are given weights.
    """
    n = len(texts)
    if not (0 < toxic.sum() < n):
        return Model(np.empty(0, np.int64), np.empty(0), -np.inf)
    s = sentences(texts)
    doc_word = np.unique(np.stack([s.row[s.of_word], s.which]), axis=1)
    held = np.bincount(doc_word[1], minlength=len(s.words))
    bad = np.bincount(doc_word[1], toxic[doc_word[0]], len(s.words))
    word, place = grams(s.words)
    of_all, of_bad = (np.bincount(place, x[word], 1 << BITS) for x in (held, bad))
    keep = np.flatnonzero((of_bad >= LEAST) & (of_bad > 2 * toxic.mean() * of_all))
    new = np.full(1 << BITS, -1)
    new[keep] = np.arange(len(keep))
    known = new[place] >= 0
    word, gram = word[known], new[place[known]]
    has = np.zeros(len(s.words), bool)
    has[word] = True
    some = has[s.which]
    of, which = np.unique(np.stack([s.of_word[some], s.which[some]]), axis=1)
    x = np.r_[np.full(len(keep), 0.05), -4.0]
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        value = np.bincount(word, x[gram], len(s.words))
        p = _sigmoid(np.bincount(of, value[which], len(s.row)) + x[-1])
        total = np.clip(_noisy_or(p, s.row, n), 1e-9, 1 - 1e-9)
        pull = np.where(toxic[s.row] > 0, p * ((1 - total) / total)[s.row], -p)
        by_word = np.bincount(which, pull[of], len(s.words))
        g = np.r_[np.bincount(gram, by_word[word], len(keep)) - SPARSE, pull.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 if step < STEPS // 2 else 0.3)
        x[:-1] = np.maximum(x[:-1], 0)
    full = np.flatnonzero(x[:-1] > 1e-3)
    return Model(keep[full], x[full], float(x[-1]))


def _sentence_scores(model: Model, s: Sentences) -> np.ndarray:
    weights = np.zeros(1 << BITS)
    weights[model.grams] = model.weights
    word, place = grams(s.words)
    value = np.bincount(word, weights[place], len(s.words)) if len(word) else np.zeros(len(s.words))
    some = value[s.which] > 0
    of, which = np.unique(np.stack([s.of_word[some], s.which[some]]), axis=1)
    return _sigmoid(np.bincount(of, value[which], len(s.row)) + model.bias)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    s = sentences(texts)
    return _noisy_or(_sentence_scores(model, s), s.row, len(texts))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of labelled rows that are not held out.

    About `sample` texts of `sample_bytes` bytes in all reach the driver at most, chosen by a hash of doc_id and text;
    a text over LONGEST bytes is not learned from. Rows that repeat as a whole count once.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    million, known = 1_000_000, marked.count()
    if known > sample:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < int(million * sample / known))
    text = F.col("text").cast("string")
    met = docs.select("doc_id", text.alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    met = met.join(F.broadcast(marked), "doc_id").select("doc_id", "text", F.col("_toxic").cast("int").alias("y"))
    rows, size = met.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rate = min(1.0, sample / max(rows, 1), sample_bytes / max(size or 0, 1))
    if rate < 1:
        met = met.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(million)) < int(million * rate))
    table = met.distinct().toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(table.column("text").combine_chunks() if len(table) else pa.array([], pa.string()), np.asarray(table.column("y")).astype(np.int64))


def scored(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, sentence, sentence_score for every row of docs.

    n_offending: sentences that score `least` or more; sentence: the worst one's number among the text's sentences with
    words, from 0 (the first, of ties; null if the text has none), with its score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                s = sentences(part.column(2))
                each, n = _sentence_scores(model, s), len(part)
                p = _noisy_or(each, s.row, n)
                worst = np.lexsort((np.arange(len(each)), -each, s.row))
                first = worst[np.flatnonzero(np.r_[True, s.row[1:] != s.row[:-1]])] if len(each) else worst
                which, top, none = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
                row = s.row[first]
                which[row], top[row], none[row] = first - np.searchsorted(s.row, row), each[first], False
                many = np.bincount(s.row, each >= least, n).astype(np.int64)
                columns = [part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(many), pa.array(which, mask=none), pa.array(top, mask=none)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "n_offending", "sentence", "sentence_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_offending long, sentence long, sentence_score double")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (number among the text's sentences with words, from 0), score: the sentences that offend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                s = sentences(part.column(1))
                p = _sentence_scores(model, s)
                first = np.searchsorted(s.row, s.row)
                hit = np.flatnonzero(p >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(s.row[hit])), pa.array((hit - first[hit]).astype(np.int64)), pa.array(p[hit])], names=["doc_id", "sentence", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence long, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learn(docs, read(spark, sf_dir, "labels")))
