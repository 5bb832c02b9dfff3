"""Token counts under a unigram model, by dynamic programming over a trie.

The model's pieces are weighed by their scores. Distinct pre-tokens (words with the spaces before them) are put into a
trie; at each new node the best score of its prefix is found from the nodes above it, once for all pre-tokens that
share the prefix, and a node where a pre-token ends keeps the count of pieces of its best path. A document's count
is the sum over its pre-tokens. Of paths of equal score, the one with the longer last piece wins. A character that no
piece is counts as one piece for each of its bytes, at 10 below the smallest score.

Defined results: a null or empty text has 0 tokens; repeated rows count alike; other columns are no input. The trie is
`DEEP` characters deep: what a longer pre-token has beyond is scored without nodes, in memory that doesn't grow with
it, by the same steps; a trie of `NODES` nodes is cleared before the next pre-token.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import read
from tessera.llm.pieces import Vocabulary, segments, vocabulary
from tessera.llm.words import parts

#: Nodes and pre-tokens that a task keeps.
NODES = 500_000
#: Characters of a pre-token that get nodes.
DEEP = 200
PENALTY = 10.0


class Trie:
    def __init__(self, words: Vocabulary):
        self.score = {p: float(words.score[i]) for p, i in words.pieces.items()}
        self.longest = words.longest
        self.unknown = min(self.score.values()) - PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = array("d", [0.0]), array("I", [0])
        self.ends: dict[str, int] = {}

    def add(self, token: str) -> int:
        """Puts a pre-token in; gives the count of its best path."""
        if len(self.best) > NODES:
            self.clear()
        child, node, longest = self.child, 0, self.longest
        # what is known of the last prefixes, of which no piece reaches further back
        best, count = [0.0] * (longest + 1), [0] * (longest + 1)
        for depth, c in enumerate(token, 1):
            at = depth % (longest + 1)
            if depth > DEEP:
                best[at], count[at] = self.forward(token, depth, best, count)
                continue
            key = node << 21 | ord(c)
            node = child.get(key)
            if node is None:
                node = child[key] = len(self.best)
                top, n = self.forward(token, depth, best, count)
                self.best.append(top)
                self.count.append(n)
            best[at], count[at] = self.best[node], self.count[node]
        n = count[len(token) % (longest + 1)]
        if len(self.ends) < NODES:
            self.ends[token] = n
        return n

    def forward(self, token: str, depth: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Best score and its pieces of token[:depth], from those of the shorter prefixes (by their length, modulo)."""
        get, round_ = self.score.get, self.longest + 1
        top, n = -np.inf, 0
        for start in range(max(0, depth - self.longest), depth):
            own = get(token[start:depth])
            if own is not None and (x := best[start % round_] + own) > top:
                top, n = x, count[start % round_] + 1
        if token[depth - 1] not in self.score and (x := best[(depth - 1) % round_] + self.unknown) > top:
            top, n = x, count[(depth - 1) % round_] + len(token[depth - 1].encode())
        return top, n

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, pre-tokens) of each text."""
        rows, tokens, which = segments(texts)
        get = self.ends.get
        each = np.array([n if (n := get(t)) is not None else self.add(t) for t in tokens.to_pylist()], np.int64)
        found = np.bincount(rows, each[which] if len(each) else None, len(texts)) if len(rows) else np.zeros(len(texts))
        return found.astype(np.int64), np.bincount(rows, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(vocabulary(model))
        for batch in batches:
            for part in parts(batch, 1):
                tokens, pre = trie.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(pre)], names=["doc_id", "n_tokens", "n_pretokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
