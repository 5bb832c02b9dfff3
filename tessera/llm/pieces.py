"""SentencePiece vocabularies, and texts cut into the stretches that their pieces can't cross."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The library's mark for a space. Here a space stands for it, in texts and pieces alike.
MARK = "▁"
CUT = " *[^ \\n\\t]+|[\\n\\t]| +"
BETWEEN = "\x1f"


class Vocabulary:
    """Pieces, scores and ids of a model file with byte fallback and no normalization but the leading space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.byte = {}
        self.pieces: dict[str, int] = {}
        for i in every:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece.replace(MARK, " ")] = i
        self.score = np.array([model.get_score(i) for i in every])
        if len(self.byte) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(len(p) > 1 and re.search("[^ ] |[\n\t]", p) for p in self.pieces):
            raise ValueError("pieces cross the cuts")
        self.longest = max(map(len, self.pieces))
        self.text = {i: p.encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte.items()}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def segments(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row of each segment, distinct segments, each one's number among them).

    A segment is a word with the spaces before it, or one of the line feeds and tabs, which no longer piece holds. A text has a space before it; an empty one has no segment.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    full = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    if pc.any(pc.match_substring(texts, BETWEEN)).as_py():
        lists = pa.array([re.findall(CUT, t) for t in full.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(pc.replace_substring_regex(full, CUT, f"\\0{BETWEEN}"), BETWEEN)
    rows = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    flat = lists.flatten()
    some = np.asarray(pc.binary_length(flat)) > 0
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return rows[some], coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
