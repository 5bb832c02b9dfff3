"""Pairs of sets that are alike, counted in blocks inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Members of sets that are indexed at once, and pairs that are handed on at once.
BLOCK, HANDED = 4_000_000, 100_000


class Index:
    """Sets (number, members) by their members: which sets have each member, in order of numbers."""

    def __init__(self, table: pa.Table):
        numbers = table.column(0).to_numpy()
        counts, members = lists(table.column(1).combine_chunks())
        order = np.argsort(numbers)
        place = np.empty(len(order), "int64")
        place[order] = np.arange(len(order))
        self.numbers, self.sizes = numbers[order], counts[order]
        held = np.repeat(place, counts)
        by = np.lexsort((held, members))
        members, self.held = members[by], held[by]
        self.starts = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]])) if len(members) else np.zeros(0, "int64")
        self.members, self.ends = members[self.starts], np.append(self.starts[1:], len(members))

    def alike(self, number: int, members: np.ndarray, least: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places, likeness) of the sets that are as alike as `least`, by Jaccard; for one of the index's own only sets with smaller numbers."""
        at = np.searchsorted(self.members, members)
        at = np.minimum(at, len(self.members) - 1)
        at = at[self.members[at] == members]
        runs = [self.held[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]
        if own:
            before = np.searchsorted(self.numbers, number)
            runs = [r[: np.searchsorted(r, before)] for r in runs]
        if not runs:
            return np.zeros(0, "int64"), np.zeros(0)
        common = np.bincount(np.concatenate(runs), minlength=1)
        # what two sets share is at least that share of either of them
        found = np.flatnonzero(common >= max(1, np.ceil(least * len(members) - 1e-9)))
        common = common[found]
        likeness = common / (self.sizes[found] + len(members) - common)
        near = likeness >= least
        return found[near], likeness[near]


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, members) of arrays without nulls."""
    return np.diff(column.offsets.to_numpy()).astype("int64"), column.flatten().to_numpy()


def matcher(index: Index, least: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What gives (indexed set, set, likeness) of the pairs that are alike for sets (number, members, whether it is in the index too), each pair once."""

    def handed(pairs: list) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*pairs, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = [], 0
        for batch in batches:
            counts, members = lists(batch.column(1))
            ends = np.cumsum(counts)
            for number, own, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                found, likeness = index.alike(number, members[a:b], least, own)
                if len(found):
                    pairs.append((index.numbers[found], np.full(len(found), number), likeness))
                    n += len(found)
                if n >= HANDED:
                    yield handed(pairs)
                    pairs, n = [], 0
        if pairs:
            yield handed(pairs)

    return run
