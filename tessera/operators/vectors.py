"""The k items nearest to each of many queries, by matrix products inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of a block of scores, pairs that are scored exactly at once, vectors whose copies a task counts.
CELLS, PAIRS, SEEN = 4_000_000, 50_000, 200_000
#: Queries and items of a tile of products (1 MB), pairs found after which they are scored exactly.
TALL, WIDE, FOUND = 512, 512, 200_000
#: Squared norms outside of this range are scored exactly only.
PLAIN = 1e-140, 1e140


def unpacked(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, starts, values) of arrays of numbers; size 0 for one that is null or holds a null, which is like nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype("int64")
    flat = column.flatten()
    ends = np.cumsum(counts)
    sizes = counts.copy()
    if flat.null_count:
        sizes[np.searchsorted(ends, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")] = 0
    return sizes, ends - counts, pc.fill_null(flat.cast("float64"), 0.0).to_numpy(zero_copy_only=False)


def of_size(vectors: tuple[np.ndarray, np.ndarray, np.ndarray], d: int) -> np.ndarray:
    """A row for each vector: zeros for one that isn't of size d."""
    sizes, starts, values = vectors
    if (sizes == d).all() and len(values) == len(sizes) * d:
        return values.reshape(len(sizes), d)
    out, at = np.zeros((len(sizes), d)), np.flatnonzero(sizes == d)
    out[at] = values[starts[at][:, None] + np.arange(d)]
    return out


class Side:
    """Those of the vectors that are of size d: as they are, their squared norms summed up in order, unit vectors, and which are not plain."""

    def __init__(self, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], d: int):
        self.rows = rows = of_size(vectors, d)
        self.there = vectors[0] == d
        with np.errstate(all="ignore"):
            self.norms = np.concatenate([np.zeros(0), *(in_order(rows[i : i + PAIRS] ** 2) for i in range(0, len(rows), PAIRS))])
            self.plain = (self.norms >= PLAIN[0]) & (self.norms <= PLAIN[1])
            self.odd = np.flatnonzero(~self.plain & (rows != 0).any(axis=1))
            unit = rows / np.sqrt(np.where(self.plain, self.norms, 1.0))[:, None]
        unit[~self.plain] = 0
        self.unit = unit.astype("float32")


def in_order(products: np.ndarray) -> np.ndarray:
    """Sums of rows from left to right, as a loop over the numbers gives them."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, within [-1, 1]; 0 where a norm is 0 or sizes differ; infinite for not-a-number, so that it comes first."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for at in range(0, len(i), PAIRS):
            x, y = i[at : at + PAIRS], j[at : at + PAIRS]
            norm = np.sqrt(a.norms[x] * b.norms[y])
            got = np.clip(in_order(a.rows[x] * b.rows[y]) / norm, -1, 1)
            out[at : at + PAIRS] = np.where((norm == 0) | ~b.there[y], 0.0, np.where(np.isnan(got), np.inf, got))
    return out


class Best:
    """The k best (score, number) of each query so far: by falling score, then rising number."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.number = k, np.full((n, k), -np.inf), np.full((n, k), -1)

    def add(self, query: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        met = np.unique(query)
        held, place = np.nonzero(self.number[met] >= 0)
        q = np.concatenate([query, met[held]])
        s = np.concatenate([score, self.score[met[held], place]])
        n = np.concatenate([number, self.number[met[held], place]])
        order = np.lexsort((n, -s, q))
        q, s, n = q[order], s[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.number[q[keep], rank[keep]] = s[keep], n[keep]


def copies(seen: dict[bytes, list], keys: list, vectors: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Which of these items, in order of their keys, can be among the k first of their vector's copies that don't have one certain key.

    Copies score alike, so of 2 k copies, at most k of them with one key, k are left whichever key is left out.
    """
    sizes, starts, values = vectors
    keep = np.ones(len(keys), bool)
    for i, key in enumerate(keys):
        mark = blake2b(values[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=16).digest()
        n, last, run = seen.get(mark, (0, None, 0))
        run = run + 1 if n and key == last else 1
        if n >= 2 * k or run > k:
            keep[i] = False
        else:
            seen[mark] = (n + 1, key, run)
    if len(seen) > SEEN:
        seen.clear()
    return keep


def matcher(asked: tuple[pa.Array, tuple], k: int, least: float | None, other: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What gives the k nearest items of a task to each query: items come as (key, vector) in order of their keys."""
    names, vectors = asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict = {}
        if other:
            for i, key in enumerate(names.to_pylist()):
                own.setdefault(key, []).append(i)
        groups = []
        for d in np.unique(vectors[0]):
            at = np.flatnonzero(vectors[0] == d)
            groups.append((int(d), at, Side((vectors[0][at], vectors[1][at], vectors[2]), int(d))))
        place, best = np.zeros(len(names), "int64"), [Best(len(at), k) for _, at, _ in groups]
        for _, at, _ in groups:
            place[at] = np.arange(len(at))
        seen: dict[bytes, list] = {}
        kept, n = [], 0
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            items, keys = unpacked(batch.column(1)), batch.column(0)
            keep = np.flatnonzero(copies(seen, keys.to_pylist(), items, k))
            if not len(keep):
                continue
            items, keys = (items[0][keep], items[1][keep], items[2]), keys.take(pa.array(keep))
            pairs = [(q, i) for i, key in enumerate(keys.to_pylist()) for q in own.get(key, ())] if other else []
            pairs = np.array(pairs, "int64").reshape(-1, 2)
            for (d, at, asking), found in zip(groups, best, strict=True):
                mine = pairs[vectors[0][pairs[:, 0]] == d]
                meet(asking, Side(items, d), found, np.column_stack([place[mine[:, 0]], mine[:, 1]]), n, least)
            kept.append(keys)
            n += len(keep)
        if not kept:
            return
        all_keys = pa.chunked_array(kept).combine_chunks()
        for (_, at, _), found in zip(groups, best, strict=True):
            for begin in range(0, len(at), max(1, 65_536 // k)):
                q, p = np.nonzero(found.number[begin : begin + max(1, 65_536 // k)] >= 0)
                q += begin
                score = found.score[q, p]
                columns = [names.take(pa.array(at[q])), all_keys.take(pa.array(found.number[q, p])), pa.array(np.where(np.isinf(score), np.nan, score))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def meet(asking: Side, items: Side, best: Best, never: np.ndarray, first: int, least: float | None) -> None:
    """Adds the items, numbered from first, to the best of the queries, without the pairs in never.

    Products of unit vectors in single precision are within `off` of the cosine, so what may be among the k best is
    known from them, and only that is scored in double precision. Products are made in tiles that stay in a core's
    cache, and of a tile only the queries are looked at whose highest product reaches their bar.
    """
    m, d = items.rows.shape
    off = (d + 16) * 2.0**-24
    bar = bars(asking, items, best, never, least, off)
    low = below(bar)
    across = -(-m // WIDE)
    tile = never[:, 0] // TALL * across + never[:, 1] // WIDE
    never = never[np.argsort(tile, kind="stable")]
    edges = np.searchsorted(np.sort(tile), np.arange(-(-len(bar) // TALL) * across + 1))
    cache, found, n = np.empty(TALL * WIDE, "float32"), [], 0
    for t, begin in enumerate(range(0, len(bar), TALL)):
        unit = asking.unit[begin : begin + TALL].T
        mine, odd = low[begin : begin + TALL], within(asking.odd, begin, begin + TALL)
        for u, at in enumerate(range(0, m, WIDE)):
            some = items.unit[at : at + WIDE]
            score = np.matmul(some, unit, out=cache[: len(some) * len(mine)].reshape(len(some), len(mine)))
            strange = within(items.odd, at, at + WIDE)
            # not-a-number is above all, so an infinite bar is met by what isn't plain only
            if len(odd):
                score[:, odd] = np.inf
            if len(strange):
                score[strange] = np.inf
            out = never[edges[t * across + u] : edges[t * across + u + 1]]
            if len(out):
                score[out[:, 1] - at, out[:, 0] - begin] = -np.inf
            most = score.max(axis=0)
            hit = np.flatnonzero(most >= mine)
            if not len(hit):
                continue
            if 3 * len(hit) > len(mine):
                hit = np.arange(len(mine))
            seen = score if len(hit) == len(mine) else score.take(hit, axis=1)
            i, q = cells(seen >= mine[hit])
            found.append((hit[q] + begin, i + at, seen[i, q]))
            n += len(q)
            if best.k == 1 and not len(odd) and not len(strange):
                mine[hit] = np.maximum(mine[hit], below(most[hit].astype("float64") - 2 * off))
        if n and (n >= FOUND or begin + TALL >= len(bar)):
            q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
            if best.k > 1:
                keep = ahead(q, s, best.k, 2 * off)
                q, i = q[keep], i[keep]
            best.add(q, cosines(asking, q, items, i), i + first)
            found, n = [], 0


def bars(asking: Side, items: Side, best: Best, never: np.ndarray, least: float | None, off: float) -> np.ndarray:
    """What a product must reach at least; where a query has less than k items yet, by the first of these items."""
    bar = np.where(best.number[:, -1] >= 0, best.score[:, -1] - off, -2.0)
    new = np.flatnonzero(best.number[:, -1] < 0)
    first = items.unit[: max(WIDE, 256 * best.k)]
    if len(first) >= best.k:
        out, strange = never[never[:, 1] < len(first)], within(items.odd, 0, len(first))
        step = max(1, CELLS // len(first))
        for begin in range(0, len(new), step):
            some = new[begin : begin + step]
            score = asking.unit[some] @ first.T
            score[:, strange] = -np.inf
            no = out[np.isin(out[:, 0], some)]
            score[np.searchsorted(some, no[:, 0]), no[:, 1]] = -np.inf
            score[np.isin(some, asking.odd)] = -np.inf
            bar[some] = np.maximum(-2.0, (score.max(axis=1) if best.k == 1 else np.partition(score, -best.k, axis=1)[:, -best.k]).astype("float64") - 2 * off)
    return bar if least is None else np.maximum(bar, least - off)


def ahead(query: np.ndarray, score: np.ndarray, k: int, off: float) -> np.ndarray:
    """Which of these pairs aren't more than off below k others of their query; infinite scores are not known yet, so they stay and count for nothing."""
    keep = np.ones(len(query), bool)
    known = np.flatnonzero(np.isfinite(score))
    known = known[np.lexsort((-score[known], query[known]))]
    q, s = query[known], score[known].astype("float64")
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))[: len(q)]
    size = np.diff(np.append(first, len(q)))
    least = np.where(size >= k, s[np.minimum(first + k, len(s)) - 1], -np.inf) - off
    keep[known] = s >= np.repeat(least, size)
    return keep


def below(bar: np.ndarray) -> np.ndarray:
    """The bars in single precision, none rounded up."""
    return np.nextafter(bar.astype("float32"), np.float32(-4))


def within(places: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Those of the rising places that are from begin up to end, counted from begin."""
    return places[slice(*np.searchsorted(places, (begin, end)))] - begin


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are set; eight are looked at together, as few are."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:whole].view("uint64"))
    near = (eight[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])
    return at // mask.shape[1], at % mask.shape[1]
