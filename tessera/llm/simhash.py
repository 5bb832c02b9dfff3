"""SimHash near-duplicates, found by bit-sliced comparison.

A fingerprint has a bit set where over half the hashes of a text's word shingles have it. Distinct fingerprints meet in
ten tables: of five blocks of bits, two within radius 3 agree on two at least, so every linked pair shares a bucket. A
bucket of more than `HOT` fingerprints is dealt anew by one of four parts of its other bits, of which such a pair
again agrees on one at least. Inside a task the fingerprints lie sorted by bucket as 64 bit planes; all distances at a
given offset are counted at once, 64 to a machine word, by carry-save counters over planes xor shifted planes, and
words whose lanes have all passed the radius are abandoned. Lanes already known to be connected are masked, so a group
of near copies costs few comparisons and gives one link for each member. Components are then found over all links.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links like any other; rows
that repeat share a component; a component none of whose rows has a doc_id has a null id; other columns are ignored by
`fingerprints` and kept by `first_of_groups`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import plain_names, read, written
from tessera.llm.graph import components
from tessera.llm.words import lean

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HOT = 4096
#: Rows that a linking task holds at once, but for a bucket that has more.
HELD = 100_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        pieces = zip((ends - size)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pieces]
    n, ones = len(hashes), np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64).view(np.uint8).reshape(n, 8)
    for k in range(0, n, 1 << 14):
        ones += np.unpackbits(packed[k : k + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """(keep..., _fp): the fingerprint of every row's text as a signed long."""
    schema = docs.select(*keep).schema.add("_fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found)], names=[*keep, "_fp"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(lean(run), schema)


class Planes:
    """Fingerprints as 64 bit planes, word by word."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        words = n // 64 + 1
        bits = np.zeros((words * 64, 64), np.uint8)
        bits[:n] = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        self.planes = np.zeros((64, 2 * words + 2), np.uint64)
        self.planes[:, :words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)

    def within(self, lanes: np.ndarray, offset: int, radius: int) -> np.ndarray:
        """Those of lanes (ascending) whose value differs from the one at lane + offset in at most radius bits."""
        at = lanes >> 6
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        word, live = at[first], np.bitwise_or.reduceat(np.uint64(1) << (lanes & 63).astype(np.uint64), first)
        width = radius.bit_length()
        count, over = np.zeros((width, len(word)), np.uint64), np.zeros(len(word), np.uint64)
        far, low = offset >> 6, np.uint64(offset & 63)
        for k, plane in enumerate(self.planes):
            other = plane[word + far]
            if low:
                other = (other >> low) | (plane[word + far + 1] << (np.uint64(64) - low))
            carry = plane[word] ^ other
            for c in count:
                c_and = c & carry
                c ^= carry
                carry = c_and
            over |= carry
            if k % 8 == 7:
                stay = (live & ~over) != 0
                if not stay.all():
                    word, live, over, count = word[stay], live[stay], over[stay], count[:, stay]
                    if not len(word):
                        return np.empty(0, np.int64)
        more, same = np.zeros_like(over), ~np.zeros_like(over)  # count > radius, from the top bit down
        for b in reversed(range(width)):
            if radius >> b & 1:
                same &= count[b]
            else:
                more |= same & count[b]
                same &= ~count[b]
        live &= ~(over | more)
        hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        row, bit = np.nonzero(hit)
        return word[row] * 64 + bit


def local_links(bucket_ends: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted by bucket; bucket_ends[i] is where i's bucket ends. (member, root) positions of those linked in their bucket."""
    n = len(values)
    label, lanes = np.arange(n), np.arange(n)
    planes, offset = None, 0
    while True:
        offset += 1
        lanes = lanes[lanes + offset < bucket_ends[lanes]]
        if not len(lanes):
            break
        apart = lanes[label[lanes] != label[lanes + offset]]
        if not len(apart):
            # a group of near copies is soon connected as a whole: then nothing is left to compare
            if offset % 16 == 1 and (label == label[bucket_ends - 1])[np.isin(bucket_ends, bucket_ends[lanes])].all():
                break
            continue
        planes = planes or Planes(values)
        met = planes.within(apart, offset, radius)
        if len(met):
            pairs = np.unique(np.stack([label[met], label[met + offset]]), axis=1)
            root: dict[int, int] = {}

            def find(x: int, root=root) -> int:
                while (up := root.get(x, x)) != x:
                    x = up
                return x

            for a, b in pairs.T.tolist():
                a, b = sorted((find(a), find(b)))
                root[b] = a
            old = np.array(list(root), np.int64)
            if len(old):
                to = np.arange(n)
                to[old] = [find(x) for x in old.tolist()]
                label = to[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, at).bitwiseAND((1 << size) - 1) for at, size in BLOCKS]


def _joined(parts: list[Column]) -> Column:
    out = parts[0]
    for k, p in enumerate(parts[1:], 1):
        out = out.bitwiseOR(F.shiftleft(p, 13 * k))
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (_fp) -> (a, b): pairs within radius (3 at most) that connect all that are linked."""
    if radius > 3:
        raise ValueError("the tables find pairs within 3 bits")
    part = _blocks(F.col("_fp"))
    tables = []
    for t, pair in enumerate(combinations(range(5), 2)):
        rest = _joined([part[k] for k in range(5) if k not in pair])
        tables.append(F.struct(F.lit(t).cast("long").bitwiseOR(F.shiftleft(_joined([part[k] for k in pair]), 4)).alias("k"), rest.alias("rest")))
    keyed = prints.select("_fp", F.explode(F.array(*tables)).alias("_t")).select("_fp", "_t.k", "_t.rest")
    hot = keyed.groupBy("k").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(F.col("k").alias("_k"))
    fine = F.array(*[F.shiftrightunsigned("rest", 10 * q).bitwiseAND(1023).bitwiseOR(q << 10).cast("int") for q in range(4)])
    dealt = keyed.join(hot, F.col("k") == F.col("_k"), "left").select("_fp", "k", F.explode(F.when(F.col("_k").isNull(), F.array(F.lit(-1))).otherwise(fine)).alias("sub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            k, s, v = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])])
            held.clear()
            end = len(k)
            if not final:  # the last bucket may go on
                end = int(starts[-1])
                held.append((k[end:], s[end:], v[end:]))
            starts = starts[starts < end]
            if end:
                sizes = np.diff(np.r_[starts, end])
                several = np.repeat(sizes > 1, sizes)
                values, ends = v[:end][several], np.cumsum(sizes[sizes > 1])
                member, root = local_links(np.repeat(ends, sizes[sizes > 1]), values.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(values[member]), pa.array(values[root])], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "sub", "_fp")))
            if sum(len(x[0]) for x in held) > HELD:
                yield from flush(False)
        if held:
            yield from flush(True)

    return dealt.repartition("k", "sub").sortWithinPartitions("k", "sub", "_fp").select("k", "sub", "_fp").mapInArrow(run, "a long, b long").distinct()


def _grouped(docs: DataFrame, *keep: str, radius: int = RADIUS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of every row (doc_id, keep..., _fp), and (node, root): the smallest fingerprint that links reach, the component itself."""
    prints = written(fingerprints(docs, "doc_id", *keep, shingle=shingle), "simhash")
    return prints, written(components(links(prints.select("_fp").distinct(), radius)), "simhash-roots")


def _firsts(prints: DataFrame, roots: DataFrame, first: Column) -> DataFrame:
    """(_fp, root, f) of distinct fingerprints: f is the least `first` of all rows of the component.

    Rows are counted down to fingerprints, and fingerprints to components, by aggregates that combine before they
    shuffle. Both sides of the joins are tables, so that adaptive execution can split a component with a third of all.
    """
    own = prints.groupBy("_fp").agg(F.min(first).alias("f"))
    own = written(own.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", F.coalesce("root", "_fp").alias("root"), "f"), "simhash-own")
    least = written(own.groupBy("root").agg(F.min("f").alias("f")), "simhash-least")
    return own.drop("f").join(least, "root")


def near_duplicates(docs: DataFrame, *keep: str, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, keep..., _fp, component_id for every row: the smallest doc_id of all rows that links reach."""
    prints, roots = _grouped(docs, *keep, radius=radius, shingle=shingle)
    least = written(_firsts(prints, roots, F.col("doc_id")).select("_fp", F.col("f").alias("component_id")), "simhash-components")
    return prints.join(least, "_fp")


def first_of_groups(docs: DataFrame) -> DataFrame:
    """The rows of docs, of each component only the first by doc_id (null ids last, then by a hash of the text).

    Components that share a doc_id or have none stay apart; of rows that repeat as a whole one stays; an empty table
    gives an empty one.
    """
    docs, old_names = plain_names(docs, "doc_id", "text")
    marked = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    prints, roots = _grouped(marked, "_key")
    first = _firsts(prints, roots, F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("_key")))
    stay = written(first.select(F.col("f.doc_id").alias("_d"), F.col("f._key").alias("_k")).distinct(), "simhash-stay")
    # rows that repeat as a whole: the count of each that stays
    same = F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("_key"))
    times = prints.join(stay, same).groupBy("_d", "_k").agg(F.count("*").alias("_n"))
    met = marked.join(times, same)
    once, more = met.where("_n = 1"), met.where("_n > 1").dropDuplicates(["doc_id", "_key"])
    return once.unionAll(more).select(*old_names)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
