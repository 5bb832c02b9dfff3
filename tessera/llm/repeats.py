"""Repeated substrings across a corpus, by suffix arrays of shards.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. Two lengths can be asked for
at once. Strings meet in shards: every window (as many bytes as the shorter length, with those up to the longer one
behind them) goes by its anchor, the smallest hash of the grams in it, so equal windows share an anchor. Windows that
follow each other with one anchor form a run, whose bytes travel once. Anchors of which there is one run in the corpus
can't repeat (but for a periodic one), and their bytes stay where they are. Of runs with the same hashes two copies travel: the first to the
shard of its anchor, the second to a shard of second copies.

A shard's suffixes are sorted by Larsson-Sadakane refinement, Kasai's pass gives common prefixes, and a window repeats
that shares `length` bytes with the next or the last window in order. The shard of second copies is merged into it by
binary search: a run repeats as a whole if the search finds its bytes. Hashes only choose shards and stand for further
copies of a run whose two first were compared. An anchor with more than `SHARD_RUNS` different runs has several shards.
These aren't merged pair by pair: what each leaves open, with one of every group of equal windows that it found, goes window by
window to a place named by a hash of its bytes, where copies from two shards are again compared by binary search.

Defined results: a null text counts as empty; a text shorter than `length` keeps every byte; matches don't cross rows;
rows that repeat are each other's copies and lose all windows; ids play no part in what is removed; texts of any length
are cut into pieces of `PIECE` bytes that overlap. `deduplicated` drops characters of which only some bytes are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import dropped, plain_names, read, written
from tessera.llm.suffixes import PAD, common_prefixes, eights, found_in, padded, suffix_array
from tessera.llm.words import lean, parts, ragged


LENGTH = 400
#: The shorter length, for passages: fifty words of four letters, with a space each.
PASSAGE = 250
GRAM = 32
#: Bytes that are scanned at once; places in a piece fit 20 bits.
PIECE = 1 << 19
PLACES = (1 << 20) - 1
#: Different runs of an anchor in one shard, and bytes of a shard that holds several anchors.
SHARD_RUNS = 2048
SHARD_BYTES = 250_000
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def grams(words: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each place; words: eights(big=False)."""
    n = max(0, len(words) - GRAM + 8)
    h = words[:n] * MIX[0]
    for k in (1, 2, 3):
        h += words[8 * k : 8 * k + n] * MIX[k]
    h ^= h >> np.uint64(29)
    h *= MIX[4]
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, windows: np.ndarray, short: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, inner) of every run among the first `windows` windows of texts piece[starts[i]:ends[i]].

    A run is a stretch of window starts, `short` at most, whose windows have the same smallest gram hash (of the
    leftmost gram, of equals). The hash is the run's anchor: windows of equal content lie in runs of equal anchor.
    Only in a run where that gram comes at several places (inner) two windows may be equal.
    """
    fits = windows > 0
    if not fits.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    words = eights(np.concatenate([piece, np.zeros(PAD, np.uint8)]), False)
    h = grams(words)
    low = np.uint64(PLACES)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), short - GRAM + 1)
    edge, begins = np.zeros(len(least) + 1, np.int32), np.zeros(len(least), bool)
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, starts[fits] + windows[fits], -1)
    begins[starts[fits]] = True
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    gram = (least[at] & low).astype(np.int64)
    anchor = h[gram]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | begins[at[1:]]])
    cuts = -(-np.diff(np.r_[first, len(at)]) // short)
    first = ragged(np.zeros(len(first), np.int64), cuts) * short + np.repeat(first, cuts)
    start = at[first]
    windows = np.diff(np.r_[first, len(at)])
    return np.searchsorted(starts, start, "right") - 1, start, windows, anchor[first], gram[first] != gram[first + windows - 1]


def pieces(offsets: np.ndarray, lengths: tuple[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts texts that lie end to end at offsets into stretches of at most PIECE bytes.

    Gives (base, text numbers, starts, ends, windows): windows that have all their bytes, up to the longer length, here.
    """
    (short, long), k, n = lengths, 0, len(offsets) - 1
    while k < n:
        if offsets[k + 1] - offsets[k] > PIECE:  # a long text alone
            size = int(offsets[k + 1] - offsets[k])
            for a in range(0, size - short + 1, PIECE - long + 1):
                end = min(PIECE, size - a)
                yield int(offsets[k]) + a, np.array([k]), np.array([0]), np.array([end]), np.array([end - short + 1 if a + end == size else PIECE - long + 1])
                if a + end == size:
                    break
            k += 1
            continue
        end = int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1
        starts, ends = offsets[k:end] - offsets[k], offsets[k + 1 : end + 1] - offsets[k]
        yield int(offsets[k]), np.arange(k, end), starts, ends, ends - starts - short + 1
        k = end


RUNS = "_key long, start int, windows int, size int, anchor long, frag long, inner boolean"


def runs(keyed: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """(_key, text) -> a row for every run: its place, windows and bytes; frag hashes the bytes and the number of windows."""
    short, long = lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            text = batch.column(1).cast(pa.binary())
            offsets = np.frombuffer(text.buffers()[1], np.int32, count=len(text) + 1, offset=4 * text.offset).astype(np.int64)
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.empty(0, np.uint8)
            for base, rows, starts, ends, fit in pieces(offsets, lengths):
                piece = data[base : base + int(ends[-1])]
                which, start, windows, anchor, inner = runs_of(piece, starts, ends, fit, short)
                if not len(start):
                    continue
                size = np.minimum(windows - 1 + long, ends[which] - start)
                view = memoryview(piece)
                frag = [xxhash.xxh64_intdigest(view[a : a + n], w) for a, n, w in zip(start.tolist(), size.tolist(), windows.tolist(), strict=True)]
                place = base + start - offsets[rows[which]]
                columns = [keys[rows[which]], place.astype(np.int32), windows.astype(np.int32), size.astype(np.int32), anchor.view(np.int64), np.array(frag, np.uint64).view(np.int64), inner]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["_key", "start", "windows", "size", "anchor", "frag", "inner"])

    return keyed.select("_key", F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(lean(run), RUNS)


def _spots(places: np.ndarray) -> list[int]:
    """Ascending numbers as [first, end) stretches, flat."""
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([np.r_[places[:1], places[cut + 1]], np.r_[places[cut], places[-1:]] + 1], axis=1).ravel().tolist()


class Shard:
    """Runs laid end to end, each before a byte that no UTF-8 text has, with their suffixes in order."""

    def __init__(self, texts: list[bytes], windows: np.ndarray):
        self.starts, self.ends, text = _end_to_end(texts)
        self.words, self.text = eights(text), text
        self.order, _ = suffix_array(self.words)
        edge = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(edge, self.starts, 1)
        np.add.at(edge, self.starts + windows, -1)
        self.is_window = np.cumsum(edge)[:-1].astype(bool)

    def repeats(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of all windows, and how many bytes (up to depth) each shares with the windows before and behind it in order."""
        order = self.order[self.is_window[self.order]]
        shared = common_prefixes(eights(self.text, False), order, depth)
        before, behind = np.empty((2, len(self.words)), np.int64)
        before[order], behind[order] = shared, np.r_[shared[1:], 0]
        places = np.flatnonzero(self.is_window)
        room = self.ends[np.searchsorted(self.starts, places, "right") - 1] - places
        return places, np.minimum(before[places], room), np.minimum(behind[places], room)

    def met_by(self, texts: list[bytes]) -> np.ndarray:
        """Which of other shard's runs are runs of this one: found by binary search in its order, to their ends."""
        first = np.zeros(len(self.order), bool)
        first[self.starts] = True
        own = self.order[first[self.order]]
        starts, ends, text = _end_to_end(texts)
        return found_in(eights(text), starts, self.words, own, ends - starts + 1) >= 0


def _end_to_end(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends - 1, padded(b"\xff".join(texts) + b"\xff")


FOUND = "kind int, anchor long, frag long, spots array<array<int>>, at int, name long, open boolean, name_far long, open_far boolean"


def _judged(rows: list[tuple], second: dict[int, bytes], lengths: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """rows (anchor, sub, frag, windows, bytes) of a shard, and the second copies of some -> rows of FOUND.

    Of kind 0 are runs with the stretches of windows that repeat, for either length. Of kind 1, for an anchor that has
    other shards (sub isn't null), are the windows that may repeat in these: open ones, and one of each group found here,
    with a hash of their bytes for either length (null if the window isn't among these for that length).
    """
    short, long = lengths
    shard = Shard([r[4] for r in rows], np.array([r[3] for r in rows]))
    places, before, behind = shard.repeats(long)
    run = np.repeat(np.arange(len(rows)), [r[3] for r in rows])
    at, room = places - shard.starts[run], shard.ends[run] - places
    asked = np.array(list(second), np.int64)
    whole = np.zeros(len(rows), bool)
    if len(asked):
        whole[asked[shard.met_by(list(second.values()))]] = True
    hits = [((np.maximum(before, behind) >= n) | whole[run]) & (room >= n) for n in lengths]
    cuts = np.searchsorted(places, shard.starts[1:])
    found = [[_spots(p[h]) if h.any() else [] for p, h in zip(np.split(at, cuts), np.split(hit, cuts), strict=True)] for hit in hits]
    some = [k for k in range(len(rows)) if found[0][k]]
    none = [None] * len(some)
    yield _table([0] * len(some), [rows[k][0] for k in some], [rows[k][2] for k in some], [[f[k] for f in found] for k in some], none, none, none, none, none)
    shared = np.array([r[1] is not None for r in rows])[run]
    view = memoryview(shard.text)

    def named(part: np.ndarray, n: int, hit: np.ndarray) -> list[pa.Array]:
        """Names of windows that are the first here with their bytes, and whether they are open."""
        asked = (room[part] >= n) & (before[part] < n)
        names = np.zeros(len(part), np.uint64)
        names[asked] = [xxhash.xxh64_intdigest(view[a : a + n]) for a in places[part][asked].tolist()]
        return [pa.array(names.view(np.int64), mask=~asked), pa.array(~hit[part], mask=~asked)]

    wanted = np.flatnonzero(shared & ((before < short) | (room >= long) & (before < long)))
    for part in np.array_split(wanted, 1 + len(wanted) // 65_536) if len(wanted) else []:
        far = named(part, long, hits[1]) if long > short else [[None] * len(part)] * 2
        yield _table([1] * len(part), [rows[k][0] for k in run[part]], [rows[k][2] for k in run[part]], [None] * len(part), at[part], *named(part, short, hits[0]), *far)


def _table(*columns) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def _matched(copies: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """First and second copies (anchor, sub, frag, copy, windows, bytes) -> rows of FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        second: dict[int, bytes] = {}
        size, last = 0, None
        for batch in batches:
            for anchor, sub, frag, copy, windows, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last == (anchor, sub, frag, copy):
                    continue  # of a row that the corpus repeats as a whole
                # shards of one anchor aren't laid together, as its windows are open towards the other ones
                if held and (anchor, sub) != last[:2] and (size >= SHARD_BYTES or anchor == last[0]):
                    yield from _judged(held, second, lengths)
                    held, second, size = [], {}, 0
                last = (anchor, sub, frag, copy)
                if copy:
                    second[len(held) - 1] = raw
                else:
                    held.append((anchor, sub, frag, windows, raw))
                    size += len(raw)
        if held:
            yield from _judged(held, second, lengths)

    dealt = copies.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "frag", "copy")
    return dealt.select("anchor", "sub", "frag", "copy", "windows", "bytes").mapInArrow(lean(run), FOUND)


def _taken(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (_key, start, size, anchor, sub, frag, copy, windows): gives them with their bytes."""
    names = ["anchor", "sub", "frag", "copy", "windows", "bytes"]
    lists = wanted.groupBy("_key").agg(F.collect_list(F.struct("start", "size", *names[:-1])).alias("_runs"))
    columns = keyed.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at)):
            places = batch.column(len(columns))
            row = np.repeat(np.arange(len(batch)), np.asarray(places.value_lengths()))
            every = places.flatten()
            raw = batch.column(at).cast(pa.binary()).to_pylist()
            start, size = (np.asarray(every.field(f)) for f in ("start", "size"))
            for k in range(0, len(row), 4096):
                cut = slice(k, k + 4096)
                taken = [raw[r][a : a + n] for r, a, n in zip(row[cut].tolist(), start[cut].tolist(), size[cut].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(every.field(f).slice(k, 4096) for f in names[:-1]), pa.array(taken, pa.binary())], names=names)

    # all columns go in, so that this exchange of the texts is the one that the result uses again
    return keyed.join(lists, "_key").select(*columns, "_runs").mapInArrow(lean(run), "anchor long, sub int, frag long, copy int, windows int, bytes binary")


def _copies(kinds: DataFrame) -> DataFrame:
    """The first copy of each kind, and the second, of those that come more than once."""
    first, second = F.struct(F.lit(0).alias("copy"), "p.*"), F.struct(F.lit(1).alias("copy"), "q.*")
    both = F.when(F.col("n") > 1, F.array(first, second)).otherwise(F.array(first))
    return kinds.withColumn("_c", F.explode(both)).select("_c.*", "windows", "anchor", "sub", "frag")


def _over_shards(keyed: DataFrame, met: DataFrame, windows: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """Windows that shards of one anchor left open (FOUND, kind 1) -> anchor, frag, spots of those that two shards have."""
    place, either = F.struct("frag", "at"), ["anchor", "frag", "at"]
    windows = windows.select(*either, F.lit(0).alias("level"), "name", "open").unionAll(windows.select(*either, F.lit(1).alias("level"), "name_far", "open_far")).where("name is not null")
    named = windows.groupBy("anchor", "level", "name").agg(F.count("*").alias("n"), F.max("open").alias("_o"), F.min(place).alias("p"), F.max(place).alias("q"))
    # the name stands for the anchor from here on, the anchor for the run
    twice = named.where("n > 1 and _o").select(F.col("name"), "level", "anchor", F.explode(F.array(F.struct(F.lit(0).alias("copy"), "p.*"), F.struct(F.lit(1).alias("copy"), "q.*"))).alias("_c")).select("name", "level", "anchor", "_c.*")
    size = F.element_at(F.array(*map(F.lit, lengths)), F.col("level") + 1)
    copies = twice.join(met.select("anchor", "frag", "p"), ["anchor", "frag"]).select(
        F.col("p._key"), (F.col("p.start") + F.col("at")).alias("start"), size.alias("size"), F.xxhash64("anchor", "name", "level").alias("anchor"),
        F.lit(None).cast("int").alias("sub"), F.lit(0).cast("long").alias("frag"), "copy", F.lit(1).alias("windows"))
    same = _matched(_taken(keyed, copies), lengths).where("kind = 0").select(F.col("anchor").alias("_n")).distinct()
    repeat = windows.where("open").withColumn("_n", F.xxhash64("anchor", "name", "level")).join(same, "_n")
    # windows that follow each other become one stretch
    after = F.row_number().over(Window.partitionBy("anchor", "frag", "level").orderBy("at"))
    stretch = repeat.withColumn("_g", F.col("at") - after).groupBy("anchor", "frag", "level", "_g").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    cut, none = F.array("a", "b"), F.array().cast("array<int>")
    if lengths[0] == lengths[1]:
        return stretch.select("anchor", "frag", F.array(cut, cut).alias("spots"))
    return stretch.select("anchor", "frag", F.when(F.col("level") == 0, F.array(cut, none)).otherwise(F.array(none, cut)).alias("spots"))


def spots(keyed: DataFrame, lengths: tuple[int, int] = (LENGTH, LENGTH)) -> DataFrame:
    """keyed (_key, text, ...) -> _key, found: a list of (start, spots for either length) for every key of which something repeats."""
    every = written(runs(keyed, lengths), "runs")
    several = written(every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("inner").alias("_i")).where("n > 1 or _i").select("anchor"), "anchors")
    often = written(every.join(several, "anchor", "left_semi").drop("inner"), "runs-met")
    dropped(every)
    dropped(several)
    place = F.struct("_key", "start", "size")
    kinds = often.groupBy("anchor", "frag").agg(F.count("*").alias("n"), F.min(place).alias("p"), F.max(place).alias("q"), F.first("windows").alias("windows"))
    kinds = written(kinds, "run-kinds")
    # a table, so that adaptive execution can split an anchor in the join
    count = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > SHARD_RUNS), "anchors-hot")
    sub = F.when(F.col("kinds").isNotNull(), F.pmod(F.xxhash64("frag"), F.expr(f"(kinds + {SHARD_RUNS} - 1) div {SHARD_RUNS}")).cast("int"))
    met = kinds.join(count, "anchor", "left").withColumn("sub", sub).drop("kinds")
    found = written(_matched(_taken(keyed, _copies(met)), lengths), "run-repeats")
    repeat = found.where("kind = 0").select("anchor", "frag", "spots")
    if not count.isEmpty():
        repeat = repeat.unionAll(_over_shards(keyed, met.where("sub is not null"), found.where("kind = 1"), lengths))
    return often.join(repeat, ["anchor", "frag"]).groupBy("_key").agg(F.collect_list(F.struct("start", "spots")).alias("found"))


def _covered(found: list[dict] | None, length: int, which: int = 0) -> list[tuple[int, int]]:
    """Maximal removed runs [a, b) of a text; which: the shorter or the longer length."""
    parts = sorted((f["start"] + s[k], f["start"] + s[k + 1] - 1 + length) for f in found or [] for s in [f["spots"][which]] for k in range(0, len(s), 2))
    out = [list(p) for p in parts[:1]]
    for a, b in parts[1:]:
        if a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text", F.length("text")))


def _cut(docs: DataFrame, lengths: tuple[int, int], columns: list[str]) -> DataFrame:
    """docs (all of columns, with text) with what repeats in each."""
    keyed = _keyed(docs.select(*columns))
    return keyed.join(spots(keyed, lengths), "_key", "left")


def removed(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; n_repeated, n_repeated_spans: bytes and maximal runs
    that strings of `passage` bytes (length at most) cover which start elsewhere, found in the same suffix arrays."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                raw, found = text.as_py() or b"", found.as_py()
                cut, near = _covered(found, length, 1), _covered(found, passage)
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in cut), len(cut), digest.hexdigest(), sum(b - a for a, b in near), len(near)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated", "n_repeated_spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = _cut(docs, (passage, length), ["doc_id", "text"]).select("doc_id", "text", "found")
    return cut.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long, n_repeated_spans long")


def deduplicated(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """docs with what repeats cut out of text; n_chars, where docs has it, is that of a changed text."""
    docs, old_names = plain_names(docs, "doc_id", "text", "n_chars")
    columns = docs.columns
    at = columns.index("text")

    def left(text: str, found: list[dict]) -> str:
        raw, place, kept = text.encode(), 0, []
        for a, b in _covered(found, length):
            kept.append(raw[place:a].decode(errors="ignore"))
            place = b
        return "".join([*kept, raw[place:].decode(errors="ignore")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts = [t.as_py() if f is None else left(t.as_py(), f) for t, f in zip(batch.column(at), batch.column(len(columns)).to_pylist(), strict=True)]
            out = list(batch.columns[:-1])
            out[at] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                k = columns.index("n_chars")
                changed = batch.column(len(columns)).is_valid()
                out[k] = pc.if_else(changed, pc.utf8_length(out[at]).cast(out[k].type), out[k])
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return _cut(docs, (length, length), columns).select(*columns, "found").mapInArrow(lean(run), docs.schema).select(*old_names)


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
