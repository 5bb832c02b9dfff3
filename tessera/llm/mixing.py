"""Mixing sources to target weights, over fixed-length blocks of words.

Each source's documents are laid end to end in a pseudorandom order and cut into blocks of `block` words. A source's
quota of words becomes slots; every slot draws its output shard, so that the counts of a shard's sources are a
multinomial draw, conditioned on the quotas. Slots, numbered by shard within their source, pass through a
pseudorandom permutation of the source's block indices, one for each pass over the source, and are joined to the
blocks by that index. The last slot is cut to the word, so each source gives exactly its rounded target.

Everything is DataFrame expressions. Only sizes and offsets are shuffled, unless the caller asks for texts.
Prefix sums run in two levels (bucket totals, then inside a bucket), so no source's rows meet in one task.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, weighed last; rows
that repeat are mixed as separate documents; of sources that reach their cap at the same level, the first by code point counts first; an empty table gives an empty result; other columns are ignored by
`mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, n_words, read, text_of, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 128
SHARDS = 256
#: For the two-level prefix sums: documents to a bucket, and buckets of a source at least.
BUCKET, BUCKETS = 50_000, 1024
#: Slots that one row gives when slots are listed.
CHUNK = 4096
#: Multipliers of the index permutations; a prime is coprime to every count that it doesn't divide.
PRIMES = (15485863, 32452843, 49979687, 67867967, 86028121)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> also target.

    Sources by code point, null last, weigh `weights`, repeating. The targets share `share` times all sizes by weight;
    one that exceeds `cap` times its source's size stops there and the excess is shared anew. The fixed point is
    min(weight * level, cap * size), with the level found from prefix sums over sources ordered by cap * size / weight.
    One row per source: the windows below order the distinct sources only.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.withColumn("_w", F.get(w, F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))))
    ranked = ranked.withColumn("_top", F.col("source_size") * F.lit(cap)).withColumn("_r", F.col("_top") / F.col("_w"))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum("_top").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    found = ranked.withColumn("_level", level)
    # the first source whose own cap the level doesn't pass fixes the level of all after it
    fixed = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct(F.col("_r"), F.col("_level")))).over(every)
    return found.withColumn("target", F.least(F.col("_top"), F.coalesce(F.col("_w") * fixed["_level"], F.col("_top")))).select("source", "source_size", "target")


def pack(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """Adds _start: the place of the document's first word among its source's words. Needs source, doc_id and size."""
    mixed = docs.withColumn("_h", F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = mixed.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    base = sums.select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), (F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).alias("_base"))
    inner = Window.partitionBy("source", "_b").orderBy("_h", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = mixed.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return placed.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bb"))).withColumn("_start", F.col("_base") + F.col("_in")).drop("_h", "_b", "_bb", "_s", "_base", "_in")


def _buckets(docs: DataFrame) -> int:
    """So many that a bucket has about BUCKET documents at most, even of a source that has all."""
    return max(BUCKETS, docs.count() // BUCKET)


def _listed(df: DataFrame, n: Column, name: str, step: int = CHUNK) -> DataFrame:
    """One row for each of 0 .. n-1, in two steps, so that no array is long and the few rows at first don't list all in one task."""
    some = df.withColumn("_n", n).where("_n > 0").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {step}"))))
    # the number is given, else adaptive execution puts these small rows, which grow to many, into one partition
    some = some.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns, "_c")
    return some.withColumn(name, F.explode(F.sequence(F.col("_c") * step, F.least(F.col("_n"), (F.col("_c") + 1) * step) - 1))).drop("_n", "_c")


def slots(aims: DataFrame, seed: int = 0, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(source, source_size, target) -> one row per slot: source, shard, epoch, index of its block, take (words)."""
    quota = aims.where("source_size > 0").select(
        "source", F.col("source_size").alias("_size"), F.round("target").cast("long").alias("_t"),
        F.expr(f"source_size div {block}").alias("_full"), F.expr(f"(source_size + {block - 1}) div {block}").alias("_blocks"),
    ).withColumn("_epochs", F.expr("_t div _size")).withColumn("_rest", F.col("_t") - F.col("_epochs") * F.col("_size"))
    quota = quota.withColumn("_slots", F.col("_epochs") * F.col("_blocks") + F.expr(f"(_rest + {block - 1}) div {block}"))
    draw = _listed(quota, F.col("_slots"), "_j").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("source"), F.col("_j")), F.lit(shards)).cast("int"))
    counts = draw.groupBy("source", "_size", "_full", "_blocks", "_rest", "_epochs", "shard").agg(F.count("*").alias("_k"))
    first = F.sum("_k").over(Window.partitionBy("source").orderBy("shard")) - F.col("_k")
    own = _listed(counts.withColumn("_first", first), F.col("_k"), "_i").withColumn("_j", F.col("_first") + F.col("_i"))
    own = own.withColumn("epoch", F.expr("cast(_j div _blocks as int)")).withColumn("_p", F.col("_j") - F.col("epoch") * F.col("_blocks"))
    key = F.xxhash64(F.lit(seed), F.lit("index"), F.col("source"), F.col("epoch"))
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    prime = F.coalesce(*[F.when(F.col("_full") % p != 0, p) for p in (F.get(primes, F.pmod(key + F.lit(i), F.lit(len(PRIMES))).cast("int")) for i in range(len(PRIMES)))], F.lit(1).cast("long"))
    # of each pass, whole blocks come first, permuted; the source's short last block ends the pass
    index = F.when(F.col("_p") < F.col("_full"), (prime * F.col("_p") + F.pmod(F.shiftrightunsigned(key, 1), F.greatest(F.col("_full"), F.lit(1)))) % F.greatest(F.col("_full"), F.lit(1))).otherwise(F.col("_full"))
    take = F.when(F.col("epoch") < F.col("_epochs"), F.lit(block)).otherwise(F.least(F.lit(block).cast("long"), F.col("_rest") - F.col("_p") * block))
    return own.select("source", "shard", "epoch", index.alias("index"), take.cast("long").alias("take"))


def _draws(packed: DataFrame, aims: DataFrame, seed: int, block: int, shards: int) -> DataFrame:
    """A row for each piece of a document (named by source, _start, doc_id, size) that a slot takes: epoch, _from, _to in words of the document."""
    parts = packed.where("size > 0").select("source", "_start", "doc_id", "size").withColumn("_block", F.explode(F.sequence(F.expr(f"_start div {block}"), F.expr(f"(_start + size - 1) div {block}"))))
    at = slots(aims, seed, block, shards).select(F.col("source").alias("_s"), "epoch", "index", "take")
    # slots come from an explode, whose size Spark guesses too low to choose a broadcast by
    met = parts.join(at.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("index")))
    low = F.greatest(F.col("_start"), F.col("_block") * block)
    high = F.least(F.col("_start") + F.col("size"), F.col("_block") * block + F.col("take"))
    return met.select("source", "_start", "doc_id", "size", "epoch", (low - F.col("_start")).alias("_from"), (high - F.col("_start")).alias("_to")).where("_to > _from")


def _aims(sized: DataFrame, weights, share, cap) -> DataFrame:
    return targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, share, cap)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source)."""
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size")), "mix-sizes")
    aims = _aims(sized, weights, share, cap)
    packed = pack(sized, seed, _buckets(sized))
    met = _draws(packed, aims, seed, block, shards).select("source", "_start", "doc_id", "size", (F.col("_to") - F.col("_from")).alias("_w"))
    every = packed.select("source", "_start", "doc_id", "size", F.lit(0).cast("long").alias("_w"))
    # rows of size 0 share their start with others; each keeps a row of its own
    some = met.unionAll(every.where("size > 0")).groupBy("source", "_start", "doc_id", "size").agg(F.sum("_w").alias("taken"))
    rows = some.select("source", "doc_id", "size", "taken").unionAll(every.where("size = 0").select("source", "doc_id", "size", F.col("_w").alias("taken")))
    return rows.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix as documents: a row for each document and pass that the mix takes words of, with docs' columns.

    A document taken whole keeps its text; of one taken in part, the taken words are joined by a space. n_chars, where
    docs has it, is that of the new text.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in columns]).alias("_row"), F.col("doc_id"), F.col("source"), n_words("text").alias("size"))
    aims = _aims(rows.select("source", "size"), weights, share, cap)
    sized = rows.where("size > 0")
    buckets = _buckets(docs)
    met = _draws(pack(sized.select("source", "doc_id", "size"), seed, buckets), aims, seed, block, shards)
    spans = met.groupBy("source", "_start", "epoch").agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("_spans"), F.sum(F.col("_to") - F.col("_from")).alias("_taken"))
    spans = spans.withColumnRenamed("source", "_s").withColumnRenamed("_start", "_at")
    full = pack(sized, seed, buckets).join(spans, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_start") == F.col("_at")))
    words = F.filter(F.split(text_of(F.col("_row")["text"]), SPACE), lambda w: w != "")
    cut = F.array_join(F.flatten(F.transform(F.col("_spans"), lambda s: F.slice(F.col("_words"), (s["_from"] + 1).cast("int"), (s["_to"] - s["_from"]).cast("int")))), " ")
    text = F.when(F.col("_taken") == F.col("size"), F.col("_row")["text"]).otherwise(cut)
    out = full.withColumn("_words", F.when(F.col("_taken") < F.col("size"), words)).withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return out.select(*[made[c].alias(c) if made.get(c) is not None else F.col("_row")[c].alias(c) for c in columns])


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
