"""How many items of a group tell its story: distinct kinds, the knee of new word pairs, and a check by compression."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.sources.tables import table

# Groups this small stay whole, smallest answer, radius of likeness, least height of a knee, tolerance of the check.
WHOLE, MIN_K, RADIUS, KNEE, TOLERANCE = 8, 3, 3, 0.05, 0.15


def simhash(text: Column) -> Column:
    """64-bit fingerprint of a text's runs of four characters, each voting with the first 64 bits of its MD5."""

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 3)), lambda i: F.substr(t, i, F.lit(4)))
        bits = let(F.transform(runs, lambda g: F.conv(F.substring(F.md5(g), 1, 16), 16, -10).cast("long")), lambda hs: F.transform(
            F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(hs, F.lit(0), lambda a, h: a + F.when(F.getbit(h, b) == 1, 1).otherwise(-1)) > 0))
        return F.aggregate(F.transform(bits, lambda on, i: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return let(F.lower(text), of)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def bigram_curve(rows: DataFrame, group: str, idx: str, text: str) -> DataFrame:
    """(group, idx, seen): how many different word pairs a group's items up to each one hold."""
    w = rows.select(group, idx, F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "").alias("_w"))
    pairs = w.select(group, idx, F.explode(F.when(F.size("_w") < 2, F.col("_w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - 1)), lambda i: F.array_join(F.slice(F.col("_w"), i, 2), " ")))).alias("pair"))
    new = pairs.groupBy(group, "pair").agg(F.min(idx).alias(idx)).groupBy(group, idx).agg(F.count("*").alias("_new"))
    every = rows.select(group, idx).join(new, [group, idx], "left")
    run = Window.partitionBy(group).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return every.select(group, idx, F.sum(F.coalesce("_new", F.lit(0))).over(run).cast("long").alias("seen"))


def knee(curve: DataFrame, group: str, idx: str, seen: str) -> DataFrame:
    """The number of items at which a group's curve is farthest above its chord, if that is far enough; else null."""
    w = Window.partitionBy(group)
    c = curve.withColumn("_k", F.row_number().over(w.orderBy(idx))).withColumn("_n", F.count("*").over(w)).withColumn("_lo", F.min(seen).over(w)).withColumn("_hi", F.max(seen).over(w))
    height = F.try_divide(F.col(seen) - F.col("_lo"), F.col("_hi") - F.col("_lo")) - F.try_divide(F.col("_k") - 1, F.col("_n") - 1)
    best = c.withColumn("_d", F.round(height, 12)).groupBy(group).agg(F.max(F.struct(F.coalesce("_d", F.lit(-1.0)).alias("d"), (-F.col("_k")).alias("k"))).alias("b"))
    return best.select(group, F.when(F.col("b.d") >= KNEE, -F.col("b.k")).cast("int").alias("knee"))


def _print(text: str) -> int:
    import hashlib

    votes = np.zeros(64, np.int64)
    t = text.lower()
    for i in range(max(1, len(t) - 3)):
        h = int(hashlib.md5(t[i : i + 4].encode()).hexdigest()[:16], 16)
        votes += np.where((h >> np.arange(64, dtype=object)) & 1, 1, -1).astype(np.int64)
    return sum(1 << b for b in range(64) if votes[b] > 0)


def kinds_of(texts: list[str], radius: int = RADIUS) -> int:
    """Greedy groups of fingerprints within radius of their first member."""
    leaders: list[int] = []
    for t in texts:
        p = _print(t)
        if all((p ^ q).bit_count() > radius for q in leaders):
            leaders.append(p)
    return len(leaders)


def best_k(texts: list[str], bias: float = 1.0, least: int = MIN_K, most: int | None = None) -> int:
    """Items to keep of a group: all of a small one; its kinds if few; else the knee of new word pairs, raised where kinds are many, scaled by bias, and by a fifth if what is kept compresses unlike the whole."""
    n = len(texts)
    if n <= WHOLE:
        return n
    most = n if most is None else most
    kinds = kinds_of(texts)
    if kinds <= 3:
        return min(most, max(least, kinds))
    seen: set[str] = set()
    curve = []
    for t in texts:
        w = t.lower().split()
        seen |= {" ".join(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else set(w)
        curve.append(len(seen))
    y = np.array(curve, float)
    floor = int(n * (0.3 + 0.7 * kinds / n))
    k = floor
    if y[-1] > y[0]:
        d = (y - y[0]) / (y[-1] - y[0]) - np.arange(n) / (n - 1)
        if d.max() >= KNEE:
            k = int(d.argmax()) + 1
            k = max(k, floor) if kinds / n > 0.7 else k
    k = min(most, max(least, int(k * bias)))
    if k < n:
        ratio = lambda s: len(zlib.compress("\n".join(s).encode(), 1)) / max(1, len("\n".join(s).encode()))
        if abs(ratio(texts) - ratio(texts[:k])) > TOLERANCE:
            k = min(most, int(k * 1.2))
    return k


def adaptive_k(rows: DataFrame, group: str, idx: str, text: str, bias: float = 1.0, most: int = 15) -> DataFrame:
    """(group, n, k): one row for each group of items (a payload's array)."""
    schema = f"{group} {rows.schema[group].dataType.simpleString()}, n int, k int"

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(idx)[text].fillna("").tolist()
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(texts)], "k": [best_k(texts, bias, MIN_K, most)]})

    return rows.select(group, idx, text).groupBy(group).applyInPandas(size, schema)


def _items(s, d) -> DataFrame:
    return table(s, d, "events").select("user_id", "event_id", F.concat_ws(" ", "event_type", "props").alias("text"))


QUERIES = {
    "adaptive_k": (lambda s, d: adaptive_k(_items(s, d), "user_id", "event_id", "text"), None),
    "bigram_knee": (lambda s, d: knee(bigram_curve(_items(s, d), "user_id", "event_id", "text"), "user_id", "event_id", "seen"), "with w as (select user_id, event_id, list_filter(string_split_regex(lower(concat_ws(' ', event_type, props)), '\\s+'), lambda x: x <> '') as w from events), p as (select user_id, event_id, unnest(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as pair from w), f as (select user_id, e, count(*) as n from (select user_id, pair, min(event_id) as e from p group by 1, 2) group by 1, 2), c as (select v.user_id, event_id, sum(coalesce(n, 0)) over (partition by v.user_id order by event_id) as seen, row_number() over (partition by v.user_id order by event_id) as k, count(*) over (partition by v.user_id) as n from events v left join f on v.user_id = f.user_id and event_id = e), h as (select *, round(coalesce((seen - min(seen) over q) / nullif(max(seen) over q - min(seen) over q, 0) - (k - 1) / nullif(n - 1, 0), -1), 12) as dist from c window q as (partition by user_id)) select user_id, case when dist >= 0.05 then cast(k as integer) end as knee from h qualify row_number() over (partition by user_id order by dist desc, k) = 1"),
    "simhash_prints": (lambda s, d: table(s, d, "customer").select("c_custkey", simhash(F.col("c_name")).alias("print")), "with g as (select c_custkey, substr(lower(c_name), i, 4) as g from customer, lateral (select unnest(range(1, greatest(1, length(c_name) - 3) + 1)) as i)), v as (select c_custkey, b, sum(case when (cast('0x' || substr(md5(g), 1 + 8 * (1 - b // 32), 8) as bigint) >> (b % 32)) & 1 = 1 then 1 else -1 end) as v from g, range(64) t(b) group by 1, 2) select c_custkey, cast(sum(case when v > 0 and b < 63 then cast(1 as hugeint) << b when v > 0 then -(cast(1 as hugeint) << 63) else 0 end) as bigint) as print from v group by 1"),
}
