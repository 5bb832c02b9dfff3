"""Which items of a group to keep: dedup, plans, priorities, set algebra over kept items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.detect import is_error_item
from tessera.operators.windows import change_points
from tessera.sources.tables import table

# Fixed values of plans.
MAX_ITEMS, FIRST_SHARE, LAST_SHARE = 15, 0.3, 0.15


def k_split(k: Column, first: float = FIRST_SHARE, last: float = LAST_SHARE) -> Column:
    """Struct (first, last, important) of k places, halves rounded to even."""
    a = F.greatest(F.lit(1), F.bround(k * first, 0)).cast("int")
    b = F.greatest(F.lit(1), F.bround(k * last, 0)).cast("int")
    a = F.least(a, k)
    b = F.least(b, k - a)
    return F.struct(a.alias("first"), b.alias("last"), (k - a - b).cast("int").alias("important"))


def dedup(rows: DataFrame, group: list, idx: str, content: Column) -> DataFrame:
    """Of items with the same content the one of the lowest index."""
    return rows.withColumn("_h", F.md5(content)).groupBy(*group, "_h").agg(F.min(idx).alias(idx)).drop("_h")


def top_n(rows: DataFrame, group: str, idx: str, score: Column, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(score.desc(), idx)
    return rows.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= n).drop("_p")


def cluster_sample(rows: DataFrame, group: str, idx: str, text: Column, per: int = 2) -> DataFrame:
    """At most `per` items of each cluster: those whose first 50 characters hash alike."""
    w = Window.partitionBy(group, "_c").orderBy(idx)
    return rows.withColumn("_c", F.substring(F.md5(F.left(text, F.lit(50))), 1, 8)).withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= per).drop("_c", "_p")


def time_series(rows: DataFrame, group: str, order: list, value: str, near: int = 2, sigma: float = 2.0) -> DataFrame:
    """First and last item of each group, and those within `near` of a change point."""
    w = Window.partitionBy(group).orderBy(*order)
    points = change_points(rows, group, order, value, sigma=sigma).select(F.col(group).alias("_g"), F.col("place").alias("_at"))
    spread = points.select("_g", F.explode(F.sequence(F.col("_at") - near, F.col("_at") + near)).alias("_at")).distinct()
    r = rows.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    r = r.join(spread, (F.col(group) == F.col("_g")) & (F.col("_k") == F.col("_at")), "left")
    return r.where(F.col("_at").isNotNull() | (F.col("_k") == 0) | (F.col("_k") == F.col("_n") - 1)).drop("_k", "_n", "_g", "_at")


def smart_sample(rows: DataFrame, group: str, order: list, value: str, text: Column, anchors: int = 2, sigma: float = 2.0) -> DataFrame:
    """Items at either end of a group, that look like errors, or whose value is far from the group's mean; with why."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).withColumn("_m", F.avg(value).over(w)).withColumn("_s", F.stddev_samp(value).over(w))
    why = F.when(is_error_item(text), "error").when(F.abs(F.col(value) - F.col("_m")) > sigma * F.col("_s"), "anomaly").when((F.col("_k") <= anchors) | (F.col("_k") > F.col("_n") - anchors), "anchor")
    return r.withColumn("why", why).where("why is not null").drop("_k", "_n", "_m", "_s")


def prioritise(rows: DataFrame, group: str, order: list, critical: Column, budget: int = MAX_ITEMS) -> DataFrame:
    """Critical items all, even over budget; then the first 3 and last 2 of the group and others in order while budget lasts."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    rank = F.when(critical, 0).when((F.col("_k") <= 3) | (F.col("_k") > F.col("_n") - 2), 1).otherwise(2)
    r = r.withColumn("_r", rank).withColumn("_p", F.row_number().over(w.orderBy("_r", "_k")))
    return r.where((F.col("_r") == 0) | (F.col("_p") <= budget)).drop("_k", "_n", "_r", "_p")


def dropped(all_rows: DataFrame, kept: DataFrame, key: list, category: Column) -> DataFrame:
    """What was left out, counted by category, most first."""
    return all_rows.join(kept.select(*key), key, "left_anti").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


def per_file_top(rows: DataFrame, group: str, file: str, order: list, score: Column, files: int = 15, per_file: int = 5) -> DataFrame:
    """The best files of each group by their matches' score, and of each the first, the last and the best matches."""
    w = Window.partitionBy(group, file)
    r = rows.withColumn("_s", score)
    rank = r.groupBy(group, file).agg(F.sum("_s").alias("_t")).withColumn("_f", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_t"), file))).where(F.col("_f") <= files)
    r = r.join(rank.select(group, file), [group, file]).withColumn("_a", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    edge = F.when((F.col("_a") == 1) | (F.col("_a") == F.col("_n")), 0).otherwise(1)
    return r.withColumn("_p", F.row_number().over(w.orderBy(edge, F.desc("_s"), "_a"))).where(F.col("_p") <= per_file).drop("_s", "_a", "_n", "_p")


def union_of_flags(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def mask_union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))


def mask_intersection(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(False)) & F.coalesce(y, F.lit(False)))


def mask_spans(mask: Column) -> Column:
    """Array of (start, end) of the stretches where a mask holds."""
    n = F.size(mask)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i - 1), F.lit(False)))
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(mask, i) & ~F.coalesce(F.get(mask, i + 1), F.lit(False)))
    return F.when(n == 0, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end"))))


_E = ["ts", "event_id"]
_W = "window w as (partition by user_id order by ts, event_id)"

QUERIES = {
    "k_split": (lambda s, d: table(s, d, "part").select("p_partkey", k_split(F.col("p_size")).alias("k")).select("p_partkey", "k.*"), "select p_partkey, a as first, b as last, p_size - a - b as important from (select *, least(greatest(1, cast(round_even(p_size * 0.15::double, 0) as integer)), p_size - a) as b from (select *, least(greatest(1, cast(round_even(p_size * 0.3::double, 0) as integer)), p_size) as a from part))"),
    "dedup_by_content": (lambda s, d: dedup(table(s, d, "events"), ["user_id"], "event_id", F.concat_ws("|", "event_type", "props")), "select user_id, min(event_id) as event_id from events group by user_id, event_type, props"),
    "exact_duplicates": (lambda s, d: table(s, d, "documents").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "select md5(text) as hash, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1"),
    "top_n_plan": (lambda s, d: top_n(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", F.col("l_extendedprice"), 12).select("l_suppkey", "l_orderkey", "l_extendedprice"), "select l_suppkey, l_orderkey, l_extendedprice from lineitem qualify row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey) <= 12"),
    "cluster_sample_plan": (lambda s, d: cluster_sample(table(s, d, "events"), "user_id", "event_id", F.concat_ws("|", "event_type", "props")).select("user_id", "event_id"), "select user_id, event_id from events qualify row_number() over (partition by user_id, left(concat_ws('|', event_type, props), 50) order by event_id) <= 2"),
    "time_series_plan": (lambda s, d: time_series(table(s, d, "events"), "user_id", _E, "value", sigma=1.0).select("user_id", "event_id"), f"with r as (select *, row_number() over w - 1 as k, count(*) over (partition by user_id) as n, stddev_samp(value) over (partition by user_id) as sd, avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) as a, avg(value) over (partition by user_id order by ts, event_id rows between current row and 4 following) as b from events {_W}), p as (select user_id as u, k as c from r where k >= 5 and k <= n - 5 and n >= 10 and sd > 0 and abs(b - a) > sd) select user_id, event_id from r where k = 0 or k = n - 1 or exists (select 1 from p where u = user_id and abs(k - c) <= 2)"),
    "smart_sample_plan": (lambda s, d: smart_sample(table(s, d, "events"), "user_id", _E, "value", F.col("event_type")).select("user_id", "event_id", "why"), f"select * from (select user_id, event_id, case when event_type = 'error' then 'error' when abs(value - avg(value) over p) > 2 * stddev_samp(value) over p then 'anomaly' when row_number() over w <= 2 or row_number() over w > count(*) over p - 2 then 'anchor' end as why from events window w as (partition by user_id order by ts, event_id), p as (partition by user_id)) where why is not null"),
    "prioritised_keep": (lambda s, d: prioritise(table(s, d, "events"), "user_id", _E, F.col("event_type") == "error").select("user_id", "event_id"), f"select user_id, event_id from (select *, row_number() over (partition by user_id order by r, k) as p from (select *, row_number() over w as k, case when event_type = 'error' then 0 when row_number() over w <= 3 or row_number() over w > count(*) over (partition by user_id) - 2 then 1 else 2 end as r from events {_W})) where r = 0 or p <= 15"),
    "dropped_summary": (lambda s, d: dropped(table(s, d, "events"), prioritise(table(s, d, "events"), "user_id", _E, F.col("event_type") == "error"), ["event_id"], F.col("event_type")), f"select event_type as category, count(*) as n from (select *, row_number() over (partition by user_id order by r, k) as p from (select *, row_number() over w as k, case when event_type = 'error' then 0 when row_number() over w <= 3 or row_number() over w > count(*) over (partition by user_id) - 2 then 1 else 2 end as r from events {_W})) where r <> 0 and p > 15 group by 1"),
    "per_file_top": (lambda s, d: per_file_top(table(s, d, "lineitem"), "l_suppkey", "l_partkey", ["l_orderkey", "l_linenumber"], F.floor("l_quantity").cast("long"), 10, 3).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"), "with x as (select *, cast(floor(l_quantity) as bigint) as s from lineitem), f as (select l_suppkey, l_partkey from x group by 1, 2 qualify row_number() over (partition by l_suppkey order by sum(s) desc, l_partkey) <= 10), r as (select x.*, row_number() over (partition by l_suppkey, l_partkey order by l_orderkey, l_linenumber) as a, count(*) over (partition by l_suppkey, l_partkey) as n from x join f using (l_suppkey, l_partkey)) select l_suppkey, l_partkey, l_orderkey, l_linenumber from r qualify row_number() over (partition by l_suppkey, l_partkey order by case when a = 1 or a = n then 0 else 1 end, s desc, a) <= 3"),
    "mask_algebra": (lambda s, d: table(s, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(F.col("p_size"), i) == 1).alias("a"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(F.col("p_partkey"), i) == 1).alias("b")).select("p_partkey", F.size(mask_spans(mask_union("a", "b"))).cast("long").alias("union_spans"), F.size(F.filter(mask_intersection("a", "b"), lambda x: x)).cast("long").alias("both")), "select p_partkey, (select count(*) from range(8) t(i) where ((p_size | p_partkey) >> i) & 1 = 1 and (i = 0 or ((p_size | p_partkey) >> (i - 1)) & 1 = 0)) as union_spans, (select count(*) from range(8) t(i) where ((p_size & p_partkey) >> i) & 1 = 1) as both from part"),
    "set_operations": (lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(s, d, "customer").select(F.col("c_custkey").alias("k"))).exceptAll(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))).union(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))), "((select o_custkey as k from orders intersect select c_custkey from customer) except all select s_suppkey from supplier) union all select cast(n_nationkey as bigint) from nation"),
}
