"""Operators that look at a row's neighbours: change points, context, runs, gaps, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tessera.operators.metrics import requests  # noqa: F401
from tessera.sources.tables import table


def change_points(rows: DataFrame, group: str, order: list, value: str, width: int = 5, sigma: float = 2.0, gap: int | None = None) -> DataFrame:
    """Rows where the mean of the next `width` values leaves that of the last `width` by over `sigma` sample deviations.

    With gap, a change point within gap rows of the last one that was kept is dropped.
    """
    w = Window.partitionBy(group).orderBy(*order)
    every = Window.partitionBy(group)
    x = F.col(value).cast("double")
    r = rows.where(x.isNotNull() & ~F.isnan(x)).withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(every)).withColumn("_sd", F.stddev_samp(x).over(every))
    r = r.withColumn("_a", F.avg(x).over(w.rowsBetween(-width, -1))).withColumn("_b", F.avg(x).over(w.rowsBetween(0, width - 1)))
    hit = r.where((F.col("_k") >= width) & (F.col("_k") <= F.col("_n") - width) & (F.col("_n") >= 2 * width) & (F.col("_sd") > 0) & (F.abs(F.col("_b") - F.col("_a")) > sigma * F.col("_sd")))
    if not gap:
        return hit.drop("_n", "_sd", "_a", "_b").withColumnRenamed("_k", "place")
    # the kept ones depend on those kept before: an ordered fold over the few hits of a group
    fold = hit.groupBy(group).agg(F.array_sort(F.collect_list("_k")).alias("_ks"))
    kept = F.aggregate("_ks", F.array().cast("array<int>"), lambda a, k: F.when((F.size(a) == 0) | (k - F.element_at(a, -1) > gap), F.concat(a, F.array(k))).otherwise(a))
    return fold.select(group, F.explode(kept).alias("place"))


def context(rows: DataFrame, group: str, order: list, selected: Column, before: int = 3, after: int = 3) -> DataFrame:
    """Rows within `before` rows ahead of, or `after` rows behind, a selected one."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-after, before)
    return rows.withColumn("_near", F.max(selected.cast("int")).over(w)).where("_near = 1").drop("_near")


def first_last_top(rows: DataFrame, group: str, order: list, score: str, most: int) -> DataFrame:
    """Of each group its first and last row, then those of the best score, `most` in all."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_a", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    edge = F.when(F.col("_a") == 1, 0).when(F.col("_a") == F.col("_n"), 1).otherwise(2)
    return r.withColumn("_e", edge).withColumn("_p", F.row_number().over(w.orderBy("_e", F.desc(score), *order))).where(F.col("_p") <= most).drop("_a", "_n", "_e", "_p")


def islands(rows: DataFrame, group: str, order: list, key: str) -> DataFrame:
    """Runs of neighbouring rows with the same key: (group, key, run, n, first, last)."""
    w = Window.partitionBy(group).orderBy(*order)
    r = rows.withColumn("_k", F.row_number().over(w)).withColumn("_new", (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    r = r.withColumn("run", F.sum("_new").over(w))
    return r.groupBy(group, "run", key).agg(F.count("*").alias("n"), F.min("_k").alias("first"), F.max("_k").alias("last"))


def downsample(rows: DataFrame, group: str, order: list, tail: int, head: int) -> DataFrame:
    """The last `tail` rows of each group, and `head` of the others at even distances."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.greatest(F.count("*").over(w) - tail, F.lit(0)))
    even = F.floor(F.col("_k") * head / F.col("_m")) != F.floor((F.col("_k") - 1) * head / F.col("_m"))
    return r.where((F.col("_k") >= F.col("_m")) | (F.col("_k") == 0) | even).drop("_k", "_m")


def stride_fill(rows: DataFrame, group: str, order: list, content: Column, most: int) -> DataFrame:
    """Rows of different content at a stride that gives about `most` of each group."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most)))
    r = r.where(F.col("_k") % F.col("_step") == 0).withColumn("_h", F.md5(content))
    r = r.withColumn("_d", F.row_number().over(Window.partitionBy(group, "_h").orderBy("_k"))).where("_d = 1")
    return r.withColumn("_p", F.row_number().over(w.orderBy("_k"))).where(F.col("_p") <= most).drop("_k", "_step", "_h", "_d", "_p")


def anchors(rows: DataFrame, group: str, order: list, density: str, front: int, middle: int, back: int) -> DataFrame:
    """First and last rows of each group, and of its middle those of the highest density."""
    w = Window.partitionBy(group)
    r = rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    region = F.when(F.col("_k") <= front, "front").when(F.col("_k") > F.col("_n") - back, "back").otherwise("middle")
    r = r.withColumn("region", region).withColumn("_p", F.row_number().over(Window.partitionBy(group, "region").orderBy(F.desc(density), "_k")))
    return r.where((F.col("region") != "middle") | (F.col("_p") <= middle)).drop("_k", "_n", "_p")


def cache_miss(turns: DataFrame, session: str, order: list, read: str, prefix: str, at: str, ttl_seconds: int) -> DataFrame:
    """Why a turn's cache read failed: cold, hit, ttl_expiry, prefix_change or unknown."""
    w = Window.partitionBy(session).orderBy(*order)
    idle = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1e6
    why = F.when(F.row_number().over(w) == 1, "cold").when(F.col(read) > 0, "hit").when(idle > ttl_seconds, "ttl_expiry").when(F.col(prefix) != F.lag(prefix).over(w), "prefix_change").otherwise("unknown")
    return turns.withColumn("cause", why)


def sessions(rows: DataFrame, key: str, at: str, order: list, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): rows of a key with less than gap between neighbours."""
    w = Window.partitionBy(key).orderBy(at, *order)
    new = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) >= gap_seconds * 1_000_000) | (F.row_number().over(w) == 1)
    r = rows.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w))
    return r.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def drift(requests_: DataFrame, session: str, order: list, axes: list[str]) -> DataFrame:
    """Which of the axes' hashes changed since the session's last request, joined by commas; null for none."""
    w = Window.partitionBy(session).orderBy(*order)
    changed = [F.when((F.sha2(F.col(a).cast("string"), 256) != F.lag(F.sha2(F.col(a).cast("string"), 256)).over(w)), F.lit(a)) for a in axes]
    return requests_.withColumn("drift", F.nullif(F.concat_ws(",", *changed), F.lit("")))


def token_bucket(calls: DataFrame, key: str, at: str, order: list, capacity: int, per_second: float) -> DataFrame:
    """calls with passed: whether a bucket that refills steadily, and is full at a key's first call, lets each through.

    It is an ordered fold (a call that is turned away takes nothing) with a state of two numbers for each key, so rows
    are sorted by key and time and stream through a task; no key's calls are held together.
    """
    given = calls.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, "_t", *order)
    place, when, schema = given.columns.index(key), given.columns.index("_t"), StructType([*given.schema.fields, StructField("passed", BooleanType())])

    def run(batches):
        import pyarrow as pa

        held, level, last, begun = None, 0.0, 0, False
        for batch in batches:
            passed = []
            for k, now in zip(batch.column(place).to_pylist(), batch.column(when).to_pylist(), strict=True):
                if k != held or not begun:
                    held, level, last, begun = k, float(capacity), now, True
                level, last = min(float(capacity), level + (now - last) / 1e6 * per_second), now
                passed.append(level >= 1)
                level -= level >= 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(passed, pa.bool_())], names=schema.names)

    return given.mapInArrow(run, schema).drop("_t")


_E = ["ts", "event_id"]
_W = "window w as (partition by user_id order by ts, event_id)"
_CP = f"(select *, row_number() over w - 1 as k, count(*) over (partition by user_id) as n, stddev_samp(value) over (partition by user_id) as sd, avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) as a, avg(value) over (partition by user_id order by ts, event_id rows between current row and 4 following) as b from events {_W})"
_CPT = "k >= 5 and k <= n - 5 and n >= 10 and sd > 0 and abs(b - a) > 1 * sd"

QUERIES = {
    "change_points": (lambda s, d: change_points(table(s, d, "events"), "user_id", _E, "value", sigma=1.0).select("user_id", "event_id", "place"), f"select user_id, event_id, cast(k as integer) as place from {_CP} where {_CPT}"),
    "change_points_spaced": (lambda s, d: change_points(table(s, d, "events"), "user_id", _E, "value", sigma=1.0, gap=5), f"with recursive h as (select user_id, k from {_CP} where {_CPT}), r as (select user_id, min(k) as k from h group by 1 union all select user_id, k2 from (select r.user_id, (select min(h.k) from h where h.user_id = r.user_id and h.k > r.k + 5) as k2 from r) where k2 is not null) select user_id, cast(k as integer) as place from r"),
    "context_lines": (lambda s, d: context(table(s, d, "events"), "user_id", _E, F.col("event_type") == "error").select("user_id", "event_id"), f"select user_id, event_id from (select *, max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 3 preceding and 3 following) as near from events) where near = 1"),
    "first_last_top": (lambda s, d: first_last_top(table(s, d, "events"), "user_id", _E, "value", 5).select("user_id", "event_id"), f"select user_id, event_id from (select *, row_number() over (partition by user_id order by e, value desc, ts, event_id) as p from (select *, case when row_number() over w = 1 then 0 when row_number() over w = count(*) over (partition by user_id) then 1 else 2 end as e from events {_W})) where p <= 5"),
    "runs_of_type": (lambda s, d: islands(table(s, d, "events"), "user_id", _E, "event_type").select("user_id", "event_type", "run", "n"), f"select user_id, event_type, cast(run as bigint) as run, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as run from (select *, case when event_type = lag(event_type) over w then 0 else 1 end as new from events {_W})) group by 1, 2, 3"),
    "downsample": (lambda s, d: downsample(table(s, d, "events"), "user_id", _E, 10, 7).select("user_id", "event_id"), f"select user_id, event_id from (select *, row_number() over w - 1 as k, greatest(count(*) over (partition by user_id) - 10, 0) as m from events {_W}) where k >= m or k = 0 or floor(k * 7 / m) <> floor((k - 1) * 7 / m)"),
    "stride_fill": (lambda s, d: stride_fill(table(s, d, "events"), "user_id", _E, F.concat_ws("|", "event_type", "props"), 8).select("user_id", "event_id"), f"select user_id, event_id from (select *, row_number() over (partition by user_id order by k) as p from (select *, row_number() over (partition by user_id, event_type, props order by k) as u from (select *, row_number() over w - 1 as k, greatest(1, floor(count(*) over (partition by user_id) / 8)) as step from events {_W}) where k % step = 0) where u = 1) where p <= 8"),
    "anchor_slots": (lambda s, d: anchors(table(s, d, "events"), "user_id", _E, "value", 3, 2, 3).select("user_id", "event_id", "region"), f"select user_id, event_id, region from (select *, row_number() over (partition by user_id, region order by value desc, k) as p from (select *, row_number() over w as k, case when row_number() over w <= 3 then 'front' when row_number() over w > count(*) over (partition by user_id) - 3 then 'back' else 'middle' end as region from events {_W})) where region <> 'middle' or p <= 2"),
    "cache_miss_causes": (lambda s, d: cache_miss(table(s, d, "events").withColumn("read", F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0)), "user_id", _E, "read", "props", "ts", 3600).groupBy("cause").agg(F.count("*").alias("n")), f"select cause, count(*) as n from (select case when row_number() over w = 1 then 'cold' when event_type in ('view', 'click') then 'hit' when epoch_us(ts) - epoch_us(lag(ts) over w) > 3600000000 then 'ttl_expiry' when props <> lag(props) over w then 'prefix_change' else 'unknown' end as cause from events {_W}) group by 1"),
    "sessions_by_gap": (lambda s, d: sessions(table(s, d, "events"), "user_id", "ts", ["event_id"], 6 * 3600), f"select user_id, cast(session as bigint) as session, min(ts) as start, max(ts) as \"end\", count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as session from (select *, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 21600000000 then 0 else 1 end as new from events {_W})) group by 1, 2"),
    "prefix_drift": (lambda s, d: drift(table(s, d, "events"), "user_id", _E, ["event_type", "props"]).where("drift is not null").groupBy("drift").agg(F.count("*").alias("n")), f"select drift, count(*) as n from (select nullif(concat_ws(',', case when event_type <> lag(event_type) over w then 'event_type' end, case when props <> lag(props) over w then 'props' end), '') as drift from events {_W}) where drift is not null group by 1"),
    "rate_limit": (
        lambda s, d: token_bucket(table(s, d, "events"), "user_id", "ts", ["event_id"], 2, 1 / 345600).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("passed")),
        """
        with recursive e as (
            select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events
        ), r(user_id, i, t, level, passed) as (
            select user_id, i, t, 1.0::double, 1 from e where i = 1
            union all
            select user_id, i, t, case when now >= 1 then now - 1 else now end, case when now >= 1 then 1 else 0 end
            from (select e.user_id, e.i, e.t, least(2.0::double, r.level + (e.t - r.t) / 1e6::double * (1.0::double / 345600)) as now from r join e on e.user_id = r.user_id and e.i = r.i + 1)
        ) select user_id, count(*) as n, cast(sum(passed) as bigint) as passed from r group by 1
        """,
    ),
}
