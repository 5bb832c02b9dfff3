"""Request metrics, savings and fleet dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table

# Price of a million input tokens without a known model, retention, buckets of input size, normal quantile.
FALLBACK_PRICE = 3.0
RETENTION_DAYS = 365
INPUT_BUCKETS = ((2000, "xs"), (8000, "s"), (32000, "m"), (128000, "l"))
Z = 1.96


def requests(spark, folder: str) -> DataFrame:
    """Line items read as requests: one row per line, its price as tokens before and, less the discount, after."""
    x = table(spark, folder, "lineitem")
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("mode"), F.col("l_suppkey").alias("client"),
        F.floor("l_extendedprice").cast("long").alias("before"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("after"))


REQUESTS = """(select l_orderkey * 10 + l_linenumber as id, l_shipdate as ts, l_returnflag as model, l_linestatus as mode, l_suppkey as client,
  cast(floor(l_extendedprice) as bigint) as before, cast(floor(l_extendedprice * (1 - l_discount)) as bigint) as after from lineitem)"""


def query(requests_: DataFrame, start=None, end=None, model: str | None = None, mode: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Requests that meet every given condition, latest first; a page of them if limit is given."""
    tests = [c for c, on in ((F.col("ts") >= F.lit(start), start is not None), (F.col("ts") < F.lit(end), end is not None), (F.col("model") == model, model is not None), (F.col("mode") == mode, mode is not None)) if on]
    out = requests_.where(reduce(lambda a, b: a & b, tests)) if tests else requests_
    if limit is None:
        return out
    return out.orderBy(F.desc("ts"), F.desc("id")).offset(offset).limit(limit)


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """An upsert log's state: the last row of each key. The maximum combines before the shuffle, so no key is hot."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(F.col(at), *[F.col(c).alias(f"_{c}") for c in rest if c != at])).alias("r")).select(key, *[(F.col(f"r.{c}") if c == at else F.col(f"r._{c}")).alias(c) for c in rest])


def summary(requests_: DataFrame) -> DataFrame:
    saved = F.col("before") - F.col("after")
    return requests_.agg(
        F.count("*").alias("n_requests"), F.sum("before").alias("tokens_before"), F.sum("after").alias("tokens_after"), F.sum(saved).alias("tokens_saved"),
        F.round(F.avg(saved), 4).alias("mean_saved"), F.sum(F.when(F.col("mode") == "F", 1).otherwise(0)).cast("long").alias("n_audit"), F.count_distinct("model").alias("n_models"))


def savings_windows(requests_: DataFrame, as_of: str, by: str = "model") -> DataFrame:
    """Savings of a lifetime, of today and of the last 168 hours, for each value of `by` and (as null) in all."""
    now = F.lit(as_of).cast("timestamp_ntz")
    saved = F.col("before") - F.col("after")
    when = lambda c: F.sum(F.when(c, saved).otherwise(0)).cast("long")
    held = requests_.where((F.col("ts") <= now) & (F.col("ts") > now - F.expr(f"interval {RETENTION_DAYS} days")))
    sets = held.groupingSets([[F.col(by)], []], F.col(by))
    return sets.agg(F.sum(saved).alias("lifetime"), when(F.date_trunc("day", "ts") == F.date_trunc("day", now)).alias("today"), when(F.col("ts") > now - F.expr("interval 168 hours")).alias("week"), F.grouping(by).cast("int").alias("is_total"))


def bucket_start(ts: str | Column, bucket: str) -> Column:
    """Start of the hour, day, week (Monday) or month."""
    return F.date_trunc(bucket, ts).cast("timestamp_ntz")


def counter_deltas(rows: DataFrame, key: str, at: str, counter: str) -> DataFrame:
    """Adds delta: how far a cumulative counter rose since the key's previous row; 0 where it fell."""
    w = Window.partitionBy(key).orderBy(at[0] if isinstance(at, tuple) else at, *(at[1:] if isinstance(at, tuple) else ()))
    return rows.withColumn("delta", F.greatest(F.col(counter) - F.coalesce(F.lag(counter).over(w), F.lit(0)), F.lit(0)))


def rollup(rows: DataFrame, key: str, at: tuple, counter: str, bucket: str) -> DataFrame:
    d = counter_deltas(rows, key, at, counter)
    return d.groupBy(bucket_start(at[0], bucket).alias("bucket")).agg(F.sum("delta").cast("long").alias("delta"), F.count("*").alias("n"))


def counters(spark, folder: str) -> DataFrame:
    """Events read as beacons: a user is an instance; its counter is the running number of its events' tens."""
    e = table(spark, folder, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "ts", "event_id", "event_type", F.sum(F.floor(F.col("value")).cast("long")).over(w).alias("counter"))


COUNTERS = "(select user_id, ts, event_id, event_type, cast(sum(cast(floor(value) as bigint)) over (partition by user_id order by ts, event_id) as bigint) as counter from events)"


def dashboard(rows: DataFrame, grain: str) -> DataFrame:
    """Two levels: the most of each instance's counter in a period, then their sum, and the instances."""
    each = rows.groupBy(bucket_start("ts", grain).alias("period"), "user_id").agg(F.max("counter").alias("top"))
    return each.groupBy("period").agg(F.sum("top").cast("long").alias("total"), F.count_distinct("user_id").alias("instances"))


def top_instances(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max("counter").alias("top"), F.count("*").alias("beacons")).orderBy(F.desc("top"), "user_id").limit(n)


def breakdown(rows: DataFrame, label: Column) -> DataFrame:
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def json_series(rows: DataFrame, at: str, value: str) -> DataFrame:
    """One JSON array of (at, value) objects, in order of at."""
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(at, value)))).alias("series"))


def arm(key: Column, holdout: float) -> Column:
    """holdout or treatment, by the first 32 bits of the key's SHA-256."""
    share = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(share < holdout, "holdout").otherwise("treatment")


def input_bucket(tokens: Column) -> Column:
    out = F.lit("xl")
    for top, name in reversed(INPUT_BUCKETS):
        out = F.when(tokens < top, name).otherwise(out)
    return out


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"))


def estimate_vs_holdout(rows: DataFrame, stratum: str, arm_: str, value: str) -> DataFrame:
    """Savings of the treated against the held out of their stratum, with a 95 % interval."""
    m = moments(rows, [stratum, arm_], value)
    t, h = (m.where(F.col(arm_) == name).select(F.col(stratum), *[F.col(c).alias(f"{c}_{name[0]}") for c in ("n", "mean", "var")]) for name in ("treatment", "holdout"))
    both = t.join(h, stratum)
    saved = F.sum(F.col("n_t") * (F.col("mean_h") - F.col("mean_t")))
    var = F.sum(F.col("n_t") * F.col("var_t") + F.col("n_t") * F.col("n_t") * F.col("var_h") / F.col("n_h"))
    got = both.agg(saved.alias("saved"), F.sqrt(var).alias("se"), F.sum("n_t").alias("n"))
    return got.select(F.round("saved", 3).alias("saved"), F.round(F.col("saved") - Z * F.col("se"), 3).alias("low"), F.round(F.col("saved") + Z * F.col("se"), 3).alias("high"), F.col("n").cast("long").alias("n"))


def baseline_lookup(keys: DataFrame, strata: DataFrame, whole: str, prefix: str) -> DataFrame:
    """Baseline mean of a key's stratum; of all strata with its prefix where it has none; of everything else."""
    by_prefix = strata.groupBy(prefix).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("prefix_mean"))
    overall = strata.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).first()[0]
    out = keys.join(strata.select(whole, "mean"), whole, "left").join(by_prefix, prefix, "left")
    level = F.when(F.col("mean").isNotNull(), "stratum").when(F.col("prefix_mean").isNotNull(), "prefix").otherwise("global")
    return out.select(whole, level.alias("level"), F.round(F.coalesce("mean", "prefix_mean", F.lit(overall)), 4).alias("baseline"))


def estimate_vs_baseline(observed: DataFrame, baseline: DataFrame, stratum: str) -> DataFrame:
    both = observed.select(stratum, *[F.col(c).alias(f"{c}_o") for c in ("n", "mean", "var")]).join(baseline.select(stratum, *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "var")]), stratum)
    got = both.agg(F.sum(F.col("n_o") * (F.col("mean_b") - F.col("mean_o"))).alias("saved"), F.sqrt(F.sum(F.col("n_o") * F.col("var_o") + F.col("n_o") * F.col("n_o") * F.col("var_b") / F.col("n_b"))).alias("se"))
    return got.select(F.round("saved", 3).alias("saved"), F.round(F.col("saved") - Z * F.col("se"), 3).alias("low"), F.round(F.col("saved") + Z * F.col("se"), 3).alias("high"))


def cost(requests_: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model's tokens by a price table (model, price: of a million), the fallback price where it has none."""
    price = F.coalesce("price", F.lit(FALLBACK_PRICE))
    out = requests_.groupBy("model").agg(F.sum("after").alias("tokens")).join(prices, "model", "left")
    return out.select("model", "tokens", F.round(F.col("tokens") * price / 1_000_000, 6).alias("cost"))


def budget(requests_: DataFrame, by: str, days: int, allowed: float) -> DataFrame:
    """Spend of the days up to and with each request's day, and whether it is over what is allowed."""
    daily = requests_.groupBy(by, F.to_date("ts").alias("day")).agg(F.sum("after").alias("tokens"))
    w = Window.partitionBy(by).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-(days - 1), 0)
    return daily.select(by, "day", F.sum("tokens").over(w).cast("long").alias("spent"), (F.sum("tokens").over(w) > allowed).alias("over"))


def hit_rate(input_: Column, read: Column, created: Column) -> Column:
    """Share of a prompt that the cache gave; null without a prompt."""
    return F.try_divide(read.cast("double"), (input_ + read + created).cast("double"))


def ratio_histogram(requests_: DataFrame, bins: int = 10) -> DataFrame:
    ratio = F.col("after") / F.col("before")
    return requests_.where("before > 0").groupBy("model", F.least(F.floor(ratio * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("after") >= F.col("before")).cast("int")).cast("long").alias("rejected"))


def performance(requests_: DataFrame, by: str) -> DataFrame:
    saved = (F.col("before") - F.col("after")).cast("double")
    return requests_.groupBy(by).agg(F.count("*").alias("n"), F.round(F.percentile(saved, 0.5), 4).alias("p50"), F.round(F.percentile(saved, 0.95), 4).alias("p95"), F.max(saved).alias("top"))


def window_tokens(requests_: DataFrame, start: str, end: str, weights: dict[str, float]) -> DataFrame:
    """Weighted tokens of requests in [start, end) by model; a model without a weight counts once."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in p]), F.col("model")), F.lit(1.0))
    held = requests_.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
    return held.groupBy("model").agg(F.round(F.sum(F.col("after") * weight), 2).alias("weighted"), F.count("*").alias("n"))


_STRATA = "(select *, concat(mode, '|', model) as stratum, case when cast(('0x' || substr(sha256(cast(id as varchar)), 1, 8)) as bigint) / 4294967295.0 < 0.2 then 'holdout' else 'treatment' end as arm from " + REQUESTS + ")"


def _armed(s, d) -> DataFrame:
    r = requests(s, d)
    return r.withColumn("stratum", F.concat_ws("|", "mode", "model")).withColumn("arm", arm(F.col("id").cast("string"), 0.2))


def _split(s, d):
    r = requests(s, d).withColumn("stratum", F.concat_ws("|", "mode", "model"))
    return moments(r.where("id % 2 = 0"), ["stratum"], "after"), moments(r.where("id % 2 = 1"), ["stratum"], "after")


QUERIES = {
    "request_query": (lambda s, d: query(requests(s, d), model="A", mode="F").select("id", "before", "after"), f"select id, before, after from {REQUESTS} where model = 'A' and mode = 'F'"),
    "request_page": (lambda s, d: query(requests(s, d), mode="O", limit=50, offset=25).select("id", "ts"), f"select id, ts from {REQUESTS} where mode = 'O' order by ts desc, id desc limit 50 offset 25"),
    "request_upsert_latest": (lambda s, d: latest(requests(s, d).select("client", "ts", "id", "after"), "client", "ts"), f"select client, ts, id, after from {REQUESTS} qualify row_number() over (partition by client order by ts desc, id desc, after desc) = 1"),
    "request_summary": (lambda s, d: summary(requests(s, d)), f"select count(*) as n_requests, cast(sum(before) as bigint) as tokens_before, cast(sum(after) as bigint) as tokens_after, cast(sum(before - after) as bigint) as tokens_saved, round(avg(before - after), 4) as mean_saved, cast(count(*) filter (mode = 'F') as bigint) as n_audit, count(distinct model) as n_models from {REQUESTS}"),
    "savings_windows": (lambda s, d: savings_windows(requests(s, d), "1998-06-15 12:00:00"), f"select model, cast(sum(before - after) as bigint) as lifetime, cast(coalesce(sum(before - after) filter (date_trunc('day', ts) = timestamp '1998-06-15'), 0) as bigint) as today, cast(coalesce(sum(before - after) filter (ts > timestamp '1998-06-08 12:00:00'), 0) as bigint) as week, cast(grouping(model) as integer) as is_total from {REQUESTS} where ts <= timestamp '1998-06-15 12:00:00' and ts > timestamp '1998-06-15 12:00:00' - interval 365 days group by grouping sets ((model), ())"),
    **{f"counter_rollup_{b}": ((lambda s, d, b=b: rollup(counters(s, d), "user_id", ("ts", "event_id"), "counter", b)), f"select cast(date_trunc('{b}', ts) as timestamp) as bucket, cast(sum(delta) as bigint) as delta, count(*) as n from (select ts, greatest(counter - coalesce(lag(counter) over (partition by user_id order by ts, event_id), 0), 0) as delta from {COUNTERS}) group by 1") for b in ("hour", "day", "week", "month")},
    **{f"dashboard_{g}": ((lambda s, d, g=g: dashboard(counters(s, d), g)), f"select period, cast(sum(top) as bigint) as total, count(distinct user_id) as instances from (select cast(date_trunc('{g}', ts) as timestamp) as period, user_id, max(counter) as top from {COUNTERS} group by 1, 2) group by 1") for g in ("day", "hour")},
    "dashboard_top20": (lambda s, d: top_instances(counters(s, d)), f"select user_id, max(counter) as top, count(*) as beacons from {COUNTERS} group by 1 order by 2 desc, 1 limit 20"),
    "dashboard_breakdown": (lambda s, d: breakdown(table(s, d, "customer"), F.split_part(F.col("c_name"), F.lit("#"), F.lit(1))), "select split_part(c_name, '#', 1) as label, count(*) as n from customer group by 1 order by 2 desc, 1"),
    "dashboard_series": (lambda s, d: json_series(table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), "day", "n"), "select '[' || string_agg('{\"day\":\"' || day || '\",\"n\":' || n || '}', ',' order by day) || ']' as series from (select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1)"),
    "ab_arms": (lambda s, d: _armed(s, d).groupBy("arm").agg(F.count("*").alias("n")), f"select arm, count(*) as n from {_STRATA} group by 1"),
    "ab_savings_ci": (lambda s, d: estimate_vs_holdout(_armed(s, d), "stratum", "arm", "after"), f"with m as (select stratum, arm, count(*) as n, avg(after) as mean, coalesce(var_samp(after), 0) as var from {_STRATA} group by 1, 2), g as (select sum(t.n * (h.mean - t.mean)) as saved, sqrt(sum(t.n * t.var + t.n * t.n * h.var / h.n)) as se, sum(t.n) as n from m t join m h using (stratum) where t.arm = 'treatment' and h.arm = 'holdout') select round(saved, 3) as saved, round(saved - 1.96 * se, 3) as low, round(saved + 1.96 * se, 3) as high, cast(n as bigint) as n from g"),
    "baseline_savings_ci": (lambda s, d: estimate_vs_baseline(*_split(s, d), "stratum"), f"with r as (select *, concat(mode, '|', model) as stratum from {REQUESTS}), m as (select stratum, id % 2 as odd, count(*) as n, avg(after) as mean, coalesce(var_samp(after), 0) as var from r group by 1, 2), g as (select sum(o.n * (b.mean - o.mean)) as saved, sqrt(sum(o.n * o.var + o.n * o.n * b.var / b.n)) as se from m o join m b using (stratum) where o.odd = 0 and b.odd = 1) select round(saved, 3) as saved, round(saved - 1.96 * se, 3) as low, round(saved + 1.96 * se, 3) as high from g"),
    "baseline_backoff": (lambda s, d: baseline_lookup(requests(s, d).select(F.concat_ws("|", "mode", "model").alias("stratum"), F.col("mode").alias("prefix")).distinct(), moments(requests(s, d).where("model <> 'N'").withColumn("stratum", F.concat_ws("|", "mode", "model")).withColumn("prefix", F.col("mode")), ["stratum", "prefix"], "after"), "stratum", "prefix"),
        f"with r as (select *, concat(mode, '|', model) as stratum from {REQUESTS}), b as (select stratum, mode as prefix, count(*) as n, avg(after) as mean from r where model <> 'N' group by 1, 2), p as (select prefix, sum(n * mean) / sum(n) as pm from b group by 1), k as (select distinct stratum, mode as prefix from r) select k.stratum, case when mean is not null then 'stratum' when pm is not null then 'prefix' else 'global' end as level, round(coalesce(mean, pm, (select sum(n * mean) / sum(n) from b)), 4) as baseline from k left join b using (stratum) left join p on k.prefix = p.prefix"),
    "stratum_buckets": (lambda s, d: requests(s, d).groupBy("mode", input_bucket(F.col("before")).alias("bucket")).agg(F.count("*").alias("n")), f"select mode, case when before < 2000 then 'xs' when before < 8000 then 's' when before < 32000 then 'm' when before < 128000 then 'l' else 'xl' end as bucket, count(*) as n from {REQUESTS} group by 1, 2"),
    "cost_by_model": (lambda s, d: cost(requests(s, d), s.createDataFrame([("A", 5.0), ("N", 1.5)], "model string, price double")), f"select model, cast(tokens as bigint) as tokens, round(tokens * case model when 'A' then 5.0 when 'N' then 1.5 else 3.0 end / 1000000, 6) as cost from (select model, sum(after) as tokens from {REQUESTS} group by 1)"),
    "budget_window": (lambda s, d: budget(requests(s, d), "model", 7, 2_000_000), f"select model, day, cast(sum(tokens) over w as bigint) as spent, sum(tokens) over w > 2000000 as over from (select model, cast(ts as date) as day, sum(after) as tokens from {REQUESTS} group by 1, 2) window w as (partition by model order by day range between interval 6 days preceding and current row)"),
    "cache_hit_rate": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("i"), F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).alias("r"), F.sum(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("c")).select("user_id", F.round(hit_rate(F.col("i"), F.col("r"), F.col("c")), 6).alias("rate")), "select user_id, round(r / nullif(i + r + c, 0), 6) as rate from (select user_id, count(*) filter (event_type = 'view') as i, count(*) filter (event_type = 'click') as r, count(*) filter (event_type = 'signup') as c from events group by 1)"),
    "ratio_histogram": (lambda s, d: ratio_histogram(requests(s, d)), f"select model, cast(least(floor(after / before * 10), 9) as integer) as bin, count(*) as n, cast(count(*) filter (after >= before) as bigint) as rejected from {REQUESTS} where before > 0 group by 1, 2"),
    "performance_by_mode": (lambda s, d: performance(requests(s, d), "mode"), f"select mode, count(*) as n, round(quantile_cont(cast(before - after as double), 0.5), 4) as p50, round(quantile_cont(cast(before - after as double), 0.95), 4) as p95, max(cast(before - after as double)) as top from {REQUESTS} group by 1"),
    "window_tokens": (lambda s, d: window_tokens(requests(s, d), "1995-01-01", "1996-01-01", {"A": 5.0, "R": 0.5}), f"select model, round(sum(after * cast(case model when 'A' then 5.0 when 'R' then 0.5 else 1.0 end as double)), 2) as weighted, count(*) as n from {REQUESTS} where ts >= timestamp '1995-01-01' and ts < timestamp '1996-01-01' group by 1"),
    "savings_cube": (lambda s, d: requests(s, d).cube("model", "mode").agg(F.sum(F.col("before") - F.col("after")).alias("saved"), F.count("*").alias("n")), f"select model, mode, cast(sum(before - after) as bigint) as saved, count(*) as n from {REQUESTS} group by cube (model, mode)"),
    "savings_rollup_regions": (lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).rollup("c_mktsegment", "o_orderpriority").agg(F.sum(F.floor("l_quantity")).cast("long").alias("quantity"), F.count("*").alias("n")), "select c_mktsegment, o_orderpriority, cast(sum(floor(l_quantity)) as bigint) as quantity, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by rollup (c_mktsegment, o_orderpriority)"),
    "metric_counts": (lambda s, d: requests(s, d).groupBy("model", "mode").agg(F.count("*").alias("n"), F.sum("before").alias("before"), F.sum("after").alias("after")), f"select model, mode, count(*) as n, cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after from {REQUESTS} group by 1, 2"),
    "distinct_instances": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users")), "select event_type, count(distinct user_id) as users from events group by 1"),
}
