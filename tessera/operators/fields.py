"""Statistics of fields over groups of items, and what they say: kinds of fields, patterns, whether a group may be reduced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.detect import is_error_item
from tessera.functions.text import UUID, entropy
from tessera.sources.tables import table

# Fixed thresholds.
MIN_ITEMS, SIGMA = 5, 2.0
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}|$)"


def information(items: DataFrame, group: str, key: str, item: str) -> DataFrame:
    """(group, key, score): how much each of a group's JSON objects tells, 0 to 1: 0.4 rarity + 0.3 length + 0.3 structure.

    Rarity is the mean of 1 - frequency over an object's values, length its text's place between the group's shortest
    and longest, structure half the share of the group's rare fields (below 20 %) that it has and half the share of the
    common ones (80 %) that it lacks. One object alone gets 0.5 of each; an empty one, null or no object, 0, and only
    objects count in a group. (group, key) names an item. Counts are aggregated before they are joined to the cells.
    """
    i = items.select(group, key, F.from_json(item, "map<string,string>").alias("_m"), F.length(item).alias("_l"), F.to_json(F.struct(F.col(group).alias("g"))).alias("_g"))
    valid = i.where("_m is not null")
    cells = valid.select("_g", group, key, F.explode("_m").alias("_f", "_v")).withColumn("_v", F.coalesce("_v", F.lit("null")))
    n = valid.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    values = cells.groupBy("_g", "_f", "_v").agg(F.count("*").alias("_c"))
    fields = values.groupBy("_g", "_f").agg(F.sum("_c").alias("_fc")).join(n.select("_g", "_n"), "_g")
    fields = fields.select("_g", "_f", "_n", (F.col("_fc") < F.col("_n") * 0.2).cast("int").alias("_rare"), (F.col("_fc") >= F.col("_n") * 0.8).cast("int").alias("_common"))
    of_group = n.join(fields.groupBy("_g").agg(F.sum("_rare").alias("_rares"), F.sum("_common").alias("_commons")), "_g", "left")
    told = cells.join(values.join(fields, ["_g", "_f"]), ["_g", "_f", "_v"])
    own = told.groupBy("_g", key).agg(F.avg(1 - F.col("_c") / F.col("_n")).alias("_u"), F.sum("_rare").alias("_has"), F.sum("_common").alias("_got"))
    whole = i.join(of_group, "_g", "left").join(own.withColumnsRenamed({"_g": "_h", key: "_k"}), (F.col("_g") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    half = lambda part, of: F.coalesce(0.5 * F.try_divide(part, of), F.lit(0.0))
    length = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise(F.try_divide(F.col("_l") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    structure = half(F.col("_has"), F.col("_rares")) + half(F.col("_commons") - F.col("_got"), F.col("_commons"))
    score = F.when(F.col("_u").isNull(), 0.0).when(F.col("_n") < 2, 0.5).otherwise(0.4 * F.col("_u") + 0.3 * length + 0.3 * structure)
    return whole.select(group, key, score.alias("score"))


def long_form(rows: DataFrame, group: str, idx: str, fields: dict[str, str]) -> DataFrame:
    """One row for each item and field: (group, idx, field, kind, s, x). fields: name -> 'number' or 'string'."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("kind"), F.col(n).cast("string").alias("s"), (F.col(n).cast("double") if k == "number" else F.lit(None).cast("double")).alias("x")) for n, k in fields.items()])
    return rows.select(group, idx, F.explode(cells).alias("c")).select(group, idx, "c.*")


def field_stats(cells: DataFrame, group: str) -> DataFrame:
    """For each group and field: items, distinct values (null is one), their share, bounds, mean, sample variance and mean length.

    Numbers that aren't finite are left out; the variance of one number is 0.
    """
    x = F.when(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x"))
    got = cells.groupBy(group, "field", "kind").agg(
        F.count("*").alias("n"), F.count_distinct(F.coalesce("s", F.lit("None"))).alias("kinds"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
        F.count(x).alias("n_numbers"), F.avg(F.length("s")).alias("mean_length"))
    return got.withColumn("unique_ratio", F.col("kinds") / F.col("n")).withColumn("var", F.when(F.col("n_numbers") > 0, F.coalesce("var", F.lit(0.0)))).withColumn("constant", F.col("kinds") == 1)


def top_values(cells: DataFrame, group: str, n: int = 5) -> DataFrame:
    """The n most frequent values of each field, ties by value."""
    counts = cells.groupBy(group, "field", "s").agg(F.count("*").alias("times"))
    w = Window.partitionBy(group, "field").orderBy(F.desc("times"), F.col("s").asc_nulls_last())
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def id_confidence(kind: Column, unique_ratio: Column, uuid_share: Column, mean_entropy: Column, sequential: Column, spread: Column) -> Column:
    """How sure it is that a field identifies its item; 0 if not."""
    text, number = kind == "string", kind == "number"
    return F.when(unique_ratio < 0.9, 0.0).when(text & (uuid_share > 0.8), 0.95).when(text & (mean_entropy > 0.7) & (unique_ratio > 0.95), 0.8).when(number & sequential & (unique_ratio > 0.95), 0.9).when(
        number & (spread > 0) & (unique_ratio > 0.95), 0.85).when(unique_ratio > 0.98, 0.7).otherwise(0.0)


def score_confidence(low: Column, high: Column, sequential: Column, falling: Column, fractional: Column) -> Column:
    """How sure it is that a numeric field is a score; below 0.4 it isn't."""
    base = F.when((low >= 0) & (high <= 1), 0.4).when((low >= -1) & (high <= 1), 0.35).when((low >= 0) & (high <= 10), 0.3).when((low >= 0) & (high <= 100), 0.25).otherwise(0.0)
    total = base + F.when(falling > 0.7, 0.3).otherwise(0.0) + F.when(fractional > 0.3, 0.1).otherwise(0.0)
    return F.when((base == 0) | F.coalesce(sequential, F.lit(False)), 0.0).otherwise(F.least(F.lit(0.95), total))


def series_shape(cells: DataFrame, group: str, idx: str) -> DataFrame:
    """For each numeric field in item order: whether it counts up by one, the share of falling pairs, of fractions among the first 20."""
    w = Window.partitionBy(group, "field").orderBy(idx)
    s = cells.where("kind = 'number' and x is not null").withColumn("d", F.col("x") - F.lag("x").over(w)).withColumn("k", F.row_number().over(w))
    got = s.groupBy(group, "field").agg(
        F.count("*").alias("_n"), F.avg((F.col("d") == 1).cast("double")).alias("ones"), F.avg((F.col("d") < 0).cast("double")).alias("falling"),
        F.avg(F.when(F.col("k") <= 20, (F.col("x") != F.floor("x")).cast("double"))).alias("fractional"))
    return got.select(group, "field", ((F.col("_n") >= 5) & (F.col("ones") > 0.8)).alias("sequential"), "falling", "fractional")


def field_kinds(cells: DataFrame, group: str, idx: str) -> DataFrame:
    """field_stats with id_confidence and score_confidence."""
    first = cells.withColumn("k", F.row_number().over(Window.partitionBy(group, "field").orderBy(idx))).where("k <= 20 and kind = 'string'")
    text = first.groupBy(group, "field").agg(F.avg(F.col("s").rlike("^" + UUID + "$").cast("double")).alias("uuid_share"), F.avg(entropy("s")).alias("mean_entropy"))
    out = field_stats(cells, group).join(series_shape(cells, group, idx), [group, "field"], "left").join(text, [group, "field"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ident = id_confidence(F.col("kind"), F.col("unique_ratio"), zero("uuid_share"), zero("mean_entropy"), F.coalesce("sequential", F.lit(False)), F.coalesce(F.col("high") - F.col("low"), F.lit(0.0)))
    score = F.when(F.col("kind") == "number", score_confidence(F.col("low"), F.col("high"), F.col("sequential"), zero("falling"), zero("fractional"))).otherwise(0.0)
    return out.withColumn("id_confidence", ident).withColumn("score_confidence", score)


def is_temporal(cells: DataFrame, group: str, idx: str) -> DataFrame:
    """Whether over half of a field's first 10 values are ISO times, or lie in the range of epochs."""
    w = Window.partitionBy(group, "field").orderBy(idx)
    first = cells.withColumn("k", F.row_number().over(w)).where("k <= 10")
    hit = F.col("s").rlike(ISO) | F.col("x").between(1_000_000_000, 2_000_000_000) | F.col("x").between(1_000_000_000_000, 2_000_000_000_000)
    return first.groupBy(group, "field").agg((F.avg(F.coalesce(hit, F.lit(False)).cast("double")) > 0.5).alias("temporal"))


def pattern(fields: DataFrame, temporal: DataFrame, group: str) -> DataFrame:
    """time_series, logs, search_results or generic for each group."""
    f = fields.join(temporal, [group, "field"], "left")
    got = f.groupBy(group).agg(
        F.max(F.coalesce("temporal", F.lit(False))).alias("temporal"), F.max((F.col("kind") == "number") & (F.coalesce("var", F.lit(0.0)) > 0) & ~F.coalesce("temporal", F.lit(False))).alias("varies"),
        F.max((F.col("kind") == "string") & (F.col("unique_ratio") > 0.5) & (F.col("mean_length") > 20)).alias("message"), F.max((F.col("kind") == "string") & (F.col("unique_ratio") < 0.1) & F.col("kinds").between(2, 10)).alias("level"),
        F.max("score_confidence").alias("score"))
    return got.select(group, F.when(F.col("temporal") & F.col("varies"), "time_series").when(F.col("message") & F.col("level"), "logs").when(F.col("score") >= 0.5, "search_results").otherwise("generic").alias("pattern"))


def crushability(has_id: Column, max_unique: Column, non_id_unique: Column, signal: Column) -> Column:
    """Struct (crush, confidence, reason): whether a group's items may be sampled without losing what tells them apart."""
    case = lambda yes, sure, why: F.struct(F.lit(yes).alias("crush"), F.lit(sure).alias("confidence"), F.lit(why).alias("reason"))
    return F.when((non_id_unique < 0.1) & has_id, case(True, 0.85, "repetitive besides ids")).when(max_unique < 0.3, case(True, 0.9, "few different values")).when(has_id & (max_unique > 0.8) & ~signal, case(False, 0.85, "all items differ")).when(
        (max_unique > 0.8) & signal, case(True, 0.7, "items differ, with a signal")).when(~signal, case(False, 0.6, "no signal")).otherwise(case(True, 0.5, "medium"))


def strategy(n: Column, crush: Column, pattern_: Column, changes: Column, message_repeats: Column) -> Column:
    return F.when(n < MIN_ITEMS, "none").when(~crush, "skip").when((pattern_ == "time_series") & changes, "time_series").when((pattern_ == "logs") & message_repeats, "cluster").when(pattern_ == "search_results", "top_n").otherwise("smart_sample")


def reduction(strategy_: Column, constant_share: Column) -> Column:
    base = F.when(strategy_ == "time_series", 0.7).when(strategy_ == "cluster", 0.8).when(strategy_ == "top_n", 0.6).when(strategy_ == "smart_sample", 0.5).otherwise(0.0)
    return F.least(F.lit(0.95), base + 0.2 * constant_share)


def analyse(cells: DataFrame, group: str, idx: str) -> DataFrame:
    """pattern, crushability and strategy of each group of items."""
    kinds = field_kinds(cells, group, idx)
    stats = kinds.groupBy(group).agg(
        F.max("n").alias("n"), F.max(F.col("id_confidence") > 0).alias("has_id"), F.max("unique_ratio").alias("max_unique"), F.max(F.when(F.col("id_confidence") == 0, F.col("unique_ratio")).otherwise(0.0)).alias("non_id_unique"),
        F.max(F.col("score_confidence") >= 0.4).alias("score"), F.avg(F.col("constant").cast("double")).alias("constant_share"))
    odd = cells.join(kinds.where("kind = 'number'").select(group, "field", "mean", "var"), [group, "field"]).groupBy(group).agg(F.max(F.abs(F.col("x") - F.col("mean")) > SIGMA * F.sqrt("var")).alias("anomaly"))
    bad = cells.groupBy(group).agg(F.max(F.coalesce(is_error_item("s"), F.lit(False))).alias("error"))
    out = stats.join(pattern(kinds, is_temporal(cells, group, idx), group), group).join(odd, group, "left").join(bad, group, "left")
    signal = F.col("score") | F.coalesce("anomaly", F.lit(False)) | F.coalesce("error", F.lit(False))
    out = out.withColumn("c", crushability(F.col("has_id"), F.col("max_unique"), F.col("non_id_unique"), signal))
    s = strategy(F.col("n"), F.col("c.crush"), F.col("pattern"), F.coalesce("anomaly", F.lit(False)), F.lit(False))
    return out.select(group, "n", "pattern", F.col("c.crush").alias("crush"), F.col("c.confidence").alias("confidence"), s.alias("strategy"), F.round(reduction(s, F.col("constant_share")), 6).alias("reduction"))


def outliers(cells: DataFrame, group: str, idx: str) -> DataFrame:
    """Numbers more than two sample deviations from their field's mean."""
    w = Window.partitionBy(group, "field")
    return cells.where("x is not null").withColumn("_m", F.avg("x").over(w)).withColumn("_d", F.stddev_samp("x").over(w)).where(F.abs(F.col("x") - F.col("_m")) > SIGMA * F.col("_d")).select(group, idx, "field", "x")


def rare_fields(cells: DataFrame, group: str, idx: str, share: float = 0.2) -> DataFrame:
    """Items that hold a field which fewer than `share` of their group's items hold."""
    held = cells.where("s is not null")
    n = cells.groupBy(group).agg(F.count_distinct(idx).alias("n")).where(F.col("n") >= MIN_ITEMS)
    rare = held.groupBy(group, "field").agg(F.count("*").alias("k")).join(n, group).where(F.col("k") < share * F.col("n")).select(group, "field")
    return held.join(rare, [group, "field"]).select(group, idx).distinct()


def rare_values(counts: DataFrame, group: str, value: str, n: str, share: float = 0.8, most: int = 5) -> DataFrame:
    """Of 2 to 50 values, those beyond the fewest that cover `share` of the items, if these are `most` at most."""
    w = Window.partitionBy(group).orderBy(F.desc(n), value)
    every = Window.partitionBy(group)
    c = counts.withColumn("_before", F.sum(n).over(w) - F.col(n)).withColumn("_total", F.sum(n).over(every)).withColumn("_kinds", F.count("*").over(every)).withColumn("_core", F.col("_before") < share * F.col("_total"))
    c = c.withColumn("_k", F.sum(F.col("_core").cast("int")).over(every))
    return c.where(F.col("_kinds").between(2, 50) & (F.col("_k") <= most) & ~F.col("_core")).select(group, value, n)


def type_tag(json_type: Column) -> Column:
    """int, float, string, bool or json for the type of a JSON value."""
    return F.when(json_type.isin("BIGINT", "INT"), "int").when(json_type.startswith("DECIMAL") | json_type.isin("DOUBLE", "FLOAT"), "float").when(json_type == "STRING", "string").when(json_type == "BOOLEAN", "bool").otherwise("json")


def key_types(rows: DataFrame, text: str) -> DataFrame:
    """Keys of JSON objects with how many rows hold them and their tag, json where they conflict; by frequency, then name."""
    v = rows.select(F.try_parse_json(text).alias("v")).where("v is not null")
    m = v.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "value"))
    got = m.groupBy("key").agg(F.count("*").alias("n"), F.collect_set(type_tag(F.schema_of_variant("value"))).alias("tags"))
    return got.select("key", "n", F.when(F.size("tags") == 1, F.get("tags", F.lit(0))).otherwise("json").alias("tag"))


def linear_percentiles(rows: DataFrame, group: str, value: str, at=(0.25, 0.5, 0.75)) -> DataFrame:
    return rows.groupBy(group).agg(*[F.round(F.percentile(value, q), 6).alias(f"p{int(q * 100)}") for q in at])


def basic_stats(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.var_samp(value), F.lit(0.0)), 4).alias("var"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.round(F.median(value), 6).alias("median"))


FIELDS = {"event_id": "number", "value": "number", "event_type": "string"}
_CELLS = "(select user_id, event_id as idx, field, kind, s, x from (select user_id, event_id, unnest([{'field': 'event_id', 'kind': 'number', 's': cast(event_id as varchar), 'x': cast(event_id as double)}, {'field': 'value', 'kind': 'number', 's': cast(value as varchar), 'x': value}, {'field': 'event_type', 'kind': 'string', 's': event_type, 'x': null}], recursive := true) from events))"


def cells(s, d) -> DataFrame:
    return long_form(table(s, d, "events").withColumn("idx", F.col("event_id")), "user_id", "idx", FIELDS)


_STATS = f"(select user_id, field, kind, count(*) as n, count(distinct case when field = 'value' then cast(x as varchar) else coalesce(s, 'None') end) as kinds, min(x) as low, max(x) as high, avg(x) as mean, case when count(x) > 0 then coalesce(var_samp(x), 0) end as var from {_CELLS} group by 1, 2, 3)"
_SHAPE = f"(select user_id, field, count(*) >= 5 and avg(case when d = 1 then 1.0 when d is not null then 0.0 end) > 0.8 as sequential, avg(case when d < 0 then 1.0 when d is not null then 0.0 end) as falling, avg(case when k <= 20 then case when x <> floor(x) then 1.0 else 0.0 end end) as fractional from (select *, x - lag(x) over w as d, row_number() over w as k from {_CELLS} where kind = 'number' and x is not null window w as (partition by user_id, field order by idx)) group by 1, 2)"
_SCORE = "case when base = 0 or coalesce(sequential, false) then 0.0 else least(0.95, base + case when coalesce(falling, 0) > 0.7 then 0.3 else 0 end + case when coalesce(fractional, 0) > 0.3 then 0.1 else 0 end) end"
_BASE = "case when kind <> 'number' then 0.0 when low >= 0 and high <= 1 then 0.4 when low >= -1 and high <= 1 then 0.35 when low >= 0 and high <= 10 then 0.3 when low >= 0 and high <= 100 then 0.25 else 0.0 end"

QUERIES = {
    "information_score": (
        lambda s, d: information(table(s, d, "events").select("user_id", "event_id", F.concat(
            F.lit('{"t":"'), "event_type", F.when(F.col("event_id") % 7 != 0, F.concat(F.lit('","v":"'), F.floor(F.col("value") / 10).cast("string"))).otherwise(""),
            F.when(F.col("event_id") % 11 == 0, '","e":"yes').otherwise(""), F.lit('"}')).alias("item")), "user_id", "event_id", "item").withColumn("score", F.round("score", 6)),
        """
        with i as (
            select user_id, event_id, event_type as t, case when event_id % 7 <> 0 then cast(cast(floor(value / 10) as bigint) as varchar) end as v, case when event_id % 11 = 0 then 'yes' end as e from events
        ), l as (select *, 8 + length(t) + coalesce(7 + length(v), 0) + coalesce(7 + length(e), 0) as l from i),
        n as (select user_id, count(*) as n, min(l) as lo, max(l) as hi from l group by 1),
        c as (select user_id, event_id, 't' as f, t as v from i union all select user_id, event_id, 'v', v from i where v is not null union all select user_id, event_id, 'e', e from i where e is not null),
        x as (select *, count(*) over (partition by user_id, f, v) as c, count(*) over (partition by user_id, f) as fc from c),
        f as (select user_id, count(distinct f) filter (fc < n * 0.2) as rares, count(distinct f) filter (fc >= n * 0.8) as commons from x join n using (user_id) group by 1),
        o as (select user_id, event_id, avg(1 - c / n) as u, count(*) filter (fc < n * 0.2) as has, count(*) filter (fc >= n * 0.8) as got from x join n using (user_id) group by 1, 2)
        select user_id, event_id, round(case when n < 2 then 0.5 else 0.4::double * u + 0.3::double * case when hi = lo then 0.5 else (l - lo) / (hi - lo) end
            + 0.3::double * (coalesce(0.5::double * has / nullif(rares, 0), 0) + coalesce(0.5::double * (commons - got) / nullif(commons, 0), 0)) end, 6) as score
        from l join n using (user_id) join f using (user_id) join o using (user_id, event_id)
        """,
    ),
    "field_stats": (lambda s, d: field_stats(cells(s, d), "user_id").select("user_id", "field", "n", "kinds", F.round("unique_ratio", 6).alias("unique_ratio"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("mean", 8).alias("mean"), "constant"),
        f"select user_id, field, n, kinds, round(kinds / n, 6) as unique_ratio, round(low, 6) as low, round(high, 6) as high, round(mean, 8) as mean, kinds = 1 as constant from {_STATS}"),
    "basic_stats": (lambda s, d: basic_stats(table(s, d, "events"), "event_type", "value"), "select event_type, count(value) as n, round(avg(value), 6) as mean, round(coalesce(var_samp(value), 0), 4) as var, round(coalesce(stddev_samp(value), 0), 6) as sd, round(median(value), 6) as median from events group by 1"),
    "linear_percentiles": (lambda s, d: linear_percentiles(table(s, d, "events"), "user_id", "value"), "select user_id, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75 from events group by 1"),
    "top_values": (lambda s, d: top_values(cells(s, d).where("field = 'event_type'"), "user_id", 3).select("user_id", "s", "times", "place"), "select user_id, event_type as s, times, cast(place as integer) as place from (select *, row_number() over (partition by user_id order by times desc, event_type) as place from (select user_id, event_type, count(*) as times from events group by 1, 2)) where place <= 3"),
    "score_fields": (lambda s, d: field_kinds(cells(s, d), "user_id", "idx").select("user_id", "field", F.round("score_confidence", 6).alias("score_confidence")), f"select user_id, field, round(cast({_SCORE} as double), 6) as score_confidence from (select t.*, {_BASE} as base, sequential, falling, fractional from {_STATS} t left join {_SHAPE} s using (user_id, field))"),
    "id_fields": (lambda s, d: field_kinds(cells(s, d).where("kind = 'number'"), "user_id", "idx").select("user_id", "field", "id_confidence"), f"select user_id, field, cast(case when kinds / n < 0.9 then 0 when sequential and kinds / n > 0.95 then 0.9 when high - low > 0 and kinds / n > 0.95 then 0.85 when kinds / n > 0.98 then 0.7 else 0 end as double) as id_confidence from {_STATS} t left join {_SHAPE} s using (user_id, field) where kind = 'number'"),
    "temporal_fields": (lambda s, d: is_temporal(long_form(table(s, d, "events").withColumn("idx", F.col("event_id")).withColumn("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "user_id", "idx", {"at": "string", "value": "number"}), "user_id", "idx"), "select user_id, 'at' as field, true as temporal from events group by 1 union all select user_id, 'value', avg(case when value between 1000000000 and 2000000000 then 1.0 else 0.0 end) > 0.5 from events group by 1"),
    "array_analysis": (lambda s, d: analyse(cells(s, d), "user_id", "idx"), None),
    "zscore_outliers": (lambda s, d: outliers(cells(s, d).where("field = 'value'"), "user_id", "idx"), "select user_id, event_id as idx, 'value' as field, value as x from (select *, avg(value) over w as m, stddev_samp(value) over w as sd from events window w as (partition by user_id)) where abs(value - m) > 2 * sd"),
    "structural_outliers": (lambda s, d: rare_fields(long_form(table(s, d, "events").withColumn("idx", F.col("event_id")).withColumn("failure", F.when(F.col("event_type") == "error", F.col("props"))), "user_id", "idx", {"value": "number", "failure": "string"}), "user_id", "idx"), "select user_id, event_id as idx from (select *, count(*) over w as n, count(*) filter (event_type = 'error') over w as k from events window w as (partition by user_id)) where n >= 5 and event_type = 'error' and k < 0.2 * n"),
    "rare_status": (
        lambda s, d: rare_values(
            table(s, d, "lineitem").select("l_returnflag", F.expr("case when l_orderkey % 20 < 17 then 'ok' when l_orderkey % 20 < 19 then 'warn' else concat('e', cast(l_orderkey % 3 as string)) end").alias("status"))
            .groupBy("l_returnflag", "status").agg(F.count("*").alias("n")), "l_returnflag", "status", "n"),
        """
        with c as (
            select l_returnflag, case when l_orderkey % 20 < 17 then 'ok' when l_orderkey % 20 < 19 then 'warn' else 'e' || (l_orderkey % 3) end as status, count(*) as n from lineitem group by 1, 2
        ), b as (
            select *, sum(n) over (partition by l_returnflag order by n desc, status) - n as before, sum(n) over (partition by l_returnflag) as total, count(*) over (partition by l_returnflag) as kinds from c
        ), k as (select *, case when before < 0.8 * total then 1 else 0 end as core from b)
        select l_returnflag, status, n from (select *, sum(core) over (partition by l_returnflag) as k from k) where kinds between 2 and 50 and k <= 5 and core = 0
        """,
    ),
    "key_types": (lambda s, d: key_types(table(s, d, "events"), "props"), "select key, count(*) as n, 'int' as tag from (select unnest(json_keys(props)) as key from events) group by 1"),
    "string_entropy": (lambda s, d: table(s, d, "customer").select("c_custkey", F.round(entropy("c_name"), 6).alias("entropy")), "select c_custkey, round(case when count(*) < 2 then 0.0 else -sum(n / total * log2(n / total)) / log2(least(count(*), any_value(total))) end, 6) as entropy from (select c_custkey, ch, count(*) as n, sum(count(*)) over (partition by c_custkey) as total from (select c_custkey, unnest(string_split(c_name, '')) as ch from customer) group by 1, 2) group by 1"),
    "error_items": (lambda s, d: table(s, d, "events").select("event_id", is_error_item(F.to_json(F.struct("event_type", "props"))).alias("bad")).where("bad").select("event_id"), "select event_id from events where event_type = 'error'"),
}
