"""Patterns of tools learned from use, signatures, hints, probes; request bodies and streamed answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table

# Step of a strategy's success rate, what a retrieval takes off, users counted apart.
STEP, PENALTY, USERS = 0.02, 0.05, 100


def signature(items: DataFrame, group: str, text: str) -> DataFrame:
    """(group, signature): SHA-256 prefix of the sorted names and kinds of the fields of a group's JSON objects."""
    v = items.select(group, F.try_parse_json(text).alias("v")).where("v is not null")
    f = v.select(group, F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("key", "value"))
    kinds = f.groupBy(group).agg(F.array_sort(F.collect_set(F.concat_ws(":", "key", F.lower(F.schema_of_variant("value"))))).alias("s"))
    return kinds.select(group, F.substring(F.sha2(F.array_join("s", ","), 256), 1, 24).alias("signature"))


def patterns(events: DataFrame, keys: list[str], user: str, ratio: str, retrieved: Column) -> DataFrame:
    """Use of each tool signature: events, users (capped), mean ratio and share retrieved."""
    got = events.groupBy(*keys).agg(F.count("*").alias("n"), F.least(F.count_distinct(user), F.lit(USERS)).alias("users"), F.avg(ratio).alias("ratio"), F.sum(retrieved.cast("int")).cast("long").alias("retrieved"))
    return got.withColumn("retrieval_rate", F.col("retrieved") / F.col("n"))


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns of two sides as one: counts summed, means weighed by them."""
    both = a.unionByName(b)
    return both.groupBy(*keys).agg(F.sum("n").alias("_n"), (F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("ratio"), F.sum("retrieved").alias("retrieved"), F.least(F.sum("users"), F.lit(USERS)).alias("users")).withColumnRenamed("_n", "n")


def success_rates(events: DataFrame, keys: list[str], order: list[str], retrieved: Column, start: float = 0.5) -> DataFrame:
    """A rate that rises by STEP with each use, 1 at most, and falls by PENALTY with each retrieval, 0 at least: an ordered fold over each key's flags."""
    flags = events.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, retrieved.alias("_r")))), lambda x: x["_r"]).alias("_f"))
    rate = F.aggregate("_f", F.lit(start), lambda a, r: F.when(r, F.greatest(F.lit(0.0), a - PENALTY)).otherwise(F.least(F.lit(1.0), a + STEP)))
    return flags.select(*keys, F.round(rate, 6).alias("rate"))


def hints(patterns_: DataFrame, least: int = 5) -> DataFrame:
    """What to do with a tool's output, by how often it had to be fetched again."""
    rate = F.col("retrieval_rate")
    advice = F.when(F.col("n") < least, "default").when(rate > 0.5, "skip").when(rate > 0.2, "keep_more").otherwise("compress")
    return patterns_.withColumn("hint", advice)


def field_meaning(unique_ratio: Column, share_equal: Column, share_range: Column, numeric: Column, temporal: Column, mean_length: Column) -> Column:
    """identifier, temporal, score, status, content or unknown, from a field's values and how it was queried."""
    return F.when(temporal, "temporal").when((unique_ratio > 0.9) & (share_equal >= share_range), "identifier").when(numeric & (share_range > share_equal), "score").when(unique_ratio < 0.1, "status").when(mean_length > 50, "content").otherwise("unknown")


def reads_audit(ops: DataFrame, session: str, order: list, file: str, size: str) -> DataFrame:
    """Reads of a session's files: bytes, and those that only repeat what the file's last read gave."""
    w = Window.partitionBy(session, file).orderBy(*order)
    r = ops.withColumn("_same", F.col(size).eqNullSafe(F.lag(size).over(w)) & F.lag(size).over(w).isNotNull())
    return r.groupBy(session).agg(F.count("*").alias("reads"), F.sum(size).cast("long").alias("bytes"), F.sum(F.when(F.col("_same"), F.col(size)).otherwise(0)).cast("long").alias("repeated_bytes"))


def command_class(command: Column) -> Column:
    """read, search, list, edit, test, build, git or other, by a shell command's first word."""
    head = F.regexp_extract(F.trim(command), r"^(?:\w+=\S+\s+)*(?:sudo\s+)?(\S+)", 1)
    return F.when(head.isin("cat", "head", "tail", "less", "sed", "nl"), "read").when(head.isin("grep", "rg", "ag", "find", "fd"), "search").when(head.isin("ls", "tree", "du"), "list").when(head.isin("pytest", "jest", "go", "cargo") & command.rlike("test"), "test").when(
        head.isin("make", "npm", "cargo", "go", "mvn", "gradle"), "build").when(head == "git", "git").when(head.isin("apply_patch", "tee", "mv", "cp", "rm"), "edit").otherwise("other")


def canonical(text: Column) -> Column:
    """A JSON value with its keys in order, or the text as it is where it isn't JSON; equal for values that only differ in their keys' order."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def id_named(keys: Column) -> Column:
    """Those of an object's keys whose name promises a value that changes from call to call."""
    return F.filter(keys, lambda k: F.lower(k).rlike(r"(^|_)(id|uuid|nonce|token|timestamp|session|request)$"))


def frozen_count(messages: DataFrame, marked: Column) -> DataFrame:
    """One past the last message of each conversation that carries a cache marker; 0 without one."""
    return messages.groupBy("conv_id").agg(F.coalesce(F.max(F.when(marked, F.col("turn") + 1)), F.lit(0)).cast("long").alias("frozen"))


def assembled(deltas: DataFrame, message: str, order: list, text: str, usage: str) -> DataFrame:
    """A streamed answer's pieces as one text, with the last usage that was told."""
    got = deltas.groupBy(message).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("_d"), F.max_by(F.col(usage), F.when(F.col(usage).isNotNull(), F.struct(*order))).alias("usage"))
    return got.select(message, F.array_join(F.transform("_d", lambda x: F.coalesce(x["_t"], F.lit(""))), "").alias("text"), "usage")


def sse_events(raw: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, event, data) of server-sent events in a text: blocks between empty lines; data lines are joined by line feeds."""
    parts = raw.select(key, F.posexplode(F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+"), lambda b: F.trim(b) != "")).alias("place", "block"))
    data = F.array_join(F.transform(F.filter(F.split("block", "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return parts.select(key, "place", F.regexp_extract("block", r"(?m)^event: ?(\S+)", 1).alias("event"), data.alias("data"))


def decision(bypass: Column, auth: Column, empty: Column, enabled: Column) -> Column:
    """Why a request passes as it is, or null if it is compressed: the first reason in order."""
    return F.when(bypass, "bypass_header").when(~enabled, "disabled").when(empty, "no_messages").when(auth == "unlicensed", "unlicensed")


def accept_ratio(pressure: Column, relaxed: float = 0.85, strict: float = 0.65) -> Column:
    """How small a result must be to be taken, tighter as the context fills up."""
    return F.lit(relaxed) + (strict - relaxed) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), pressure))


_P = "(select event_type, props, count(*) as n, least(count(distinct user_id), 100) as users, avg(value) as ratio, cast(count(*) filter (event_id % 7 = 0) as bigint) as retrieved from events group by 1, 2)"


def _patterns(s, d) -> DataFrame:
    return patterns(table(s, d, "events"), ["event_type", "props"], "user_id", "value", F.col("event_id") % 7 == 0)


QUERIES = {
    "tool_patterns": (lambda s, d: _patterns(s, d).select("event_type", "props", "n", "users", F.round("ratio", 6).alias("ratio"), "retrieved"), f"select event_type, props, n, users, round(ratio, 6) as ratio, retrieved from {_P}"),
    "pattern_merge": (lambda s, d: merged(_patterns(s, d), _patterns(s, d), ["event_type", "props"]).select("event_type", "props", "n", F.round("ratio", 6).alias("ratio"), "retrieved"), f"select event_type, props, cast(2 * n as bigint) as n, round(ratio, 6) as ratio, cast(2 * retrieved as bigint) as retrieved from {_P}"),
    "compression_hints": (lambda s, d: hints(_patterns(s, d)).groupBy("hint").agg(F.count("*").alias("patterns")), f"select case when n < 5 then 'default' when retrieved / n > 0.5 then 'skip' when retrieved / n > 0.2 then 'keep_more' else 'compress' end as hint, count(*) as patterns from {_P} group by 1"),
    "success_rates": (lambda s, d: success_rates(table(s, d, "events"), ["event_type", "user_id"], ["ts", "event_id"], F.col("event_id") % 7 == 0), "with recursive e as (select event_type, user_id, event_id % 7 = 0 as r, row_number() over (partition by event_type, user_id order by ts, event_id) as i from events), f(event_type, user_id, i, a) as (select distinct event_type, user_id, cast(0 as bigint), 0.5::double from events union all select f.event_type, f.user_id, e.i, case when r then greatest(0, a - 0.05::double) else least(1, a + 0.02::double) end from f join e on e.event_type = f.event_type and e.user_id = f.user_id and e.i = f.i + 1) select event_type, user_id, round(a, 6) as rate from f qualify row_number() over (partition by event_type, user_id order by i desc) = 1"),
    "tool_signatures": (lambda s, d: signature(table(s, d, "events"), "event_type", "props"), "select event_type, left(sha256('k:bigint'), 24) as signature from events group by 1"),
    "reads_audit": (lambda s, d: reads_audit(table(s, d, "events").withColumn("bytes", F.floor("value").cast("long")), "user_id", ["ts", "event_id"], "event_type", "bytes"), "select user_id, count(*) as reads, cast(sum(b) as bigint) as bytes, cast(coalesce(sum(b) filter (b = p), 0) as bigint) as repeated_bytes from (select *, lag(b) over (partition by user_id, event_type order by ts, event_id) as p from (select *, cast(floor(value) as bigint) as b from events)) group by 1"),
    "frozen_counts": (lambda s, d: frozen_count(table(s, d, "conversations"), F.col("role") == "assistant"), "select conv_id, cast(coalesce(max(turn + 1) filter (role = 'assistant'), 0) as bigint) as frozen from conversations group by 1"),
    "assembled_answers": (lambda s, d: assembled(table(s, d, "events").withColumn("u", F.when(F.col("event_type") == "purchase", F.col("event_id"))), "user_id", ["ts", "event_id"], "event_type", "u").select("user_id", F.md5("text").alias("hash"), "usage"), "select user_id, md5(string_agg(event_type, '' order by ts, event_id)) as hash, arg_max(event_id, {'t': ts, 'e': event_id}) filter (event_type = 'purchase') as usage from events group by 1"),
    "accept_ratio": (lambda s, d: table(s, d, "part").select("p_partkey", F.round(accept_ratio(F.col("p_size") / 40), 6).alias("ratio")), "select p_partkey, round(0.85::double - 0.2::double * least(1, p_size / 40), 6) as ratio from part"),
}
