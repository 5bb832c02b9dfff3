"""What decides whether and how a payload is compressed, and caches of what was: predicates, keys, breakers, scopes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tessera.sources.tables import table

# They must equal the behaviour that is matched.
ANALYSIS_WORDS = (
    "analyze", "analyse", "review", "audit", "inspect", "security", "vulnerability", "bug", "issue", "problem", "explain", "understand",
    "how does", "what does", "debug", "fix", "error", "wrong", "broken", "refactor", "improve", "optimize", "clean up",
)
FAMILIES = ("opus", "sonnet", "haiku", "fable", "mythos", "gpt", "gemini")
PATH_IN_TICKS = r"`([/\w.]+(?:/[\w.]+)+)`"
# End of fixed values.


def glob_pattern(glob: str) -> str:
    """A glob of *, ? and [sets] as a pattern for rlike."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c != "_" else c)
        k += 1
    return f"(?s)^{out}$"


def excluded(name: Column, tools: Iterable[str]) -> Column:
    """Whether a tool's name is in the set, in any case, or fits one of its globs."""
    plain = [t for t in tools if not set(t) & set("*?[")]
    globs = [glob_pattern(t.lower()) for t in tools if set(t) & set("*?[")]
    low = F.lower(name)
    hit = name.isin(plain) | low.isin(plain)
    for g in globs:
        hit = hit | low.rlike(g)
    return F.coalesce(hit, F.lit(False))


def analysis_intent(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """key, intent: whether the last user message of a conversation asks to review or explain."""
    last = messages.groupBy(key).agg(F.max_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order))).alias("_t"))
    return last.select(key, F.coalesce(F.lower("_t").rlike("|".join(ANALYSIS_WORDS)), F.lit(False)).alias("intent"))


def named_results(results: DataFrame, calls: DataFrame, call: str, name: str) -> DataFrame:
    """results with the tool's name of the call they answer; of a repeated call id, the last name by its own order wins."""
    last = calls.groupBy(call).agg(F.max_by(name, "order").alias(name))
    return results.join(last, call, "left")


def model_family(model: Column) -> Column:
    low, out = F.lower(model), F
    for f in FAMILIES:
        out = out.when(F.contains(low, F.lit(f)), f)
    return out.otherwise("other")


def transform_summary(applied: DataFrame, key: str, order: list[str], tag: str) -> DataFrame:
    """key, summary: tags by first use, each with how often it came if more than once."""
    first = applied.groupBy(key, tag).agg(F.min(F.struct(*order)).alias("_f"), F.count("*").alias("_n"))
    part = F.when(F.col("_n") > 1, F.concat(F.col(tag), F.lit("*"), F.col("_n").cast("string"))).otherwise(F.col(tag))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_f", part.alias("p")))), lambda x: x["p"]), " ").alias("summary"))


def exact_hits(requests: DataFrame, key: str, at: str, order: list, seconds: float) -> DataFrame:
    """requests with hit: whether an answer to the same key was stored, by the last miss, no longer ago than `seconds`.

    A miss stores its answer anew. Which request that was is followed from the first: a request is a miss if the last
    miss of its key lies further back, so each stretch of `seconds` after a miss holds hits only. The chain of misses is
    walked over distinct stretches, of which a key has as many as it has misses.
    """
    t = F.unix_micros(F.col(at).cast("timestamp"))
    walked = requests.withColumn("_t", t).repartition(F.col(key)).sortWithinPartitions(key, "_t", *order)
    place, when, span = walked.columns.index(key), walked.columns.index("_t"), int(seconds * 1e6)
    schema = StructType([*walked.schema.fields, StructField("hit", BooleanType())])

    def run(batches):
        import pyarrow as pa

        held, stored = None, None
        for batch in batches:
            hits = []
            for k, now in zip(batch.column(place).to_pylist(), batch.column(when).to_pylist(), strict=True):
                if k != held or stored is None:
                    held, stored, hit = k, now, False
                else:
                    hit = now - stored <= span
                    stored = stored if hit else now
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=schema.names)

    return walked.mapInArrow(run, schema).drop("_t")


def result_cache(seen: DataFrame, text: str, worth: Column) -> DataFrame:
    """One row for each distinct text, by its hash: how often it comes, and its tier, which is `skip` where compressing wasn't worth it."""
    rows = seen.select(F.sha2(F.col(text), 256).alias("hash"), worth.alias("_w"))
    return rows.groupBy("hash").agg(F.count("*").alias("uses"), F.max("_w").alias("_w")).select("hash", "uses", F.when(F.col("_w"), "result").otherwise("skip").alias("tier"))


def cleared(memories: DataFrame, scope: dict[str, object]) -> DataFrame:
    """What is left after a scope is cleared: rows that differ from it in any of its levels (a null differs)."""
    same = F.lit(True)
    for level, value in scope.items():
        same = same & F.coalesce(F.col(level) == F.lit(value), F.lit(False))
    return memories.where(~same)


def without_entities(entities: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, ...) and relations (a, b, ...) after those in gone (id) are deleted, with every relation they have."""
    g = gone.select(F.col("id").alias("_g")).distinct()
    left = relations.join(g, F.col("a") == F.col("_g"), "left_anti").join(g, F.col("b") == F.col("_g"), "left_anti")
    return entities.join(g, F.col("id") == F.col("_g"), "left_anti"), left


def relations_of(relations: DataFrame, node: Column, direction: str = "both") -> DataFrame:
    """Relations (a, b, ...) out of a node, into it, or both."""
    ways = {"outgoing": F.col("a") == node, "incoming": F.col("b") == node}
    return relations.where(ways[direction] if direction in ways else ways["outgoing"] | ways["incoming"])


def stale(memories: DataFrame, key: str, text: str, files: DataFrame, path: str, root: str = "/") -> DataFrame:
    """key of memories whose text names, between ticks, a path below root that is no known file."""
    refs = memories.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PATH_IN_TICKS), F.lit(1)))).alias("_ref"))
    refs = refs.withColumn("_p", F.when(F.startswith("_ref", F.lit(root)), F.substring("_ref", len(root) + 1, 1 << 30)).otherwise(F.col("_ref")))
    return refs.join(files.select(F.col(path).alias("_file")), F.col("_p") == F.col("_file"), "left_anti").select(key).distinct()


def breaker(calls: DataFrame, key: str, at: str, order: list, failed: Column, threshold: int = 3, seconds: float = 60.0) -> DataFrame:
    """calls with state: `passed` through untouched while the breaker is open, else `failed` or `ok`.

    `threshold` failures in a row open it for `seconds` from the last of them; a success starts the count anew. It is an
    ordered fold with a state of two numbers for each key, so rows stream through a task.
    """
    given = calls.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_bad", failed.cast("boolean"))
    given = given.repartition(F.col(key)).sortWithinPartitions(key, "_t", *order)
    place, when, bad = (given.columns.index(c) for c in (key, "_t", "_bad"))
    schema, span = StructType([*given.schema.fields, StructField("state", StringType())]), int(seconds * 1e6)

    def run(batches):
        import pyarrow as pa

        held, count, until, begun = None, 0, None, False
        for batch in batches:
            out = []
            for k, now, wrong in zip(*(batch.column(c).to_pylist() for c in (place, when, bad)), strict=True):
                if k != held or not begun:
                    held, count, until, begun = k, 0, None, True
                if until is not None and now < until:
                    out.append("passed")
                    continue
                count = count + 1 if wrong else 0
                if count >= threshold:
                    count, until = 0, now + span
                out.append("failed" if wrong else "ok")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return given.mapInArrow(run, schema).drop("_t", "_bad")


def window_render(used: Column, limit: Column, resets_at: Column, since_reset: Column, now: Column, seconds: float) -> Column:
    """Struct (used, utilization, seconds_to_reset, synthesized) of a usage window; past its reset, what was used since then counts."""
    left = (F.unix_micros(resets_at) - F.unix_micros(now)) / 1e6
    past = left <= 0
    periods = F.floor(-left / F.lit(seconds)) + 1
    now_used = F.when(past, F.least(F.coalesce(since_reset, F.lit(0)), limit)).otherwise(used)
    share = F.round(F.coalesce(F.try_divide(now_used * 100.0, limit), F.lit(0.0)), 2)
    return F.struct(now_used.alias("used"), share.alias("utilization"), F.when(past, left + periods * seconds).otherwise(left).alias("seconds_to_reset"), F.coalesce(past, F.lit(False)).alias("synthesized"))


def batch_results(results: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """Results of a batch with the contexts that were stored for their ids; context_found tells those without one."""
    return results.join(contexts.withColumn("context_found", F.lit(True)), key, "left").withColumn("context_found", F.coalesce("context_found", F.lit(False)))


_MODEL = "concat('claude-', element_at(array('Opus-4', 'sonnet-4', 'haiku', 'x'), cast(event_id % 4 + 1 as int)), if(event_id % 8 = 3, '-gpt', ''))"

QUERIES = {
    "excluded_tools": (
        lambda s, d: table(s, d, "events").where(excluded(F.concat(F.lit("MCP__"), "event_type"), ["mcp__c*", "mcp__?iew", "mcp__[!a-o]urchase"])).select("event_id"),
        "select event_id from events where event_type like 'c%' or event_type like '_iew' or regexp_matches(event_type, '^[^a-o]urchase$')",
    ),
    "analysis_intent": (
        lambda s, d: analysis_intent(table(s, d, "conversations"), "conv_id", "turn", "role", "text"),
        f"""
        select conv_id, coalesce(regexp_matches(lower(max_by(text, turn) filter (role = 'user' and text is not null)), '{"|".join(ANALYSIS_WORDS)}'), false) as intent
        from conversations group by 1
        """,
    ),
    "named_results": (
        lambda s, d: named_results(
            table(s, d, "lineitem").select("l_orderkey", "l_linenumber"),
            table(s, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("tool"), F.col("o_orderdate").alias("order")),
            "l_orderkey", "tool").groupBy("tool").agg(F.count("*").alias("n")),
        "select o_orderpriority as tool, count(*) as n from lineitem left join (select * from orders where o_orderstatus <> 'P') on l_orderkey = o_orderkey group by 1",
    ),
    "model_families": (
        lambda s, d: table(s, d, "events").select(model_family(F.expr(_MODEL)).alias("family")).groupBy("family").agg(F.count("*").alias("n")),
        "select case event_id % 4 when 0 then 'opus' when 1 then 'sonnet' when 2 then 'haiku' else case when event_id % 8 = 3 then 'gpt' else 'other' end end as family, count(*) as n from events group by 1",
    ),
    "transform_summary": (
        lambda s, d: transform_summary(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type"),
        """
        select user_id, string_agg(case when n > 1 then event_type || '*' || n else event_type end, ' ' order by ts, event_id) as summary
        from (select user_id, event_type, count(*) as n, min(ts) as ts, arg_min(event_id, (ts, event_id)) as event_id from events group by 1, 2) group by 1
        """,
    ),
    "exact_cache": (
        lambda s, d: exact_hits(table(s, d, "events").withColumn("k", F.concat_ws("|", "user_id", "event_type")), "k", "ts", ["event_id"], 86400).where("hit").select("event_id"),
        """
        with recursive e as (
            select event_id, user_id || '|' || event_type as k, epoch_us(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events
        ), r(event_id, k, i, stored, hit) as (
            select event_id, k, i, t, false from e where i = 1
            union all
            select e.event_id, e.k, e.i, case when e.t - r.stored <= 86400000000 then r.stored else e.t end, e.t - r.stored <= 86400000000
            from r join e on e.k = r.k and e.i = r.i + 1
        ) select event_id from r where hit
        """,
    ),
    "result_cache": (
        lambda s, d: result_cache(table(s, d, "documents").where("text is not null"), "text", F.length("text") > 2000).groupBy("tier").agg(F.count("*").alias("texts"), F.sum("uses").alias("uses")),
        "select case when length(text) > 2000 then 'result' else 'skip' end as tier, count(distinct text) as texts, cast(count(*) as bigint) as uses from documents where text is not null group by 1",
    ),
    "clear_scope": (
        lambda s, d: cleared(table(s, d, "events"), {"user_id": 1, "event_type": "click"}).groupBy("event_type").agg(F.count("*").alias("n")),
        "select event_type, count(*) as n from events where not coalesce(user_id = 1 and event_type = 'click', false) group by 1",
    ),
    "delete_entities": (
        lambda s, d: without_entities(
            table(s, d, "nation").select(F.col("n_nationkey").alias("id")), table(s, d, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).alias("b")),
            table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("id")))[1].groupBy("a").agg(F.count("*").alias("n")),
        "with g as (select n_nationkey as g from nation where n_regionkey = 2) select c_nationkey as a, count(*) as n from customer where c_nationkey not in (select g from g) and c_custkey % 25 not in (select g from g) group by 1",
    ),
    "relations_of": (
        lambda s, d: relations_of(table(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")), F.lit(7)).groupBy("a", "b").agg(F.count("*").alias("n")),
        "select l_suppkey as a, l_partkey as b, count(*) as n from lineitem where l_suppkey = 7 or l_partkey = 7 group by 1, 2",
    ),
    "stale_memories": (
        lambda s, d: stale(
            table(s, d, "part").select("p_partkey", F.concat(F.lit("see `/repo/src/p"), F.col("p_partkey").cast("string"), F.lit(".py` and `src/p1.py`")).alias("note")), "p_partkey", "note",
            table(s, d, "part").where("p_size <= 25 or p_partkey = 1").select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path")), "path", "/repo/"),
        "select p_partkey from part where not (p_size <= 25 or p_partkey = 1)",
    ),
    "breaker": (
        lambda s, d: breaker(table(s, d, "events"), "user_id", "ts", ["event_id"], F.col("value") > 20, 2, 5 * 86400).groupBy("user_id", "state").agg(F.count("*").alias("n")),
        """
        with recursive e as (
            select user_id, epoch_us(ts) as t, coalesce(value > 20, false) as bad, row_number() over (partition by user_id order by ts, event_id) as i from events
        ), r(user_id, i, fails, until, state) as (
            select distinct user_id, cast(0 as bigint), 0, cast(0 as bigint), '' from events
            union all
            select e.user_id, e.i,
                case when e.t < r.until then r.fails when not e.bad or r.fails + 1 >= 2 then 0 else r.fails + 1 end,
                case when e.t >= r.until and e.bad and r.fails + 1 >= 2 then e.t + 432000000000 else r.until end,
                case when e.t < r.until then 'passed' when e.bad then 'failed' else 'ok' end
            from r join e on e.user_id = r.user_id and e.i = r.i + 1
        ) select user_id, state, count(*) as n from r where i > 0 group by 1, 2
        """,
    ),
    "window_render": (
        lambda s, d: table(s, d, "events").select("event_id", window_render(
            F.floor("value").cast("long"), F.lit(60).cast("long"), F.col("ts").cast("timestamp"), F.floor(F.col("value") * 2).cast("long"), F.lit("2024-01-16 00:00:00").cast("timestamp"), 18000.0).alias("w")).select("event_id", "w.*"),
        """
        with e as (select event_id, value, (epoch_us(ts) - epoch_us(timestamp '2024-01-16 00:00:00')) / 1e6 as l from events),
        u as (select *, case when l <= 0 then least(cast(floor(value * 2) as bigint), 60) else cast(floor(value) as bigint) end as used from e)
        select event_id, used, round(used * 100.0::double / 60, 2) as utilization, case when l <= 0 then l + (floor(-l / 18000.0::double) + 1) * 18000.0::double else l end as seconds_to_reset, l <= 0 as synthesized from u
        """,
    ),
    "batch_results": (
        lambda s, d: batch_results(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), "doc_id").groupBy("context_found", "quality").agg(F.count("*").alias("n")),
        "select l.doc_id is not null as context_found, quality, count(*) as n from documents left join labels l using (doc_id) group by 1, 2",
    ),
}
