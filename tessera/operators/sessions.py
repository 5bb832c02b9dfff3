"""Analytics of sessions: blocks, re-reads, read lifecycles, tool pairs, loops, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.detect import is_rag
from tessera.functions.text import content_key, short_hash, tokens_simple
from tessera.sources.tables import table

# Smallest re-read, in tokens; largest gap of polling, in messages; fewest calls of a loop.
REREAD_TOKENS, ADJACENT_GAP, MIN_LOOP = 50, 3, 3
# Smallest read that is replaced, in bytes; what replaces it.
REWRITE_BYTES = 512
NOTES = {
    "stale": "[Read content stale: {file} was modified after this read — re-read the file for current content. Retrieve original: hash={key}]",
    "superseded": "[Read content superseded: {file} was re-read later — re-read the file if needed. Retrieve original: hash={key}]",
}


def blocks(messages: DataFrame) -> DataFrame:
    """One block per message (conv_id, turn, role, text): kind, tokens, hash."""
    kind = F.when(F.col("role") == "tool", "tool_result").when(is_rag("text"), "rag").when(F.col("role").isin("system", "user", "assistant"), F.col("role")).otherwise("unknown")
    return messages.select("conv_id", "turn", kind.alias("kind"), tokens_simple(F.length("text")).alias("tokens"), short_hash("text").alias("hash"), "text")


def breakdown(blocks_: DataFrame, kinds=("system", "user", "assistant")) -> DataFrame:
    """Tokens of each kind of block by conversation, one column each. kinds is given, so that no pass finds it."""
    return blocks_.groupBy("conv_id").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("tokens"))), F.lit(0)).cast("long").alias(k) for k in kinds], F.sum("tokens").alias("total"))


def rereads(served: DataFrame, session: str, order: list, content: str, tokens: str, least: int = REREAD_TOKENS, gap: int = ADJACENT_GAP) -> DataFrame:
    """Contents that a session was served again, more than gap messages after the last time: wasted tokens by session."""
    w = Window.partitionBy(session).orderBy(*order)
    r = served.withColumn("_i", F.row_number().over(w))
    r = r.where(F.col(tokens) >= least).withColumn("_gap", F.col("_i") - F.lag("_i").over(Window.partitionBy(session, content).orderBy("_i")))
    return r.where(F.col("_gap") > gap).groupBy(session).agg(F.count("*").alias("rereads"), F.sum(tokens).cast("long").alias("wasted"))


def read_lifecycle(ops: DataFrame, session: str, file: str, order: list, is_read: Column, is_edit: Column, low: str, high: str) -> DataFrame:
    """Reads that are stale (the file was edited later), superseded (a later read covers their lines) or fresh.

    A file's last edit in its session is an aggregate; reads that cover others are met by a join on session and file.
    """
    w = Window.partitionBy(session, file).orderBy(*order)
    o = ops.withColumn("_i", F.row_number().over(w)).withColumn("_edit", F.when(is_edit, F.row_number().over(w)))
    last = o.groupBy(session, file).agg(F.max("_edit").alias("_last"))
    reads = o.where(is_read)
    later = reads.select(F.col(session).alias("_s"), F.col(file).alias("_f"), F.col("_i").alias("_j"), F.col(low).alias("_lo"), F.col(high).alias("_hi"))
    covered = reads.join(later, (F.col(session) == F.col("_s")) & (F.col(file) == F.col("_f")) & (F.col("_j") > F.col("_i")) & (F.col("_lo") <= F.col(low)) & (F.col("_hi") >= F.col(high)), "left_semi").select(session, file, "_i", F.lit(True).alias("_cov"))
    out = reads.join(last, [session, file], "left").join(covered, [session, file, "_i"], "left")
    return out.withColumn("state", F.when(F.col("_last") > F.col("_i"), "stale").when(F.col("_cov"), "superseded").otherwise("fresh"))


def rewritten(reads: DataFrame, text: str, file: str, state: str, superseded: bool = False, frozen: Column | None = None, least_bytes: int = REWRITE_BYTES) -> DataFrame:
    """Reads with the text of stale ones (and superseded ones, if asked for) replaced by a note that names the stored original.

    `key` is the original's key, null where the text stays: for fresh reads, short texts, nulls and what is frozen in a
    provider's prefix cache. The originals to store are (key, text) of the given reads. A read of no file has one unknown.
    """
    swap = (F.octet_length(text) >= least_bytes) & F.col(state).isin("stale", *["superseded"] * superseded)
    if frozen is not None:
        swap = swap & ~F.coalesce(frozen, F.lit(False))
    name = F.when(F.coalesce(F.col(file), F.lit("")) == "", "unknown").otherwise(F.col(file))
    note = F.element_at(F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair]), F.col(state))
    told = F.replace(F.replace(note, F.lit("{key}"), content_key(text)), F.lit("{file}"), name)
    return reads.withColumn("key", F.when(swap, content_key(text))).withColumn(text, F.when(F.col("key").isNotNull(), told).otherwise(F.col(text)))


def tool_pairs(calls: DataFrame, results: DataFrame, session: str, call: str) -> DataFrame:
    """Each tool call with the number of its results, 0 for one that has none."""
    n = results.groupBy(session, call).agg(F.count("*").alias("results"))
    return calls.join(n, [session, call], "left").withColumn("results", F.coalesce("results", F.lit(0)))


def loops(calls: DataFrame, session: str, signature: Column, is_error: Column, tokens: Column, least: int = MIN_LOOP) -> DataFrame:
    """Calls repeated in a session: an error loop (half or more failed) wastes all tokens, another all but the largest call's."""
    got = calls.groupBy(session, signature.alias("signature")).agg(F.count("*").alias("n"), F.sum(is_error.cast("int")).cast("long").alias("errors"), F.sum(tokens).cast("long").alias("_sum"), F.max(tokens).alias("_max")).where(F.col("n") >= least)
    error = F.col("errors") * 2 >= F.col("n")
    return got.select(session, "signature", "n", F.when(error, "error").otherwise("refetch").alias("kind"), F.when(error, F.col("_sum")).otherwise(F.col("_sum") - F.col("_max")).alias("wasted"))


def retries(failed: DataFrame, done: DataFrame, session: str, at: str, text: str) -> DataFrame:
    """Failed calls with a later success of the same session whose text is within a third (2 at least) of edits."""
    a = failed.select(session, F.col(at).alias("failed_at"), F.col(text).alias("failed"))
    b = done.select(F.col(session).alias("_s"), F.col(at).alias("done_at"), F.col(text).alias("done"))
    near = F.levenshtein("failed", "done") <= F.greatest(F.lit(2), F.floor(F.greatest(F.length("failed"), F.length("done")) / 3))
    return a.join(b, (F.col(session) == F.col("_s")) & (F.col("done_at") > F.col("failed_at")) & near).groupBy(session, "failed_at").agg(F.min("done_at").alias("done_at"))


def without_contradictions(pairs: DataFrame) -> DataFrame:
    """(a, b) rules, without those of which the reverse is there too."""
    back = pairs.select(F.col("b").alias("_a"), F.col("a").alias("_b"))
    return pairs.join(back, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")


def last_user_text(messages: DataFrame) -> DataFrame:
    """The text of each conversation's latest user message."""
    return messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def live_zone(messages: DataFrame, frozen: int = 0) -> DataFrame:
    """Messages from each conversation's latest user message on, past the frozen ones."""
    at = messages.where((F.col("role") == "user") & (F.col("turn") >= frozen)).groupBy("conv_id").agg(F.max("turn").alias("_at"))
    return messages.join(at, "conv_id").where(F.col("turn") >= F.col("_at")).drop("_at")


def turn_kind(messages: DataFrame) -> DataFrame:
    """new_ask if a conversation ends with a user's words, continuation if with another role's."""
    return messages.groupBy("conv_id").agg(F.max_by("role", "turn").alias("_r")).select("conv_id", F.when(F.col("_r") == "user", "new_ask").otherwise("continuation").alias("kind"))


def prefix_hash(messages: DataFrame, n: int) -> DataFrame:
    """SHA-256 of each conversation's first n messages, in order."""
    first = messages.where(F.col("turn") < n).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return first.select("conv_id", F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\x00"), x["text"])), "\x01"), 256).alias("prefix_hash"))


def conversation_tokens(messages: DataFrame, overhead: int = 4, reply: int = 3) -> DataFrame:
    """Tokens of a conversation: its texts, an overhead for each message and one for the reply."""
    return messages.groupBy("conv_id").agg((F.sum(tokens_simple(F.length("text")) + overhead) + reply).cast("long").alias("tokens"))


def suffix_tokens(messages: DataFrame) -> DataFrame:
    """Tokens behind each message, and what it takes off them to pay for rewriting it: see net_gain."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)
    t = messages.withColumn("tokens", tokens_simple(F.length("text")))
    return t.withColumn("suffix", F.coalesce(F.sum("tokens").over(w), F.lit(0)).cast("long"))


def net_gain(saved: Column, suffix: Column, reads: float = 10.0, alive: float = 1.0, write: float = 1.25, read: float = 0.1) -> Column:
    """Tokens gained by taking `saved` off a cached prompt with `suffix` behind them, at the prices of writing and reading a cache."""
    return saved * (write + read * (reads - 1)) - alive * (write - read) * (suffix + saved)


def verbosity(turns: DataFrame, session: str, order: list, words: str) -> DataFrame:
    """Per session: turns, median words, and the share of turns at least as long as the median and 50 words."""
    med = turns.groupBy(session).agg(F.count("*").alias("turns"), F.percentile(words, 0.5).alias("median"))
    long_ = turns.join(med, session).groupBy(session).agg(F.avg((F.col(words) >= F.greatest(F.lit(50), F.col("median"))).cast("double")).alias("_l"))
    return med.join(long_, session).select(session, "turns", F.round("median", 4).alias("median"), F.round("_l", 6).alias("long_share"))


_EV = "(select *, user_id as session, 'f' || (event_id % 7) as file, event_id % 50 as lo, event_id % 50 + 20 + event_id % 13 as hi from events)"
_M = "conversations"
_TOK = "case when length(text) = 0 then 0 else greatest(1, cast(floor(length(text) / 4.0 + 0.5) as bigint)) end"


def _ops(s, d):
    e = table(s, d, "events")
    return e.withColumn("file", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"))).withColumn("lo", F.col("event_id") % 50).withColumn("hi", F.col("event_id") % 50 + 20 + F.col("event_id") % 13)


def _reads(s, d):
    return _ops(s, d).withColumn("text", F.repeat(F.concat(F.lit("größe "), "event_type"), (F.col("event_id") % 60).cast("int")))


_STATES = f"""
with o as (select *, row_number() over (partition by session, file order by ts, event_id) as i from {_EV}),
e as (select session, file, max(i) filter (event_type = 'error') as last from o group by 1, 2)
select event_id, case when last > i then 'stale' when exists (select 1 from o b where b.event_type <> 'error' and b.session = o.session and b.file = o.file and b.i > o.i and b.lo <= o.lo and b.hi >= o.hi) then 'superseded' else 'fresh' end as state from o join e using (session, file) where event_type <> 'error'
"""

QUERIES = {
    "block_breakdown": (lambda s, d: breakdown(blocks(table(s, d, "conversations"))), f"select conv_id, cast(coalesce(sum(t) filter (role = 'system'), 0) as bigint) as system, cast(coalesce(sum(t) filter (role = 'user'), 0) as bigint) as \"user\", cast(coalesce(sum(t) filter (role = 'assistant'), 0) as bigint) as assistant, cast(sum(t) as bigint) as total from (select *, {_TOK} as t from {_M}) group by 1"),
    "reread_waste": (lambda s, d: rereads(table(s, d, "events").withColumn("content", F.concat_ws("|", "event_type", "props")).withColumn("tokens", F.floor("value").cast("long")), "user_id", ["ts", "event_id"], "content", "tokens"), "select user_id, count(*) as rereads, cast(sum(tokens) as bigint) as wasted from (select *, i - lag(i) over (partition by user_id, content order by i) as gap from (select * from (select user_id, concat_ws('|', event_type, props) as content, cast(floor(value) as bigint) as tokens, row_number() over (partition by user_id order by ts, event_id) as i from events) where tokens >= 50)) where gap > 3 group by 1"),
    "read_lifecycle": (lambda s, d: read_lifecycle(_ops(s, d), "user_id", "file", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_type") == "error", "lo", "hi").select("event_id", "state"), _STATES),
    "read_rewrite": (
        lambda s, d: rewritten(read_lifecycle(_reads(s, d), "user_id", "file", ["ts", "event_id"], F.col("event_type") != "error", F.col("event_type") == "error", "lo", "hi"), "text", "file", "state", superseded=True, frozen=F.col("event_id") < 100).select("event_id", "text", "key"),
        f"""
        with t as (select event_id, 'f' || (event_id % 7) as file, repeat('größe ' || event_type, cast(event_id % 60 as int)) as text from events),
        r as (select *, strlen(text) >= 512 and state <> 'fresh' and event_id >= 100 as swap, substring(sha256(text), 1, 24) as h from t join ({_STATES}) using (event_id))
        select event_id, case when swap then h end as key, case when not swap then text
            when state = 'stale' then '[Read content stale: ' || file || ' was modified after this read — re-read the file for current content. Retrieve original: hash=' || h || ']'
            else '[Read content superseded: ' || file || ' was re-read later — re-read the file if needed. Retrieve original: hash=' || h || ']' end as text
        from r
        """,
    ),
    "tool_pairing": (lambda s, d: tool_pairs(table(s, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("call")), table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_returnflag = 'R'").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("call")), "session", "call"), "select o_custkey as session, o_orderkey as call, count(l_orderkey) as results from orders left join lineitem on o_orderkey = l_orderkey and l_returnflag = 'R' group by 1, 2"),
    "loop_detection": (lambda s, d: loops(table(s, d, "events"), "user_id", F.concat_ws("|", "event_type", "props"), F.col("event_type") == "error", F.floor("value").cast("long")), "select user_id, signature, n, case when errors * 2 >= n then 'error' else 'refetch' end as kind, case when errors * 2 >= n then s else s - m end as wasted from (select user_id, concat_ws('|', event_type, props) as signature, count(*) as n, count(*) filter (event_type = 'error') as errors, cast(sum(cast(floor(value) as bigint)) as bigint) as s, max(cast(floor(value) as bigint)) as m from events group by 1, 2) where n >= 3"),
    "retry_pairs": (lambda s, d: retries(table(s, d, "events").where("event_type = 'error'"), table(s, d, "events").where("event_type = 'purchase'"), "user_id", "ts", "props"), "select a.user_id, a.ts as failed_at, min(b.ts) as done_at from events a join events b on a.user_id = b.user_id and b.ts > a.ts and levenshtein(a.props, b.props) <= greatest(2, floor(greatest(length(a.props), length(b.props)) / 3)) where a.event_type = 'error' and b.event_type = 'purchase' group by 1, 2"),
    "no_contradictions": (lambda s, d: without_contradictions(table(s, d, "lineitem").select((F.col("l_partkey") % 900).alias("a"), (F.col("l_suppkey") % 900).alias("b")).distinct()), "with p as (select distinct l_partkey % 900 as a, l_suppkey % 900 as b from lineitem) select a, b from p where not exists (select 1 from p q where q.a = p.b and q.b = p.a)"),
    "last_user_text": (lambda s, d: last_user_text(table(s, d, "conversations")), "select conv_id, arg_max(text, turn) as query from conversations where role = 'user' group by 1"),
    "live_zone": (lambda s, d: live_zone(table(s, d, "conversations")).select("conv_id", "turn", "role"), "select c.conv_id, turn, role from conversations c join (select conv_id, max(turn) as start from conversations where role = 'user' group by 1) u on c.conv_id = u.conv_id and turn >= start"),
    "turn_kinds": (lambda s, d: turn_kind(table(s, d, "conversations")), "select conv_id, case when arg_max(role, turn) = 'user' then 'new_ask' else 'continuation' end as kind from conversations group by 1"),
    "prefix_hashes": (lambda s, d: prefix_hash(table(s, d, "conversations"), 2), "select conv_id, sha256(string_agg(role || chr(0) || text, chr(1) order by turn)) as prefix_hash from conversations where turn < 2 group by 1"),
    "conversation_tokens": (lambda s, d: conversation_tokens(table(s, d, "conversations")), f"select conv_id, cast(sum({_TOK} + 4) + 3 as bigint) as tokens from conversations group by 1"),
    "net_gain": (lambda s, d: suffix_tokens(table(s, d, "conversations")).select("conv_id", "turn", "suffix", F.round(net_gain(F.floor(F.col("tokens") / 2), F.col("suffix")), 4).alias("gain")), f"select conv_id, turn, suffix, round(saved * (1.25 + 0.1::double * 9) - (1.25 - 0.1::double) * (suffix + saved), 4) as gain from (select conv_id, turn, floor(t / 2) as saved, cast(coalesce(sum(t) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) as bigint) as suffix from (select *, {_TOK} as t from conversations))"),
    "verbosity_signals": (lambda s, d: verbosity(table(s, d, "conversations").withColumn("words", F.regexp_count("text", F.lit(r"\S+"))), "conv_id", ["turn"], "words"), "with t as (select conv_id, len(regexp_extract_all(text, '\\S+')) as words from conversations), m as (select conv_id, count(*) as turns, quantile_cont(words, 0.5) as median from t group by 1) select conv_id, turns, round(median, 4) as median, round(avg(case when words >= greatest(50, median) then 1.0 else 0.0 end), 6) as long_share from t join m using (conv_id) group by conv_id, turns, median"),
    "failure_rate": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("rate")), "select user_id, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6) as rate from events group by 1"),
}
