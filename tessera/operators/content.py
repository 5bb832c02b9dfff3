"""Profiles of texts: tokens, kinds, waste, volatile words, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import detect as D
from tessera.functions import text as T
from tessera.sources.tables import spread, table


def profile(texts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Texts, estimated tokens, kinds and waste of each group, in one pass and one shuffle of sums."""
    seen = texts.select(*by, T.tokens(text).alias("tokens"), D.content_type(text)["type"].alias("type"), T.waste(text).alias("w"))
    kinds = ("json_array", "diff", "html", "search", "log", "tabular", "code", "text")
    return seen.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.col("w.html") + F.col("w.base64") + F.col("w.whitespace") + F.col("w.json_bloat")).alias("waste"),
        *[F.sum((F.col("type") == k).cast("int")).cast("long").alias(f"n_{k}") for k in kinds])


def repeated_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines with their number of texts, for those in two or more."""
    lines = texts.select("doc_id", F.explode(F.array_distinct(F.split(text, "\n"))).alias("line")).where(F.trim("line") != "")
    return lines.groupBy(F.md5("line").alias("hash")).agg(F.count("*").alias("texts"), F.first(F.length("line")).alias("length")).where("texts > 1")


def features(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts that describe a prompt: length, words, distinct words, questions, lists, code fences, digits, capitals."""
    t = F.col(text)
    words = T.words(t)
    return texts.select(key, F.length(t).alias("chars"), F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("vocabulary"), T.count(t, r"\?").alias("questions"), T.count(t, r"(?m)^\s*([-*]|\d+\.)\s").alias("list_items"), F.floor(T.count(t, "```") / 2).cast("int").alias("code_blocks"), T.count(t, "[0-9]").alias("digits"), T.count(t, "[A-Z]").alias("capitals"))


DENSE = T.DENSE


def sql_tokens(x: str) -> str:
    """The estimate in DuckDB SQL."""
    n = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    code = T.CODE_MARK.replace("'", "''")
    return f"""(case when length({x}) = 0 then 0 else greatest(1, cast(floor((length({x}) - {n(DENSE)}) / cast(case when regexp_matches({x}, '^\\s*[\\[{{]') and json_valid({x}) then 3.2 when {n(code)} > length({x}) / 500 then 3.5 else 4.0 end as double) + {n(DENSE)} / 1.5::double + 0.5::double) as bigint)
  + len(regexp_extract_all(array_to_string(regexp_extract_all({x}, 'https?://\\S+'), ' '), '[/?&]')) + 2 * {n("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")}) end)"""


_LINES = "(select concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', upper(event_type), ' user=', user_id) as line, * from events)"

QUERIES = {
    "content_profile": (lambda s, d: profile(spread(table(s, d, "documents")), ["lang", "source"]).select("lang", "source", "n", "tokens"), f"select lang, source, count(*) as n, cast(sum({sql_tokens('text')}) as bigint) as tokens from documents group by 1, 2"),
    "page_types": (lambda s, d: table(s, d, "pages").select(D.content_type("html").alias("c")).groupBy("c.type").agg(F.count("*").alias("n"), F.round(F.min("c.confidence"), 6).alias("low")), "select 'html' as type, count(*) as n, round(min(least(1.0::double, 0.5::double + 0.3 * cast(regexp_matches(h, '(?i)<html[\\s>]') as integer) + 0.1 * cast(regexp_matches(h, '(?i)<head[\\s>]') as integer) + 0.1 * cast(regexp_matches(h, '(?i)<body[\\s>]') as integer) + least(0.3::double, 0.03::double * len(regexp_extract_all(h, '(?i)<(div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[\\s>]'))))), 6) as low from (select substr(html, 1, 3000) as h from pages)"),
    "html_waste": (lambda s, d: table(s, d, "pages").select("page_id", T.waste("html")["html"].alias("tokens")), "select page_id, case when length(w) = 0 then 0 else " + sql_tokens("w")[1:-1].split("then 0 else ", 1)[1].rsplit(" end", 1)[0] + " end as tokens from (select page_id, array_to_string(list_concat(regexp_extract_all(html, '<[^>]+>'), regexp_extract_all(html, '<!--[\\s\\S]*?-->')), '') as w from pages)"),
    "whitespace_runs": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.expr("concat(text, repeat(' ', cast(doc_id % 7 as int)), 'x', repeat('\n', cast(doc_id % 5 as int)), if(doc_id % 3 = 0, concat(md5(text), md5(text)), ''))").alias("text"))
        .select("doc_id", T.count(F.col("text"), T.BLANKS).cast("long").alias("runs"), T.waste("text")["base64"].alias("base64")).select("doc_id", "runs", (F.col("base64") > 0).alias("base64")).where("runs > 0 or base64"),
        """
        with t as (select doc_id, text || repeat(' ', doc_id % 7) || 'x' || repeat(chr(10), doc_id % 5) || case when doc_id % 3 = 0 then md5(text) || md5(text) else '' end as text from documents),
        r as (select doc_id, len(regexp_extract_all(text, '[ \\t]{4,}|\\n{3,}')) as runs, len(regexp_extract_all(text, '[A-Za-z0-9+/]{50,}={0,2}')) > 0 as base64 from t)
        select doc_id, runs, base64 from r where runs > 0 or base64
        """,
    ),
    "volatile_words": (lambda s, d: table(s, d, "events").select(F.explode(D.volatile_tokens(F.concat_ws(" ", F.md5(F.col("user_id").cast("string")), F.lit("at"), F.date_format("ts", "yyyy-MM-dd"), F.lit("done.")))).alias("v")).groupBy("v.label").agg(F.count("*").alias("n")), "select 'hex_hash' as label, count(*) as n from events union all select 'iso8601', count(*) from events"),
    "alignment_score": (lambda s, d: table(s, d, "conversations").where("role = 'system'").select("conv_id", D.alignment_score(F.size(D.volatile_tokens("text"))).alias("score")), "select conv_id, 100.0::double as score from conversations where role = 'system'"),
    "log_line_levels": (lambda s, d: table(s, d, "events").select(D.line_importance(F.concat(F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string")), "log")["category"].alias("category")).groupBy("category").agg(F.count("*").alias("n")), "select case when event_type = 'error' then 'error' end as category, count(*) as n from events group by 1"),
    "synthetic_log_type": (lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.upper("event_type")).alias("l")))), lambda x: x["l"]), "\n").alias("t")).select("user_id", D.content_type("t")["type"].alias("type")), "select user_id, 'log' as type from events group by 1"),
    "repeated_lines": (lambda s, d: repeated_lines(table(s, d, "documents")).select("hash", "texts"), "select md5(line) as hash, count(*) as texts from (select distinct doc_id, unnest(string_split(text, chr(10))) as line from documents) where trim(line) <> '' group by line having count(*) > 1"),
    "prompt_features": (lambda s, d: features(table(s, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k").select("k", "chars", "questions", "digits", "capitals"), "select conv_id || '-' || turn as k, cast(length(text) as integer) as chars, cast(len(regexp_extract_all(text, '\\?')) as integer) as questions, cast(len(regexp_extract_all(text, '[0-9]')) as integer) as digits, cast(len(regexp_extract_all(text, '[A-Z]')) as integer) as capitals from conversations"),
    "content_keys": (lambda s, d: table(s, d, "documents").select("doc_id", T.content_key("text").alias("key"), T.short_hash("text").alias("short"), T.marker(T.content_key("text", 12)).alias("marker")), "select doc_id, left(sha256(text), 24) as key, left(md5(text), 16) as short, '<<ccr:' || left(sha256(text), 12) || '>>' as marker from documents"),
    "echo_ratio": (lambda s, d: table(s, d, "benchmark").select("item_id", F.round(T.echo_ratio("text", F.lower(F.col("text")), 3), 6).alias("ratio")), "select item_id, 1.0::double as ratio from benchmark"),
    "image_tokens": (lambda s, d: table(s, d, "part").select("p_partkey", T.image_tokens_tiles(F.col("p_size") * 100, F.col("p_size") * 60 + 300).alias("tiles"), T.image_tokens_area(F.col("p_size") * 100, F.col("p_size") * 60 + 300).alias("area")), "with a as (select p_partkey, p_size * 100 as w, p_size * 60 + 300 as h from part), b as (select *, least(1.0::double, 2048::double / greatest(w, h)) as f, least(1.0::double, 1568::double / greatest(w, h)) as g from a), c as (select *, least(1.0::double, 768::double / least(w * f, h * f)) as k from b) select p_partkey, cast(ceil(floor(w * f * k) / 512) * ceil(floor(h * f * k) / 512) * 170 + 85 as bigint) as tiles, cast(floor(floor(w * g) * floor(h * g) / 750) as bigint) as area from c"),
    "bucket_starts": (lambda s, d: table(s, d, "orders").select("o_orderkey", *[F.date_trunc(b, "o_orderdate").cast("timestamp_ntz").alias(b) for b in ("week", "month")]), "select o_orderkey, cast(date_trunc('week', o_orderdate) as timestamp) as week, cast(date_trunc('month', o_orderdate) as timestamp) as month from orders"),
    "ttl_status": (lambda s, d: table(s, d, "events").groupBy(F.when(F.col("ts") + F.expr("interval 1800 seconds") < F.lit("2024-01-20").cast("timestamp_ntz"), "expired").otherwise("live").alias("status")).agg(F.count("*").alias("n")), "select case when ts + interval 1800 seconds < timestamp '2024-01-20' then 'expired' else 'live' end as status, count(*) as n from events group by 1"),
}
