"""Relevance: BM25, vectors, hybrids, caches by likeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions.detect import query_alpha
from tessera.functions.text import bm25_terms
from tessera.operators.vectors import matcher, unpacked
from tessera.sources.tables import spread, table, written

# Saturation, length weight, raw score that counts as 1, bonus and length of long matches.
K1, B, TOP_RAW, BONUS, LONG = 1.5, 0.75, 10.0, 0.3, 8
#: Bytes of query vectors that go to a task at once.
BLOCK = 64_000_000


def bm25(items: DataFrame, item: str, text: str, queries: DataFrame, query: str, query_text: str) -> DataFrame:
    """(query, item, score, matched): BM25 in [0, 1] for pairs with a term in common, with a bonus for long terms.

    Items are cut into (item, term, times) once; only terms of queries are shuffled on, as the join with the queries'
    terms comes before the aggregation by pair.
    """
    docs = items.select(item, bm25_terms(text).alias("_t")).withColumn("_len", F.size("_t"))
    size = docs.agg(F.count("*").alias("n"), F.avg("_len").alias("avg")).first()
    terms = queries.select(query, F.explode(bm25_terms(query_text)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("qf"))
    wanted = terms.select("term").distinct()
    post = docs.select(item, "_len", F.explode("_t").alias("term")).join(wanted, "term", "left_semi").groupBy("term", item, "_len").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.lit(size["avg"]))) * F.col("qf")
    got = post.join(df, "term").join(terms, "term").groupBy(query, item).agg(F.sum(weight).alias("raw"), F.max((F.length("term") >= LONG).cast("int")).alias("long"), F.count("*").alias("matched"))
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("raw") / TOP_RAW) + F.col("long") * BONUS)
    return got.select(query, item, "raw", score.alias("score"), "matched")


def top(scored: DataFrame, by: str, score: str, item: str, k: int) -> DataFrame:
    """The k best items of each query; Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def nearest(items: DataFrame, item: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, least: float | None = None, max_queries: int = 160_000, other: bool = False) -> DataFrame:
    """The k items of the highest cosine to each query, exactly; with `other`, an item of the query's own key is none.

    The queries go to every task as matrices, in blocks of about max_queries or 64 MB, dealt by their key; each block is
    one pass over the items, and where there are several its result is written to the shared folder before the next
    begins. A task multiplies matrices and hands on its k best of each query only (see `vectors`).
    """
    spark, given, rows = items.sparkSession, queries.select(query, F.col(query_vector).alias("_q")), items.select(item, F.col(vector).alias("_v"))
    if other:
        given, rows = given.where(F.col(query).isNotNull()), rows.where(F.col(item).isNotNull())
    size = given.agg(F.count("*").alias("n"), F.max(F.size("_q")).alias("d")).first()
    blocks = max(1, -(-size["n"] // max_queries), -(-size["n"] * 8 * max(size["d"] or 1, 1) // BLOCK))
    rows, cores = spread(rows), spark.sparkContext.defaultParallelism
    tasks = rows.rdd.getNumPartitions()
    # each task hands on k rows a query, and a last wave of few tasks leaves cores idle
    rows = (rows.coalesce(4 * cores) if tasks > 4 * cores else rows.repartition(2 * cores) if -(-tasks // cores) * cores > 1.1 * tasks else rows).sortWithinPartitions(item)
    shape = StructType([given.schema[query], items.schema[item], StructField("score", DoubleType())])

    def block(held: DataFrame) -> DataFrame:
        got = held.toArrow()
        asked = got.column(0).combine_chunks(), unpacked(got.column(1))
        sent, arrow = spark.sparkContext.broadcast(asked), to_arrow_schema(shape)
        scored = rows.mapInArrow(lambda batches: matcher(sent.value, k, least, other, arrow)(batches), shape)
        return top(scored if least is None else scored.where(F.col("score") >= least), query, "score", item, k)

    if blocks == 1:
        return block(given)
    return reduce(DataFrame.unionAll, [written(block(given.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == i)), "nearest") for i in range(blocks)])


def hybrid(exact: DataFrame, semantic: DataFrame, query: str, item: str, alpha: Column) -> DataFrame:
    """alpha of the exact score and the rest of the semantic one; a pair without one has 0 for it."""
    both = exact.select(query, item, F.col("score").alias("a")).join(semantic.select(query, item, F.col("score").alias("b")), [query, item], "full_outer")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select(query, item, (alpha * a + (1 - alpha) * b).alias("score"))


def cache_hits(entries: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, least: float = 0.95, other: bool = False) -> DataFrame:
    """Each query's nearest entry if it is near enough, else null."""
    best = nearest(entries, key, vector, queries, query, query_vector, 1, least, other=other)
    return queries.select(query).join(best.select(query, key, "score"), query, "left")


def keyword_overlap(queries: DataFrame, query: str, query_text: str, items: DataFrame, item: str, text: str, least: int = 2) -> DataFrame:
    """Pairs with at least `least` distinct terms in common, and the share of the query's terms."""
    q = queries.select(query, F.array_distinct(bm25_terms(query_text)).alias("_t")).select(query, F.size("_t").alias("_n"), F.explode("_t").alias("term"))
    i = items.select(item, F.explode(F.array_distinct(bm25_terms(text))).alias("term"))
    return q.join(i, "term").groupBy(query, item, "_n").agg(F.count("*").alias("common")).where(F.col("common") >= least).select(query, item, "common", F.round(F.col("common") / F.col("_n"), 6).alias("share"))


def anchors_of(text: Column) -> Column:
    """Ids, host names, addresses and quoted words of a query that an item should be kept for."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b\d{4,}\b|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+\b"), F.lit(0))
    quoted = F.regexp_extract_all(F.lower(text), F.lit("\"([^\"]{2,})\"|'([^']{2,})'"), F.lit(1))
    return F.array_distinct(F.concat(found, F.filter(quoted, lambda x: x != "")))


def matches_anchor(item: Column, anchors: Column) -> Column:
    return F.exists(anchors, lambda a: F.contains(F.lower(item), a))


def near_pairs_by_simhash(rows: DataFrame, key: str, prints: str, radius: int = 3) -> DataFrame:
    """Pairs of keys whose 64-bit fingerprints differ in at most radius (3) bits: they share one of four bands of 16 bits."""
    bands = F.array(*[F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(F.col(prints), 16 * k).bitwiseAND(0xFFFF).alias("v")) for k in range(4)])
    x = rows.select(key, prints, F.explode(bands).alias("band"))
    y = x.select(F.col(key).alias("_k"), F.col(prints).alias("_p"), F.col("band").alias("_b"))
    met = x.join(y, (F.col("band") == F.col("_b")) & (F.col(key) < F.col("_k")))
    return met.where(F.bit_count(F.col(prints).bitwiseXOR(F.col("_p"))) <= radius).select(F.col(key).alias("a"), F.col("_k").alias("b")).distinct()


_T = "regexp_extract_all(lower({x}), '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|\\b\\d{{4,}}\\b|[a-z0-9_]+')"


def _sql_bm25() -> str:
    return f"""(with d as (select doc_id, {_T.format(x='text')} as t from documents), n as (select count(*) as n, avg(len(t)) as a from d),
q as (select item_id, term, count(*) as qf from (select item_id, unnest({_T.format(x='text')}) as term from benchmark) group by 1, 2),
p as (select term, doc_id, dl, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from d) where term in (select term from q) group by 1, 2, 3),
f as (select term, count(*) as df from p group by 1)
select item_id, doc_id, sum(ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / a)) * qf) as raw, max(case when length(term) >= 8 then 1 else 0 end) as l, count(*) as matched from p join f using (term) join q using (term), n group by 1, 2)"""


QUERIES = {
    "bm25_top": (lambda s, d: top(bm25(spread(table(s, d, "documents")), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text").withColumn("r", F.round("raw", 6)), "item_id", "r", "doc_id", 5).select("item_id", "doc_id", F.round("raw", 4).alias("raw"), F.round("score", 4).alias("score"), "place"), f"select item_id, doc_id, round(raw, 4) as raw, round(least(1.0::double, least(1.0::double, raw / 10) + l * 0.3::double), 4) as score, cast(place as integer) as place from (select *, row_number() over (partition by item_id order by round(raw, 6) desc, doc_id) as place from {_sql_bm25()}) where place <= 5"),
    "cosine_top": (lambda s, d: nearest(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), "q", "qv", 10).select("q", "vec_id", F.round("score", 6).alias("score"), "place"), "select q, vec_id, round(score, 6) as score, cast(place as integer) as place from (select a.vec_id as q, b.vec_id, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as score, row_number() over (partition by a.vec_id order by list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) desc, b.vec_id) as place from embeddings a, embeddings b where a.vec_id % 20 = 0) where place <= 10"),
    "semantic_cache": (lambda s, d: cache_hits(table(s, d, "embeddings"), "vec_id", "embedding", table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), "q", "qv", 0.3, other=True).select("q", "vec_id"), "with p as (select a.vec_id as q, b.vec_id, list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as c from embeddings a, embeddings b where a.vec_id % 20 = 0 and b.vec_id <> a.vec_id), t as (select q, vec_id from p where c >= 0.3 qualify row_number() over (partition by q order by c desc, vec_id) = 1) select e.vec_id as q, t.vec_id from embeddings e left join t on e.vec_id = t.q where e.vec_id % 20 = 0"),
    "hybrid_alpha": (lambda s, d: table(s, d, "events").select(query_alpha(F.concat(F.lit("find "), F.col("user_id").cast("string"), F.lit(" and "), F.col("event_id").cast("string"))).alias("alpha")).groupBy("alpha").agg(F.count("*").alias("n")), "select cast(case when a + b >= 2 then 0.75 when a + b = 1 then 0.65 else 0.5 end as double) as alpha, count(*) as n from (select case when user_id >= 1000 then 1 else 0 end as a, case when event_id >= 1000 then 1 else 0 end as b from events) group by 1"),
    "keyword_overlap": (lambda s, d: keyword_overlap(table(s, d, "benchmark"), "item_id", "text", table(s, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", "text", 4), f"with q as (select item_id, len(list_distinct(t)) as n, unnest(list_distinct(t)) as term from (select item_id, {_T.format(x='text')} as t from benchmark)), i as (select distinct conv_id || '-' || turn as k, unnest({_T.format(x='text')}) as term from conversations) select item_id, k, count(*) as common, round(count(*) / any_value(n), 6) as share from q join i using (term) group by 1, 2 having count(*) >= 4"),
    "query_anchors": (lambda s, d: table(s, d, "orders").select("o_orderkey", F.explode(anchors_of(F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" of 'cust "), F.col("o_custkey").cast("string"), F.lit("' at db1.example.com")))).alias("a")).groupBy("a").agg(F.count("*").alias("n")).where("n > 1000"), "select 'db1.example.com' as a, count(*) as n from orders having count(*) > 1000"),
}
