"""How much of a text survives: token overlap, n-grams, longest common runs, facts."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions.text import all_of, tokens_simple
from tessera.sources.tables import spread, table

_WORD = re.compile("[a-z0-9_]+")
FACTS = r"https?://\S+|[A-Za-z_./-]+\.[A-Za-z]{1,4}\b|[0-9a-f]{8,}|\b\d[\d.,]*\d\b"


def exact_match(a: Column, b: Column) -> Column:
    tidy = lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    return tidy(a) == tidy(b)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("common", "n", "m")]))
def _overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Words that two texts share, as multisets, and how many each has: one count of either text's words."""

    def one(x: str | None, y: str | None) -> tuple[int, int, int]:
        p, q = (Counter(_WORD.findall((t or "").lower())) for t in (x, y))
        return sum((p & q).values()), p.total(), q.total()

    return pd.DataFrame([one(x, y) for x, y in zip(a, b, strict=True)], columns=["common", "n", "m"])


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' words, as multisets; 1 for two without words. Linear in the texts, which array functions aren't."""

    def of(p: Column) -> Column:
        return F.when(p["n"] + p["m"] == 0, 1.0).otherwise(2.0 * p["common"] / (p["n"] + p["m"]).cast("double"))

    return of(_overlap(a, b))


def fact_recall(original: Column, kept: Column) -> Column:
    """Struct (facts, found): numbers, paths, links and ids of a text, and those that what is kept of it still holds."""
    facts = F.array_distinct(all_of(original, FACTS))
    return F.struct(F.size(facts).alias("facts"), F.size(F.filter(facts, lambda f: F.contains(kept, f))).alias("found"))


@F.pandas_udf(DoubleType())
def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
    """F of the longest common subsequence of two texts' words."""

    def one(x: str | None, y: str | None) -> float:
        p, q = (x or "").lower().split(), (y or "").lower().split()
        if not p or not q:
            return 0.0
        at: dict[str, int] = {}
        for i, w in enumerate(q):
            at[w] = at.get(w, 0) | 1 << i
        whole = (1 << len(q)) - 1
        row = whole  # bits of q; a zero is a place where a longer subsequence ends, so each word of p is one step over all of q
        for w in p:
            met = row & at.get(w, 0)
            row = (row + met | row - met) & whole
        n = len(q) - row.bit_count()
        return 2 * n / (len(p) + len(q)) if n else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def bleu(a: pd.Series, b: pd.Series) -> pd.Series:
    """Geometric mean of the clipped shares of a's 1- to 4-word runs that b holds, less a penalty for being shorter."""

    def one(x: str | None, y: str | None) -> float:
        p, q = (x or "").lower().split(), (y or "").lower().split()
        if not p or not q:
            return 0.0
        logs = []
        for n in range(1, min(4, len(p), len(q)) + 1):
            g, h = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (p, q))
            logs.append(math.log(max(sum((g & h).values()), 0.1) / sum(g.values())))
        return math.exp(sum(logs) / len(logs)) * (1.0 if len(p) >= len(q) else math.exp(1 - len(q) / len(p)))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def suite(cases: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Means over cases: F1, exact matches, tokens kept."""
    x = cases.select(*by, token_f1(F.col(a), F.col(b)).alias("f1"), exact_match(F.col(a), F.col(b)).cast("int").alias("same"), tokens_simple(F.length(a)).alias("n"), tokens_simple(F.length(b)).alias("m"))
    return x.groupBy(*by).agg(F.count("*").alias("cases"), F.round(F.avg("f1"), 6).alias("f1"), F.sum("same").cast("long").alias("same"), F.round(F.sum("m") / F.sum("n"), 6).alias("ratio"))


def needle_grid(carriers: DataFrame, carrier: str, needles: list[str], limit: int) -> DataFrame:
    """Of needles put at the front, the middle or the back of carriers cut to limit characters: the share that survives."""
    places = F.array(F.lit("front"), F.lit("middle"), F.lit("back"))
    grid = carriers.select(carrier, F.explode(places).alias("place")).select(carrier, "place", F.explode(F.array(*[F.lit(n) for n in needles])).alias("needle"))
    half = F.floor(F.length(carrier) / 2).cast("int")
    text = F.when(F.col("place") == "front", F.concat(F.col("needle"), F.col(carrier))).when(F.col("place") == "back", F.concat(F.col(carrier), F.col("needle"))).otherwise(F.concat(F.left(carrier, half), F.col("needle"), F.substr(carrier, half + 1)))
    kept = F.concat(F.left(text, F.lit(limit // 2)), F.right(text, F.lit(limit // 2)))
    return grid.select("place", "needle", F.contains(kept, F.col("needle")).alias("hit")).groupBy("place", "needle").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("int")).cast("long").alias("hits"))


_PAIR = "(select doc_id, lang, length(text) as n, length(text) // 2 as m, lower(text) as a, lower(left(text, length(text) // 2)) as b from documents)"
_F1 = f"""
    t as (select *, regexp_extract_all(a, '[a-z0-9_]+') as x, regexp_extract_all(b, '[a-z0-9_]+') as y from {_PAIR}),
    c as (
        select doc_id, sum(least(n, m)) as common
        from (select doc_id, w, count(*) as n from (select doc_id, unnest(x) as w from t) group by 1, 2)
        join (select doc_id, w, count(*) as m from (select doc_id, unnest(y) as w from t) group by 1, 2) using (doc_id, w) group by 1
    ),
    f as (select *, case when coalesce(len(x), 0) + coalesce(len(y), 0) = 0 then 1.0::double else 2.0::double * coalesce(common, 0) / (len(x) + len(y)) end as f1 from t left join c using (doc_id))
"""


def _halves(s, d) -> DataFrame:
    """Whole texts and their first halves."""
    return spread(table(s, d, "documents")).select("doc_id", "lang", F.lower("text").alias("a"), F.lower(F.left("text", F.floor(F.length("text") / 2).cast("int"))).alias("b"))


QUERIES = {
    "token_f1": (lambda s, d: _halves(s, d).select("doc_id", F.round(token_f1(F.col("a"), F.col("b")), 6).alias("f1")), f"with {_F1} select doc_id, round(f1, 6) as f1 from f"),
    "fact_recall": (lambda s, d: table(s, d, "documents").select("doc_id", fact_recall(F.col("text"), F.left("text", F.floor(F.length("text") / 2).cast("int"))).alias("r")).select("doc_id", "r.*").where("facts > 0"), "select doc_id, cast(len(f) as integer) as facts, cast(len(list_filter(f, lambda x: contains(left(text, length(text) // 2), x))) as integer) as found from (select doc_id, text, list_distinct(regexp_extract_all(text, 'https?://\\S+|[A-Za-z_./-]+\\.[A-Za-z]{1,4}\\b|[0-9a-f]{8,}|\\b\\d[\\d.,]*\\d\\b')) as f from documents) where len(f) > 0"),
    "eval_suite": (
        lambda s, d: suite(_halves(s, d), "a", "b", ["lang"]),
        f"""
        with {_F1} select lang, count(*) as cases, round(avg(f1), 6) as f1,
            cast(count(*) filter (trim(regexp_replace(a, '[\\s\x0b]+', ' ', 'g')) = trim(regexp_replace(b, '[\\s\x0b]+', ' ', 'g'))) as bigint) as same,
            round(sum(case when m = 0 then 0 else greatest(1, floor(m / 4.0::double + 0.5)) end) / sum(case when n = 0 then 0 else greatest(1, floor(n / 4.0::double + 0.5)) end), 6) as ratio
        from f group by 1
        """,
    ),
    "rouge_l": (lambda s, d: _halves(s, d).select("doc_id", F.round(rouge_l("a", "b"), 6).alias("rouge")), None),
    "bleu": (lambda s, d: _halves(s, d).select("doc_id", F.round(bleu("b", "a"), 6).alias("bleu")), None),
    "needle_grid": (lambda s, d: needle_grid(table(s, d, "documents"), "text", ["[NEEDLE-4711]"], 1000), "with c as (select text, length(text) // 2 as h from documents), g as (select 'front' as place, '[NEEDLE-4711]' || text as t from c union all select 'back', text || '[NEEDLE-4711]' from c union all select 'middle', left(text, h) || '[NEEDLE-4711]' || substr(text, h + 1) from c) select place, '[NEEDLE-4711]' as needle, count(*) as n, cast(count(*) filter (contains(left(t, 500) || right(t, 500), '[NEEDLE-4711]')) as bigint) as hits from g group by 1"),
}
