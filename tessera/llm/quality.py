"""Quality rules: learned decision lists over document statistics.

Every statistic is a DataFrame expression over the whole text. A decision list is learned from labelled statistics by
sequential covering: a rule grows condition by condition (feature at most or above a threshold, chosen by information
gain over the rows that no earlier rule covers), is pruned on rows held back from growing, and is kept while it is
precise enough. The list becomes one ordered Spark conditional expression. Only counts by (feature, threshold bin)
reach the driver: at most features * (bins + 1) * 2 rows for each grown condition.

Defined results: a null or empty text has no words and fails the base rules; labels that are null, or whose document
is absent, teach nothing; a document labelled more than once counts once, bad if any label says so; with no labels, or
no rule that is precise enough, the list is empty and keeps every document that passes the base rules; repeated rows
are judged alike; columns other than doc_id and text are never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, WORD, let, read, text_of, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: About so many labelled documents at most teach the list, chosen by a hash of their id.
SAMPLE = 20_000
BINS = 24
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule stays if so large a share of the labelled rows that it covers is bad, and it covers so many bad ones.
PRECISION = 0.95
SUPPORT = 5


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: What rules test, over the columns of `statistics`; never null.
FEATURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "dup_lines_per_word": lambda: _ratio("n_dup_lines", "n_words"),
    "repeat_words": lambda: _ratio("n_repeat_words", "n_words"),
    "upper": lambda: _ratio("n_upper", "word_chars"),
    "marks_per_word": lambda: _ratio("n_marks", "n_words"),
    "digits": lambda: _ratio("n_digits", "word_chars"),
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits")


def _windows(words: Column, n: int = WINDOW) -> Column:
    """A hash for each window of n words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)])))


def _in_repeats(windows: Column, n: int = WINDOW) -> Column:
    """Number of words that lie in a window found twice or more. Only texts that have one sort their windows."""
    by_hash = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    places = let(by_hash, lambda s: F.array_sort(F.filter(
        F.transform(s, lambda x, k: F.when(F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"])), lambda p: p.isNotNull())))
    covered = let(places, lambda d: F.aggregate(F.transform(d, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(d, k + 1) - p, F.lit(n)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as a struct column _row, with one long column for each of STATISTICS."""
    t = F.col("_t")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), text_of(docs[text]).alias("_t"))
    trimmed = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    rows = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    rows = rows.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))).withColumn("_win", _windows(F.col("_words")))
    found = {
        "n_words": F.size("_words"), "word_chars": F.length(F.regexp_replace(t, SPACE, "")), "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": _in_repeats(F.col("_win")),
        "n_upper": F.regexp_count(t, F.lit("[A-Z]")), "n_marks": F.regexp_count(t, F.lit("[!?]")), "n_digits": F.regexp_count(t, F.lit("[0-9]")),
    }
    return rows.select("_row", *[c.cast("long").alias(k) for k, c in found.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _passed(value: Column, thresholds: list[float]) -> Column:
    """Number of thresholds below value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda t: t < value)) if thresholds else F.lit(0)


def _holds(condition: tuple[int, str, int]) -> Column:
    feature, side, place = condition
    at = F.get(F.col("_bins"), F.lit(feature))
    return at <= place if side == "<=" else at > place


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out &= _holds(c)
    return out


def _gain(p: int, n: int, P: int, N: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(P / (P + N))) if p and P else 0.0


def _grow(rows: DataFrame, places: list[list[float]], barred: set[int]) -> list[tuple[int, str, int]]:
    """The conditions of most gain; of equal ones that whose threshold lies in the widest gap between thresholds."""
    rule: list[tuple[int, str, int]] = []
    while len(rule) < MAX_CONDITIONS:
        got = rows.where(_all(rule)).select("_bad", F.posexplode("_bins").alias("f", "b")).groupBy("f", "b").agg(F.sum("_bad").alias("p"), F.count("*").alias("n")).collect()
        counts = {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in got}
        P, N = (sum(v[i] for (f, _), v in counts.items() if f == 0) for i in (0, 1))
        if not P or not N:
            break
        best, chosen = (1e-9, 0.0), None
        for f, marks in enumerate(places):
            p = n = 0
            for b in range(len(marks) if f not in barred else 0):
                p, n = p + counts.get((f, b), (0, 0))[0], n + counts.get((f, b), (0, 0))[1]
                gap = (marks[min(b + 1, len(marks) - 1)] - marks[b]) / ((marks[-1] - marks[0]) or 1.0)
                for side, x, y in (("<=", p, n), (">", P - p, N - n)):
                    if (g := (round(_gain(x, y, P, N), 9), gap)) > best:
                        best, chosen = g, (f, side, b)
        if chosen is None:
            break
        rule.append(chosen)
    return rule


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[tuple[str, str, float]]]:
    """An ordered list of rules that reject; a rule is a conjunction of (feature, '<=' or '>', threshold)."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    known = marked.count()
    if known > sample:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / known))
    # at most about `sample` rows: small enough for every executor
    met = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    stats = statistics(met)
    names = list(FEATURES)
    rows = stats.select(F.array(*[FEATURES[k]() for k in names]).alias("_x"), (F.col("_row._q") == 0).cast("int").alias("_bad"), (F.pmod(F.xxhash64(F.lit("grow"), F.col("_row.doc_id")), F.lit(3)) > 0).alias("_grow"), base_failed().alias("_base"))
    # written before rows are dropped: Spark would push a filter on statistics below the join, to all documents
    rows = written(rows, "quality-sample").where("not _base").coalesce(2)
    marks = [i / BINS for i in range(1, BINS)]
    cuts = rows.groupBy("_bad").agg(*[F.percentile_approx(F.col("_x")[i], marks).alias(k) for i, k in enumerate(names)]).collect()
    places = [sorted({x for r in cuts for x in r[k] or []}) for k in names]
    if not any(places):
        return []
    bins = F.array(*[_passed(F.col("_x")[i], p) for i, p in enumerate(places)])
    left = rows.select("_bad", "_grow", bins.alias("_bins"))
    found: list[list[tuple[int, str, int]]] = []
    barred: set[int] = set()  # features whose rule turned out not to be precise
    while len(found) < MAX_RULES:
        rule = _grow(left.where("_grow"), places, barred)
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        seen = left.groupBy("_grow").agg(*[F.sum(F.when(_all(h), F.col("_bad") if i else 1 - F.col("_bad"))).alias(f"{'np'[i]}{k}") for k, h in enumerate(heads) for i in (0, 1)]).collect()
        count = lambda name, held: sum(r[name] or 0 for r in seen if held is None or r["_grow"] != held)
        worth = lambda k: (count(f"p{k}", True) - count(f"n{k}", True)) / max(1, count(f"p{k}", True) + count(f"n{k}", True))
        k = max(range(len(heads)), key=lambda k: (worth(k), -k)) if count(f"p{len(heads) - 1}", True) else len(heads) - 1
        p, n = count(f"p{k}", None), count(f"n{k}", None)
        if p < SUPPORT or p < PRECISION * (p + n):
            barred.add(rule[0][0])
            continue
        found.append(heads[k])
        left = left.where(~_all(heads[k]))
    return [[(names[f], side, places[f][b]) for f, side, b in rule] for rule in found]


def listed(rules: list[list[tuple[str, str, float]]]) -> Column:
    """The list as one conditional: the number (from 1) of the first rule that holds, null if none does."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for name, side, x in rule:
            holds &= FEATURES[name]() <= F.lit(float(x)) if side == "<=" else FEATURES[name]() > F.lit(float(x))
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs as _row, with STATISTICS, base_failed, rule (number of the rule that rejects) and kept."""
    rules = learn(docs, labels, sample)
    judged = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), listed(rules)))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, as they are, that the rules keep."""
    return quality_rules(docs, labels).where("kept").select("_row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs, read(spark, sf_dir, "labels"))
    return out.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
