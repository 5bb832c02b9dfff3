"""Token estimates, waste, hashes and other scalars over text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the estimator.
CHARS_PER_TOKEN, CHARS_PER_TOKEN_CODE, CHARS_PER_TOKEN_JSON, CHARS_PER_TOKEN_DENSE = 4.0, 3.5, 3.2, 1.5
CODE_MARK = r"(?m)(?:def |class |function |const |let |var |import |from |if \(|for \(|while \(|switch \(|try \{|catch \(|=>|->|\{\{|\}\}|;$)"
DENSE = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}\x{20000}-\x{2a6df}]"
URL = r"https?://\S+"
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
# Fixed patterns of waste.
TAG, COMMENT, BASE64, BLANKS, JSON_BLOCK = r"<[^>]+>", r"<!--[\s\S]*?-->", r"[A-Za-z0-9+/]{50,}={0,2}", r"[ \t]{4,}|\n{3,}", r"\{[\s\S]{500,}\}"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where lambdas in body use it again and again."""
    return F.transform(F.array(value), body).getItem(0)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def all_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def parses_as_json(text: str | Column) -> Column:
    return F.try_parse_json(_c(text)).isNotNull()


def tokens(text: str | Column, chars_per_token: float | None = None) -> Column:
    """Estimated tokens of a text: its characters by the ratio of its kind, dense scripts apart, with a surcharge for URLs and UUIDs."""
    t = _c(text)
    if chars_per_token:
        return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(t) / chars_per_token + 0.5))).cast("long")
    dense = count(t, DENSE)
    ratio = F.when(t.rlike(r"^\s*[\[{]") & parses_as_json(t), CHARS_PER_TOKEN_JSON).when(count(t, CODE_MARK) > F.length(t) / 500, CHARS_PER_TOKEN_CODE).otherwise(CHARS_PER_TOKEN)
    base = F.floor((F.length(t) - dense) / ratio + dense / CHARS_PER_TOKEN_DENSE + 0.5)
    extra = count(F.array_join(all_of(t, URL), " "), "[/?&]") + 2 * count(t, UUID)
    return F.when(F.coalesce(F.length(t), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), base + extra)).cast("long")


def tokens_simple(length: Column) -> Column:
    """The estimate of plain Latin text of that many characters."""
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(length / CHARS_PER_TOKEN + 0.5))).cast("long")


def waste(text: str | Column) -> Column:
    """Struct of tokens spent on HTML, base64, blank runs and large JSON blocks."""
    t = F.coalesce(_c(text), F.lit(""))
    blanks = all_of(t, BLANKS)
    blocks = F.transform(all_of(t, JSON_BLOCK), lambda b: tokens(b))
    return F.struct(
        tokens(F.array_join(F.concat(all_of(t, TAG), all_of(t, COMMENT)), "")).alias("html"),
        tokens(F.array_join(all_of(t, BASE64), "")).alias("base64"),
        F.greatest(F.lit(0), tokens(F.array_join(blanks, "")) - tokens(F.array_join(blanks, " "))).alias("whitespace"),
        F.aggregate(F.filter(blocks, lambda n: n > 500), F.lit(0).cast("long"), lambda a, n: a + n).alias("json_bloat"),
    )


def short_hash(text: str | Column, length: int = 16) -> Column:
    return F.substring(F.md5(_c(text)), 1, length)


def content_key(text: str | Column, length: int = 24) -> Column:
    """Key of a stored original."""
    return F.substring(F.sha2(_c(text), 256), 1, length)


def call_key(name: str | Column, arguments: str | Column) -> Column:
    """One key for calls of a tool that differ in the order of their JSON arguments at most."""
    parsed = F.try_parse_json(_c(arguments))
    return short_hash(F.concat(_c(name), F.lit("\x00"), F.coalesce(F.to_json(parsed), _c(arguments))))


def marker(key: str | Column) -> Column:
    return F.concat(F.lit("<<ccr:"), _c(key), F.lit(">>"))


def markers_in(text: str | Column) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("<<ccr:([^>]+)>>"), F.lit(1))


def words(text: str | Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return all_of(F.lower(_c(text)), r"[a-z0-9_]+")


def bm25_terms(text: str | Column) -> Column:
    """UUIDs, numbers of four digits or more, and words, lower-cased."""
    return all_of(F.lower(_c(text)), r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b\d{4,}\b|[a-z0-9_]+")


def entropy(text: str | Column) -> Column:
    """Shannon entropy of a text's characters over the most that many different characters can have; 0 for fewer than two."""

    def of(chars: Column) -> Column:
        kinds = F.array_distinct(chars)
        share = F.transform(kinds, lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        bits = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
        return F.when(F.size(kinds) < 2, 0.0).otherwise(bits / F.log2(F.size(kinds).cast("double")))

    return let(F.split(_c(text), ""), of)


def shingles(tokens_: Column, k: int) -> Column:
    """Distinct runs of k words, joined by a space; all words as one where there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(tokens_) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(let(tokens_, runs)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def echo_ratio(output: str | Column, context: str | Column, n: int = 8) -> Column:
    """Share of an output's n-word runs that its context holds."""
    a, b = shingles(words(output), n), shingles(words(context), n)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def redact_images(text: str | Column) -> Column:
    return F.regexp_replace(_c(text), r"data:image/[a-z+.-]+;base64,[A-Za-z0-9+/=]+", "[image]")


def image_tokens_tiles(width: Column, height: Column, detail: str = "high") -> Column:
    """Tokens of an image that is fitted into 2048 and then 768 at the shorter side, and cut into tiles of 512."""
    if detail == "low":
        return F.lit(85).cast("long")
    fit = F.least(F.lit(1.0), 2048 / F.greatest(width, height))
    w, h = width * fit, height * fit
    again = F.least(F.lit(1.0), 768 / F.least(w, h))
    return (F.ceil(F.floor(w * again) / 512) * F.ceil(F.floor(h * again) / 512) * 170 + 85).cast("long")


def image_tokens_area(width: Column, height: Column) -> Column:
    """Tokens of an image that is fitted into 1568, by its area over 750."""
    fit = F.least(F.lit(1.0), 1568 / F.greatest(width, height))
    return F.floor(F.floor(width * fit) * F.floor(height * fit) / 750).cast("long")
