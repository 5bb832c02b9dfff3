"""The parts of mixed texts: sections, spans that change from call to call, kinds of cells, protected tags, bloat."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import all_of, count
from tessera.sources.tables import table

# Fixed patterns of what changes from call to call.
DYNAMIC = {
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "datetime": r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:Z|[+-]\d{2}:\d{2})?\b", "date": r"\b\d{4}-\d{2}-\d{2}\b",
    "time": r"\b\d{2}:\d{2}:\d{2}\b", "hash": r"\b[0-9a-f]{32,64}\b", "version": r"\bv\d+\.\d+(?:\.\d+)?\b",
}
OPAQUE = 256
TAGS = ("thinking", "context", "document", "instructions", "system-reminder", "example", "tool_result")


def sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, kind, section): fenced code, JSON blocks, search lines and prose of a text, in order; joined by line feeds they are the text."""

    def kind(line: str) -> str:
        return "search" if re.match(r"^[^\s:]+:\d+:", line) else "text"

    def cut(t: str) -> list[tuple[str, str]]:
        lines, out, i = t.split("\n"), [], 0
        while i < len(lines):
            j, k = i + 1, kind(lines[i])
            if lines[i].lstrip().startswith("```"):
                j = next((n + 1 for n in range(i + 1, len(lines)) if lines[n].lstrip().startswith("```")), len(lines))
                k = "code"
            elif lines[i].strip()[:1] in ("{", "["):
                # the shortest run of lines from here that parses
                for n in range(i + 1, min(len(lines), i + 500) + 1):
                    if lines[n - 1].rstrip()[-1:] in ("}", "]"):
                        try:
                            json.loads("\n".join(lines[i:n]))
                        except ValueError:
                            continue
                        j, k = n, "json"
                        break
            if k in ("search", "text"):
                while j < len(lines) and kind(lines[j]) == k and not lines[j].lstrip().startswith("```") and lines[j].strip()[:1] not in ("{", "["):
                    j += 1
            out.append((k, "\n".join(lines[i:j])))
            i = j
        return out

    schema = f"{key} {texts.schema[key].dataType.simpleString()}, place int, kind string, section string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *s) for i, t in enumerate(batch.column(1).to_pylist()) if t is not None for n, s in enumerate(cut(t))]
            at, place, what, section = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(place, pa.int32()), pa.array(what, pa.string()), pa.array(section, pa.string())], names=[key, "place", "kind", "section"])

    return texts.select(key, text).mapInArrow(run, schema)


def dynamic_counts(text: Column) -> Column:
    """Struct of how many spans of each kind that changes a text holds; a date in a time stamp counts for both."""
    return F.struct(*[count(text, p).alias(k) for k, p in DYNAMIC.items()])


def stable(text: Column) -> Column:
    """A text with its changing spans as marks of their kinds, the longest kinds first."""
    for kind, p in DYNAMIC.items():
        text = F.regexp_replace(text, p, f"<{kind}>")
    return text


def cell_class(value: Column) -> Column:
    """scalar, object, array, json (a string of JSON), base64, html or long for the text of a table's cell."""
    v = F.try_parse_json(value)
    shape = F.schema_of_variant(v)
    inner = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    text = F.coalesce(F.try_variant_get(v, "$", "string"), value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when((shape == "STRING") & text.rlike(r"^\s*[\[{]") & inner.isNotNull(), "json").when(F.octet_length(text) <= OPAQUE, "scalar").when(
        text.rlike(r"^[A-Za-z0-9+/=\s]+$"), "base64").when(text.rlike(r"(?i)<[a-z!/][^>]*>"), "html").otherwise("long")


def tag_blocks(text: Column, tags=TAGS) -> Column:
    """The blocks of a text in any of the tags, as they stand."""
    return F.flatten(F.array(*[all_of(text, rf"(?s)<{t}(?:\s[^>]*)?>.*?</{t}>") for t in tags]))


def protected(text: Column, tags=TAGS) -> Column:
    """A text with its tagged blocks held out as marks of their key."""
    for t in tags:
        text = F.regexp_replace(text, rf"(?s)<{t}(?:\s[^>]*)?>.*?</{t}>", f"[[held:{t}]]")
    return text


def restored(text: Column, blocks: Column, tags=TAGS) -> Column:
    """protected undone: each tag's marks are filled with its blocks in order."""
    for t in tags:
        own = _own(blocks, t)
        parts = F.split(text, rf"\[\[held:{t}\]\]", -1)
        text = F.array_join(F.zip_with(parts, own, lambda p, b: F.concat(F.coalesce(p, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return text


def _own(blocks: Column, tag: str) -> Column:
    return F.filter(blocks, lambda b: b.rlike(rf"^<{tag}[\s>]"))


def bloat(text: Column) -> Column:
    """Share of a text's lines that repeat an earlier one, once numbers are masked: how much a reduction could take."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    masked = F.transform(lines, lambda x: F.regexp_replace(x, r"\d+", "#"))
    return F.coalesce(F.try_divide((F.size(masked) - F.size(F.array_distinct(masked))).cast("double"), F.size(masked).cast("double")), F.lit(0.0))


def must_keep(words: Column) -> Column:
    """Words that no reduction may drop: numbers, hexadecimal, capitals, paths, file names, flags, mixed case."""
    return F.filter(words, lambda w: w.rlike(r"\d|^0x|^[A-Z]{2,}$|[/\\]|\.[a-z]{1,4}$|^--?\w|[a-z][A-Z]"))


def _note(s, d) -> DataFrame:
    return table(s, d, "events").select("event_id", F.concat(F.lit("at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" id "), F.md5(F.col("event_id").cast("string")), F.lit(" <context>"), "event_type", F.lit("</context> v1.2 end")).alias("t"))


QUERIES = {
    "dynamic_spans": (lambda s, d: _note(s, d).select(dynamic_counts(F.col("t")).alias("c")).agg(*[F.sum(f"c.{k}").cast("long").alias(k) for k in ("datetime", "date", "time", "hash", "version")]), "select cast(count(*) as bigint) as datetime, cast(count(*) as bigint) as date, cast(count(*) as bigint) as time, cast(count(*) as bigint) as hash, cast(count(*) as bigint) as version from events"),
    "stable_prefixes": (lambda s, d: _note(s, d).groupBy(stable(F.col("t")).alias("stable")).agg(F.count("*").alias("n")), "select 'at <datetime> id <hash> <context>' || event_type || '</context> <version> end' as stable, count(*) as n from events group by 1"),
    "protected_tags": (lambda s, d: _note(s, d).select(protected(F.col("t")).contains("[[held:context]]").alias("held"), (restored(protected(F.col("t")), tag_blocks(F.col("t"))) == F.col("t")).alias("same")).groupBy("held", "same").agg(F.count("*").alias("n")), "select true as held, true as same, count(*) as n from events"),
    "cell_classes": (lambda s, d: table(s, d, "events").select(F.explode(F.array("props", F.col("value").cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"')))).alias("v")).groupBy(cell_class(F.col("v")).alias("class")).agg(F.count("*").alias("n")), "select 'object' as class, count(*) as n from events union all select 'scalar', 2 * count(*) from events"),
    "line_bloat": (lambda s, d: table(s, d, "documents").select("doc_id", F.round(bloat(F.col("text")), 6).alias("bloat")).where("bloat > 0"), "select doc_id, round(1 - len(list_distinct(m)) / len(m), 6) as bloat from (select doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '\\d+', '#', 'g')) as m from documents) where len(m) > 0 and len(list_distinct(m)) < len(m)"),
    "must_keep_words": (lambda s, d: _note(s, d).select(F.size(must_keep(F.split("t", " "))).alias("k")).groupBy("k").agg(F.count("*").alias("n")), None),
    "mixed_sections": (lambda s, d: sections(table(s, d, "events").groupBy("user_id").agg(F.concat(F.lit("notes\n```\ncode\n```\n"), F.max("props"), F.lit("\na.py:1:x\nb.py:2:y\nend")).alias("t")), "user_id", "t").groupBy("kind").agg(F.count("*").alias("n")), "with u as (select count(distinct user_id) as n from events) select kind, cast(n * k as bigint) as n from u, (values ('text', 2), ('code', 1), ('json', 1), ('search', 1)) v(kind, k)"),
}
