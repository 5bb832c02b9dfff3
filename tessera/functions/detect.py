"""What kind of content a text is, and what its lines and words signal, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import _c, count, let, parses_as_json

# Fixed patterns of the detectors.
DIFF_HEADER = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@|@@@+\s+-\d+(?:,\d+)?\s+(?:-\d+(?:,\d+)?\s+)+\+\d+(?:,\d+)?\s+@@@+)"
DIFF_CHANGE = r"^[+-][^+-]"
SEARCH_LINE = r"^[^\s:]+:\d+:"
STRUCTURE_TAG = r"(?i)<(div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[\s>]"
LOG_ERROR = r"(?i)\b(ERROR|FAIL|FAILED|FATAL|CRITICAL)\b|\b(WARN|WARNING)\b"
LOG_OTHER = r"(?i:\b(INFO|DEBUG|TRACE)\b)|^\s*\d{4}-\d{2}-\d{2}|^\s*\[\d{2}:\d{2}:\d{2}\]|^={3,}|^-{3,}|^\s*PASSED|^\s*FAILED|^\s*SKIPPED|^npm ERR!|^yarn error|^cargo error|Traceback \(most recent call last\)|^\w*(Error|Exception):|^\s*at\s+[\w.$]+\("
CODE = {
    "python": r'^\s*(def|class|import|from|async def)\s+\w+|^\s*@\w+|^\s*"""|^\s*if __name__\s*==',
    "javascript": r"^\s*(function|const|let|var|class|import|export)\s+|^\s*(async\s+function|=>\s*\{)|^\s*module\.exports",
    "typescript": r"^\s*(interface|type|enum|namespace)\s+\w+|^:\s*(string|number|boolean|any|void)\b",
    "go": r"^\s*(func|type|package|import)\s+|^\s*func\s+\([^)]+\)\s+\w+",
    "rust": r"^\s*(fn|struct|enum|impl|mod|use|pub)\s+|^\s*#\[",
    "java": r"^\s*(public|private|protected)\s+(class|interface|enum)|^\s*@\w+|^\s*package\s+[\w.]+;",
}
RAG = r"(?i)\[Document\s*\d+\]|\[Source:\s*|<context>|<document>|Retrieved from:|From the knowledge base:"
ERROR_WORDS = ("error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected")
LINE_WORDS = {
    "error": ("error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected"),
    "warning": ("warn", "warning"),
    "importance": ("important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix"),
    "security": ("security", "auth", "password", "secret"),
}
PRIORITY = {"error": 0.95, "warning": 0.85, "security": 0.75, "importance": 0.6, "markdown": 0.45}
INDICATORS = ("error", "fail", "exception", "traceback", "fatal", "panic", "crash")


def lines(text: Column, n: int | None = None) -> Column:
    out = F.split(text, "\n", -1)
    return out if n is None else F.slice(out, 1, n)


def _full(rows: Column) -> Column:
    return F.size(F.filter(rows, lambda x: F.trim(x) != ""))


def _hits(rows: Column, pattern: str) -> Column:
    return F.size(F.filter(rows, lambda x: x.rlike(pattern)))


def json_confidence(t: Column) -> Column:
    """1.0 for an array of objects, 0.8 for any other JSON array, else null."""
    good = F.trim(t).startswith("[") & parses_as_json(t)
    dicts = F.trim(t).rlike(r"^\[\s*\{")
    return F.when(good, F.when(dicts & all_objects(t), 1.0).otherwise(0.8))


def all_objects(t: Column) -> Column:
    """Whether every item of a JSON array is an object, and there is one."""
    items = F.try_variant_get(F.try_parse_json(t), "$", "array<variant>")
    return (F.size(items) > 0) & F.forall(items, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def diff_confidence(t: Column) -> Column:
    rows = lines(t, 500)
    heads = _hits(rows, DIFF_HEADER)
    return F.when(heads > 0, F.least(F.lit(1.0), F.lit(0.5) + heads * 0.2 + _hits(rows, DIFF_CHANGE) * 0.05))


def html_confidence(t: Column) -> Column:
    s = F.substring(t, 1, 3000)
    doctype, html = s.rlike(r"(?i)^\s*<!doctype\s+html"), s.rlike(r"(?i)<html[\s>]")
    tags = count(s, STRUCTURE_TAG)
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    total = F.least(F.lit(1.0), one(doctype, 0.5) + one(html, 0.3) + one(s.rlike(r"(?i)<head[\s>]"), 0.1) + one(s.rlike(r"(?i)<body[\s>]"), 0.1) + F.least(F.lit(0.3), tags * 0.03))
    return F.when((doctype | html | (tags >= 3)) & (total >= 0.5), total)


def search_confidence(t: Column) -> Column:
    ratio = let(lines(t, 100), lambda rows: F.try_divide(_hits(rows, SEARCH_LINE), _full(rows)))
    return let(ratio, lambda r: F.when((r > 0) & (r >= 0.3), F.least(F.lit(1.0), F.lit(0.4) + r * 0.6)))


def log_confidence(t: Column) -> Column:
    seen = let(lines(t, 200), lambda rows: F.struct(_hits(rows, LOG_ERROR).alias("bad"), F.try_divide(F.size(F.filter(rows, lambda x: x.rlike(LOG_ERROR) | x.rlike(LOG_OTHER))), _full(rows)).alias("ratio")))
    return let(seen, lambda s: F.when((s["ratio"] > 0) & (s["ratio"] >= 0.1), F.least(F.lit(1.0), F.lit(0.3) + s["ratio"] * 0.5 + s["bad"] * 0.05)))


def tabular_confidence(t: Column) -> Column:
    """Markdown tables, or lines with the same number of a delimiter that don't read like prose."""
    separator = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$"

    def delimited(sample: Column, delim: str, least: float) -> Column:
        n = F.size(sample)

        def of(counts: Column) -> Column:
            # the most common count, the first of equals
            times = F.transform(F.array_distinct(counts), lambda c: F.struct(F.size(F.filter(counts, lambda x: x == c)).alias("n"), (-F.array_position(counts, c)).alias("first"), c.alias("c")))
            enders = F.size(F.filter(sample, lambda x: F.rtrim(x).rlike(r"[.!?]$"))) / n
            cells = F.aggregate(counts, F.lit(0), lambda a, x: a + x) + n
            wordy = F.aggregate(F.transform(sample, lambda x: count(F.translate(x, delim, " "), r"\S+")), F.lit(0), lambda a, x: a + x) / cells
            return let(F.array_max(times), lambda best: F.when(
                (n >= 3) & (F.get(counts, F.lit(0)) > 0) & (best["c"] > 0) & (best["n"] / n >= least) & (enders < 0.5) & (wordy <= 3),
                F.least(F.lit(0.95), F.lit(0.5) + best["n"] / n * 0.3 + F.least(best["c"] + 1, F.lit(5)) * 0.03)))

        return let(counts_of(sample, delim), of)

    def of(rows: Column) -> Column:
        markdown = F.exists(F.transform(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), lambda x, i: x.contains("|") & F.get(rows, i + 1).rlike(separator)), lambda b: b)
        found = let(F.slice(rows, 1, 20), lambda sample: F.greatest(*[delimited(sample, d, least) for d, least in ((",", 0.85), ("\t", 0.7), (";", 0.85), ("|", 0.85))]))
        return F.when(F.size(rows) < 3, None).when(markdown, 0.95).otherwise(found)

    return let(F.slice(F.filter(lines(t), lambda x: F.trim(x) != ""), 1, 50), of)


def counts_of(rows: Column, delim: str) -> Column:
    return F.transform(rows, lambda x: F.length(x) - F.length(F.replace(x, F.lit(delim), F.lit(""))))


def code_language(t: Column) -> Column:
    """Struct (language, hits) of the language with the most lines; ties go to the first in CODE."""
    rows = lines(t, 100)
    return F.array_max(F.array(*[F.struct(_hits(rows, p).alias("hits"), F.lit(-k).alias("order"), F.lit(lang).alias("language")) for k, (lang, p) in enumerate(CODE.items())]))


def code_confidence(t: Column) -> Column:
    best = code_language(t)["hits"]
    return F.when(best >= 3, F.least(F.lit(1.0), F.lit(0.4) + best / F.greatest(_full(lines(t, 100)), F.lit(1)) * 0.4 + best * 0.02))


def content_type(text: str | Column) -> Column:
    """Struct (type, confidence): the first of JSON, diff, HTML, search results, log, table and code that is sure enough, else text."""
    t = F.coalesce(_c(text), F.lit(""))
    chain = (("json_array", json_confidence(t), 0.0), ("diff", diff_confidence(t), 0.7), ("html", html_confidence(t), 0.7), ("search", search_confidence(t), 0.6), ("log", log_confidence(t), 0.5), ("tabular", tabular_confidence(t), 0.6), ("code", code_confidence(t), 0.5))
    # each test only runs where those before it were not sure
    plain = F.struct(F.lit("text").alias("type"), F.lit(0.5).alias("confidence"))
    out = plain
    for kind, c, least in reversed(chain):
        out = _first(kind, c, least, out)
    return F.when(F.trim(t) == "", F.struct(F.lit("text").alias("type"), F.lit(0.0).alias("confidence"))).otherwise(out)


def _first(kind: str, confidence: Column, least: float, rest: Column) -> Column:
    return let(confidence.cast("double"), lambda c: F.when(c >= least, F.struct(F.lit(kind).alias("type"), c.alias("confidence"))).otherwise(rest))


def is_mixed(text: str | Column) -> Column:
    """Two or more of: a code fence, a JSON block, more than five prose runs, search lines."""
    t = _c(text)
    signs = [t.contains("```"), t.rlike(r"(?m)^\s*[\[{]\s*$|(?m)^\s*[\[{]\""), count(t, r"[A-Z][a-z]+(?:\s+\w+){5,}") > 5, t.rlike("(?m)" + SEARCH_LINE)]
    return sum((F.when(s, 1).otherwise(0) for s in signs), F.lit(0)) >= 2


def is_rag(text: str | Column) -> Column:
    return _c(text).rlike(RAG)


def is_error_item(text: str | Column) -> Column:
    return F.lower(_c(text)).rlike("|".join(ERROR_WORDS))


def has_error_indicator(text: str | Column) -> Column:
    return F.lower(_c(text)).rlike("|".join(INDICATORS))


def line_importance(line: str | Column, context: str = "text") -> Column:
    """Struct (category, priority) of the first whole word that signals; null if none does."""
    x = F.lower(_c(line))
    word = lambda kind: x.rlike(r"\b(" + "|".join(LINE_WORDS[kind]) + r")\b")
    order = ["error", "importance", "security" if context == "diff" else "warning"]
    out = F.lit(None)
    if context == "text":
        out = F.when(_c(line).rlike(r"^(#{1,4} |\*\*|> )"), "markdown")
    for kind in reversed(order):
        out = F.when(word(kind), kind).otherwise(out)
    score = F.lit(None)
    for kind, p in PRIORITY.items():
        score = F.when(out == kind, p).otherwise(score)
    return F.struct(out.cast("string").alias("category"), score.cast("double").alias("priority"))


def volatile_kind(token: Column) -> Column:
    """uuid, jwt, iso8601 or hex_hash for a token that changes from call to call, else null."""
    part = r"[A-Za-z0-9_-]{4,}"
    date = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
    return F.when(token.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"), "uuid").when(token.rlike(rf"^{part}\.{part}\.{part}$"), "jwt").when(token.rlike(date), "iso8601").when(
        token.rlike(r"^[0-9a-fA-F]+$") & F.length(token).isin(32, 40, 64), "hex_hash")


def volatile_tokens(text: str | Column) -> Column:
    """Array of (label, sample) of the words that change from call to call."""
    bare = F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"""^[.,;:!?"'()\[\]{}<>]+|[.,;:!?"'()\[\]{}<>]+$""", "")), lambda w: w != "")
    kinds = F.transform(bare, lambda w: F.struct(volatile_kind(w).alias("label"), F.when(F.length(w) <= 16, w).otherwise(F.concat(F.left(w, F.lit(8)), F.lit("..."), F.right(w, F.lit(4)))).alias("sample")))
    return F.filter(kinds, lambda x: x["label"].isNotNull())


def alignment_score(findings: Column) -> Column:
    """100, less 10 for each finding, 0 at least."""
    return F.greatest(F.lit(0.0), 100.0 - 10.0 * F.coalesce(findings, F.lit(0)))


def query_alpha(query: str | Column, base: float = 0.5) -> Column:
    """Weight of exact matching for a query: more for UUIDs, ids, host names and addresses."""
    q = _c(query)
    uuids, ids = count(q, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"), count(q, r"\b\d{4,}\b")
    names = F.lower(q).rlike(r"\b[a-z0-9][a-z0-9-]*(\.[a-z0-9][a-z0-9-]*)*\.(com|net|org|io|dev|local|internal)\b") | F.lower(q).rlike(r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b")
    least = F.when(uuids > 0, 0.85).when(ids >= 2, 0.75).when(ids == 1, 0.65).when(names, 0.6).otherwise(0.0)
    return F.greatest(F.lit(0.3), F.least(F.lit(0.9), F.greatest(F.lit(base), least)))


# Fixed patterns of error categories, in the order they are tried.
ERROR_CATEGORIES = (
    ("file_not_found", r"No such file or directory|ENOENT|FileNotFoundError|does not exist"),
    ("module_not_found", r"ModuleNotFoundError|ImportError|No module named"),
    ("command_not_found", r"command not found"),
    ("permission_denied", r"Permission denied|EACCES|EPERM|auto-denied"),
    ("file_too_large", r"file is too large|too many lines|exceeds.*limit"),
    ("is_directory", r"EISDIR|Is a directory"),
    ("syntax_error", r"SyntaxError|IndentationError"),
    ("runtime_error", r"Traceback \(most recent|Exception:|Error:"),
    ("timeout", r"timed? ?out|TimeoutError|deadline exceeded"),
    ("no_matches", r"No (?:matches|files|results) found|0 matches"),
    ("user_rejected", r"user.*reject|user.*denied|declined|didn't want to proceed"),
    ("sibling_error", r"[Ss]ibling tool call errored"),
    ("exit_code", r"exit code|non-zero|exited with"),
    ("connection_error", r"ConnectionError|ConnectionRefused|ECONNREFUSED|network"),
    ("build_failure", r"BUILD FAILED|compilation error|compile error"),
)


def error_category(text: str | Column) -> Column:
    """Category of an error message, by the first pattern that its first 2,000 characters match."""
    t = F.left(_c(text), F.lit(2000))
    out = F.lit("unknown")
    for kind, pattern in reversed(ERROR_CATEGORIES):
        out = F.when(t.rlike("(?i)" + pattern), kind).otherwise(out)
    return out
