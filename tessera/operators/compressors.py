"""Compressors: content in, shorter content out, with what was left out stored under a key.

A payload is one row; its lines or items fit in memory, as the tables of payloads are what is large. Rules that look at a
line alone are Columns elsewhere; here each row's selection, which depends on what was selected before, runs in Arrow
batches. Payloads that repeat should be made distinct by their key before, and joined back after.
"""

from __future__ import annotations

import ast
import csv
import hashlib
import io
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from tessera.functions import detect as D
from tessera.functions import text as T
from tessera.sources.stores import evict, put, status, stored
from tessera.sources.tables import spread, table

# Fixed values of the log, search, diff and prose compressors, and of the crusher.
LOG = {"passthrough": 50, "errors": 10, "traces": 3, "trace_lines": 20, "warnings": 5, "context": 3, "total": 100}
SEARCH = {"per_file": 5, "total": 30, "files": 15}
DIFF = {"context": 2, "hunks": 10, "files": 20, "passthrough": 50}
PROSE = {"ratio": 0.5, "recency": 1.0, "relevance": 2.0, "salience": 1.5, "short": 12, "near": 0.85, "segments": 6}
CRUSH = {"min_items": 5, "max_items": 15, "first": 0.3, "last": 0.15, "sigma": 2.0, "lossless": 0.15, "core": 0.8, "flatten": 6, "buckets": (2, 8), "bucket_share": 0.7, "mixed": 8}
LEVELS = (("error", r"\b(ERROR|error|Error|FATAL|fatal|Fatal|CRITICAL|critical)\b"), ("fail", r"\b(FAIL|FAILED|fail|failed|Failed)\b"), ("warn", r"\b(WARN|WARNING|warn|warning|Warning)\b"), ("info", r"\b(INFO|info|Info)\b"), ("debug", r"\b(DEBUG|debug|Debug)\b"), ("trace", r"\b(TRACE|trace|Trace)\b"))
LEVEL_SCORE = {"error": 1.0, "fail": 1.0, "warn": 0.5, "info": 0.1, "unknown": 0.1, "debug": 0.05, "trace": 0.02}
FORMATS = {"pytest": r"^(=+ .*(test session|passed|failed)|(PASSED|FAILED) |.*::test_)", "npm": r"^(npm (ERR!|WARN)|> )", "cargo": r"^\s*(Compiling|Finished|error\[E|warning: unused)", "jest": r"^\s*(PASS|FAIL) .*\.(test|spec)\.", "make": r"^make(\[\d+\])?: "}
SUMMARY = r"^(={3,}|-{3,}|\d+ (passed|failed|skipped|error|warning)|(Tests?|Suites?)[: ]\s*\d|TOTAL|Total|Summary|(Build|Compile|Test).*(succeeded|failed|complete))"
TRACE_START = r"^(Traceback \(most recent call last\)|Exception in thread|thread '.*' panicked|goroutine \d+|\s*at\s+[\w.$]+\()"


def level(line: str) -> str:
    return next((name for name, p in LEVELS if re.search(p, line)), "unknown")


def log_format(lines: list[str]) -> str:
    hits = {name: sum(bool(re.match(p, x)) for x in lines[:100]) for name, p in FORMATS.items()}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] else "generic"


def compress_log(text: str, bias: float = 1.0) -> tuple[str, str]:
    """First and last errors with context, stack traces, distinct warnings and summaries, in order; then what was left out."""
    lines = text.split("\n")
    if len(lines) < LOG["passthrough"]:
        return text, "passthrough"
    levels = [level(x) for x in lines]
    traces, inside = [], 0
    for i, x in enumerate(lines):
        if inside and (x.startswith((" ", "\t")) or re.match(r"^\w*(Error|Exception)\b", x)) and i - traces[-1][0] < LOG["trace_lines"]:
            traces[-1][1] = i + 1
            inside = 0 if re.match(r"^\w", x) else inside
        elif re.match(TRACE_START, x):
            if not (inside and traces[-1][1] == i):
                traces.append([i, i + 1])
            inside = 1
        else:
            inside = 0
    in_trace = {i for a, b in traces for i in range(a, b)}
    score = [min(1.0, LEVEL_SCORE[v] + 0.3 * (i in in_trace) + 0.4 * bool(re.match(SUMMARY, x))) for i, (v, x) in enumerate(zip(levels, lines, strict=True))]

    def chosen(places: list[int], most: int) -> list[int]:
        first = list(dict.fromkeys([*places[:1], *places[-1:], *sorted(places, key=lambda i: (-score[i], i))]))
        return first[:most]

    keep: dict[int, float] = {}
    for name, most in (("error", LOG["errors"]), ("fail", LOG["errors"])):
        for i in chosen([i for i, v in enumerate(levels) if v == name], max(1, round(most * bias))):
            keep |= {j: score[j] for j in range(max(0, i - LOG["context"]), min(len(lines), i + LOG["context"] + 1)) if j not in keep}
    seen: set[str] = set()
    warnings = [i for i, v in enumerate(levels) if v == "warn" and not ((k := re.sub(r"0x[0-9a-f]+|\d+|(/[\w.-]+)+", "#", lines[i])) in seen or seen.add(k))]
    keep |= {i: score[i] for i in warnings[: LOG["warnings"]]}
    keep |= {i: score[i] for a, b in traces[: LOG["traces"]] for i in range(a, b)}
    keep |= {i: score[i] for i, x in enumerate(lines) if re.match(SUMMARY, x)}
    if len(keep) > LOG["total"]:
        keep = dict(sorted(keep.items(), key=lambda p: (-p[1], p[0]))[: LOG["total"]])
    left = len(lines) - len(keep)
    counts = {k: n for k, _ in LEVELS if (n := sum(v == k and i not in keep for i, v in enumerate(levels)))}
    tail = f"[{left} lines omitted{': ' if counts else ''}{', '.join(f'{n} {k}' for k, n in counts.items())}]"
    return "\n".join([*(lines[i] for i in sorted(keep)), tail]) if left else text, f"log:{log_format(lines)}"


def compress_search(text: str, context: str = "") -> tuple[str, str]:
    """The best matches of the best files of a search's output."""
    files: dict[str, list[tuple[int, str, float]]] = {}
    wanted = {w for w in re.findall(r"\w+", context.lower()) if len(w) > 2}
    for line in text.split("\n"):
        if m := re.match(r"^((?:[A-Za-z]:)?[^:\n]+?)[:-](\d+)[:-](.*)$", line):
            low = m[3].lower()
            score = 0.3 * sum(w in low for w in wanted)
            score += next((s for words, s in ((D.LINE_WORDS["error"], 0.5), (D.LINE_WORDS["warning"], 0.4), (D.LINE_WORDS["importance"], 0.3)) if re.search(rf"\b({'|'.join(words)})\b", low)), 0.0)
            files.setdefault(m[1], []).append((int(m[2]), m[3], min(1.0, score)))
    if not files:
        return text, "passthrough"
    best = sorted(files, key=lambda f: (-sum(x[2] for x in files[f]), f))[: SEARCH["files"]]
    out, total = [], 0
    for f in sorted(best):
        found = files[f]
        pick = list(dict.fromkeys([0, len(found) - 1, *sorted(range(len(found)), key=lambda i: (-found[i][2], i))]))[: min(SEARCH["per_file"], SEARCH["total"] - total)]
        total += len(pick)
        out += [f"{f}:{found[i][0]}:{found[i][1]}" for i in sorted(pick)]
        if len(found) > len(pick):
            out.append(f"[... and {len(found) - len(pick)} more matches in {f}]")
        if total >= SEARCH["total"]:
            break
    return "\n".join(out), "search"


def compress_diff(text: str, context: str = "") -> tuple[str, str]:
    """Files with most changes, their first, last and best hunks, and of these the lines near a change."""
    lines = text.split("\n")
    if len(lines) < DIFF["passthrough"]:
        return text, "passthrough"
    files: list[tuple[list[str], list[list[str]]]] = []
    for line in lines:
        if line.startswith("diff --") or not files:
            files.append(([line], []))
        elif line.startswith("@@"):
            files[-1][1].append([line])
        elif files[-1][1]:
            files[-1][1][-1].append(line)
        else:
            files[-1][0].append(line)
    wanted = {w for w in re.findall(r"\w+", context.lower()) if len(w) > 2}
    changes = lambda h: sum(x[:1] in "+-" and x[:3] not in ("+++", "---") for x in h[1:] if x)

    def score(h: list[str]) -> float:
        low = "\n".join(h).lower()
        return min(1.0, min(0.3, 0.03 * changes(h)) + 0.2 * sum(w in low for w in wanted) + 0.3 * bool(re.search(r"\b(error|security|auth|fix|bug|password|secret)\b", low)))

    kept = sorted(sorted(range(len(files)), key=lambda i: (-sum(map(changes, files[i][1])), i))[: DIFF["files"]])
    out: list[str] = []
    for i in kept:
        head, hunks = files[i]
        out += head
        pick = sorted(list(dict.fromkeys([0, len(hunks) - 1, *sorted(range(len(hunks)), key=lambda k: (-score(hunks[k]), k))]))[: DIFF["hunks"]]) if hunks else []
        for k in pick:
            h = hunks[k]
            at = [j for j, x in enumerate(h) if j and x[:1] in ("+", "-")]
            near = {j for a in at for j in range(a - DIFF["context"], a + DIFF["context"] + 1)}
            out += [x for j, x in enumerate(h) if j == 0 or j in near]
        if len(hunks) > len(pick):
            out.append(f"[{len(hunks) - len(pick)} hunks omitted]")
    if len(files) > len(kept):
        out.append(f"[{len(files) - len(kept)} files omitted]")
    return "\n".join(out), "diff"


def segments(text: str) -> list[str]:
    return [s for line in text.split("\n") for s in (x.strip() for x in re.split(r"(?<=[.!?])\s", line.strip())) if s]


def compress_prose(text: str, context: str = "", ratio: float = PROSE["ratio"]) -> tuple[str, str]:
    """Sentences by recency, relevance and salience, without near-duplicates, until the share of characters is kept."""
    parts = segments(text)
    if len(parts) < PROSE["segments"]:
        return text, "passthrough"
    asked = set(re.findall(r"\w+", context.lower()))
    words = [re.findall(r"\w+", s.lower()) for s in parts]
    df: dict[str, int] = {}
    for w in words:
        for t in set(w) & asked:
            df[t] = df.get(t, 0) + 1
    mean = sum(map(len, words)) / len(words)

    def relevance(w: list[str]) -> float:
        raw = 0.0
        for t in set(w) & asked:
            f = w.count(t)
            raw += np.log((len(parts) - df[t] + 0.5) / (df[t] + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / mean))
        return min(1.0, min(1.0, raw / 10) + 0.3 * any(len(t) >= 8 for t in set(w) & asked))

    def value(i: int) -> float:
        own = parts[i].split()
        salient = sum(bool(re.search(r"\d|[A-Z]{2,}|[_/.]\w|[a-z][A-Z]", x)) for x in own)
        v = PROSE["recency"] * (i + 1) / len(parts) + PROSE["relevance"] * relevance(words[i]) + PROSE["salience"] * salient / (len(own) + 1)
        return v * (0.25 if len(parts[i]) < PROSE["short"] else 1)

    target, size, seen, keep = max(1, int(sum(map(len, parts)) * min(1.0, max(0.05, ratio)))), 0, set(), set()
    for i in sorted(range(len(parts)), key=lambda i: (-value(i), i)):
        if size >= target:
            break
        grams = {tuple(words[i][k : k + 3]) for k in range(max(1, len(words[i]) - 2))} if words[i] else set()
        if grams and len(grams & seen) / len(grams) >= PROSE["near"]:
            continue
        seen |= grams
        keep.add(i)
        size += len(parts[i])
    return "\n".join(parts[i] for i in sorted(keep)), "prose"


def tag_of(values: list) -> str:
    kinds = {"bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string" if isinstance(v, str) else "json" for v in values if v is not None}
    return kinds.pop() if len(kinds) == 1 else "json" if kinds else "string"


def csv_schema(items: list[dict]) -> str:
    """[N]{column:type,...} and the rows as CSV: what compacts objects of like keys without loss."""
    freq: dict[str, int] = {}
    for x in items:
        for k in x:
            freq[k] = freq.get(k, 0) + 1
    columns = sorted(freq, key=lambda k: (-freq[k], k))
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for x in items:
        writer.writerow(["" if k not in x else v if isinstance(v := x[k], str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for k in columns])
    return f"[{len(items)}]{{{','.join(f'{k}:{tag_of([x[k] for x in items if k in x])}' for k in columns)}}}\n{out.getvalue()}".rstrip("\n")


def flattened(items: list[dict]) -> list[dict]:
    """Objects whose fields that hold objects of one and the same few keys in every item that has them are replaced by a field for each key."""
    done: set[str] = set()
    while True:
        for k in dict.fromkeys(k for x in items for k in x):
            inner = [x[k] for x in items if k in x]
            keys = {tuple(sorted(v)) for v in inner if isinstance(v, dict)}
            if k not in done and len(keys) == 1 and all(isinstance(v, dict) for v in inner) and 0 < len(next(iter(keys))) <= CRUSH["flatten"]:
                break
            done.add(k)
        else:
            return items
        items = [{n: w for f, v in x.items() for n, w in ([(f"{f}.{i}", v[i]) for i in v] if f == k else [(f, v)])} for x in items]


def discriminator(items: list[dict]) -> str | None:
    """The text field of every item that has the most different values, if these are few: it tells kinds of items apart."""
    low, high = CRUSH["buckets"]
    best: tuple[int, str] | None = None
    for k in sorted(set.intersection(*map(set, items))) if items else []:
        if all(isinstance(x[k], str) for x in items):
            n = len({x[k] for x in items})
            if low <= n <= high and n / len(items) <= CRUSH["bucket_share"] and (best is None or n > best[0]):
                best = n, k
    return best[1] if best else None


def table_of(items: list[dict]) -> str:
    """Items as a table without loss; items of several kinds (few fields in most of them) as a table for each value of their discriminator."""
    items = flattened(items)
    freq = Counter(k for x in items for k in x)
    core = sum(n >= CRUSH["core"] * len(items) for n in freq.values())
    by = discriminator(items) if core < CRUSH["core"] * len(freq) else None
    if by is None:
        return csv_schema(items)
    kinds = dict.fromkeys(x[by] for x in items)
    return "\n".join(f"{by}={json.dumps(v, ensure_ascii=False)}:\n" + csv_schema([{k: w for k, w in x.items() if k != by} for x in items if x[by] == v]) for v in kinds)


def minified(text: str) -> str:
    """JSON without the white space between its tokens; the text itself if that isn't shorter. Numbers and keys keep their form."""
    json.loads(text)
    made = re.sub(r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+', lambda m: m[1] or "", text)
    return made if len(made) < len(text) else text


def _kind(x) -> str:
    return "dict" if isinstance(x, dict) else "str" if isinstance(x, str) else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "list" if isinstance(x, list) else "null"


def mixed_items(items: list, query: str = "") -> list[int]:
    """Indices to keep of an array of several kinds: objects, texts and numbers are sampled among themselves, other items and small groups stay."""
    if len(items) <= CRUSH["mixed"]:
        return list(range(len(items)))
    groups: dict[str, list[int]] = {}
    for i, x in enumerate(items):
        groups.setdefault(_kind(x), []).append(i)
    keep: set[int] = set()
    for kind, at in groups.items():
        sampled = kind in ("dict", "str", "number") and len(at) >= CRUSH["min_items"]
        keep |= {at[k] for k in kept_items([items[i] for i in at], query)} if sampled else set(at)
    return sorted(keep)


def markdown_kv(items: list[dict]) -> str:
    return "\n".join("- " + "; ".join(f"{k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in x.items()) for x in items)


def _split(k: int) -> tuple[int, int]:
    first = min(k, max(1, round(k * CRUSH["first"])))
    return first, min(k - first, max(1, round(k * CRUSH["last"])))


def kept_items(items: list, query: str = "") -> list[int]:
    """Indices to keep of an array: errors and outliers all, both ends, what the query names, then a stride; repeats once."""
    n, most = len(items), CRUSH["max_items"]
    if n <= max(8, CRUSH["min_items"]):
        return list(range(n))
    text = [x if isinstance(x, str) else json.dumps(x, sort_keys=True, ensure_ascii=False) for x in items]
    must = {i for i, t in enumerate(text) if any(w in t.lower() for w in D.ERROR_WORDS)}
    columns: dict[str, list[tuple[int, float]]] = {}
    for i, x in enumerate(items):
        for k, v in (x.items() if isinstance(x, dict) else (("", x),)):
            if isinstance(v, (int, float)) and not isinstance(v, bool) and np.isfinite(v):
                columns.setdefault(k, []).append((i, float(v)))
    for cells in columns.values():
        v = np.array([c[1] for c in cells])
        sd = v.std(ddof=1) if len(v) > 1 else 0.0
        if sd > 0:
            must |= {cells[k][0] for k in np.flatnonzero(np.abs(v - v.mean()) > CRUSH["sigma"] * sd)}
    if all(isinstance(x, dict) for x in items):
        freq: dict[str, int] = {}
        for x in items:
            for k in x:
                freq[k] = freq.get(k, 0) + 1
        rare = {k for k, f in freq.items() if f < 0.2 * n}
        must |= {i for i, x in enumerate(items) if rare & set(x)}
    named = [w for w in re.findall(r"[\w.@-]{4,}", query.lower())]
    must |= {i for i, t in enumerate(text) if any(w in t.lower() for w in named)}
    first, last = _split(most)
    keep, seen = list(sorted(must)), {text[i] for i in must}
    step = max(1, n // most)
    for i in dict.fromkeys([*range(first), *range(n - last, n), *range(0, n, step)]):
        if len(keep) >= max(most, len(must)):
            break
        if i not in must and text[i] not in seen:
            keep.append(i)
            seen.add(text[i])
    return sorted(keep)


def key_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def crush_value(value, query: str = "", depth: int = 0, side: dict[str, str] | None = None):
    """A JSON value with its long arrays laid out as a table where that alone saves enough, however long, or else sampled.

    side takes the JSON of every array that loses items, by the key that its marker names.
    """
    if depth > 50:
        return value
    if isinstance(value, list):
        if len(value) >= CRUSH["min_items"]:
            whole = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
            if all(isinstance(x, dict) for x in value):
                flat = table_of(value)
                if len(flat) <= (1 - CRUSH["lossless"]) * len(whole):
                    return flat
            keep = kept_items(value, query) if len({_kind(x) for x in value}) == 1 else mixed_items(value, query)
            if len(keep) < len(value):
                key = key_of(whole)
                if side is not None:
                    side[key] = whole
                return [*(value[i] for i in keep), f"<<ccr:{key}>> {len(value) - len(keep)} items omitted"]
        return [crush_value(x, query, depth + 1, side) for x in value]
    if isinstance(value, dict):
        return {k: crush_value(v, query, depth + 1, side) for k, v in value.items()}
    if isinstance(value, str) and value[:1] in "[{" and len(value) > 256:
        try:
            return json.dumps(crush_value(json.loads(value), query, depth + 1, side), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return value
    return value


def compress_json(text: str, query: str = "", side: dict[str, str] | None = None) -> tuple[str, str]:
    try:
        value = json.loads(text)
    except ValueError:
        return text, "passthrough"
    out = crush_value(value, query, 0, side)
    return out if isinstance(out, str) and not isinstance(value, str) else json.dumps(out, separators=(",", ":"), ensure_ascii=False), "crush"


def parse_table(text: str) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a Markdown, delimited or fixed-width table."""
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        return [], []
    cells = lambda r: [c.strip() for c in r.strip().strip("|").split("|")]
    rule = lambda r: len([c for c in cells(r) if c]) >= 2 and all(re.match(r"^:?-{2,}:?$", c) for c in cells(r) if c)
    if "|" in lines[0] and rule(lines[1]):
        return cells(lines[0]), [cells(x) for x in lines[1:] if "|" in x and not rule(x)]
    for delim in ",\t;|":
        if lines[0].count(delim) and lines[0].count(delim) == lines[1].count(delim):
            rows = [r for r in csv.reader(io.StringIO(text), delimiter=delim) if any(c.strip() for c in r)]
            return [h.strip() for h in rows[0]], rows[1:]
    return re.split(r"\s{2,}", lines[0].strip()), [re.split(r"\s{2,}", x.strip()) for x in lines[1:]]


def records(header: list[str], rows: list[list[str]]) -> list[dict[str, str]]:
    return [dict(zip(header, [*r, *[""] * len(header)], strict=False)) for r in rows] if header else []


def compress_table(text: str, query: str = "") -> tuple[str, str]:
    items = records(*parse_table(text))
    if not items:
        return text, "passthrough"
    keep = kept_items(items, query)
    out = csv_schema([items[i] for i in keep])
    if len(keep) < len(items):
        out += f"\n<<ccr:{key_of(text)}>> {len(items) - len(keep)} rows omitted"
    return (out, "table") if len(out) < 0.95 * len(text) else (text, "passthrough")


class _Reader(HTMLParser):
    SKIP = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip, self.title, self.in_title = [], 0, "", False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        self.in_title = tag == "title"
        if tag in ("p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "article", "section"):
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        self.in_title = False
        if tag in ("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "article", "section"):
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.parts.append(data)


def compress_html(text: str, query: str = "") -> tuple[str, str]:
    """The text of a page's body without scripts, styles, navigation and the like, one block a line."""
    reader = _Reader()
    reader.feed(text)
    body = "\n".join(x for x in (re.sub(r"\s+", " ", line).strip() for line in "".join(reader.parts).split("\n")) if x)
    return body, "html"


def compress_code(text: str, query: str = "", body: int = 5) -> tuple[str, str]:
    """Python with long function bodies cut to their first lines; other languages by indentation of braces."""
    lines = text.split("\n")
    try:
        tree = ast.parse(text)
    except SyntaxError:
        depth, out, cut = 0, [], 0
        inside = 0
        for line in lines:
            inside = inside + 1 if depth else 0
            if inside <= body + 1 or depth + line.count("{") - line.count("}") <= 0:
                out.append(line)
            else:
                cut += 1
            depth = max(0, depth + line.count("{") - line.count("}"))
        return ("\n".join(out), "code:braces") if cut else (text, "passthrough")
    drop: set[int] = set()
    notes: dict[int, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and node.end_lineno - node.body[0].lineno >= body + 1:
            first = node.body[0].lineno - 1 + body
            notes.setdefault(first, f"{' ' * node.body[0].col_offset}# [{node.end_lineno - first} lines omitted]")
            drop |= set(range(first, node.end_lineno))
    out = []
    for i, line in enumerate(lines):
        if i in notes and (i == 0 or i - 1 not in drop):
            out.append(notes[i])
        if i not in drop:
            out.append(line)
    return ("\n".join(out), "code:python") if drop else (text, "passthrough")


def mine_templates(text: str, least: int = 3) -> tuple[str, str]:
    """Runs of lines of one shape as a template and its variable words: without loss."""
    lines = text.split("\n")
    if len(lines) < 20:
        return text, "passthrough"
    out, i = [], 0
    while i < len(lines):
        words, j = lines[i].split(" "), i + 1
        fixed = [True] * len(words)
        while j < len(lines):
            other = lines[j].split(" ")
            now = [f and a == b for f, a, b in zip(fixed, words, other, strict=False)] if len(other) == len(words) else []
            if not now or sum(now) < max(2, 0.4 * len(words)):
                break
            fixed, j = now, j + 1
        if j - i >= least and not all(fixed):
            out.append(f"[template x{j - i}] " + " ".join(w if f else "<*>" for w, f in zip(words, fixed, strict=True)))
            out += ["  " + " | ".join(w for w, f in zip(lines[k].split(" "), fixed, strict=True) if not f) for k in range(i, j)]
        else:
            out += lines[i:j]
        i = j
    made = "\n".join(out)
    return (made, "templates") if len(made) < len(text) else (text, "passthrough")


KERNELS: dict[str, Callable[[str, str], tuple[str, str]]] = {
    "json_array": compress_json, "log": lambda t, q: compress_log(t), "search": compress_search, "diff": compress_diff, "html": compress_html,
    "tabular": compress_table, "code": compress_code, "text": compress_prose,
}


RESULT = StructType([StructField(n, t) for n, t in (("compressed", StringType()), ("strategy", StringType()), ("tokens_before", LongType()), ("tokens_after", LongType()), ("key", StringType()), ("inner", MapType(StringType(), StringType())))])
_CODE, _DENSE = re.compile(T.CODE_MARK), re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), T.DENSE))


def estimate(text: str | None) -> int:
    """functions.text.tokens of one text."""
    if not text:
        return 0
    dense, ratio = len(_DENSE.findall(text)), T.CHARS_PER_TOKEN
    if re.match(r"\s*[\[{]", text) and _parses(text):
        ratio = T.CHARS_PER_TOKEN_JSON
    elif len(_CODE.findall(text)) > len(text) / 500:
        ratio = T.CHARS_PER_TOKEN_CODE
    extra = sum(len(re.findall("[/?&]", u)) for u in re.findall(T.URL, text, re.A)) + 2 * len(re.findall(T.UUID, text))
    return max(1, int((len(text) - dense) / ratio + dense / T.CHARS_PER_TOKEN_DENSE + 0.5) + extra)


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def compressed(payloads: DataFrame, text: str = "text", query: str | None = None) -> DataFrame:
    """Adds type, strategy, compressed, tokens before and after, and key: the payload's kind decides the compressor.
    inner: the arrays inside a JSON payload that lost items, by the keys of their markers.

    What would not get shorter, or fails, stays as it is. The kind is found by Columns, so only the compressor's own work
    leaves the JVM.
    """
    kind = payloads.withColumn("type", D.content_type(text)["type"])

    columns = kind.columns
    at = columns.index(text)

    def one(t: str | None, k: str, q: str | None) -> tuple:
        before, side = estimate(t), {}
        try:
            out, how = (t, "passthrough") if not t else compress_json(t, q or "", side) if k == "json_array" else KERNELS[k](t, q or "")
        except (ValueError, RecursionError, AssertionError):
            out, how = t, "passthrough:failed"
        after = estimate(out) if t else before
        if after >= before:
            return t, how if how.startswith("passthrough") else "passthrough", before, before, None, None
        return out, how, before, after, key_of(t), list(side.items()) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            rows = [one(t, k, q) for t, k, q in zip(batch.column(at).to_pylist(), batch.column(len(columns) - 1).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*columns, *RESULT.names])

    return kind.select(*columns, (F.col(query) if query else F.lit("")).alias("_query")).mapInArrow(run, StructType([*kind.schema, *RESULT]))


def store_of(compressed_: DataFrame, text: str = "text") -> DataFrame:
    """(key, payload): originals of what was shortened and of the arrays inside that lost items, each once."""
    whole = compressed_.where("key is not null").select("key", F.col(text).alias("payload"))
    inner = compressed_.where("inner is not null").select(F.explode("inner").alias("key", "payload"))
    return whole.unionAll(inner).groupBy("key").agg(F.first("payload").alias("payload"))


def retrieved(rows: DataFrame, store: DataFrame) -> DataFrame:
    return rows.join(store, "key", "left")


def _payloads(s, d) -> DataFrame:
    e = table(s, d, "events")
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", c.alias("l")))), lambda x: x["l"]), "\n")
    log = e.groupBy("user_id").agg(ordered(F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("event_type"), F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("value="), F.col("value").cast("string")))).alias("text"))
    rows = e.groupBy("user_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value"))), lambda x: x)).alias("text"))
    found = e.groupBy("user_id").agg(ordered(F.concat(F.lit("src/f"), (F.col("event_id") % 9).cast("string"), F.lit(".py:"), F.col("event_id").cast("string"), F.lit(":"), F.col("event_type"))).alias("text"))
    grid = e.groupBy("user_id").agg(F.concat(F.lit("event,kind,value\n"), ordered(F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.col("value").cast("string")))).alias("text"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("user_id"), F.col("html").alias("text"))
    prose = table(s, d, "documents").select(F.col("doc_id").alias("user_id"), "text")
    parts = [x.withColumn("payload", F.lit(n)) for n, x in (("log", log), ("json", rows), ("search", found), ("table", grid), ("page", pages), ("prose", prose))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return spread(out)


def _round_trip(done: DataFrame) -> DataFrame:
    back = retrieved(done.where("key is not null"), store_of(done).withColumnRenamed("payload", "original"))
    return back.groupBy("payload", (F.col("text") == F.col("original")).alias("same")).agg(F.count("*").alias("n"))


def minify(text) -> Column:
    """A Column's JSON without the white space between its tokens, in the JVM."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|[ \t\r\n]+', "$1")


QUERIES = {
    "json_minified": (
        lambda s, d: table(s, d, "events").select("event_id", minify(F.concat(F.lit('[ {"id": '), F.col("event_id").cast("string"), F.lit(',\n\t"a b" : "x \\" y" } , '), F.col("user_id").cast("string"), F.lit(" ]"))).alias("text")),
        """select event_id, '[{"id":' || event_id || ',"a b":"x \\" y"},' || user_id || ']' as text from events""",
    ),
    "compress_payloads": (lambda s, d: compressed(_payloads(s, d)).groupBy("payload", "type").agg(F.count("*").alias("n"), F.sum("tokens_before").alias("before"), F.sum("tokens_after").alias("after")), None),
    "compress_roundtrip": (lambda s, d: _round_trip(stored(compressed(_payloads(s, d)).select("payload", "text", "key", "inner"), "compressed")), None),
    "store_status": (lambda s, d: status(put(table(s, d, "events"), "user_id", "props", "ts"), "ts", "2024-01-31").groupBy("status").agg(F.count("*").alias("n")), "select case when epoch_us(timestamp '2024-01-31') - epoch_us(t) > 1800000000 then 'expired' else 'live' end as status, count(*) as n from (select user_id, max(ts) as t from events group by 1) group by 1"),
    "store_eviction": (lambda s, d: evict(table(s, d, "events").select("event_id", "ts"), "ts", "event_id", 500), "select event_id, ts from events order by ts desc, event_id limit 500"),
}
