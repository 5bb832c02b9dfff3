"""Stored tables: requests, savings ledgers, originals, memories; and files of sessions, tables and cases."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType([T.StructField(n, k) for n, k in (("ts", T.TimestampType()), ("before", T.LongType()), ("after", T.LongType()), ("saved", T.LongType()), ("cost_usd", T.DoubleType()), ("model", T.StringType()), ("client", T.StringType()), ("source", T.StringType()), ("pid", T.LongType()))])
TELEMETRY = T.StructType([T.StructField("instance_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("os", T.StringType()), T.StructField("version", T.StringType()), T.StructField("tokens_saved", T.LongType()), T.StructField("requests", T.LongType()), T.StructField("by_model", T.MapType(T.StringType(), T.LongType()))])
CASES = "id string, context string, query string, ground_truth string, metadata map<string,string>"
TRANSCRIPT = "type string, timestamp string, message struct<role:string, content:string>, sessionId string"
# Fixed names of tools of the transcripts' kinds.
TOOL_NAMES = {"shell": "Bash", "exec_command": "Bash", "local_shell": "Bash", "run_shell_command": "Bash", "read_file": "Read", "view": "Read", "write_file": "Write", "create_file": "Write", "apply_patch": "Edit", "str_replace": "Edit", "replace": "Edit", "search_file_content": "Grep", "grep": "Grep", "glob": "Glob", "list_directory": "LS"}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in a temporary one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Adds rows to a store; by: columns to partition by, a date for retention to prune."""
    writer = df.write.mode("append").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def read_ledger(spark: SparkSession, path: str, as_of: str, retention_days: int = 365) -> DataFrame:
    """Events of a JSON-lines ledger within retention; lines that don't parse are left out."""
    rows = spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col("ts").isNotNull() & (F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {retention_days} days"))).drop("_bad")


def compact_ledger(spark: SparkSession, path: str, to: str, as_of: str, retention_days: int = 365) -> None:
    read_ledger(spark, path, as_of, retention_days).write.mode("overwrite").json(to)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path)


def read_transcripts(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Messages of session transcripts, one JSON object a line, with the file as the session where none is named."""
    rows = spark.read.schema(TRANSCRIPT).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(path)
    return rows.select(F.coalesce("sessionId", F.regexp_extract("_metadata.file_path", r"([^/]+)\.jsonl$", 1)).alias("session_id"), F.to_timestamp("timestamp").alias("ts"), F.coalesce("message.role", "type").alias("role"), F.col("message.content").alias("content"))


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    """Messages of chat files, each one JSON document with a list of messages."""
    shape = "sessionId string, messages array<struct<type:string, timestamp:string, content:string>>"
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    return rows.select(F.col("sessionId").alias("session_id"), F.posexplode("messages").alias("turn", "m")).select("session_id", "turn", F.col("m.type").alias("role"), F.to_timestamp("m.timestamp").alias("ts"), F.col("m.content").alias("content"))


def tool_name(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TOOL_NAMES.items() for x in p]), F.lower(name)), name)


def message_blocks(rows: DataFrame, content: str = "content") -> DataFrame:
    """One row for each block of a message whose content is a list of typed blocks; a plain text is one text block."""
    shape = "array<struct<type:string, text:string, id:string, name:string, input:string, tool_use_id:string, content:string>>"
    blocks = F.coalesce(F.from_json(content, shape), F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col(content).alias("text"))), shape[6:-1])))
    return rows.withColumn("b", F.explode_outer(blocks)).select(*[c for c in rows.columns if c != content], "b.*")


def scan_perf_log(spark: SparkSession, path: str, as_of: str, hours: int = 168) -> DataFrame:
    """model, before, after, ms of a proxy log's lines of the last hours; lines whose time doesn't parse are kept."""
    line = spark.read.text(path)
    got = line.select(
        F.try_to_timestamp(F.regexp_extract("value", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)).alias("ts"), F.regexp_extract("value", r"model=(\S+)", 1).alias("model"),
        F.regexp_extract("value", r"before=(\d+)", 1).try_cast("long").alias("before"), F.regexp_extract("value", r"after=(\d+)", 1).try_cast("long").alias("after"), F.regexp_extract("value", r"ms=([\d.]+)", 1).try_cast("double").alias("ms"))
    return got.where((F.col("ts").isNull() | (F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))) & (F.col("model") != ""))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Sections of Markdown files: (file, title, body), one memory each."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    parts = whole.select("file", F.explode(F.filter(F.split("value", r"(?m)^#{1,3} "), lambda x: F.trim(x) != "")).alias("s"))
    blank = F.lit(" \t\r\n")
    return parts.select("file", F.btrim(F.substring_index("s", "\n", 1), blank).alias("title"), F.btrim(F.regexp_replace("s", "^[^\n]*", ""), blank).alias("body"))


def write_markdown(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def compress_batch(spark: SparkSession, path: str, to: str) -> None:
    """Each request of a JSON-lines batch, with its message's content compressed, as JSON lines again."""
    from tessera.operators.compressors import compressed

    rows = spark.read.schema("custom_id string, content string").json(path)
    compressed(rows, "content").select("custom_id", F.col("compressed").alias("content"), "strategy", "key").write.mode("overwrite").json(to)


def put(store: DataFrame, key: str, payload: str, at: str) -> DataFrame:
    """Latest payload of each key of a log of puts."""
    return store.groupBy(key).agg(F.max(F.struct(F.col(at), F.col(payload))).alias("r")).select(key, F.col(f"r.{payload}").alias(payload), F.col(f"r.{at}").alias(at))


def status(store: DataFrame, at: str, as_of: str, ttl_seconds: int = 1800) -> DataFrame:
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return store.withColumn("status", F.when(age > ttl_seconds * 1_000_000, "expired").otherwise("live"))


def evict(store: DataFrame, at: str, key: str, capacity: int = 1000) -> DataFrame:
    """The newest entries, capacity of them."""
    return store.orderBy(F.desc(at), key).limit(capacity)
