"""Event streams: windows with late data, sessions, learned counts, per-session cache state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.stores import scratch
from tessera.sources.tables import table

LATE = "30 minutes"
#: A place after all others, for nulls.
NEVER = 2**63 - 1


def source(spark: SparkSession, folder: str, name: str = "events", files_per_trigger: int | None = 1) -> DataFrame:
    """A stream of a table's files, or of its one file; without files_per_trigger a trigger takes all that is there."""
    schema = table(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern the path may be a file or a folder; a plain one must be a folder
    return reader.parquet(f"{folder}/{name}.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Events and their value by type, in tumbling or sliding windows; late ones count until the watermark passes."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    got = events.withWatermark("ts", LATE).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("long")).alias("value"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def session_windows(events: DataFrame, gap: str) -> DataFrame:
    """Events of a user's sessions: windows that end when nothing came for `gap`."""
    got = events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def evidence(events: DataFrame, least: int) -> DataFrame:
    """How often each kind of event with the same properties was seen, for those seen often enough."""
    return events.groupBy(F.md5(F.concat_ws("|", "event_type", "props")).alias("pattern")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def prefix_state(events: DataFrame, ttl_ms: int = 3_600_000) -> DataFrame:
    """(user_id, seen, hits): for each user how many events came, and how many had the properties of the one before.

    A trigger's events of a user come in several Arrow batches, in no order; they are put in order of ts, then event_id
    (nulls last), over all of them, as two numbers and the code of the properties each. A null has no equal. State is one
    small tuple per user, dropped when event time has passed its last event by ttl_ms.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen, hits = state.get if state.exists else (None, 0, 0)
        codes, parts = {last: 0}, []
        for batch in batches:
            code = np.fromiter((codes.setdefault(p, len(codes)) for p in batch["props"]), "int64", len(batch))
            parts.append((batch["at"].to_numpy("int64"), batch["event_id"].to_numpy("int64"), code))
        at, ids, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        run = np.concatenate([[0], code[np.lexsort((ids, at))]])
        hits += int(np.count_nonzero((run[1:] == run[:-1]) & (run[1:] != codes.get(None, -1))))
        seen, last = seen + len(at), list(codes)[run[-1]]
        latest = int(at[at < NEVER].max(initial=0)) // 1000
        state.update((last, seen, hits))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "hits": [hits]})

    ordered = [F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"), F.coalesce("event_id", F.lit(NEVER)).alias("event_id")]
    return events.withWatermark("ts", LATE).select("user_id", "ts", *ordered, "props").groupBy("user_id").applyInPandasWithState(step, "user_id long, seen long, hits long", "last string, seen long, hits long", "update", GroupStateTimeout.EventTimeTimeout)


def finished(stream: DataFrame, mode: str, then: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """What a stream has given once all that is there was read: each batch replaces (complete) or adds to (update, append) a table in the shared folder."""
    spark = stream.sparkSession
    out, marks = scratch(spark, "stream"), scratch(spark, "marks")

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again writes over itself
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


_WIN = "(select *, cast(floor(value) as bigint) as v from events)"

QUERIES = {
    "stream_tumbling": (lambda s, d: finished(windowed(source(s, d), "1 day"), "complete"), f"select time_bucket(interval 1 day, ts) as start, event_type, count(*) as n, cast(sum(v) as bigint) as value from {_WIN} group by 1, 2"),
    "stream_sliding": (lambda s, d: finished(windowed(source(s, d), "12 hours", "6 hours"), "complete"), f"select start, event_type, count(*) as n, cast(sum(v) as bigint) as value from (select *, unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as start from {_WIN}) group by 1, 2"),
    "batch_session_windows": (lambda s, d: session_windows(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours"), "select min(ts) as start, max(ts) + interval 6 hours as \"end\", user_id, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id))) group by user_id, s"),
    "stream_evidence": (lambda s, d: finished(evidence(source(s, d), 5), "complete"), "select md5(concat_ws('|', event_type, props)) as pattern, count(*) as n from events group by 1 having count(*) >= 5"),
    "stream_prefix_state": (lambda s, d: finished(prefix_state(source(s, d, files_per_trigger=None)), "update"), "select user_id, count(*) as seen, cast(count(*) filter (same) as bigint) as hits from (select *, coalesce(props = lag(props) over (partition by user_id order by ts, event_id), false) as same from events) group by 1"),
}
