"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Paths of the tables that `written` made, where `written_alone` asks for them.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one where it is unset, but on a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def until_the_end(spark: SparkSession, path: str) -> None:
    """Has path removed when the session's JVM ends, if nothing removes it before."""
    files, where = _at(spark, path)
    files.deleteOnExit(where)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    until_the_end(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    if (made := _made.get()) is not None:
        made.append(path)
    return table


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows, written; the tables that it wrote on its way are removed then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        table = written(make(), name)
    finally:
        _made.reset(token)
    for path in made:
        if path != table.scratch_path:
            files, where = _at(table.sparkSession, path)
            files.delete(where, True)
    return table


def dropped(table: DataFrame) -> None:
    """Removes a table made by `written` that no plan needs any more."""
    files, where = _at(table.sparkSession, table.scratch_path)
    files.delete(where, True)


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row even where body's lambdas use it many times."""
    return F.transform(F.array(value), body).getItem(0)


def plain_names(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column but `keep` under a name that no operator uses inside; and how to select the old names again."""
    names = {c: c if c in keep else f"_column{k}_" for k, c in enumerate(docs.columns)}
    return docs.select(*[docs[c].alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]
