"""Places for intermediate tables, and small DataFrame helpers that several operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once.
BATCH_ROWS = 2000
_HELD: dict[Hashable, Any] = {}
_OWN: list[str] = []


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What `make` makes, kept in this Python worker until another key is asked for, so that stages don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Hands freed memory of this worker, which lives on for other tasks, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def let_go() -> None:
    """Frees what other operators' tasks keep in this Python worker."""
    _HELD.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir, which has to be set on a cluster.

    A local master, where driver and executors are one process, gets a temporary folder where it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="veridoc-"))
    return _OWN[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back, which cuts its lineage."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `written`, with the path, for a table that is dropped once it has been used."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def in_batches(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInPandas with batches of at most `rows` rows, so that a worker and its JVM hold little of the texts at once.

    The session's batch size is set, and stays so.
    """

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from work(batches)
        give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df.mapInPandas(worked, schema)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many _ after it as it takes to differ from every column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table of `written_at` that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words between ASCII white space; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bound_to(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
