"""Intermediate tables in the folder that the cluster shares, so that a lost executor takes nothing with it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 100_000

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; on a single machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="claimlake-"))
        base = _own[0]
    return base.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{folder(spark)}/claimlake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: its rows stay as they are however often they are read."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are few; else the join shuffles and hot keys are split at run time."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def col(name: str):
    """A column by its name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
