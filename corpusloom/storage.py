"""Intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is refused, since its
    executors would not find each other's files there."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="corpusloom-")
        where = _OWN[app]
    return where.rstrip("/")


def written(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it again. Shuffles before it are then free to go, and a
    lost executor costs no more than the reading of a file."""
    path = f"{shared_folder(df.sparkSession)}/corpusloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast only when a count shows at most so many (narrow) rows; otherwise the join shuffles."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).take(rows + 1)) <= rows else df
