"""Tables between the steps of a job, written to the folder that the cluster shares; broadcasts behind a count; free column names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count has shown that it has at most this many narrow rows.
BROADCAST_ROWS = 1_000_000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of this process, for a local master only.

    The temporary folder goes when the process ends. On a cluster without the setting this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _own_folder:
        own = tempfile.mkdtemp(prefix="lectern-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folder.append("file://" + own)
    return _own_folder[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}-{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors lose no part of it, the lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``limit`` rows, without counting further than that."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its size allows it, else ``df`` itself (Spark then shuffles both sides)."""
    return F.broadcast(df) if within(df, limit) else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until no column of ``df`` has them in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
