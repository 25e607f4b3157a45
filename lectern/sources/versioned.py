"""A chunk table of immutable parts that manifests publish.

A change writes its rows, and tombstones for what they replace, into a part of its own; nothing that readers see is
touched. A manifest lists the parts of a version; the table changes by the one rename that gives the next manifest its
name. A job that dies before that leaves the old version as it is, whatever it has written, and older versions stay
readable, or can be restored, until they are cleared away.

Readers merge: a row is there unless a later part has a tombstone for its document or its country. What a change
writes depends on the change alone. ``compact`` merges the newest parts whenever they outweigh the one before them, so
parts grow geometrically, there are few of them, and a row is rewritten a logarithmic number of times. A merged part is
cut into ranges of document ids, as many as its bytes ask for, which split as it grows; the scan of one document reads
one range.

The manifest is a few lines of JSON; it goes by the file system of the table, which has to rename atomically.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.store import BROADCAST_ROWS, free_names

#: Bytes of a file that a merge writes, about.
FILE_BYTES = 128 << 20
#: Parts that are merged at least.
FEWEST = 4

Manifest = dict[str, Any]


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names and times (milliseconds) of what lies in a folder; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions whose manifests are kept, oldest first."""
    return sorted(int(n[:-5]) for n, _ in _names(spark, f"{table}/log") if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, table: str, version: int | None = None) -> Manifest:
    """``version``, ``parts`` from the oldest and ``epochs`` of a version of the table, by default the newest; of a new table an empty one."""
    known = versions(spark, table)
    if version is None and not known:
        return {"version": 0, "parts": [], "epochs": {}}
    if version is not None and version not in known:
        raise ValueError(f"no version {version} of {table}")
    path = f"{table}/log/{known[-1] if version is None else version:020d}.json"
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _switch(spark: SparkSession, table: str, state: Manifest) -> int:
    """Publish ``state`` as the version that it names; raises if that version is there already."""
    name = f"{state['version']:020d}.json"
    fs, staged = _fs(spark, f"{table}/log/.{name}.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    # without an option to overwrite, the rename fails where another writer came first
    context.rename(staged, jvm.org.apache.hadoop.fs.Path(f"{table}/log/{name}"), options)
    return state["version"]


def _alive(spark: SparkSession, parts: list[Manifest]) -> DataFrame | None:
    """Rows of the parts that no later one of them replaces."""
    if not parts:
        return None
    first = spark.read.parquet(f"{parts[0]['path']}/rows")
    at, gone_at, value, key = free_names(first, "version", "gone_at", "value", "key")
    rows = None
    for p in parts:
        own = spark.read.parquet(f"{p['path']}/rows").withColumn(at, F.lit(p["version"]).cast("long"))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    replacing = [p for p in parts if p["gone"]]
    if replacing:
        gone = None
        for p in replacing:
            own = spark.read.parquet(f"{p['path']}/gone").select(F.col("key").alias(key), F.col("value").alias(value), F.lit(p["version"]).cast("long").alias(gone_at))
            gone = own if gone is None else gone.unionByName(own)
        for column in sorted({c for p in replacing for c in p["gone"]}):
            last = gone.where(F.col(key) == column).groupBy(value).agg(F.max(gone_at).alias(gone_at))
            few = sum(p["gone"].get(column, 0) for p in replacing) <= BROADCAST_ROWS
            same = F.col(column).cast("string").eqNullSafe(F.col(value)) & (F.col(at) < F.col(gone_at))
            rows = rows.join(F.broadcast(last) if few else last, same, "left_anti")
    return rows.drop(at)


def read_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of the table, by default of its newest version."""
    rows = _alive(spark, manifest(spark, table, version)["parts"])
    if rows is None:
        raise ValueError(f"no rows were ever written to {table}")
    return rows


def _part(spark: SparkSession, path: str, version: int) -> Manifest:
    """What the manifest says of a part that has been written."""
    try:
        gone = {r.key: r["count"] for r in spark.read.parquet(f"{path}/gone").groupBy("key").count().collect()}
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        gone = {}
    fs, p = _fs(spark, path)
    return {"version": version, "path": path, "rows": spark.read.parquet(f"{path}/rows").count(), "bytes": fs.getContentSummary(p).getLength(), "gone": gone}


def publish(table: str, rows: DataFrame, key: str, gone: DataFrame | None = None, source: str | None = None, epoch: int = 0) -> int:
    """Add ``rows`` as the next version; all older rows with a ``key`` value that occurs in them, or in ``gone``, go. Returns the version.

    ``rows`` are evaluated once. With ``source``, an ``epoch`` of it that has been published is not published again.
    Two writers at once: the later one raises, and may try again. Null is a value like others.
    """
    spark = rows.sparkSession
    now = manifest(spark, table)
    if source is not None and now["epochs"].get(source, -1) >= epoch:
        return now["version"]
    version, path = now["version"] + 1, f"{table}/data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/rows")
    if now["parts"]:
        values = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col(key).cast("string").alias("value"))
        if gone is not None:
            values = values.unionByName(gone.select(F.col(key).cast("string").alias("value")))
        values.distinct().select(F.lit(key).alias("key"), "value").write.parquet(f"{path}/gone")
    epochs = now["epochs"] if source is None else now["epochs"] | {source: epoch}
    return _switch(spark, table, {"version": version, "parts": [*now["parts"], _part(spark, path, version)], "epochs": epochs})


def compact(spark: SparkSession, table: str, fewest: int = FEWEST, file_bytes: int = FILE_BYTES, order: str = "document_id") -> int:
    """Merge the newest parts while the part before them is no larger than they are together, if they are ``fewest`` at least. Returns the version.

    Tombstones stay as long as an older part is left that they may strike.
    """
    now = manifest(spark, table)
    parts, size = now["parts"], 0
    first = len(parts)
    while first > 0 and (size == 0 or parts[first - 1]["bytes"] <= size):
        first -= 1
        size += parts[first]["bytes"]
    merged = parts[first:]
    if len(merged) < fewest:
        return now["version"]
    path = f"{table}/data/{uuid.uuid4().hex}"
    ranges = max(1, -(-size // file_bytes))
    _alive(spark, merged).repartitionByRange(ranges, order).sortWithinPartitions(order).write.parquet(f"{path}/rows")
    replacing = [f"{p['path']}/gone" for p in merged if p["gone"]]
    if first > 0 and replacing:
        spark.read.parquet(*replacing).distinct().write.parquet(f"{path}/gone")
    state = {"version": now["version"] + 1, "parts": [*parts[:first], _part(spark, path, merged[-1]["version"])], "epochs": now["epochs"]}
    return _switch(spark, table, state)


def restore(spark: SparkSession, table: str, version: int) -> int:
    """Publish an older version again, as the newest one; what came after it is out of the table, but not lost."""
    old, now = manifest(spark, table, version), manifest(spark, table)
    return _switch(spark, table, {"version": now["version"] + 1, "parts": old["parts"], "epochs": now["epochs"]})


def clear_old(spark: SparkSession, table: str, keep: int = 2, age_seconds: float = 86_400) -> list[str]:
    """Remove what only versions before the newest ``keep`` need, and what failed jobs have left; folders younger than ``age_seconds`` stay, as a job may be writing them. Returns the names."""
    known = versions(spark, table)
    needed = {p["path"].rsplit("/", 1)[1] for v in known[-keep:] for p in manifest(spark, table, v)["parts"]}
    before = spark.sparkContext._jvm.java.lang.System.currentTimeMillis() - 1000 * age_seconds
    old = [f"log/{v:020d}.json" for v in known[:-keep]] + [f"data/{n}" for n, t in _names(spark, f"{table}/data") if n not in needed and t <= before]
    for name in old:
        fs, p = _fs(spark, f"{table}/{name}")
        fs.delete(p, True)
    return old
