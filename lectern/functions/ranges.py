"""Sequential rules over tables of any size: rows sorted into ranges over all tasks, each range read in order by one task.

A key with very many rows lies in many ranges. What a rule has to know of the ranges before is worked out between two
passes over the ranges, from a summary of each key in each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.store import bounded, cut

#: Rows in a range, about.
RANGE_ROWS = 500_000


def key_of(column: str) -> Column:
    """A key as text that is never null: null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def sorted_ranges(rows: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``part``, dealt by ``order`` to ranges of about ``range_rows``; written, so that the ranges stay as they are."""
    kept = cut(rows, "rows")
    ranges = max(1, -(-kept.count() // range_rows))
    return cut(kept.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "ranges")


def in_order(ranges: DataFrame, order: list[str]) -> DataFrame:
    """Whole ranges, each within one task, in order."""
    return ranges.repartition("part").sortWithinPartitions("part", *order)


def spread_keys(ranges: DataFrame, key: str) -> DataFrame:
    """The keys that lie in several ranges: one at most for each border between ranges."""
    parts = ranges.select(key, "part").distinct().groupBy(key).agg(F.count("*").alias("parts"))
    return bounded(cut(parts.where("parts > 1").select(key), "spread"))


def begins(column: pa.ChunkedArray) -> np.ndarray:
    """Begins of the runs of equal elements, and the end."""
    if not len(column):
        return np.zeros(1, np.int64)
    code = column.combine_chunks()
    code = (code if pa.types.is_integer(code.type) else code.dictionary_encode().indices).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))


def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each range together."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        begin = begins(table.column("part"))
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            piece = table.slice(a, b - a)
            if held and held[0].column("part")[0] != piece.column("part")[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
    if held:
        yield pa.concat_tables(held)
