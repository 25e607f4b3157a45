"""Column helpers for texts, all built from Spark functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngram_hashes(words: Column, k: int) -> Column:
    """xxhash64 of each run of ``k`` array elements, in order; null-safe, empty for fewer elements."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]),
    )


#: Elements that are added up one by one; the sums of whole runs are carried on.
RUN = 64


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of a non-empty array, ``op`` folded over ``start`` and the elements before it.

    Runs of ``RUN`` elements are folded first, so a long array costs about ``RUN`` steps an element, not its length.
    """

    def over(parts: Column) -> Column:
        heads = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1), F.array(start), lambda acc, part: F.concat(acc, F.array(op(F.element_at(acc, -1), F.aggregate(F.slice(part, 2, F.size(part)), F.element_at(part, 1), op))))
        )
        own = F.zip_with(parts, heads, lambda part, head: F.transform(part, lambda _, i: F.aggregate(F.slice(part, 1, i), head, op)))
        return F.flatten(own)

    runs = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(RUN)), lambda at: F.slice(values, at + 1, RUN))
    return let(runs, over)


SPANS = "array<struct<match:string,start:long,end:long>>"


def regex_spans(text: Column, pattern: str) -> Column:
    """``array<struct<match, start, end>>`` of the leftmost non-overlapping matches; code points, ends exclusive.

    The texts between matches are as many as the matches plus one; their running lengths give the offsets.
    """

    def spans(parts: Column, found: Column) -> Column:
        lengths = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), (F.length(gap) + F.length(m)).cast("long").alias("both")))

        def placed(pairs: Column) -> Column:
            ends = running(F.transform(pairs, lambda p: p["both"]), F.lit(0).cast("long"), lambda x, y: x + y)
            at = F.zip_with(pairs, ends, lambda p, e: F.struct((e + p["gap"]).alias("start"), (e + p["both"]).alias("end")))
            return F.zip_with(found, at, lambda m, x: F.struct(m.alias("match"), x["start"].alias("start"), x["end"].alias("end")))

        return let(lengths, placed)

    none = F.array().cast(SPANS)
    out = let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(parts, found)).otherwise(none)))
    return F.when(text.rlike(pattern), out).otherwise(none)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal variable, by the logistic approximation with a cubic term."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))
