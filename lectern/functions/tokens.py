"""Texts as tokens with their gaps, and phrases found at places among them. Rules about wording are written over these."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let

#: A word (letters, digits, underscores) or any other character that is no white space; what stands before it is its gap.
_TOKEN = r"(?U)\s*(?:\w+|[^\w\s])"


def tokens(text: Column) -> Column:
    """``array<struct<raw, low, gap>>``: tokens as written and in lower case (curly apostrophes as straight ones), ``gap``: white space stands before it."""
    pieces = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))

    def one(p: Column) -> Column:
        raw = F.regexp_replace(p, r"(?U)^\s+", "")
        return F.struct(raw.alias("raw"), F.lower(F.translate(raw, "’", "'")).alias("low"), (F.length(raw) < F.length(p)).alias("gap"))

    return F.transform(pieces, one)


def words(toks: Column) -> Column:
    return F.transform(toks, lambda t: t["low"])


def written(toks: Column) -> Column:
    """Tokens put together again, a blank for each gap, none in front."""
    return F.trim(F.array_join(F.transform(toks, lambda t: F.concat(F.when(t["gap"], " ").otherwise(""), t["raw"])), ""))


def at(low: Column, i: Column) -> Column:
    """The word at a place; null outside."""
    return F.get(low, i)


def phrase_end(low: Column, i: Column, phrases: Iterable[str]) -> Column:
    """Where the longest of some fixed phrases that begins at ``i`` ends; null if none does."""
    by_size: dict[int, list[str]] = {}
    for p in phrases:
        by_size.setdefault(p.count(" ") + 1, []).append(p)
    found = [F.when(F.array_join(F.slice(low, i + 1, n), " ").isin(*by_size[n]), i + n) for n in sorted(by_size, reverse=True)]
    return F.coalesce(*found)


def name_keys(names: Column) -> Column:
    """Names as ``array<struct<n, key>>``: the number of their tokens, and the tokens joined by blanks. Blank names go."""
    keys = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: words(tokens(s)))
    return F.transform(F.filter(keys, lambda k: F.size(k) > 0), lambda k: F.struct(F.size(k).alias("n"), F.array_join(k, " ").alias("key")))


def name_end(low: Column, i: Column, keys: Column) -> Column:
    """Where the longest name that begins at ``i`` ends; null if none does."""
    return F.array_max(F.transform(keys, lambda k: F.when(F.array_join(F.slice(low, i + 1, k["n"]), " ") == k["key"], i + k["n"])))


def optional(low: Column, i: Column, *some: str) -> Column:
    """``i``, or the next place if one of some words stands there."""
    return F.when(at(low, i).isin(*some), i + 1).otherwise(i)


def anywhere(low: Column, found: Callable[[Column], Column]) -> Column:
    """Whether ``found`` holds at any place."""
    return F.coalesce(F.exists(F.when(F.size(low) > 0, F.sequence(F.lit(0), F.size(low) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.coalesce(found(i), F.lit(False))), F.lit(False))


def without(toks: Column, cut_at: Callable[[Column, Column], Column]) -> Column:
    """Tokens left when, from the front on, every run from ``i`` to the end that ``cut_at(low, i)`` gives goes; null cuts nothing."""

    def walk(low: Column) -> Column:
        ends = F.transform(toks, lambda _, i: F.coalesce(cut_at(low, i), F.lit(-1)))

        def step(acc: Column, e: Column) -> Column:
            free = acc["i"] >= acc["until"]
            until = F.when(free & (e >= 0), e).otherwise(acc["until"])
            return F.struct((acc["i"] + 1).alias("i"), until.alias("until"), F.array_append(acc["keep"], free & (e < 0)).alias("keep"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("until"), F.array().cast("array<boolean>").alias("keep"))
        return let(F.aggregate(ends, start, step), lambda s: F.filter(toks, lambda _, i: F.get(s["keep"], i)))

    return let(words(toks), walk)
