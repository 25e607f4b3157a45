"""Text normalisation as column functions. The variants differ on purpose; each job names the one it needs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> dict[str, str]:
    """Letters of the Latin blocks that decompose into one ASCII letter and marks, from the Unicode tables."""
    out = {}
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalnum():
            out[chr(code)] = base
    return out


_LATIN = _latin()
_FROM, _TO = "".join(_LATIN), "".join(_LATIN.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unaccent(c: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


def squash_ws(c: Column) -> Column:
    """White space runs (Unicode) as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def has_alphanumeric(c: Column) -> Column:
    return c.rlike(r"[\p{L}\p{N}]")


def ascii_words(c: Column) -> Column:
    """Marks stripped, everything but ASCII letters and digits as blanks, lower case. A sharp s becomes a blank."""
    return F.trim(F.lower(F.regexp_replace(unaccent(c), "[^0-9A-Za-z]+", " ")))


def evidence_tokens(c: Column) -> Column:
    """ASCII tokens; an accented letter ends a token after its base letter, a sharp s is ss."""
    split = F.regexp_replace(F.regexp_replace(c, "[ßẞ]", "ss"), r"([À-ɏḀ-ỿ])", "$1 ")
    return F.regexp_extract_all(F.lower(F.translate(split, _FROM, _TO)), F.lit("[a-z0-9]+"), F.lit(0))


def fold_label(c: Column) -> Column:
    """Blanks, apostrophes and dashes of source labels in one form."""
    return squash_ws(F.translate(c, " ’–—", " '--"))


def topic_label(c: Column) -> Column:
    """A heading without numbering and decoration, case kept."""
    bare = F.regexp_replace(fold_label(c), r"(?i)^\s*(?:[|¦=]+\s*)?(?:(?:\d{1,2}|[IVX]{1,6})\s*[.)]\s*)?", "")
    return F.trim(F.regexp_replace(bare, r"\s*[|¦=]+\s*$", ""))


def without_entity(label: Column, names: Column) -> Column:
    """``label`` without a final ``in <name>``; ``names`` is an array, the longest that fits counts."""
    low = F.lower(label)
    fits = F.filter(F.transform(names, lambda n: F.concat(F.lit(" in "), n)), lambda s: F.endswith(low, F.lower(s)))
    longest = F.array_max(F.transform(fits, lambda s: F.length(s)))
    return F.when(F.size(fits) > 0, F.trim(F.substring(label, F.lit(1), F.length(label) - longest))).otherwise(label)


def subsection_label(c: Column) -> Column:
    """Subsection labels for matching: folded, without ``a.`` in front and separators behind, lower case."""
    folded = F.translate(c, " ’´`–—", " '''--")
    bare = F.regexp_replace(F.regexp_replace(folded, r"(?i)^\s*[a-z]\s*[.)]\s*", ""), r"\s*[:|¦=]+\s*$", "")
    return F.lower(squash_ws(F.regexp_replace(F.regexp_replace(bare, r"\s*/\s*", "/"), r"\s*-\s*", " - ")))


def entity_token(c: Column) -> Column:
    """Entity names and file name parts for matching."""
    return F.lower(squash_ws(F.translate(c, "_ ", "  ")))


def chat_text(c: Column) -> Column:
    """Chat wording in one form: no marks, text-speak spelt out, only letters, digits and single blanks."""
    t = F.translate(unaccent(F.lower(c)), "’", "'")
    for pattern, to in ((r"\bwhitch\b", "which"), (r"\bu\b", "you"), (r"\bwhats\b", "what is"), (r"[^a-z0-9' ]+", " "), ("'", " "), (r"\bthat\s+s\b", "thats"), (r"\bi\s+m\b", "im")):
        t = F.regexp_replace(t, pattern, to)
    return squash_ws(t)


def help_text(c: Column) -> Column:
    """The other form of chat wording: contractions spelt out first, marks and underscores kept."""
    t = F.translate(F.lower(c), "’", "'")
    for pattern, to in ((r"\b(?:whats|what's)\b", "what is"), (r"\b(?:cant|can't)\b", "cannot"), (r"(?U)[^\w\s']", " "), ("'", " ")):
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(squash_ws(t), r"\bu\b", "you")


def dedupe_list(arr: Column, normal: Callable[[Column], Column] = squash_ws) -> Column:
    """Normalised values without blanks, first occurrence kept."""
    return F.array_distinct(F.filter(F.transform(arr, normal), lambda v: v != ""))


def label_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(fold_label(c), r"[:|¦= ]+$", ""))


def repair_joins(c: Column) -> Column:
    """A blank between a small letter or digit and a capital; repeated commas as one."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "), r",(?:\s*,)+", ",")


def search_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spaced_tokens(c: Column) -> Column:
    """The words of ``search_tokens`` as one text, a blank between two."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by blanks, in order; empty for fewer words."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(n)])),
    ).otherwise(F.array().cast("array<string>"))


def runs(words: Column, sizes: Column) -> Column:
    """``array<struct<gram, pos>>``: the runs of as many ``words`` as the array ``sizes`` says, joined by blanks."""

    def of(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("gram"), i.alias("pos")))

    return F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.size(words)), of))


def contains_words(text: Column, phrase: Column) -> Column:
    """Whether ``phrase`` occurs in ``text`` as whole words; both in blank-separated form."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def truncate_at_paragraph(c: Column, n: Column) -> Column:
    """At most ``n`` characters, cut at the last blank line if that is not before half of them."""
    trimmed = F.trim(c)
    cut = F.substring(trimmed, F.lit(1), n)
    last = F.length(cut) - F.instr(F.reverse(cut), "\n\n") - 1
    at_line = (F.instr(cut, "\n\n") > 0) & (last >= F.floor(n / 2))
    short = F.when(at_line, F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)
    return F.when(F.length(trimmed) <= n, trimmed).otherwise(F.rtrim(F.regexp_replace(short, r"\s+$", "")))
