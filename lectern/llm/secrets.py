"""Secrets in whole texts: known formats, and tokens that pass a battery of randomness tests.

Long tokens get an encoding (hexadecimal, base32, letters and digits, base64) and with it an alphabet of k symbols.
Three tests ask whether their symbols could be random: chi-squared uniformity over the alphabet, runs above and below
its middle, and lag-1 serial correlation. The smallest p-value times three is the token's.

A secret is a token that passes better than ordinary tokens of its length do. How well those pass is measured on
decoys, identifiers made of the documents' own running words (``TheOtherWordHere7``), of which none is a secret. Per
length class (powers of two) the limit is the lowest p-value at which the false discoveries that the decoys foretell,
the class's tokens times (decoys that pass + 1) / (decoys + 1), are at most ``FDR`` of the tokens reported. Short tokens
give weak tests, many of their decoys pass, and the limit rises; where none is strict enough, or where there are too few
decoys to tell, nothing is reported. Tokens that fail a test at ``FLOOR`` are never reported. Decoys are made for every
length class in which there is a token, of the words of all different texts that fill it, and where those are fewer than
``DECOYS``, of ``WORDS`` as well.

The tokens of all texts are found and tested once, and written; limits and spans come from that table.

Only DataFrame functions; the histograms of p-values that the rule needs have a bounded number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.textcols import let, regex_spans, running, upper_tail
from lectern.sources.store import cut, free_names

#: In the order in which spans that begin together are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "random")
FDR = 0.02
LEAST_TOKEN = 20
#: p-values are binned by hundredths of their decimal logarithm; under ``FLOOR`` a token is not random.
BINS = 3000
FLOOR = 0.001
#: Decoys of each length class, at least.
DECOYS = 2048
#: Words of decoys where documents are too few.
WORDS = tuple(
    "get set load save open close read write find make user name account address email order item list index page file path cache config manager service handler factory controller request response session client server "
    "message event queue worker buffer stream parser builder report summary invoice payment customer product category region status default primary secondary internal external current previous next first last total count "
    "quick brown fox jumps over lazy dog and the of with from into by for not all any is has can was this that".split()
)

# The base formats.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"


def _runs(symbols: str) -> str:
    """Pattern of whole runs of ``symbols`` that may have ``LEAST_TOKEN`` characters with their padding; ``=`` is padding only where no token goes on after it."""
    padding = "=++(?![A-Za-z0-9+/_-])"
    return rf"(?<![{symbols}])(?:[{symbols}]{{{LEAST_TOKEN},}}+(?:{padding})?|[{symbols}]{{8,{LEAST_TOKEN - 1}}}+{padding})"


TOKEN = _runs("A-Za-z0-9+/_-")
#: The parts of a token that fits no encoding: what stands between ``-`` and ``_``, between ``+`` and ``/``, and between any of ``/``, ``-`` and ``_``.
PARTS = (_runs("A-Za-z0-9+/"), _runs("A-Za-z0-9_-"), _runs("A-Za-z0-9+"))

# Encodings, the first that fits is taken, with their symbols in order.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", r"^[A-Z2-7]+=*$", _LETTERS + "234567"),
    ("base62", r"^[A-Za-z0-9]+$", _LETTERS + _LETTERS.lower() + "0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _LETTERS + _LETTERS.lower() + "0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _LETTERS + _LETTERS.lower() + "0123456789-_"),
)


def _symbols(token: Column) -> Column:
    """Struct of the alphabet's size ``k`` and the symbols' places ``x`` in it; null for tokens without an encoding."""

    def places(plain: Column, alphabet: str) -> Column:
        found = F.transform(F.split(plain, ""), lambda c: F.when(c != "", F.instr(F.lit(alphabet), c) - 1).otherwise(-1))
        return F.struct(F.lit(len(alphabet)).alias("k"), F.filter(found, lambda v: v >= 0).alias("x"))

    out = F.lit(None).cast("struct<k:int,x:array<int>>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        plain = F.regexp_replace(F.lower(token) if name == "hex" else token, "=+$", "")
        out = F.when(token.rlike(pattern), places(plain, alphabet)).otherwise(out)
    return out


def p_value(token: Column) -> Column:
    """How well the token's symbols pass as random; null for tokens without an encoding or of under eight symbols."""

    def sums(x: Column, f) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(0.0), lambda acc, i: acc + f(i).cast("double"))

    def battery(s: Column) -> Column:
        x, k = s["x"], s["k"].cast("double")
        n = F.size(x).cast("double")
        plain = F.array_join(F.transform(x, lambda v: F.char(v + 33)), "")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, v: acc + F.pow((F.size(x) - F.length(F.replace(plain, F.char(v + 33), F.lit("")))).cast("double"), 2))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = sums(x, lambda i: (F.get(x, i) * 2 >= k).cast("int"))
        runs = 1 + sums(x, lambda i: F.when((i > 0) & ((F.get(x, i) * 2 >= k) != (F.get(x, i - 1) * 2 >= k)), 1).otherwise(0))
        expected = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        mean = sums(x, lambda i: F.get(x, i)) / n

        def correlation(m: Column) -> Column:
            variance = sums(x, lambda i: F.pow(F.get(x, i) - m, 2))
            lagged = sums(x, lambda i: F.when(i > 0, (F.get(x, i) - m) * (F.get(x, i - 1) - m)).otherwise(0.0))
            return F.abs(lagged / F.greatest(variance, F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n))

        p_runs = 2 * upper_tail(F.abs(runs - expected) / spread)
        p_serial = 2 * upper_tail(let(mean, correlation))
        return F.when(n >= 8, F.least(F.lit(1.0), 3 * F.least(upper_tail(chi), p_runs, p_serial)))

    return let(_symbols(token), lambda s: F.when(s.isNotNull(), battery(s)))


def _p_bin(p: Column) -> Column:
    return F.least(F.floor(-100 * F.log10(F.greatest(p, F.lit(1e-40)))), F.lit(BINS)).cast("int")


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def candidates(text: Column) -> Column:
    """``array<struct<match, start, end, class, bin>>``: long tokens with a letter and a digit, with their length class and p-value bin.

    Tokens that fit no encoding, as those that mix ``/`` with ``-``, give their parts instead, which may overlap.
    """

    def parts(s: Column) -> Column:
        found = F.array_distinct(F.concat(*[regex_spans(s["match"], p) for p in PARTS]))
        return F.transform(found, lambda q: F.struct(q["match"], (s["start"] + q["start"]).alias("start"), (s["start"] + q["end"]).alias("end")))

    encoded = "|".join(f"(?:{pattern})" for _, pattern, _ in ENCODINGS)
    tokens = F.flatten(F.transform(regex_spans(text, TOKEN), lambda s: F.when(s["match"].rlike(encoded), F.array(s)).otherwise(parts(s))))
    mixed = F.filter(tokens, lambda s: (s["end"] - s["start"] >= LEAST_TOKEN) & s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    tested = F.transform(mixed, lambda s: F.struct(s["match"], s["start"], s["end"], _length_class(s["end"] - s["start"]).alias("class"), _p_bin(p_value(s["match"])).alias("bin")))
    return F.filter(tested, lambda s: s["bin"].isNotNull())


def _decoys(words: Column, seed: Column, classes: list[int], wanted: dict[int, Column] | None = None) -> Column:
    """For each length class a token made of ``words`` from a place on, capitalised and closed by a digit, going round at the end.

    A class gets one where the words fill it, so a text's decoys are together no longer than twice the text; with
    ``wanted`` where that holds, and short arrays go round more than once.
    """
    letters = F.length(F.array_join(words, ""))

    def one(size: int) -> Column:
        n = max(LEAST_TOKEN + 4, 3 << (size - 1))
        at = F.pmod(F.xxhash64(seed, F.lit(size)), F.size(words)).cast("int")
        # words have two letters at least
        joined = F.array_join(F.transform(F.sequence(at, at + n // 2), lambda i: F.initcap(F.get(words, (i % F.size(words)).cast("int")))), "")
        token = F.concat(F.substring(joined, 1, n - 1), F.pmod(at, F.lit(10)).cast("string"))
        return F.when(letters >= n if wanted is None else wanted[size], F.struct(F.lit(size).alias("class"), _p_bin(p_value(token)).alias("bin")))

    return F.filter(F.array(*[one(c) for c in classes]), lambda d: d["bin"].isNotNull())


def decoys(texts: DataFrame, classes: list[int]) -> DataFrame:
    """``class, bin`` of decoys of each length class: one from each different one of all ``texts(text)`` whose words fill it, and where that makes fewer than ``DECOYS``, the others from ``WORDS``."""
    spark = texts.sparkSession
    if not classes:
        return spark.createDataFrame([], "class int, bin int")
    # equal texts give equal decoys, which count once
    known = texts.where("text is not null").select(F.sha2("text", 256).alias("digest"), F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("words"), F.xxhash64("text").alias("seed"))
    own = known.select("digest", let(F.col("words"), lambda w: _decoys(w, F.col("seed"), classes)).alias("d")).dropDuplicates(["digest"])
    own = cut(own.select(F.inline("d")), "decoys")
    have = dict(own.groupBy("class").agg(F.count("*")).collect())
    short = {c: max(0, DECOYS - have.get(c, 0)) for c in classes}
    picked = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.get(F.array(*[F.lit(w) for w in WORDS]), F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))).cast("int")))
    more = spark.range(max(short.values())).select("id", picked.alias("words"), F.xxhash64("id").alias("seed"))
    wanted = {c: F.col("id") < n for c, n in short.items()}
    return own.unionByName(more.select(F.inline(let(F.col("words"), lambda w: _decoys(w, F.col("seed"), classes, wanted)))))


def random_limits(tokens: DataFrame, texts: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class with a secret the bin from which on (smaller p) tokens are ordinary, by the ``tokens(class, bin)`` of all documents and decoys from ``texts(text)``.

    Bins count downwards in p: bin b holds p in (10**-((b + 1) / 100), 10**(-b / 100)]. What comes to the driver is a
    row for each length class.
    """
    real = cut(tokens.groupBy("class", "bin").agg(F.count("*").alias("real")), "token-bins")
    classes = sorted(r[0] for r in real.select("class").distinct().collect())
    false = decoys(texts, classes).groupBy("class", "bin").agg(F.count("*").alias("false"))
    found = real.join(false, ["class", "bin"], "full").fillna(0, ["real", "false"])
    better, whole = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    ranked = found.select("class", "bin", *[F.sum(c).over(w).alias(f"{c}_{n}") for c in ("real", "false") for n, w in (("to", better), ("all", whole))])
    foretold = F.col("real_all") * (F.col("false_to") + 1) / (F.col("false_all") + 1)
    able = ranked.where((F.col("false_all") > 0) & (foretold <= fdr * F.col("real_to")) & (F.pow(F.lit(10.0), -F.col("bin") / 100) >= FLOOR) & (F.col("real_to") > 0))
    return {r["class"]: r["bin"] + 1 for r in able.groupBy("class").agg(F.max("bin").alias("bin")).collect()}


def base_spans(text: Column) -> Column:
    """``array<struct<start, n, kind, end>>`` of the base formats; ``n`` is the kind's place in ``KINDS``."""
    long_enough = F.filter(regex_spans(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    return F.concat(_of("assign", long_enough), _of("access", regex_spans(text, ACCESS)), _of("hex", regex_spans(text, HEX)))


def _of(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("n"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``out`` of spans (kind, start, end), in code points, by start, then kind as listed.

    Null texts count as empty and have no spans; base kinds are always returned. Repeated rows get equal spans, an
    empty table stays empty, other columns pass unchanged; a column already named ``out`` is replaced. A text of any
    length is taken whole, in one row. With ``keep`` only those columns of ``docs`` are returned, and written.
    """
    base, tested = free_names(docs, "base", "tested")
    columns = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = F.transform(candidates(whole), lambda s: F.struct(s["start"], s["end"], s["class"], s["bin"]))
    rows = cut(docs.select(*columns, base_spans(whole).alias(base), tokens.alias(tested)), "tokens")
    limits = random_limits(rows.select(F.explode(tested).alias("c")).select("c.class", "c.bin"), docs.select(F.col(text).alias("text")))

    def kept(s: Column) -> Column:
        verdict = F.lit(False)
        for size, least in sorted(limits.items()):
            verdict = F.when(s["class"] == size, s["bin"] < least).otherwise(verdict)
        return verdict

    spans = F.array_sort(F.concat(base, _of("random", F.filter(tested, kept))))
    return rows.select(*columns, F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])).alias(out))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (of overlapping spans the union); ``n_chars``, if there, follows.

    Null texts stay null. All rows and columns stay, whatever the columns' names; repeated rows get equal texts, an
    empty table stays empty, a text of any length is one row.
    """
    (found_in,) = free_names(docs, "secrets")
    found = find_secrets(docs, text, found_in)
    long = F.lit(0).cast("long")

    def pieces(spans: Column) -> Column:
        # the end of what is dealt with before each span
        reached = running(F.transform(spans, lambda s: s["end"]), long, lambda x, y: F.greatest(x, y))
        cut = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(F.col(text), at.cast("int") + 1, (s["start"] - at).cast("int")), F.lit(mark))).otherwise(""))
        last = F.aggregate(spans, long, lambda acc, s: F.greatest(acc, s["end"]))
        return F.concat(F.array_join(cut, ""), let(last, lambda at: F.substring(F.col(text), at.cast("int") + 1, F.length(text))))

    done = found.withColumn(text, F.when(F.size(found_in) > 0, let(F.col(found_in), pieces)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
