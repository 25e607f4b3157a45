"""Periodic runs, exact groups and the manifest against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import exact, merkle, periodic, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# ---- periodic runs ---------------------------------------------------------------------------------------------------


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                out.append((i, len(stretch), q))
            i = j + 1
    return sorted(out)


def plain_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repetitive(rng, n):
    w = []
    while len(w) < n:
        kind = rng.random()
        if kind < 0.4:
            w += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))]
        else:
            unit = [rng.choice("abc" if kind < 0.7 else "abcdefghijklmnop") for _ in range(rng.randrange(1, 14))]
            w += unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit))]
    return w[:n]


def test_squared_differences_are_exact():
    rng = np.random.default_rng(3)
    for width in (1, 2, 8, 64):
        blocks, windows = rng.integers(0, 64, (5, width)), rng.integers(0, 64, (5, 2 * width))
        want = [[int(((b - w[t : t + width]) ** 2).sum()) for t in range(width)] for b, w in zip(blocks, windows, strict=True)]
        assert periodic.squared_differences(blocks, windows).tolist() == want


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        w = repetitive(rng, rng.randrange(1, 160))
        assert [tuple(r) for r in periodic.runs(np.array([ord(c) for c in w]), len(w)).tolist()] == plain_runs(w), w


def test_runs_of_long_periods_and_of_equal_codes():
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 1 << 40, 3000)
    w = np.concatenate([rng.integers(0, 1 << 40, 777), np.tile(unit, 4), unit[:100], rng.integers(0, 1 << 40, 50)])
    assert periodic.runs(w, len(w)).tolist() == [[777, 12100, 3000]]
    # codes of these words are equal, the words are not
    assert periodic.runs(np.arange(64) << 20, 64).tolist() == []


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", "  \t"]).join(repetitive(rng, rng.randrange(0, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "é é é é é é"), (504, "\x85 \x85 \x85 \x85 \x85 \x85"), (None, "a a a a a a a"), (7, "x y " * 5), (7, "x y " * 5)]
    rows.append((900, "one two three " * 40000 + "end"))
    return rows


def test_periodic_runs_of_texts(spark, texts):
    odd = frame(spark, texts).withColumns({c: F.lit("x") for c in ("runs", "n_words", "collapsed", "start")})
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic.periodic_runs(odd).collect())
    want = Counter()
    for i, t in texts:
        w = words_of(t)
        runs = [(0, 120000, 3)] if i == 900 else plain_runs(w)
        want[(i, len(w), tuple(runs), "one two three end" if i == 900 else plain_collapsed(w, runs))] += 1
    assert got == want
    assert periodic.periodic_runs(frame(spark, [])).count() == 0


def test_collapsing_keeps_texts_without_runs(spark):
    rows = [(1, "a  b\n", "x"), (2, "a a a a a a b", "y"), (3, None, None)]
    out = periodic.collapse_runs(frame(spark, rows, "doc_id long, text string, runs string"))
    assert out.columns == ["doc_id", "text", "runs"]
    assert sorted(map(tuple, out.collect())) == [(1, "a  b\n", "x"), (2, "a b", "y"), (3, None, None)]


def plain_query(i, text):
    w = words_of(text)
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapsed(w, runs)))


def test_query_of_runs_equals_brute_force(spark, texts):
    rng = random.Random(2)
    rows = [r for r in texts if r[0] is not None and r[0] != 900] + [(2000 + i, " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randrange(1, 200)))) for i in range(150)]
    got = queries.run_digests(periodic.periodic_runs(queries.periodic_texts(frame(spark, rows)))).collect()
    assert Counter(map(tuple, got)) == Counter(plain_query(*r) for r in rows)
    assert sum(r.n_runs for r in got) > 50


# ---- exact groups ----------------------------------------------------------------------------------------------------


def plain_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids, size = {}, Counter(norm)
    for (i, _), t in zip(rows, norm, strict=True):
        ids.setdefault(t, []).append(i)
    out = Counter()
    for (i, _), t in zip(rows, norm, strict=True):
        known = [x for x in ids[t] if x is not None]
        keep = min(known) if known else None
        out[(i, keep, size[t], i == keep, sha(t))] += 1
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "a\tb", "a  b", " a b", "a b ", "c", "C", "", None, " ", "\n\t", "\xa0", "d" * 100, f"own {i}"])) for i in range(400)]
    return rows + [(None, "a b"), (None, "only without id"), (None, "only without id"), (5, rows[5][1]), (401, "x" * 500_000), (402, "x" * 500_000), (403, "x" * 500_001)]


def test_exact_groups(spark, copies):
    odd = frame(spark, copies).repartition(7).withColumns({c: F.lit("x") for c in ("digest", "content", "keep_id", "salt", "h")})
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(odd).collect())
    assert got == plain_groups(copies)
    assert exact.exact_groups(frame(spark, [])).count() == 0


def test_texts_under_one_digest_stay_apart(spark, copies):
    weak = exact.exact_groups(frame(spark, copies), digest=lambda c: F.substring(exact.sha256(c), 1, 1)).collect()
    want = Counter((i, keep, size, kept, digest[0]) for (i, keep, size, kept, digest), n in plain_groups(copies).items() for _ in range(n))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in weak) == want


def test_one_group_holds_a_third_of_all_rows(spark):
    rows = spark.range(30000, numPartitions=24).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_groups(rows)
    assert got.where("group_size = 10000 and keep_id = 0").count() == 10000
    assert got.where("kept").count() == 20001


def test_drop_exact_duplicates(spark, copies):
    rows = [(i, t, "s") for i, t in copies]
    out = exact.drop_exact_duplicates(frame(spark, rows, "doc_id long, text string, digest string"))
    assert out.columns == ["doc_id", "text", "digest"]
    want = {(keep, digest) for _, keep, _, _, digest in plain_groups(copies)}
    assert Counter((r.doc_id, sha(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""))) for r in out.collect()) == Counter(want)


# ---- manifest --------------------------------------------------------------------------------------------------------


def plain_leaf(i, source, lang, n, text):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return sha("".join(map(part, (i, source, lang, n, text))))


def plain_tree(digests):
    """Root, and the siblings of each digest level by level with its place."""
    levels, at = [[(d, [i]) for i, d in enumerate(digests)]], {i: [] for i in range(len(digests))}
    while len(levels[-1]) > 1:
        now = []
        for a in range(0, len(levels[-1]), 8):
            run = levels[-1][a : a + 8]
            for k, (_, under) in enumerate(run):
                for i in under:
                    at[i].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
            now.append((sha("".join(d for d, _ in run)), [i for _, under in run for i in under]))
        levels.append(now)
    return levels[-1][0][0], at


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (tree, doc_id, leaf)."""
    groups = {}
    for t, i, d in rows:
        groups.setdefault(t, []).append((i is not None, i or 0, d))
    names = sorted(groups, key=lambda t: (t is not None, (t or "").encode()))
    done = {t: (sorted(g), plain_tree([d for _, _, d in sorted(g)])) for t, g in groups.items()}
    root, top = plain_tree([done[t][1][0] for t in names])
    out = Counter()
    for k, t in enumerate(names):
        order, (sub, at) = done[t]
        for n, (known, i, d) in enumerate(order):
            out[(i if known else None, d, sub, root, sha("".join("".join(s) for _, s in at[n] + top[k])))] += 1
    return out


@pytest.mark.parametrize("block", [8, 64, 512])
def test_manifest_equals_a_plain_tree(spark, block):
    sizes = {"en": 700, "fr": 65, "de": 64, "": 9, None: 8, "x": 1, "ü": 2}
    rows = [(t, i, sha(f"{t}{i}")) for t, n in sizes.items() for i in range(n)]
    rows += [("en", None, sha("null")), ("en", 3, sha("again")), ("fr", 3, sha("fr3")), ("fr", 3, sha("fr3"))]
    random.Random(1).shuffle(rows)
    leaves = frame(spark, rows, "tree string, doc_id long, leaf string").withColumns({c: F.lit("x") for c in ("pos", "root_", "part", "digest_")}).repartition(5)
    got = merkle.verify(merkle.manifest(leaves.select("tree", "doc_id", "leaf"), block), "leaf")
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("witness")).cast("binary"), 256).alias("p"), "verified").collect()
    assert all(r.verified for r in got)
    assert Counter(tuple(r)[:5] for r in got) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(frame(spark, [("en", 1, sha("a"))], "tree string, doc_id long, leaf string")).first()
    assert (one.subroot, one.root, one.witness) == (sha("a"), sha("a"), [])
    assert merkle.manifest(frame(spark, [], "tree string, doc_id long, leaf string")).count() == 0


def test_leaves_of_nulls_and_tampering(spark):
    rows = [(1, "s", "en", 3, "Äb"), (2, None, None, None, None), (None, "", "", 0, ""), (3, "s", "en", 1, "Z" * 100_000)]
    docs = frame(spark, rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = docs.select(merkle.document_leaf(F.col("text")).alias("leaf"), "lang", "doc_id")
    assert [r.leaf for r in got.collect()] == [plain_leaf(*r) for r in rows]
    leaves = got.select(F.col("lang").alias("tree"), "doc_id", "leaf").withColumn("claimed", F.when(F.col("doc_id") == 3, F.sha2(F.lit("other"), 256)).otherwise(F.col("leaf")))
    out = {r.doc_id: r.verified for r in merkle.verify(merkle.manifest(leaves), "claimed").collect()}
    assert out == {1: True, 2: True, None: True, 3: False}
