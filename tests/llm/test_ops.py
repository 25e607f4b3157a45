"""Each operator against a plain version of its contract, on small tables with nulls, empties, ties, repeats and odd columns."""

import math
import random
from collections import Counter

import brute as B
import pytest
from pyspark.sql import functions as F

from lectern.llm import chat, components, decontaminate, knn, langid, minhash, mixing, pii, queries, secrets, toxicity, warc

WORDS = [a + b for a in ("ta", "mo", "ri", "ke", "su", "nel", "por", "vi") for b in ("da", "lo", "mi", "sor", "ten", "ku")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "x", "ing")) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Originals, exact copies, near copies, a chain of variants, short and empty texts, null ids and repeated ids."""
    rng = random.Random(5)
    rows = []
    for i in range(40):
        rows.append((i, prose(rng, 60)))
    base = prose(rng, 120).split()
    for i in range(40, 80):  # variants that are near the base only
        w = list(base)
        w[rng.randrange(120)] = f"edit{i}"
        w[rng.randrange(120)] = f"edit{i}b"
        rows.append((i, " ".join(w)))
    rows.append((80, " ".join(base).upper()))
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one two"), (None, "one"), (None, rows[0][1])]
    rows += [(7, rows[7][1]), (300, rows[3][1]), (300, rows[50][1]), (301, "é " * 200), (302, "é " * 201)]
    rows.append((303, "long " * 60000))
    return rows


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# ---- near duplicates -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, docs, k, percent):
    got = minhash.near_duplicates(frame(spark, docs), k, percent).collect()
    want = B.near_duplicates(docs, k, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(want)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_an_empty_table_and_with_clashing_columns(spark, docs):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    odd = frame(spark, docs[:20]).withColumns({c: F.lit("x") for c in ("sig", "rep", "kept", "component_id", "n")})
    assert minhash.near_duplicates(odd, 3, 85).count() == 20


def test_large_nodes_are_compared_in_blocks(spark):
    """With one-member leaves and few orders nearly all sets stop in large nodes."""
    rng = random.Random(9)
    base = prose(rng, 60).split()
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(frame(spark, rows), 3, 85, leaf=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(B.near_duplicates(rows, 3, 85))


def test_drop_near_duplicates_keeps_one_of_each_group(spark, docs):
    rows = [(i, t, "s") for i, t in docs]
    kept = minhash.drop_near_duplicates(frame(spark, rows, "doc_id long, text string, source string"), 3, 85)
    assert kept.columns == ["doc_id", "text", "source"]
    want = {c for _, _, c in B.near_duplicates(docs, 3, 85) if c is not None}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert set(ids) - {None} == want
    assert len([i for i in ids if i is not None]) == len(want)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.id: r.component for r in components.connected_components(frame(spark, edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(frame(spark, [], "u long, v long")).count() == 0


# ---- WARC ----------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9), (6, "u", "z" * 1000), (7, "u", "z" * 1000), (None, "u", "<p>x</p>"), (None, "v", "only"), (8, "u", "twice"), (8, "u", "twice"), (9, "u", "Ü" * 333)]


@pytest.mark.parametrize(("least", "chunk"), [(0, 1 << 16), (5, 7), (2000, 100)])
def test_warc_round_trip(spark, tmp_path, least, chunk):
    pages = frame(spark, PAGES, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages, path, least, chunk)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect())
    assert got == Counter(B.warc([(p, h) for p, _, h in PAGES], least))


def test_warc_chunks_put_together_are_the_payload(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_archives(frame(spark, PAGES, "page_id long, url string, html string"), path, chunk=50)
    rows = warc.read_chunks(spark, path).where("record_type = 'response'").orderBy("record_id", "chunk_no").collect()
    bodies = {}
    for r in rows:
        bodies.setdefault((r.page_id, r.record_id), []).append(bytes(r.chunk))
        assert len(bytes(r.chunk)) <= 200
    assert {b"".join(v) for v in bodies.values()} == {(h or "").encode() for _, _, h in PAGES}


@pytest.mark.parametrize("seed", range(3))
def test_warc_of_payloads_full_of_line_ends_and_repeated_ids(spark, tmp_path, seed):
    rng = random.Random(seed)
    pages = [(rng.choice((None, 1, 2, i)), "u", "".join(rng.choices(["\r\n", "\r", "\n", "é", "a", "\r\n\r\n", "WARC/1.1\r\n"], k=rng.randrange(40)))) for i in range(150)]
    pages += [(5, "u", "ü" * 40_000), (5, "u", "v" * 70_000), (None, "u", "w\r\n" * 40_000), (None, "u", "é\n" * 70_000)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(frame(spark, pages, "page_id long, url string, html string"), path, chunk=(3, 64, 1 << 16)[seed])
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect())
    assert got == Counter(B.warc([(p, h) for p, _, h in pages]))


def test_warc_damage_is_noticed(spark, tmp_path):
    import gzip

    path = tmp_path / "w"
    warc.write_archives(frame(spark, PAGES, "page_id long, url string, html string"), f"file://{path}", chunk=50)
    part = next(p for p in path.glob("part-*") if b"zzzz" in gzip.decompress(p.read_bytes()))
    part.write_bytes(gzip.compress(gzip.decompress(part.read_bytes()).replace(b"zzzz", b"zzyz", 1)))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="digest|follow"):
        warc.read_records(spark, f"file://{path}").collect()


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_archives(frame(spark, [], "page_id long, url string, html string"), f"file://{tmp_path}/w")
    assert warc.read_records(spark, f"file://{tmp_path}/w").count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------


def leak_rows(rng, items):
    rows = [(i, prose(rng, 50)) for i in range(20)]
    for i in range(20, 110):
        w = items[i % 12][1].split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "changed"
        if i % 5 == 1:  # halves, or the first third, moved
            cut = len(w) // (2 + i % 2)
            w = w[cut:] + w[:cut]
        if i % 5 == 2:
            w.insert(rng.randrange(len(w)), "inserted")
        if i % 5 == 3:
            w = w[: -(1 + i % 4)]
        rows.append((i, prose(rng, 20 * (i % 3)) + ", " + " ".join(w).upper() + "! " + prose(rng, 20 * (i % 7 > 2))))
    rows += [(200, items[0][1]), (201, items[1][1] + " " + items[2][1]), (202, None), (203, ""), (204, "the " * 500), (200, items[0][1]), (None, items[3][1] + " tail")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, seed):
    rng = random.Random(11 + seed)
    items = [(i, prose(rng, rng.randrange(12, 60))) for i in range(12)] + [(20, "one two"), (21, None), (22, ""), (23, "the the the the the the"), (24, "of the people by the people for the people")]
    items += [(25, prose(rng, 9)), (25, prose(rng, 30))]
    rows = leak_rows(rng, items)
    benchmark = frame(spark, items, "item_id long, text string")
    odd = frame(spark, rows).withColumns({c: F.lit("x") for c in ("d", "r", "_d", "pos", "h", "_row", "item", "size")})
    found = decontaminate.contaminated(odd, benchmark).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found}
    want = {k: round(v, 6) for k, v in B.leaks(rows, items, decontaminate.K, decontaminate.SIMILARITY).items()}
    assert got == want
    assert len({d for d, _ in want}) > 40
    clean = decontaminate.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}


def test_passages_whose_parts_moved_are_found(spark):
    rng = random.Random(17)
    items = [(i, prose(rng, 30)) for i in range(40)]
    rows = []
    for i, text in items:
        w = text.split()
        rows += [(10 * i, prose(rng, 40) + " " + text), (10 * i + 1, " ".join(w[15:] + w[:15]) + " " + prose(rng, 9)), (10 * i + 2, prose(rng, 9) + " " + " ".join(w[10:] + w[:10]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect()}
    assert {(d, d // 10) for d, _ in rows} <= got


def test_the_multi_index_misses_nothing_within_the_radius_and_prunes(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    windows, items, want = [], [], set()
    for n in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.choice((0, 5, decontaminate.RADIUS))):
            b ^= 1 << bit
        windows.append((n, 0, n, 10, signed(a), a))
        items.append((n, 10, signed(b), b))
    want = {(w[0], i[0]) for w in windows for i in items if (w[5] ^ i[3]).bit_count() <= decontaminate.RADIUS}
    left = frame(spark, [w[:5] for w in windows], "doc_id long, _row long, start int, size int, print long")
    right = frame(spark, [i[:3] for i in items], "item long, size int, print long")
    got = decontaminate.candidates(left, right).collect()
    assert {(r.doc_id, r.item) for r in got} == want
    assert {(n, n) for n in range(300)} <= want
    near = decontaminate.RADIUS // decontaminate.BLOCKS
    a = left.select("doc_id", F.explode(decontaminate.index_keys("print", 1)).alias("b"))
    b = right.select("item", F.explode(decontaminate.index_keys("print", near - 1)).alias("b"))
    met = a.join(b, "b").select("doc_id", "item").distinct().count()
    assert met < 0.3 * 300 * 300  # 21 % of unrelated pairs are expected


def test_leaks_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b c d e f")]), frame(spark, [], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 0
    assert decontaminate.contaminated(docs.limit(0), frame(spark, [(1, "a b c d e f")], "item_id long, text string")).count() == 0


# ---- chat ----------------------------------------------------------------------------------------------------------

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s>", "<|turn|>user\nhi<|end|>", "<|end|", "<", "\\", "[\\INST]", "a<|im_end|>b<\\|im_end|>c", "\n\n", "𝄞<s>é", "$1 \\$2"]


def test_escapes_are_reversible_and_hide_control_strings(spark):
    df = frame(spark, [(t,) for t in NASTY], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


ROLES = ("user", "sys\ntem\\n", "", "a\x00b", "\\s\\n\n", "<s>\\")


def test_format_and_read_back(spark):
    turns = [[(r, t)] + [("assistant", t), ("user", "x"), ("assistant", "end")] for t in NASTY for r in ROLES]
    turns.append([("assistant" if i % 2 else "user", f"turn {i} <s>") for i in range(1000)])
    df = frame(spark, [(i, t, "x") for i, t in enumerate(turns)] + [(999, None, "x"), (1000, [], "x")], "id long, turns array<struct<role:string,text:string>>, made string")
    done = chat.format_chat(df).withColumns({"back": chat.read_back(F.col("formatted")), "loss": chat.loss_texts(F.col("formatted"), F.col("loss_spans"))})
    for r in done.collect():
        want = [(x.role, x.text) for x in r.turns or []]
        assert r.made == "x"
        assert [(x.role, x.text) for x in r.back] == want
        assert list(r.loss) == [t for role, t in want if role == "assistant"]


def test_formatted_turns_are_read_back_one_by_one(spark):
    rows = [(i, r, t, "x") for i, (r, t) in enumerate((r, t) for r in (*ROLES, None, "assistant") for t in (*NASTY, None))]
    df = frame(spark, rows, "id long, role string, text string, made string").withColumn("piece", F.lit("clash"))
    done = chat.format_turns(df).withColumns({"back": chat.read_turn(F.col("piece")), "loss": chat.loss_text(F.col("piece"), F.col("loss_start"), F.col("loss_end"))})
    got = {r.id: r for r in done.collect()}
    for i, role, text, _ in rows:
        r = got[i]
        assert (r.back.role, r.back.text, r.made) == (role or "", text or "", "x")
        assert r.loss == ((text or "") if role == "assistant" else "")
        assert not any(c in r.piece[len(chat.TURN) : -len(chat.END)] for c in chat.CONTROL)
    assert chat.format_turns(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 300, 0])
def test_conversations_of_any_size_have_equal_digests(spark, limit):
    rows = [(c, t, ("user", "assistant", "a\x00\\", None)[t % 4], NASTY[(c + t) % len(NASTY)]) for c in range(6) for t in range(12)]
    rows += [(None, 0, "user", "null id"), (7, None, "assistant", None), (7, 1, "user", "b"), (8, 1, "assistant", "same"), (8, 1, "assistant", "same"), (9, 0, "assistant", "x" * 5000)]
    got = queries.chat_digests(frame(spark, rows, "conv_id long, turn long, role string, text string"), limit).collect()
    probe = "</s>[INST] ok [/INST]"
    want = B.chat([*rows, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_records_that_are_too_long_for_a_variant(spark, monkeypatch):
    monkeypatch.setattr(chat, "VARIANT_BYTES", 100)
    pad = "y" * 200
    records = [f'{{"messages":[{{"role":"user","content":"{pad}"}}]}}', f'{{"dialog":{{"turns":[{{"speaker":"user","utterance":"{pad}"}}]}}}}', f'{{"prompt":"{pad}","response":"b"}}', f'{{"other":"{pad}"}}', f'{{"conversations":[{{"from":"human","value":"{pad}"}}]}}', pad]
    got = {r.id: r for r in chat.canonical_turns(frame(spark, list(enumerate(records)), "id long, record string")).collect()}
    assert [got[i].layout for i in range(6)] == ["messages", "dialog", "prompt", None, "conversations", None]
    assert [(t.role, t.text) for t in got[4].turns] == [("user", pad)]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", pad), ("assistant", "b")]
    assert got[3].turns is None


def test_layouts_are_told_by_their_fields(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}', "messages", [("user", "a"), ("assistant", "b")]),
        ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}', None, None),
        ('{"conversations":[{"value":"a","from":"human"},{"from":"gpt","value":"b"}]}', "conversations", [("user", "a"), ("assistant", "b")]),
        ('{"dialog":{"turns":[{"speaker":"user","utterance":"a, b: <c> {"}]}}', "dialog", [("user", "a, b: <c> {")]),
        ('{"response":"b","prompt":"a"}', "prompt", [("user", "a"), ("assistant", "b")]),
        ('{"instruction":"a","output":"b"}', "instruction", [("user", "a"), ("assistant", "b")]),
        ('{"system":"s","instruction":"a","output":"b"}', "instruction_system", [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ('{"unknown":1}', None, None),
        ("no json", None, None),
        (None, None, None),
        ("[1]", None, None),
    ]
    df = frame(spark, [(i, r[0], "x") for i, r in enumerate(records)], "id long, record string, layout string")
    for r in chat.canonical_turns(df).collect():
        _, layout, turns = records[r.id]
        if r.id == 1:  # a null among the values may keep its layout or lose it, but never its row
            continue
        assert r.layout == layout
        assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == turns
    assert chat.canonical_turns(df).count() == len(records)


# ---- toxicity ------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["awful", "nasty", "vileword"]
    rows, labels = [], []
    for i in range(900):
        w = prose(rng, 60).split()
        toxic = i % 4 == 0
        for _ in range(rng.choice((2, 4, 8)) if toxic else 0):
            w[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(frame(spark, rows[:600]), frame(spark, labels[:600] + [(5, None), (None, 1), (0, 1)], "doc_id long, toxic int"))
    assert model.thresholds == sorted(model.thresholds)
    assert len(model.thresholds) == toxicity.GRADES
    got = {r.doc_id: r for r in toxicity.severity(frame(spark, rows[600:] + [(9001, None), (9002, ""), (9003, "nasty " * 5000)]), model).collect()}
    wrong = sum(got[i].toxic != bool(t) for i, t in labels[600:])
    assert wrong <= 3
    assert got[9001].toxic is False
    assert got[9002].expected_severity == 0.0
    assert got[9003].grade >= 2  # one word over and over counts as eight of it
    few = [r for i, t in rows[600:] if (r := got[i]).toxic and sum(w in bad for w in t.split()) <= 2]
    many = [r for i, t in rows[600:] if (r := got[i]).toxic and sum(w in bad for w in t.split()) >= 7]
    assert sum(r.expected_severity for r in few) / len(few) < sum(r.expected_severity for r in many) / len(many)


def test_toxicity_without_anything_to_learn(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        model = toxicity.fit(docs, frame(spark, labels, "doc_id long, toxic int"))
        assert [r.toxic for r in toxicity.severity(docs, model).collect()] == [False, False]
    assert toxicity.drop_toxic(docs.limit(0), frame(spark, [], "doc_id long, toxic int")).count() == 0


def test_toxicity_sample_is_bounded_in_rows(spark):
    docs = frame(spark, [(i % 3, f"text {i % 7}") for i in range(600)])
    labels = frame(spark, [(0, 1), (1, 0), (2, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels).collect()
    assert sorted((r.doc_id, r.text, r.toxic) for r in got) == [(0, "text 0", 1), (1, "text 0", 0), (2, "text 0", 1)]
    assert toxicity.training_rows(docs, labels, 2).count() <= 2


def test_severity_equals_the_plain_model(spark):
    """Sum of sigmoid(w . x - t) over the thresholds; x is log(1 + count) up to eight, of words and word beginnings."""
    model = toxicity.OrdinalModel({"awful": 1.5, "awfu*": 0.5, "nice": -2.0, "grueso*": 0.7}, [0.5, 1.5, 3.0])
    texts = ["awful", "Awful awful AWFUL nice", "awfully gruesome", "nice", "", None, "nothing", "awful " * 20_000, "x1awful2 awful_awful", "é" * 70_000 + " awful"]
    rows = frame(spark, list(enumerate(texts))).withColumns({c: F.lit("x") for c in ("graded", "_graded", "toxic")})
    got = toxicity.severity(rows, model)
    assert got.columns == ["doc_id", "text", "graded", "_graded", "expected_severity", "grade", "toxic"]
    for r in got.collect():
        severity, grade, toxic = B.severity(texts[r.doc_id], model.weights, model.thresholds)
        assert (round(r.expected_severity, 9), r.grade, r.toxic) == (round(severity, 9), grade, toxic)


def test_the_fit_is_a_maximum_of_the_penalised_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    rows, cols = np.repeat(np.arange(200), 3), rng.integers(0, 6, 600)
    values, grades = rng.uniform(0.5, 2, 600), rng.integers(0, 4, 200)
    w, t = toxicity.fit_cumulative_link(rows, cols, values, grades, 6, steps=4000)

    def loss(w, t):
        margin = np.bincount(rows, weights=values * w[cols], minlength=200)
        upper = np.hstack([np.ones((200, 1)), 1 / (1 + np.exp(t[None, :] - margin[:, None])), np.zeros((200, 1))])
        return -np.log(upper[np.arange(200), grades] - upper[np.arange(200), grades + 1]).sum() + 0.1 * (w**2).sum()

    best = loss(w, t)
    assert list(t) == sorted(t)
    for i in range(6):
        for step in (-0.05, 0.05):
            assert loss(w + step * np.eye(6)[i], t) >= best - 1e-3
    for i in range(3):
        for step in (-0.03, 0.03):
            assert loss(w, t + step * np.eye(3)[i]) >= best - 1e-3


# ---- personal data and secrets -------------------------------------------------------------------------------------

PII_TEXTS = [
    None, "", "a@b.c@d.e x@y", "é.x+y%z@A-b.co.uk. and @nobody.com a@b a@.c", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004",
    "+1 (555) 123-4567 +12 +1234567890123456 +44 20 7946 0958.", "x" * 50000 + "@" + "y" * 50000, "1" * 30000, "12 " * 20000, "+1" + " " * 30000 + "2", "a@b.c" * 3000, "𝄞 mail a@b.de", "GB82 WEST 1234 5698 7654 32 iban", "ssn 123-45-6789", "order 123-45-6789", "0" * 16,
]


def test_pii_base_equals_plain_patterns(spark):
    df = frame(spark, list(enumerate(PII_TEXTS))).withColumn("pii", F.lit("clash"))
    for r in pii.find_pii(df).collect():
        base = [(s.kind, s.start, s.end) for s in r.pii if s.kind in B.PII_KINDS]
        assert B.digest(base, B.PII_KINDS) == B.digest(B.pii(PII_TEXTS[r.doc_id]) if len(PII_TEXTS[r.doc_id] or "") < 40000 else [], B.PII_KINDS)
        assert all(0 <= s.score <= 1 for s in r.pii)
    extra = {r.doc_id: [s.kind for s in r.pii if s.kind not in B.PII_KINDS] for r in pii.find_pii(df).collect()}
    assert extra[13] == ["iban"]
    assert extra[14] == ["national_id"]
    assert extra[15] == []
    assert pii.find_pii(df.limit(0)).count() == 0
    assert pii.mask_pii(df.where("doc_id = 12")).first().text == "𝄞 mail <email>"


@pytest.mark.parametrize("seed", range(3))
def test_pii_on_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("a1.9@-+ ()2%é5") for _ in range(300)) for _ in range(60)]
    for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect():
        assert B.digest([(s.kind, s.start, s.end) for s in r.pii if s.kind in B.PII_KINDS], B.PII_KINDS) == B.digest(B.pii(texts[r.doc_id]), B.PII_KINDS)


SECRET_TEXTS = [
    None, "", "password = hunter22 token:abc secret='abcdefgh' API_KEY: \"x/y+z_1.=-\"", "token = secret: abcdefghijkl", "passwd=" + "a" * 30000, "AKIAABCDEFGHIJKL AKIASHORT xAKIA0123456789AB", "f" * 31 + " " + "0123456789abcdef" * 3,
    "𝄞 ApiKey=12345678", "paſſword=12345678", "tokentoken=12345678", "key mZ8kQ1vX7rB3nT9wL5cY2hJ6dF4sG0pA here", "www-example-com-2020-the-same-the-same-title-1", "AKIA" * 9, "deadbeef" * 4000,
]


def test_secrets_base_equals_plain_patterns(spark):
    df = frame(spark, list(enumerate(SECRET_TEXTS))).withColumn("secrets", F.lit("clash"))
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secrets] for r in secrets.find_secrets(df).collect()}
    for i, text in enumerate(SECRET_TEXTS):
        assert B.digest([s for s in rows[i] if s[0] in B.SECRET_KINDS], B.SECRET_KINDS) == B.digest(B.secrets(text), B.SECRET_KINDS), text
    assert [s for s in rows[10] if s[0] == "random"]
    assert secrets.find_secrets(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_secrets_on_random_texts(spark, seed):
    rng = random.Random(seed)
    parts = ["password", "Token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEF123456", "abcdef0123456789", "0f", "xyz", "é", "."]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(60)]
    for r in secrets.find_secrets(frame(spark, list(enumerate(texts)))).collect():
        assert B.digest([(s.kind, s.start, s.end) for s in r.secrets if s.kind in B.SECRET_KINDS], B.SECRET_KINDS) == B.digest(B.secrets(texts[r.doc_id]), B.SECRET_KINDS)


def test_redaction(spark):
    df = frame(spark, [(1, "a password=hunter22 b", 5), (2, None, 7), (3, "clean", 5), (4, "x token=" + "0123456789abcdef" * 2 + " y", 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: (None, 7), 3: ("clean", 5), 4: ("x [SECRET] y", 12)}


def test_secrets_after_names_and_in_paths(spark):
    rng = random.Random(4)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(5)]
    padded = key[4][:18] + "=="
    cases = [("AWS_SECRET_ACCESS_KEY=", key[0], ""), ("?a=1&sig=", key[1], "&b=2"), ("AUTH=", "ghp_" + key[2][:36], " x"), ("é https://x.io/hook-v2_a/", key[3], "/t-1"), ("blob=", padded, ";"), ("k=", padded, "")]
    rows = frame(spark, [(i, "".join(c)) for i, c in enumerate(cases)])
    got = {r.doc_id: [(s.start, s.end) for s in r.secrets if s.kind == "random"] for r in secrets.find_secrets(rows).collect()}
    for i, (before, secret, _) in enumerate(cases):
        assert (len(before), len(before) + len(secret)) in got[i], cases[i]
    clean = {r.doc_id: r.text for r in secrets.redact(rows).collect()}
    assert clean[0] == "AWS_SECRET_ACCESS_KEY=[SECRET]"
    assert not any(secret in clean[i] for i, (_, secret, _) in enumerate(cases))


def test_random_tokens_pass_the_battery_and_words_do_not(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(200)]
    poor = ["".join(rng.choice("aaabeeilnost1") for _ in range(40)) for _ in range(200)]
    rows = frame(spark, [(0, t) for t in good] + [(1, t) for t in poor]).select("doc_id", secrets.p_value(F.col("text")).alias("p")).collect()
    assert sum(r.p > 0.01 for r in rows if r.doc_id == 0) >= 190
    assert sum(r.p < 1e-4 for r in rows if r.doc_id == 1) >= 190


def test_false_discoveries_among_the_secrets(spark):
    """Identifiers made of words are as many as the secrets; hardly any is reported, and nearly all long secrets are."""
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows, secret = [], {}
    for i in range(300):
        name = "get" + "".join(w.capitalize() for w in prose(rng, 12).split())[: rng.choice((22, 40, 70))] + "7"
        token = "".join(rng.choice(alphabet) for _ in range(40))
        secret[i] = token
        rows.append((i, f"{prose(rng, 400)} {name} {token} {prose(rng, 400)}"))
    docs = frame(spark, rows)
    right = wrong = 0
    for r in secrets.find_secrets(docs).collect():
        found = [rows[r.doc_id][1][s.start : s.end] for s in r.secrets if s.kind == "random"]
        right += secret[r.doc_id] in found
        wrong += sum(t != secret[r.doc_id] for t in found)
    assert right >= 280
    assert wrong <= 0.05 * right
    # the limits are those of the rule worked out on all tokens and decoys
    tokens = docs.select(F.explode(secrets.candidates(F.col("text"))).alias("c")).select("c.class", "c.bin")
    real = [tuple(r) for r in tokens.collect()]
    false = [tuple(r) for r in secrets.decoys(docs, sorted({c for c, _ in real})).collect()]
    assert min(Counter(c for c, _ in false).values()) > 0.9 * secrets.DECOYS
    assert secrets.random_limits(tokens, docs) == B.secret_limits(real, false, secrets.FDR, secrets.FLOOR)


def test_words_are_no_secrets_on_small_tables(spark):
    """Three rows are too few to tell by their own words what passes; identifiers of any length are not reported."""
    names = ["getUserAccountByEmailAddress2", "TheNameOfTheLastAccountThatWasLocked7", "parseTheWholeConfigurationFileFromTheDefaultDirectoryAndReportEveryLineThatCouldNotBeRead1" * 2]
    rows = frame(spark, [(i, f"see {n} there") for i, n in enumerate(names)])
    assert [r.secrets for r in secrets.find_secrets(rows).collect()] == [[], [], []]


def test_decoys_come_from_every_different_text(spark):
    """More texts than ``DECOYS``: each gives one to every class that its words fill, copies none, and fixed words are not needed."""
    n = secrets.DECOYS + 500
    texts = [f"{WORDS[i % 48]} {WORDS[i // 48 % 48]} {WORDS[i // 2304]} some more words of it that go on and on for quite some while" for i in range(n)]
    docs = frame(spark, [*enumerate(texts), *[(n + i, t) for i, t in enumerate(texts[:300])], (-1, "short"), (-2, None)])
    found = Counter(c for c, _ in secrets.decoys(docs, [4, 5, 9]).collect())
    assert found == {4: n, 5: n, 9: secrets.DECOYS}


def test_very_many_spans_take_linear_time(spark):
    import time

    text = "token=abcdefgh " * 20_000
    df = frame(spark, [(1, text)])
    began = time.time()
    r = secrets.find_secrets(df).first()
    assert [(s.start, s.end) for s in r.secrets] == [(15 * i, 15 * i + 14) for i in range(20_000)]
    assert secrets.redact(df).first().text == "[SECRET] " * 20_000
    assert time.time() - began < 120


def test_redaction_keeps_columns_of_any_name(spark):
    df = frame(spark, [(1, "a password=hunter22 b")]).withColumns({c: F.lit("x") for c in ("secrets", "_secrets", "at", "out")})
    got = secrets.redact(df)
    assert got.columns == df.columns
    assert tuple(got.first()) == (1, "a [SECRET] b", "x", "x", "x", "x")


# ---- mixing --------------------------------------------------------------------------------------------------------


def test_schedules_equal_a_plain_scheduler_and_keep_every_window():
    rng = random.Random(6)
    cases = [({"a": 0.99999, "b": 0.00001, "c": 0.0}, {"a": 5000, "b": 3, "c": 2}), ({"a": 1.0}, {"a": 4}), ({}, {})]
    cases += [(w, {s: rng.randrange(1, 400) for s in w}) for w in ({f"s{i}": rng.random() ** 3 for i in range(rng.randrange(1, 12))} for _ in range(20))]
    for weights, blocks in cases:
        plan = mixing.schedule(weights, blocks)
        assert plan == B.pfair(weights, blocks)
        assert Counter(s for s, _ in plan) == Counter(blocks)
        total, seen = sum(weights.values()), Counter()
        for t, (s, j) in enumerate(plan):
            assert j == seen[s]
            seen[s] += 1
            if weights[s] > 0:
                share = weights[s] / total
                assert math.floor(j / share + 1e-9) <= t < math.ceil((j + 1) / share - 1e-9)
            assert all(abs(seen[x] - (t + 1) * weights[x] / total) < 1 + 1e-9 for x in weights)
            if seen[s] == blocks[s]:  # from here on the targets can't be met
                break


def test_schedules_of_very_many_sources():
    blocks = {f"s{i}": 1 + i % 3 for i in range(120_000)}
    plan = mixing.schedule({s: 1.0 for s in blocks}, blocks)
    assert Counter(s for s, _ in plan) == Counter(blocks)


def test_mixture_holds_every_row_once(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(None, "hot"), (5, None), (6, None), (7, "s1"), (7, "s1")]
    odd = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in ("slot", "key", "_key", "h", "_h", "bucket", "buckets", "_s", "_j", "w", "c", "k", "x", "rank", "before")}
    df = frame(spark, rows, "doc_id long, source string").withColumns(odd)
    mixed = mixing.mix(df, {"hot": 5.0, "s1": 1.0, None: 1.0}, block_rows=4)
    assert mixed.columns == [c for c in df.columns if c != "slot"] + list(mixing._NEW)
    got = mixed.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in got for c in odd if c != "slot")
    sizes, targets = Counter("null" if s is None else f"={s}" for _, s in rows), {"=hot": 5.0, "=s1": 1.0, "null": 1.0}
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    want = {(s, j): t for t, (s, j) in enumerate(B.pfair({s: targets.get(s, 0.0) for s in sizes}, blocks))}
    assert all(want["null" if r.source is None else f"={r.source}", r.block] == r.slot for r in got)
    for s, n in sizes.items():
        assert sorted((r.block, r.place) for r in got if ("null" if r.source is None else f"={r.source}") == s) == [(i // 4, i % 4) for i in range(n)]
    assert {r.release for r in got if r.source == "s2"} == {None}
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [None, 7])
def test_mixture_of_rows_that_share_an_id(spark, monkeypatch, repeated):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(repeated, "hot")] * 3000 + [(i, "s") for i in range(100)]
    got = mixing.mix(frame(spark, rows, "doc_id long, source string"), block_rows=8).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)


@pytest.mark.parametrize("blocks", [1 << 17, 20])
def test_more_sources_than_are_scheduled_one_by_one(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    sizes = {"a": 600, "b": 500, "c": 400, **{f"t{i}": 4 * (1 + i % 3) for i in range(40)}, "zero": 9, None: 5}
    rows = [(1000 * n + i, s) for n, (s, size) in enumerate(sizes.items()) for i in range(size)]
    weights = {"a": 3.0, "b": 2.0, "c": 2.0} | {s: 0.01 * sizes[s] for s in sizes if s and s[0] == "t"}
    df = frame(spark, rows, "doc_id long, source string").withColumns({c: F.lit("x") for c in ("inner", "later", "due", "tree", "pos")})
    got = mixing.mix(df, weights, block_rows=4)
    assert got.columns == df.columns + list(mixing._NEW)
    got = sorted(got.collect(), key=lambda r: (r.slot, r.place))
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    for s in sizes:
        assert [r.block for r in got if r.source == s] == sorted(i // 4 for i in range(sizes[s]))
    # sources without a weight come last, and the others, small ones as a whole too, follow their targets until one runs out
    assert {r.source for r in got[-14:]} == {"zero", None}
    total, seen = sum(weights.values()), Counter()
    unit = 4 * max(1, -(-sum(-(-sizes[s] // 4) for s in sizes if s and s[0] == "t") // blocks))
    for n, r in enumerate(got, 1):
        seen["tail" if r.source and r.source[0] == "t" else r.source] += 1
        if any(seen[s] == sizes[s] for s in "abc") or seen["tail"] == sum(v for s, v in sizes.items() if s and s[0] == "t"):
            break
        if blocks > 20:
            assert all(abs(seen[s] - n * w / total) < 3 * unit for s, w in (*((s, weights[s]) for s in "abc"), ("tail", sum(w for s, w in weights.items() if s[0] == "t"))))


# ---- nearest neighbours --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [10_000, 60])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard)
    monkeypatch.setattr(knn, "LEAF_ROWS", 8)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[i % 5][1]) for i in range(60)]
    rows += [(600, None), (601, [None] * 6), (602, [float("nan")] * 6), (603, [float("inf")] * 6), (None, rows[0][1]), (700, [1.0, 2.0]), (701, [3.0, 4.0]), (750, []), (50, rows[50][1]), (800, [0.0] * 6)]
    v = knn.integer_vectors(frame(spark, rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)))
    import numpy as np

    exact = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    got = knn.top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(B.top_k(exact))


def test_scores_beyond_64_bits_rank_by_their_value(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 1.0]), (2, [2e18, 1.0]), (3, [-3e18, 1.0]), (4, [0.5, 0.25]), (5, [1e300, -1e300]), (6, [float("inf"), 1.0])]
    v = knn.integer_vectors(frame(spark, rows, "vec_id long, embedding array<double>"))
    got = knn.top_k(v, v.select(F.col("vec_id").alias("query_id"), "v"), 3).collect()
    exact = {i: [math.floor(256 * x) for x in e] for i, e in rows[:6]}
    want = []
    for q, a in exact.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in exact.items() if i != q)[:3]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_nothing(spark):
    v = knn.integer_vectors(frame(spark, [], "vec_id long, embedding array<float>"))
    assert knn.top_k(v, v.select(F.col("vec_id").alias("query_id"), "v")).count() == 0


def test_top_k_sends_neither_blocks_nor_trees_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    plans, searched = [], knn._searched

    def seen(*args):
        out = searched(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(knn, "_searched", seen)
    v = knn.integer_vectors(frame(spark, [(i, [float(i % 7), float(i % 11)]) for i in range(200)], "vec_id long, embedding array<float>"))
    assert knn.top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")).count() == 20
    assert len(plans) == 2
    assert all("FlatMapCoGroupsInPandas" in p and "BroadcastHashJoin [dim" not in p for p in plans)


@pytest.mark.parametrize("together", [1, 3])
def test_top_k_of_many_blocks_and_shards_equals_brute_force(spark, monkeypatch, together):
    """More parts of blocks than one, at home and later, and more queries than vectors."""
    for name, n in (("SHARD_ROWS", 30), ("BLOCK_ROWS", 10), ("PART_BLOCKS", together)):
        monkeypatch.setattr(knn, name, n)
    rows = [(i, [float(i % 7), float(i % 11), float(i % 3)]) for i in range(90)]
    v = knn.integer_vectors(frame(spark, rows, "vec_id long, embedding array<float>"))
    asked = frame(spark, [(1000 + i, [float(i % 5), float(-i % 13), 1.0]) for i in range(200)], "query_id long, v array<double>")
    whole = {i: [256 * x for x in e] for i, e in rows}
    want = []
    for q in asked.collect():
        best = sorted((-sum(x * y for x, y in zip(q.v, e, strict=True)), i) for i, e in whole.items())[:5]
        want += [(q.query_id, n + 1, i, int(-s)) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, knn.top_k(v, asked).collect())) == sorted(want)


# ---- language ------------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    rng = random.Random(12)
    parts = {"aa": ["ba", "ko", "tri", "mun"], "bb": ["shé", "üg", "lorn", "ko"], "cc": ["ñi", "ba", "que", "dor"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    rows = [(i, text(lang, rng.choice((4, 30, 200))), lang) for i in range(600) for lang in [rng.choice(list(parts))]]
    train = frame(spark, rows[:400] + [(9000, None, "aa"), (9001, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    test = [(i, t) for i, t, _ in rows[400:]] + [(9002, None), (9003, "12 34 !"), (9004, ""), (9005, text("bb", 50000)), (9006, "Ж")]
    got = {r.doc_id: r for r in langid.predict(frame(spark, test), model).collect()}
    assert sum(got[i].lang_pred != lang for i, _, lang in rows[400:]) <= 4
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9002, 9003, 9004))
    assert got[9005].lang_pred == "bb"
    assert got[9006].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got.values())


def test_rare_languages_keep_their_grams(spark):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i:02}": ["".join(rng.choices(letters, k=7)) for _ in range(6)] for i in range(70)}
    rows = [(i, " ".join(rng.choices(words[lang], k=5)), lang) for i, lang in enumerate(list(words) * 4)]
    big = [(1000 + i, "".join(rng.choices(letters, k=100_000)), "noise") for i in range(20)]
    model = langid.fit(frame(spark, rows + big, "doc_id long, text string, lang string"))
    assert model.languages == [*sorted(words), "noise"]
    test = [(i, " ".join(w)) for i, w in enumerate(words.values())] + [(100, big[0][1][:3000])]
    got = {r.doc_id: r.lang_pred for r in langid.predict(frame(spark, test), model).collect()}
    assert [got[i] for i in range(70)] == list(words)
    assert got[100] == "noise"


@pytest.mark.parametrize("n_languages", [3, 70])
def test_languages_equal_plain_sets(spark, n_languages):
    """Without false positives the filters are sets: the predictions are those of counting members."""
    rng = random.Random(14)
    letters = "abcdefgh é"
    rows = [(i, "".join(rng.choices(letters, k=rng.choice((3, 40, 900)))), f"l{i % n_languages:02}") for i in range(4 * n_languages)]
    test = [(i, "".join(rng.choices(letters, k=rng.choice((5, 30, 300)))) + " x") for i in range(60)] + [(60, rows[5][1]), (61, rows[6][1])]
    model = langid.fit(frame(spark, rows, "doc_id long, text string, lang string"))
    assert model.false_rate.max() < 1e-4
    got = {r.doc_id: (r.lang_pred, round(r.score, 2)) for r in langid.predict(frame(spark, test), model).collect()}
    for i, (best, score) in B.languages(rows, test).items():
        assert got[i][0] in best
        assert abs(got[i][1] - score) < 0.02


def test_very_long_texts_are_taken_apart_at_blanks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(langid, "PIECE", 10)
    parts, owner = langid.pieces(pa.array(["short", None, "abcdefghijk lmnop qrstuvwxyzab cd", "x" * 30]))
    assert parts.to_pylist() == ["short", "", "abcdefghijk", " lmnop qrstuvwxyzab", " cd", "x" * 30, ""]
    assert owner.tolist() == [0, 1, 2, 2, 2, 3, 3]


def test_null_ids_are_learned_from_and_not_held_out(spark):
    assert [r.h for r in frame(spark, [(None, "a"), (4, "b")]).select(langid.held_out().alias("h")).collect()][0] is False


def test_language_without_training_rows(spark):
    # a language under one id, in different texts and in copies of one, is learned whatever the hash of its id
    for one in range(5, 9):
        rows = [(one, f"bonjour le monde {i} encore une fois", "fr") for i in range(3000)] + [(one + 10, "hallo welt noch einmal bitte", "de")] * 3000
        known = langid.fit(frame(spark, rows + [(i, f"hello world {i} once again", "en") for i in range(100, 200)], "doc_id long, text string, lang string"))
        assert known.languages == ["de", "en", "fr"]
    model = langid.fit(frame(spark, [(1, None, "aa")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.predict(frame(spark, [(1, "abc"), (2, None)]), model).collect()] == ["und", "und"]
