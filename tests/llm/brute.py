"""Plain single-process versions of the operators' contracts, to hold the Spark results against."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(spans, order):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted((s, order.index(k), k, e) for k, s, e in spans))


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII_KINDS = ["email", "ip", "card", "phone"]


def pii(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


SECRET_KINDS = ["assign", "access", "hex"]


def secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append(("assign", *m.span()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append(("access", *m.span()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append(("hex", *m.span()))
    return out


def warc(pages, least=0):
    """page_id, html -> (page_id, bytes, digest, type, refers_to) rows."""
    groups = defaultdict(list)
    for page, html in pages:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, ids in groups.items():
        ids.sort(key=lambda p: (p is None, p))
        for i, page in enumerate(ids):
            revisit = i > 0 and len(payload) >= least
            out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", ids[0] if revisit else None))
    return out


def chat(rows):
    """conv_id, turn, role, text rows -> conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha256(loss))
    return out


def near_duplicates(docs, k, percent):
    """doc_id, text rows -> (doc_id, set size, component) rows."""
    sets = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


def leaks(docs, items, k, similarity):
    """All windows of all texts against all items: (doc_id, item_id) -> best weighted Jaccard similarity."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    bags = [(i, len(w), Counter(grams(w))) for i, w in dict.fromkeys((i, tuple(words(t))) for i, t in items) if len(w) >= k]
    df = Counter(g for _, _, b in bags for g in b)
    rare = math.log1p(len(bags))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, size, bag in bags:
            for s in range(max(1, len(w))):
                own = Counter(grams(w[s : s + size]))
                weight = lambda g: math.log1p(len(bags) / df[g]) if g in bag else rare  # noqa: B023, E731
                both = sum(weight(g) * min(n, bag[g]) for g, n in own.items())
                union = sum(weight(g) * max(own[g], bag[g]) for g in own.keys() | bag.keys())
                if both >= similarity * union and both:
                    out[d, i] = max(out.get((d, i), 0), both / union)
    return out


def top_k(rows, k=5, every=50):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            c = [math.floor(256 * x) for x in v]
            vectors[i] = min(c, vectors.get(i, c))
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def pfair(weights, blocks):
    """Slot by slot over all sources: of the blocks whose time has begun, that whose time ends first; then those without weight."""
    out = []
    for tier in (True, False):
        w = {s: weights[s] if tier else blocks[s] for s in sorted(blocks) if blocks[s] and (weights.get(s, 0) > 0) == tier}
        done, total, left, now = {s: 0 for s in w}, sum(w.values()), sum(w.values()), 0.0
        while open_ := [s for s in w if done[s] < blocks[s]]:
            now += total / left
            able = [s for s in open_ if done[s] / w[s] * total < now - 1e-9] or [min(open_, key=lambda s: (done[s] / w[s], s))]
            s = min(able, key=lambda s: ((done[s] + 1) / w[s], s))
            out.append((s, done[s]))
            done[s] += 1
            if done[s] == blocks[s]:
                left = max(left - w[s], total * 1e-12)
    return out


def byte_grams(text):
    out = []
    data = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in f" {text.lower()}  ".encode())
    for i in range(len(data) - 3):
        if data[i : i + 4].strip():
            out.append(data[i : i + 4])
    return out


def languages(rows, texts):
    """doc, text, lang rows and doc, text rows -> doc: (languages, share): those that hold the most of its n-grams."""
    sets = defaultdict(set)
    for _, t, lang in rows:
        sets[lang].update(byte_grams(t))
    out = {}
    for d, t in texts:
        grams = byte_grams(t)
        claims = {lang: sum(g in s for g in grams) for lang, s in sets.items()}
        top = max(claims.values())
        out[d] = {lang for lang, n in claims.items() if n == top}, top / max(1, sum(claims.values()))
    return out


def secret_limits(real, false, fdr, floor):
    """(class, bin) of tokens and decoys -> for each class with decoys the bin after the last at which the foretold share of false discoveries is small enough."""
    out = {}
    for c in {c for c, _ in real + false}:
        mine, decoys = [b for k, b in real if k == c], [b for k, b in false if k == c]
        for b in sorted({*mine, *decoys}):
            got = sum(x <= b for x in mine)
            if decoys and got and len(mine) * (sum(x <= b for x in decoys) + 1) / (len(decoys) + 1) <= fdr * got and 10 ** (-b / 100) >= floor:
                out[c] = b + 1
    return out


def severity(text, weights, thresholds, beginnings=(4, 5, 6, 7)):
    """Expected severity, most probable grade, and whether grade 1 or more is likelier than not; without a known feature all are 0."""
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        counts.update([word, *(word[:k] + "*" for k in beginnings if len(word) > k)])
    known = {f: n for f, n in counts.items() if f in weights}
    if not known:
        return 0.0, 0, False
    margin = sum(weights[f] * math.log(1 + min(n, 8)) for f, n in known.items())
    above = [1 / (1 + math.exp(t - margin)) for t in thresholds]
    probs = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
    return sum(above), probs.index(max(probs)), above[0] >= 0.5
