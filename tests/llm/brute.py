"""Plain versions of the operators, one row or pair at a time, to compare with."""

import functools
import hashlib
import itertools
import re
import zlib
from fractions import Fraction

EMPTY = hashlib.sha256(b"").hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each (doc_id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for item, text in items:
        w = word.findall(lowered(text))
        size = min(10, len(w))
        windows += [(str(item), tuple(w[i : i + size])) for i in range(len(w) - size + 1) if size]
    out = []
    for doc, text in docs:
        w = word.findall(lowered(text))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def near_duplicates(docs, width, percent=80):
    """(doc_id, n_shingles, component_id, kept)."""
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(s), find(d), find(d) == d) for d, s in sets.items()]


def nearest(rows, k=10, scale=1024):
    """(query_id, rank, vec_id, score) for rows (vec_id, vector)."""
    import math

    vectors = sorted({(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, v in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(v) == len(w))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def targets(sizes, cap=3, weights=(1, 2, 3)):
    """source -> target by capped water-filling in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * rest > cap * sizes[s] * w}
        if not above:
            return {s: Fraction(cap * sizes[s]) if s in full else Fraction(weight[s] * rest, w) for s in order}
        full |= above


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    digits = [int(c) for c in s if c in "0123456789"][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            n = sum(c in "0123456789" for c in m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 16 <= n <= 19 and luhn(m[0]), "phone": 8 <= n <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def held(doc_id, n, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == remainder


def line_dedup(docs, size=3):
    """doc_id -> text with the lines of later occurrences of repeated windows cut out."""
    first, lines = {}, {d: t.split("\n") for d, t in docs if t is not None and d is not None}
    for d in sorted(lines):
        for i in range(len(lines[d]) - size + 1):
            first.setdefault(tuple(lines[d][i : i + size]), (d, i))
    out = {}
    for d, x in lines.items():
        gone = {j for i in range(len(x) - size + 1) if first[tuple(x[i : i + size])] != (d, i) for j in range(i, i + size)}
        out[d] = "\n".join(line for j, line in enumerate(x) if j not in gone)
    return out


def signed64(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash64(*values):
    """Spark's xxhash64 of strings, longs and lists of longs."""
    import xxhash

    h = 42
    for v in values:
        for x in v if isinstance(v, list) else [v]:
            h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), h)
    return signed64(h)


@functools.cache
def text_terms(text):
    import regex

    return {hash64(t) for t in regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())}


def imatch(texts, low, high, seeds, levels):
    """function text -> fingerprint over the lexicon of texts."""
    df: dict = {}
    for t in texts:
        for x in text_terms(t):
            df[x] = df.get(x, 0) + 1
    lexicon = {x for x, n in df.items() if low * len(texts) <= n <= high * len(texts)}

    @functools.cache
    def code(text):
        hexed = lambda h, n: f"{h & (1 << 64) - 1:016x}"[-n:]
        every = text_terms(text)
        kept = sorted(every & lexicon)
        if not kept:
            other = hash64(sorted(every)) if every else hash64(text or "")
            return ".".join([hexed(other, 16), *[hexed(hash64(s, other), 4) for s in range(1, seeds + 1)]])
        parts = [hexed(hash64(kept), 16)]
        for s in range(1, seeds + 1):
            part = ""
            for mask in (4**j - 1 for j in range(1, levels + 1)):
                some = [t for t in kept if hash64(s, t) & mask == 0]
                part += hexed(hash64(mask, some), 4) if some else ""
            parts.append(part)
        return ".".join(parts)

    return code


def likeness(a, b):
    if a == b:
        return 1.0
    pairs = list(zip(a.split(".")[1:], b.split(".")[1:], strict=True))
    return sum(bool(x) and len(x) == len(y) and x[-4:] == y[-4:] for x, y in pairs) / len(pairs)


def edited(docs):
    """(doc_id, text) -> edited text for each distinct pair, in ascending order."""
    order = sorted({(d, t or "") for d, t in docs}, key=lambda x: (x[0] is not None, x[0] or 0, hash64(x[1])))
    out = {}
    for k, (d, t) in enumerate(order):
        half = len(t) // 2
        out[d, t] = (t[: len(t) - half] + order[(k + 1) % len(order)][1][:half], order[(k + 1) % len(order)][1])
    return out


def period_runs(w, least=24, repeats=3):
    """All (start, length, period) by trying each period on each place, with its smallest period."""
    out, n = set(), len(w)
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - a + p
            x = w[a : a + length]
            if length >= max(least, repeats * p) and all(any(x[k] != x[k + q] for k in range(length - q)) for q in range(1, p)):
                out.add((a, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def period_digest(doc, text):
    """The row of operator 12 after doc_id."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = period_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *four, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def filter_audit(docs, labels):
    """Rows of operator 13 for docs (doc_id, text, lang) and labels (doc_id, quality, toxic), order by order."""
    first: dict = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        said = [x for x in labels if x[0] == d and d is not None]
        rows.append((lang or "", {f for f, v in fails.items() if v}, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out, lost = [], {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left, before = [r for r in rows if r[0] == part], []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                key = (part, f)
                lost[key] = lost.get(key, 0) + len(here)
                out.append((part, "".join(order), step, len(left), len(here), sum(f in r[1] for r in before), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), key))
                before += here
    return sorted((*r[:-1], lost[r[-1]]) for r in out)
