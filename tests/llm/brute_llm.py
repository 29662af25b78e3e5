"""Brute-force versions of the operators and a small table with hard cases."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

LONG = "the long one has many words " * 3000
HARD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (2, "The quick  brown fox\njumps over the lazy dog near the old river bank today", "en"),
    (3, "", "en"),
    (4, None, None),
    (5, "  \t ", "de"),
    (6, "one", "en"),
    (7, "One Two", "en"),
    (8, "one two", None),
    (9, LONG, "en"),
    (10, LONG + "end", "en"),
    (11, "Größe über straße é ü 日本語 😀 1234 !!! 's don't", "de"),
    (None, "the quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (12, None, "fr"),
    (13, "12345 --- 678", "en"),
    (6, "one", "en"),
    (14, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "fr"),
]
CLASHING = ["node", "token", "hash", "_text", "_fp", "size", "bundle", "_spans"]


def hard_docs(spark, rows=None):
    """The hard cases with columns that clash with names the operators use themselves."""
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in (HARD if rows is None else rows)], schema)


def documents(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text, width):
    w = words(text)
    return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar(rows, width, num, den):
    """Per row position: (set size, positions of the rows it links with)."""
    sets = [shingles(t, width) for _, t, *_ in rows]
    by_gram = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by_gram[g].append(k)
    out = []
    for k, s in enumerate(sets):
        common = Counter(other for g in s for other in by_gram[g])
        out.append((len(s), [o for o, c in common.items() if o != k and den * c >= num * (len(s) + len(sets[o]) - c)]))
    return out


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


ITEM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").encode().translate(LOWER))


def contamination(rows, items, width=10):
    """Per row: (words, hit positions, sorted item ids as strings)."""
    windows = defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for _, text, *_ in rows:
        w, hit, found = item_words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                key = tuple(w[k:k + size])
                if key in windows:
                    hit.update(range(k, k + size))
                    found |= windows[key]
        out.append((len(w), hit, sorted(str(i) for i in found if i is not None)))
    return out
