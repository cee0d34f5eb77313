"""Awkward tables and plain-Python versions of the operators' results."""

import re
from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, extra=False):
    """Rows (id, text); an id may be None or repeat."""
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "src", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("token", "a", "b", "rid", "component", "score", "kept", "keep_id", "spans", "items", "row", "ids", "block", "label", "at"):
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one two three"),
    (5, "one two three"),
    (5, "one two three"),
    (6, "ONE  two\tthree"),
    (7, LONG),
    (8, LONG + " and more"),
    (None, "one two three four five six seven"),
    (None, None),
    (9, "ÆØÅ ñandú 東京 emoji 😀 end"),
    (10, "x" * 50_000),
]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def near_components(rows):
    """{id: (n_shingles, component)} by comparing all sets that share a shingle."""
    sets, owner = {}, defaultdict(list)
    for i, t in rows:
        sets[i] = shingles(t)
        if sets[i]:
            owner[sets[i]].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    index, order = defaultdict(list), list(owner)
    for ids in owner.values():
        for other in ids[1:]:
            union(ids[0], other)
    for k, s in enumerate(order):
        common = defaultdict(int)
        for token in s:
            for j in index[token]:
                common[j] += 1
        for j, both in common.items():
            if 100 * both >= 75 * (len(s) + len(order[j]) - both):
                union(owner[s][0], owner[order[j]][0])
        for token in s:
            index[token].append(k)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def spelling_variants(rows):
    """{word: (n, n_near, form, form_n, root)} by looking up every word's edits."""
    import zlib

    n = defaultdict(int)
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    gaps = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :]].add((w, k))
    out = {}
    for w, k in n.items():
        near = {v for v, _ in gaps[w]}
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            near |= {v for v, at in gaps[short] if at == i and v != w} | ({short} & n.keys())
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * k else None
        out[w] = (k, len(near), form, n[form] if form else None)
    roots = {}
    for w in out:
        end = w
        while out[end][2]:
            end = out[end][2]
        roots[w] = end
    return {w: (*v, roots[w]) for w, v in out.items()}
