"""Awkward documents, and brute-force versions of the contracts."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SEPS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def prose(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


def rows(seed=1):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rnd = random.Random(seed)
    a, b, c = prose(rnd, 120), prose(rnd, 90), prose(rnd, 200)
    near = a.split(" ")
    near[60] = "changed"
    out = [
        (1, a, "en", "s1", 1),
        (2, b, "en", "s1", 1),
        (3, a, "en", "s2", 1),
        (4, " ".join(near), "en", "s2", 1),
        (5, None, "en", "s1", 0),
        (6, "", "de", None, 0),
        (7, " \t\n ", None, "s3", 4),
        (8, prose(rnd, 30) + "\n" + " ".join(b.split(" ")[10:75]) + "\n" + prose(rnd, 30), "en", "s3", None),
        (9, "one", "en", "s1", 3),
        (10, "one two", "en", "s1", 7),
        (11, "Ünï cödé \U0001f600 ß straße x y", "de", "s2", 9),
        (12, prose(rnd, 9000), "en", "s1", 1),
        (None, c, "en", None, 1),
        (13, c, "en", "s2", 1),
        (13, c, "en", "s2", 1),
        (14, "w " * 400, "en", "s2", 1),
        (15, a.upper(), "en", "s1", 1),
        (16, "<|endoftext|>it's they'll 12 ½ <|startoftext|>", "en", "s1", 1),
    ]
    return out + [(100 + k, prose(rnd, rnd.randint(1, 80), "abc"), "en" if k % 2 else "de", f"s{k % 4}", 1) for k in range(40)]


def frame(spark, data=None):
    """Documents with columns that operators might use themselves."""
    d = spark.createDataFrame(rows() if data is None else data, SCHEMA)
    for name in ("id", "n", "key", "words", "rep", "score", "size", "block", "text_a", "node", "copies", "lang_pred", "kept"):
        d = d.withColumn(name, F.lit("clash"))
    return d


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def windows_removed(data, width):
    """(doc_id, n_words, n_removed, hash) of each row, by the definition."""
    order = lambda i: float("inf") if i is None else i
    first = {}
    for i, t, *_ in data:
        w = words(t)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, float("inf")), order(i))
    out = Counter()
    for i, t, *_ in data:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < order(i):
                gone |= set(range(k, k + width))
        out[i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def shingles(text, width):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1)))


def linked_components(data, width, percent):
    """doc_id to the smallest one reachable; rows of one doc_id are one node, null the largest."""
    order = lambda i: 1 << 62 if i is None else i
    sets = [(order(i), shingles(t, width)) for i, t, *_ in data]
    root = {i: i for i, _ in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return {None if i == 1 << 62 else i: None if top(i) == 1 << 62 else top(i) for i, _ in sets}
