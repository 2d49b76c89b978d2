"""Tables with the awkward cases, and brute-force versions of what SQL cannot express."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import duckdb

TABLES = "/root/testdata/sf0.001"
PROSE = " ".join(f"word{i % 97} of the {i} long line" for i in range(60))
LONG = "\n".join(f"{PROSE} {k} end" for k in range(40))

# doc_id, text, lang, source; null ids and texts, empty and blank texts, repeated rows,
# an id on two texts, a very long text, special marks and characters of several bytes.
DOCUMENTS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.replace("word7", "other"), "en", None),
    (4, LONG, "en", "b"),
    (5, "", "en", "b"),
    (6, None, None, None),
    (7, " \t\n\x0b\x0c\r ", "en", "b"),
    (8, "one two", "en", "a"),
    (9, "One  TWO", "en", "a"),
    (10, "é" * 300 + " <|endoftext|> ünï", "fr", "c"),
    (11, "a" * 700, "en", "c"),
    (11, "b " * 300, "en", "c"),
    (None, PROSE + " and more", "en", "a"),
    (None, "no id here", "en", "c"),
    (2**62 + 1, "İstanbul ẞ Ä line\nline\nline", "tr", "c"),
]
CLASH = ["size", "shard", "slot", "key", "block", "node", "draw", "row", "host", "lot", "n", "body", "payload", "ids", "part", "rule"]


def documents(spark, rows=None):
    """The cases, with further columns named like those that the operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = DOCUMENTS if rows is None else rows
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    return df.selectExpr("*", *(f"'x' AS `{c}`" for c in CLASH))


def duck(**tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"{name}_rows", frame)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_rows")
    return con


def in_duck(sql, folder=TABLES):
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], sorted(map(repr, cursor.fetchall()))


def rows_of(df, names):
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())


def words(text):
    return (text or "").encode().lower().split()


def jaccard(texts, percent=75, size=5):
    """(set size, smallest linked index) of each text, over all pairs."""
    sets = []
    for text in texts:
        w = words(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def without_repeats(docs, depth=100):
    """(id, bytes) in the order of ids to (removed spans, bytes left) of each."""
    seen, out = set(), []
    for data in docs:
        gone = bytearray(len(data))
        for i in range(len(data) - depth + 1):
            window = data[i : i + depth]
            if window in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def bigram_scores(docs, weights, classes):
    """Base and model scores for (id, text), with the given mixture weights per class."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*words(t), b" "] for i, t in docs}
    one, two = Counter(), Counter()
    for i, t in tokens.items():
        if not held(i):
            one.update(t)
            two.update(zip([b" ", *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for before, w in zip([b" ", *t[:-1]], t):
            c = one[before]
            a, b, d = weights[min(math.frexp(c)[1], classes - 1)]
            score += math.log10(a / (v + 1) + b * one[w] / n + d * two[before, w] / max(c, 1))
        out[i] = (held(i), len(t), sum(one[w] > 0 for w in t), n, base, score)
    return out


def copies_by_id(rows):
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r[1:])
    return found
