"""Whole results where a shorter way would do less."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, vectors
from tessera.llm.common import ready
from tessera.plans import catalog


def by_cosines(cosines):
    """Unit vectors with these cosines."""
    return np.linalg.cholesky(np.array(cosines))


def test_links_of_stars_and_paths(spark):
    star = by_cosines([[1, 0.945, 0.985], [0.945, 1, 0.985], [0.985, 0.985, 1]])
    turn = [np.array([np.cos(a), np.sin(a), 0.0]) for a in (0.0, 0.15, 0.30, 0.45)]
    rows = [(i, [*map(float, v), 0.0], 0) for i, v in zip((1, 2, 9), star)] + [(i, [*map(float, v), 0.0], 1) for i, v in zip((12, 15, 17, 13), turn)]
    vecs = {i: vectors.unit(np.array([v]))[0] for i, v, _ in rows}
    pairs = [(a, b) for (a, _, x), (b, _, y) in itertools.combinations(rows, 2) if x == y and vecs[a] @ vecs[b] >= 0.98]
    assert sorted(map(sorted, pairs)) == [[1, 9], [2, 9], [12, 15], [13, 17], [15, 17]]
    # All rows of a label in one bucket, so that all of its links are met in one cell.
    for ids, root in (((1, 2, 9), 1), ((12, 13, 15, 17), 12)):
        codes = np.zeros((len(ids), vectors.TABLES, 1 + vectors.HASHES), dtype=np.int64)
        got = vectors.verify(0, 0, np.array(ids), np.ones(len(ids), dtype=np.int64), np.array([vecs[i] for i in ids]), codes, np.zeros(len(ids), dtype=np.int64), 0.98)
        assert got == [(i, sum(i in p for p in pairs), root) for i in ids]
    df = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: (r["component_id"], r["n_links"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    assert found == {i: (1 if i < 10 else 12, sum(i in p for p in pairs), i in (1, 12)) for i in vecs}


def test_repeated_ids_of_vectors(spark):
    r = np.random.default_rng(11)
    base = r.normal(size=(3, 16))
    near = lambda k: base[k] + r.normal(size=16) * 0.02
    rows = [(5, near(0), 0), (7, near(0), 0), (5, near(1), 0), (9, near(1), 0), (8, near(1), 0), (5, near(2), 1), (3, near(0), 1), (5, base[2], 1), (5, base[2], 1), (2, base[2], None)]
    rows = [(i, [float(x) for x in v], label) for i, v, label in rows]
    vecs = [vectors.unit(np.array([v]))[0] for _, v, _ in rows]
    link = {(a, b) for a, b in itertools.permutations(range(len(rows)), 2) if rows[a][2] is not None and rows[a][2] == rows[b][2] and vecs[a] @ vecs[b] >= 0.98}
    reached = [{a} for a in range(len(rows))]
    for _ in rows:
        reached = [set().union(m, *({b for x, b in link if x == a} for a in m)) for m in reached]
    want = sorted((rows[a][0], sum(x == a for x, _ in link), min(rows[b][0] for b in reached[a])) for a in range(len(rows)))
    for schema in ("array<double>", "array<float>"):
        df = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("embedding", F.col("embedding").cast(schema))
        got = vectors.near_duplicates(df).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def length(x, y):
    best = [0] * (len(y) + 1)
    for p in x:
        old = 0
        for j, q in enumerate(y, 1):
            old, best[j] = best[j], old + 1 if p == q else max(best[j], best[j - 1])
    return best[-1]


@pytest.mark.parametrize("name", ["MIT", "BSD", "GPL", "MIT notice", "CC-BY-NC-4.0 notice", "ISC text", "BSD-3-Clause text"])
def test_neighbouring_licenses(name):
    known, text = [licenses.Template(n, t, 0.8) for n, t in licenses.TEMPLATES.items()], licenses.TEMPLATES[name]
    for copies in (1, 2, 3, 6, 20):
        for before, after in (("", ""), ("some words before ", " and after")):
            found = licenses.scan(before + " ".join([text] * copies) + after, known, 0.8)
            at = [len(before) + k * (len(text) + 1) for k in range(copies)]
            assert [f[:3] for f in found if f[0] == name] == [(name, 1.0, a) for a in at]
    w = text.split()
    if len(w) > 20:
        r = random.Random(4)
        for copies in (3, 8):
            cut = []
            for _ in range(copies):
                k = r.randrange(1, len(w) - 4)
                cut.append(" ".join(w[:k] + ["zzz"] * r.randint(0, 3) + w[k + r.randint(0, 3) :]))
            found = [f for f in licenses.scan(" ".join(cut), known, 0.8) if f[0] == name]
            assert len(found) == copies and all(f[1] >= 0.8 for f in found)


def test_large_gaps_without_a_unique_word():
    r = random.Random(3)
    for size in (3, 30, 150):
        x, y = r.choices("abcdefg", k=size), r.choices("abcdefg", k=size + 20)
        got = sorted(licenses.long_common(x, y, 0, len(x), 0, len(y)))
        assert len(got) == length(x, y) and all(x[i] == y[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
    assert len(licenses.align(["a", "b"] * 50, ["b", "b", "a", "a"] * 50)) > 0


def matched(x, y):
    """How many words a plain recursion aligns: common ends, then a longest increasing run of the words that occur once in both, then the gaps."""
    n = 0
    while x and y and x[0] == y[0]:
        x, y, n = x[1:], y[1:], n + 1
    while x and y and x[-1] == y[-1]:
        x, y, n = x[:-1], y[:-1], n + 1
    at = [(i, y.index(w)) for i, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    if not at:
        return n + length(x, y)
    size = []
    for k, (_, j) in enumerate(at):
        size.append(1 + max((size[m] for m in range(k) if at[m][1] < j), default=0))
    kept, k = [], max(range(len(at)), key=lambda m: (size[m], m))
    while k is not None:
        kept.insert(0, at[k])
        k = max((m for m in range(k) if size[m] == size[k] - 1), default=None)
    edges = [(-1, -1), *kept, (len(x), len(y))]
    return n + len(kept) + sum(matched(x[i + 1 : a], y[j + 1 : b]) for (i, j), (a, b) in itertools.pairwise(edges))


def test_alignment_equals_plain_recursion():
    r = random.Random(8)
    for _ in range(400):
        letters = "abcdefghijklmnopqrstuvwxyz"[: r.randint(2, 26)]
        x = r.choices(letters, k=r.randint(0, 30))
        y = x[:] if r.random() < 0.5 else r.choices(letters, k=r.randint(0, 30))
        for _ in range(r.randint(0, 6)):
            if y:
                y[r.randrange(len(y))] = r.choice(letters)
        assert len(licenses.align(x, y)) == matched(x, y)


def test_seeds_without_enough_words_around():
    known = [licenses.Template(n, t, 0.8) for n, t in licenses.TEMPLATES.items()]
    for name in ("MIT text", "BSD-3-Clause text", "Zlib text", "GPL header"):
        text = licenses.TEMPLATES[name]
        noisy = "software " * 20_000 + text + " license" * 20_000
        assert [(f[0], f[2]) for f in licenses.scan(noisy, known, 0.8) if f[0] == name] == [(name, 20_000 * 9)]
        t = next(t for t in known if t.name == name)
        words = licenses.words_of(noisy)
        assert len(t.spots(words, len(t.words) // 4 + 2)) < 5 * len(t.words)
