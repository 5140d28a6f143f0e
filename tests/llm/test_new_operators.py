"""Whitening, ranked lexical search and substring dedup against brute force; hashes of words."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from supplyscope.llm import lexical, neardup, queries, substrings, textops, whitening

# ------------------------------------------------------------------------------------------- whitening


def fitted(rows):
    """Exact eigenvectors (columns) and eigenvalues of the distinct quantised vectors, by falling eigenvalue."""
    x = np.unique(np.floor(256 * np.array(rows, float)), axis=0)
    centred = x - x.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / len(x))
    return len(x), e[::-1], q[:, ::-1]


def vectors(n=300, dim=7, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, dim)) * np.linspace(3, 0.5, dim) @ rng.normal(size=(dim, dim)) + offset).tolist()


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash"))


def check(out, rows, ids, k=4):
    n, e, q = fitted(rows)
    x = np.floor(256 * np.array(rows, float))
    sums = [sum({tuple(r): int(r[j]) for r in x}.values()) for j in range(x.shape[1])]
    got = {(r.vec_id, r.component): r for r in out}
    assert len(got) == len(set(ids)) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in ids])
        mean = np.unique(x, axis=0).mean(axis=0)
        want = (x - mean) @ q[:, c] / np.sqrt(e[c])
        assert np.allclose(mine, want if want @ mine > 0 else -want, atol=1e-8)
    for r in out:
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9
    for i, v in zip(ids, x):
        assert got[i, 1].deviation == sum((n * int(a) - s) ** 2 for a, s in zip(v, sums))


def test_whitening_equals_eigenvectors_of_the_covariance(spark):
    rows = vectors()
    ids = list(range(len(rows)))
    odd = [(900, None), (901, []), (902, [1.0] * 6 + [None]), (903, [float("nan")] * 7), (904, [1e305] + [0.0] * 6),
           (905, [float("inf")] * 7)]
    given = list(zip(ids, rows))
    # Copies of one vector, a third of all rows, count once in the fit.
    out = whitening.whiten(table(spark, given + odd + [(1000 + i, rows[5]) for i in range(150)]).repartition(5)).collect()
    assert {r.vec_id for r in out} == set(ids) | set(range(1000, 1150))
    assert len({r.whitened for r in out if r.component == 2 and (r.vec_id == 5 or r.vec_id >= 1000)}) == 1
    check([r for r in out if r.vec_id < 900], rows, ids)


def test_whitening_far_from_the_origin(spark):
    rows = vectors(120, 5, offset=2.0**32)
    x = np.floor(256 * np.array(rows, float))
    out = whitening.whiten(table(spark, list(enumerate(rows)))).collect()
    shifted = (x - x[0]) / 256  # exact; the same covariance without the offset
    n, e, q = fitted(shifted.tolist())
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9 for r in out)


def test_whitening_of_few_equal_and_mixed_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(6)] + [(7, [1.0])])).collect()
    assert {r.component for r in line} == {1} and {r.vec_id for r in line} == set(range(6))  # rank 1; length 1 is apart
    assert all(abs(r.explained - 1) < 1e-12 for r in line)
    # Equal eigenvalues: all of them are found.
    cross = [[s * 2.0 if j == i else 0.0 for j in range(5)] for i in range(5) for s in (1, -1)]
    out = whitening.whiten(table(spark, list(enumerate(cross)))).collect()
    assert {r.component for r in out} == {1, 2, 3, 4} and all(abs(r.explained - 0.2) < 1e-12 for r in out)
    assert max(r.identity_error for r in out) < 1e-12
    two = whitening.whiten(table(spark, [(i, v) for i, v in enumerate(vectors(50, 4))] + [(100 + i, v) for i, v in enumerate(vectors(50, 3))]))
    assert {(r.vec_id >= 100, r.component) for r in two.collect()} == {(a, c) for a in (0, 1) for c in (1, 2, 3, 4)} - {(1, 4)}


def test_deviations_beyond_a_long_are_missing():
    model = whitening.Whitening(10**6, [10**6 * 5, 0], np.eye(2), np.ones(2), 1.0, 1)
    x = np.array([[5, 3037], [5, 3038], [6, 7], [2**40, 1]])
    got = model.deviation(x)
    assert got[0] == 3037**2 * 10**12 and got[2] == 50 * 10**12
    assert got.mask.tolist() == [False, 3038**2 * 10**12 >= 2**63, False, True]


def test_bidiagonalisation_stops_when_the_components_are_found():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 60)) * np.concatenate([[50, 40, 30, 20], np.full(56, 0.01)])
    x -= x.mean(axis=0)
    s, v, steps = whitening.bidiagonalise(lambda q: (x.T @ (x @ q), float(((x @ q) ** 2).sum())), 60, float((x**2).sum()))
    u, want, vt = np.linalg.svd(x, full_matrices=False)
    assert steps < 20 and np.allclose(s, want[:4], rtol=1e-12) and np.allclose(np.abs((v * vt[:4]).sum(axis=1)), 1)


# ------------------------------------------------------------------------------- ranked lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    split = lambda t: [x.translate(LOWER) for x in TERM.findall(t or "")]
    held = [(d, c) for d, c in ((d, Counter(split(t))) for d, t in docs) if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in set(items):
        asked = set(split(text))
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in asked}
        scored = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            score = sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, k", [(1, 7), (2, 50), (3, 1)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical, "FIRST_STEP", 16)
    monkeypatch.setattr(lexical, "SEGMENT_ROWS", 64)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 400 if seed == 1 else 1 << 20)
    rnd = random.Random(seed)
    words = ["aa", "bB", "É", "é", "c1", "x", "日本", "the", "z9", "k"] + [f"r{i}" for i in range(80)]
    docs = [(rnd.randrange(900), " ".join(rnd.choices(words, weights=[30] * 10 + [1] * 80, k=rnd.randrange(0, 40)))) for _ in range(400)]
    docs += [(None, "aa x"), (1, None), (2, ""), (3, "--"), docs[5], docs[5], (7, "aa " * 3000)]
    items = [(i, "-".join(rnd.choices(words, k=rnd.randrange(0, 25)))) for i in range(20)]
    items += [(None, "x aa"), (40, None), (41, ""), (42, "AA aa X"), (42, "AA aa X"), (50, " ".join(words) * 20)]  # 90 terms
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    got = sorted((tuple(r) for r in lexical.search(df, asked, k).collect()), key=str)
    assert got == ranked(docs, items, k)


def test_lexical_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    # The only document's term weighs floor(1000 ln(4/3)).
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // 3000))]


# ----------------------------------------------------------------------------------- substring dedup


def cut(rows, least):
    """(doc_id, words, removed, kept text) by comparing all windows."""
    split = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    number = lambda d: 2**63 - 1 if d is None else d
    smallest = {}
    for d, w in split:
        for i in range(len(w) - least + 1):
            key = tuple(w[i:i + least])
            smallest[key] = min(smallest.get(key, 2**63), number(d))
    out = []
    for d, w in split:
        gone = {j for i in range(len(w) - least + 1) if smallest[tuple(w[i:i + least])] < number(d) for j in range(i, i + least)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_repeats_equal_brute_force(spark, least):
    rnd = random.Random(least)
    rows = []
    for i in range(120):
        t = [rnd.choice("abc") if i % 3 else rnd.choice(["xé", "y", "zz", "w"]) for _ in range(rnd.randrange(0, 60))]
        if rows and rnd.random() < 0.5:
            other = (rnd.choice(rows)[1] or "").split()
            at = rnd.randrange(len(other) + 1)
            t[5:5] = other[at:at + 20]
        rows.append((rnd.randrange(60), rnd.choice([" ", "\n", "  "]).join(t)))
    rows += [(None, "a b c a b c a b c a b"), (None, "a b c a b c a b c a b"), (3, None), (4, ""), (5, " \n"), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).repartition(3)
    out = substrings.repeats(df, least).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str) == cut(rows, least)
    for r in out:
        assert sum(b - a for a, b in r.spans) == r.n_removed
        assert all(b - a >= least for a, b in r.spans) and all(x[1] < y[0] for x, y in zip(r.spans, r.spans[1:]))


def test_passages_of_fifty_words_are_cut_once(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 300)]
    rows = [(i, f"{text(rnd.randrange(80))} {shared[i % 4]} {text(rnd.randrange(80))}") for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(40)]  # copies
    rows += [(300, text(30_000) + " " + shared[3]), (301, text(500)), (302, shared[1] + " " + shared[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.repeats(df).collect()), key=str)
    assert got == cut(rows, 50)
    stay = substrings.remove_repeats(df.withColumns({"doc": F.lit("clash"), "spans": F.lit(1)}))
    assert stay.columns == ["doc_id", "text", "doc", "spans"]
    kept = {r.doc_id: r.text for r in stay.collect()}
    assert kept == {d: (k if removed else dict(rows)[d]) for d, _, removed, k in got}
    assert substrings.repeats(df.limit(0)).count() == substrings.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_select_equal_anchors():
    rng = np.random.default_rng(2)
    for least in (3, 7, 50):
        g = rng.integers(0, 5, 400).astype(np.uint64)
        width = least - substrings.gram_words(least) + 1
        at = substrings.winnowed(g, width)
        for i in range(len(at)):
            part = g[i:i + width]
            assert at[i] - i == width - 1 - int(part[::-1].argmin())


def test_substring_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in cut(rows, 50)]
    got = sorted((tuple(r) for r in queries.op13_substrings(spark, SF_SMALL).collect()), key=str)
    assert got == sorted(want, key=str)


# ------------------------------------------------------------------------------------- hashes of words


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_built_words_do_not_collide(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    code, row, different = textops.word_codes(*textops.utf8(pa.array([f"{one} {other} x"])))
    assert len(set(textops.word_hashes(different)[0].tolist())) == 3
    docs = spark.createDataFrame([(1, f"{one} q r"), (2, f"{other} q r"), (3, f"{one} {other} {one} {other}")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width=2).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (2, 3)}
