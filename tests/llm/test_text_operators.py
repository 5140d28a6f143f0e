"""Fingerprints, near-duplicates, license scans and BPE against brute force on small tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from supplyscope.llm import bpe, fingerprints, licenses, neardup, textops

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def corpus(seed=3, n=120):
    """Random texts with copies, near copies, chains of edits, empty, null and odd texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "ÀB"]
    texts = []
    for i in range(n):
        base = texts[rnd.randrange(len(texts))] if texts and rnd.random() < 0.7 else None
        if base:
            words = base.split(" ")
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 30, 60]))))
    texts += [None, "", "  \t\n", "one", "one", "ONE", "a b", "A  B", "x" * 5000, "long " * 3000, "long " * 3000]
    return [(i * 3 + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def components_brute(rows, width, percent=80):
    sets = [shingles(r[1], width) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    smallest = {}
    for i, r in enumerate(rows):
        smallest[label[i]] = min(smallest.get(label[i], r[0]), r[0])
    return sets, [smallest[x] for x in label]


def test_words_and_shingles_are_those_of_the_regular_expression():
    import pyarrow as pa
    texts = ["A b\x0bC\x85d  e", "", None, "é\xa0x y", " lead trail ", "q" * 3_000_000 + " r"]
    data, offsets = textops.utf8(pa.array(texts))
    for t, s in zip(texts, textops.shingle_sets(data, offsets, 2)):
        assert len(s) == len(shingles(t, 2))
    same = [list(textops.shingle_sets(*textops.utf8(pa.array([x])), 2))[0] for x in ("AbC d", "abc D")]
    assert (same[0] == same[1]).all()


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = corpus()
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), width=width).collect()}
    sets, component = components_brute(rows, width)
    assert len(got) == len(rows)
    for r, s, c in zip(rows, sets, component):
        assert (got[r[0]].n_shingles, got[r[0]].component_id, got[r[0]].kept) == (len(s), c, c == r[0]), r


def test_near_duplicates_of_a_large_group(spark):
    """More near copies than a block holds, around one original; and as many exact copies."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(80)]
    rows = [(0, " ".join(base), "en", "s", 0)]
    for i in range(1, 1300):
        words = list(base)
        if i % 3:
            words[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "s", 0))
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), width=2)
    assert got.where("component_id <> 0").count() == 0 and got.where("kept").count() == 1


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0
    # Repeated rows, null ids, clashing names.
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (4, None, 3), (5, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("bands", F.lit("x"))
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()))
    assert got == [(0, 1, False), (1, 1, True), (1, 1, True), (4, 4, True), (5, 5, True)]
    stay = neardup.deduplicate(df)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == [1, 4, 5]


def test_deduplicate_keeps_one_of_each_group(spark):
    rows = corpus(seed=9)
    stay = neardup.deduplicate(spark.createDataFrame(rows, DOCS))
    sets, component = components_brute(rows, 5)
    want = {c for c in component}
    assert sorted(r.doc_id for r in stay.collect()) == sorted(want)


def test_band_and_estimate_bounds():
    assert (1 - 0.8 ** neardup.ROWS) ** neardup.BANDS < 1e-5
    assert neardup.estimate(neardup.MOST_DIFFERING) >= neardup.LEAST_ESTIMATE > neardup.estimate(neardup.MOST_DIFFERING + 1)


def test_bit_counts_estimate_the_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    m = np.array([neardup.minima(np.concatenate([shared, x])) for x in (a, b)])
    s = neardup.signatures(m).view(np.uint64)
    assert abs(neardup.estimate(neardup._differing(s[0], s[1:])[0]) - 0.8) < 0.15


def test_fingerprints_equal_brute_force(spark):
    rows = corpus(seed=4, n=60)
    random.Random(1).shuffle(rows)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    by_text = {}
    for r, following in zip(rows, rows[1:] + rows[:1]):
        text, after = r[1] or "", following[1] or ""
        q = len(text) // 4
        edited = text[:len(text) - q] + after[:q]
        g = got[r[0]]
        assert g.n_chars == len(text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text, 5), shingles(edited, 5), shingles(after, 5)
        for near, other in ((g.near_edited, b), (g.near_next, c)):
            want = len(a & other) / len(a | other) if a and other else float(a == other)
            exact = len(a | other) <= fingerprints.K
            assert near == pytest.approx(want, abs=1e-12 if exact else 0.2)
        assert by_text.setdefault(text, g.fingerprint) == g.fingerprint


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints.fingerprint_documents(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(7, "a b c d e f g h", "", "", 0)], DOCS)).first()
    assert one.near_next == 1.0
    rows = [(None, "n"), (1, "a"), (1, "b"), (1, "b"), (2, None)]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)))
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 1, 2]


def test_fingerprints_merge_and_estimate(spark):
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
    k = fingerprints.K
    whole = fingerprints.merge([a[:k], b[:k]])
    assert (whole == np.unique(np.concatenate([a, b]))[:k]).all()
    assert abs(fingerprints.distinct_count(whole) - 8000) < 8000 * 0.35
    assert abs(fingerprints.containment(a[:k], whole) - 1) < 0.35
    rows = [(i, f"w{i} w{i + 1} w{i + 2} w{i + 3} w{i + 4}", f"s{i % 2}" if i % 5 else None) for i in range(50)]
    parts = fingerprints.fingerprint_parts(spark.createDataFrame(rows, "d long, text string, source string").repartition(7), "source")
    assert {r.source: r.n_distinct for r in parts.collect()} == {"s0": 20.0, "s1": 20.0, None: 10.0}


LICENSE_TEXTS = [
    "Some words before. Released under the MIT License. And after it.",
    "released UNDER the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "nothing of this kind in here at all, only words about a license",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or any later",
    None, "", "MIT License", "word " * 4000 + "Licensed under the Apache License, Version 2.0. " + "word " * 4000,
]


def license_brute(text):
    def words(t):
        return [w for w in re.split(r"[^\w]|_", t.lower()) if w]
    w = words(text or "")
    mine = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    out = {}
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        v = words(t)
        s = {tuple(v[k:k + 5]) for k in range(len(v) - 4)}
        if len(s & mine) / len(s) >= licenses.CONTAINMENT:
            out[i] = len(s & mine) / len(s)
    # These texts hold one notice each: of two versions the fuller one counts.
    for a, b in ((5, 6), (6, 5)):
        if a in out and b in out and out[a] < out[b]:
            del out[a]
    return out


GPL = ("you can redistribute it and/or modify it under the terms of the GNU General Public License as "
       "published by the Free Software Foundation{} either version {} of the License")


def test_a_notice_of_one_version_is_not_one_of_another(spark):
    two, three = GPL.format(";", 2), GPL.format(",", 3)
    rows = [(1, two), (2, three), (3, f"{two} {three}"), (4, three + " word" * 100 + " " + two), (5, "x " + three + " x"), (5, "x " + two + " x"),
            (6, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
            (7, "This work is licensed under a Creative Commons Attribution 4.0 International License."), (None, three), (None, three)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    both = {"GPL-2.0", "GPL-3.0"}
    assert got == {1: {"GPL-2.0"}, 2: {"GPL-3.0"}, 3: both, 4: both, 5: both, 6: {"CC-BY-SA-4.0"}, 7: {"CC-BY-4.0"}, None: {"GPL-3.0"}}


def test_license_scan_equals_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(LICENSE_TEXTS)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("j", F.lit(1))).collect():
        got.setdefault(r.doc_id, {})[r.template] = r.containment
    want = {i: x for i, t in rows if (x := license_brute(t))}
    assert got == want and set(want) == {0, 1, 2, 3, 5, 9}
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_notice_of_one_shingle_is_found_beside_any_word(spark):
    rows = spark.range(8000).selectExpr("id AS doc_id", "concat('a', id, ' Released under the MIT License. b', id) AS text")
    assert licenses.scan(rows).where("template = 0 AND containment = 1").count() == 8000


def test_license_scan_runs_no_python(spark):
    df = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def reference_bpe():
    content = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    return content, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(rnd):
    alphabet = rnd.choice(["ab", "aA '", " \n\tab", "the rein.\n", "é日本　 x1’\x1c\x85 ", "0123 .,!*%$", "aé́"])
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80)))


def test_bpe_equals_the_library(reference_bpe):
    content, library = reference_bpe
    assert bpe.PATTERN == P.PATTERN
    e, rnd = bpe.encoder(content), random.Random(6)
    for text in [odd_text(rnd) for _ in range(3000)] + ["", "a" * 700, " " * 500, "word " * 2000]:
        ids = e.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert e.decode(ids) == text.encode()


def test_bpe_appends_and_edits_are_exact(reference_bpe):
    content, library = reference_bpe
    v, rnd = bpe.encoder(content).vocabulary, random.Random(7)
    for _ in range(400):
        x = bpe.Encoding(v, odd_text(rnd))
        for _ in range(4):
            i = rnd.randrange(len(x.text) + 1)
            j = rnd.randrange(i, len(x.text) + 1)
            x.edit(i, j, odd_text(rnd)[:12]) if rnd.random() < 0.7 else x.append(odd_text(rnd)[:12])
            assert x.ids == library.encode_ordinary(x.text)
    x = bpe.Encoding(v, "some words here " * 500)
    before = x.extended
    x.append("more")
    x.edit(4000, 4004, "other")
    assert x.extended - before < 100  # only what the changes touch


def test_bpe_columns(spark, reference_bpe):
    content, library = reference_bpe
    rows = [(1, "Hello there"), (2, None), (2, ""), (None, "é\n\n x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1))
    path = P.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(df, path)
    assert coded.columns == ["doc_id", "a.b", "ids"]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in coded.collect()))) == sorted(
        str((d, library.encode_ordinary(t or ""))) for d, t in rows)
    assert sorted(bytes(r.bytes) for r in bpe.decode(coded, path).collect()) == sorted((t or "").encode() for _, t in rows)
    digests = {r.ids_sha256: r for r in bpe.round_trip(df, path).collect()}
    want = np.array(library.encode_ordinary("Hello there"), "<u4").tobytes()
    assert digests[hashlib.sha256(want).hexdigest()].decoded_sha256 == hashlib.sha256(b"Hello there").hexdigest()
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(0)), path)
    assert bpe.round_trip(df.limit(0), path).count() == 0
