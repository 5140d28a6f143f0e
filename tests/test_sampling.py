"""G1 sample and G4 split: exact size, equal to brute force, independent of partitioning."""

import hashlib

import pytest

from supplyscope import operators as ops


def brute(rows, n, seed):
    key = lambda r: (hashlib.md5("|".join(map(str, (*r, seed))).encode()).hexdigest(), r)
    return sorted(sorted(rows, key=key)[:n])


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("n", [1, 37, 500])
def test_sample_n_equals_brute_force(spark, parts, n):
    rows = [(i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(parts)
    got = sorted(tuple(r) for r in ops.sample_n(df, n, ["a", "b"], seed=42).collect())
    assert got == brute(rows, n, 42)


def test_sample_n_whole_table_when_n_large(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "a long")
    assert ops.sample_n(df, 100, ["a"]).count() == 10


def test_split_is_deterministic_and_about_80_20(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    tr1, te1 = ops.train_test_split(df, ["k"], 7)
    tr2, _ = ops.train_test_split(df.repartition(7), ["k"], 7)
    assert tr1.count() + te1.count() == 20000
    assert 0.78 < tr1.count() / 20000 < 0.82
    assert tr1.exceptAll(tr2).count() == 0 and tr2.exceptAll(tr1).count() == 0
    flags = df.select(ops.train_test_flag(["k"], 7).alias("f")).filter("f").count()
    assert flags == tr1.count()


@pytest.mark.parametrize("n", [5, 60])
def test_sample_n_with_missing_keys_orders_them_last(spark, n):
    rows = [(i % 50 if i % 7 else None, i // 50 if i % 11 else None) for i in range(400)]

    def key(r):
        text = "|".join(str(x) for x in (*r, 42) if x is not None)
        return (hashlib.md5(text.encode()).hexdigest(),
                [(x is None, x if x is not None else 0) for x in r])

    want = sorted(sorted(rows, key=key)[:n], key=lambda r: [(x is None, x or 0) for x in r])
    df = spark.createDataFrame(rows, "a long, b long").repartition(4)
    got = sorted((tuple(r) for r in ops.sample_n(df, n, ["a", "b"], seed=42).collect()),
                 key=lambda r: [(x is None, x or 0) for x in r])
    assert len(got) == n or len(got) == len(want)
    assert got == want
