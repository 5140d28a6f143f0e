"""Vectors and queries of the top-k search meet in tasks of one shard each, without a join or a broadcast."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplyscope.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, n, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)]) for i in range(n)], SCHEMA)


def brute(rows, k=5, every=50):
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and np.isfinite(v).all()]
    out = []
    for q, a in {(i, tuple(v)) for i, v in valid if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in valid if i != q and len(b) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_no_join_puts_vectors_in_one_task_or_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    plan = topk.top_k(table(spark, 600))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and "MapInArrow" in plan
    # The shuffle in front of the search is by shard; by length all vectors went to one task.
    assert re.findall(r"hashpartitioning\((\w+)#\d+, \d+\), REPARTITION", plan) == ["shard"]


def test_a_shard_holds_a_share_of_the_vectors_and_each_query_once(spark):
    vectors = topk.quantised(table(spark, 2000)).withColumn("salt", F.xxhash64("vec_id"))
    asked = (vectors.where("vec_id % 50 = 0").select("dim", "vec_id", "v", F.col("vec_id").alias("query"))
             .withColumn("floor", F.lit(0).cast("long")))
    rows = topk.dealt(vectors, asked, 20).withColumn("task", F.spark_partition_id())
    shards = rows.groupBy("shard").agg(F.count_if(~F.col("asks")).alias("held"), F.count_if("asks").alias("queries"),
                                       F.count_distinct("query").alias("different"), F.count_distinct("task").alias("tasks")).collect()
    assert len(shards) == 20 and sum(r.held for r in shards) == 2000
    assert max(r.held for r in shards) < 200 and {r.queries for r in shards} == {40} and {r.tasks for r in shards} == {1}
    # The vectors come first, then the queries.
    kinds = [[a.asks for a in part] for part in rows.rdd.glom().collect() if len({a.shard for a in part}) == 1]
    assert kinds and all(k == sorted(k) for k in kinds)


@pytest.mark.parametrize("bytes_", [1 << 12, 32 << 20])
def test_many_and_few_shards_give_the_brute_force_rows(spark, monkeypatch, bytes_):
    monkeypatch.setattr(topk, "SHARD_BYTES", bytes_)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 5) for i in range(60)] + [(i, [300.0, float(i), 1.0, 0.0, -200.0]) for i in range(400, 460)]
    rows += [(i, [6e6, float(i), -3e6, 0.0, 1.0]) for i in range(500, 520)]
    # Equal as bytes and by id, but of other lengths; an id with two vectors; few candidates of a length.
    rows += [(600, [2.0**10, 0.0]), (600, [0.0, 2.0**2, 0.0, 0.0]), (601, [1.0, 1.0]), (602, [0.0, 1.0, 0.0, 0.0])]
    rows += [(0, [0.5] * 5), (0, [0.5] * 5), (650, []), (651, None), (650, [float("inf")] * 5), (None, [1.0] * 5)]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_odd_vectors_take_no_part_and_too_large_ones_are_an_error(spark):
    rows = [(1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [1e308, 1.0]), (4, None), (5, []), (None, [1.0]), (6, [-0.5, 127.996]),
            (7, [-128.0, 128.0]), (8, [2.0**23, 0.0])]
    got = {r.vec_id: (r.dim, len(r.v)) for r in topk.quantised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {6: (2, 4), 7: (2, 8), 8: (2, 16)}
    with pytest.raises(Exception, match="the vector of 9 has components"):
        topk.quantised(spark.createDataFrame([(9, [2.0**60])], SCHEMA)).collect()
