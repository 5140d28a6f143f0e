"""Intermediate tables are removed at the end of a run, those of other runs and threads are not."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from conftest import SF_SMALL
from supplyscope.operators import sample_n
from supplyscope.plans.etl import run_etl
from supplyscope.session import ensure_checkpoint_dir, materialize, run_folder
from supplyscope.sources import fixture_views, read_table


def held(spark):
    at = ensure_checkpoint_dir(spark).removeprefix("file:")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_run_removes_its_tables_and_no_others(spark, tmpdir_path):
    outside = materialize(spark.range(5).toDF("x"), "outside")
    before = held(spark)
    with run_folder(spark, "run"):
        one = materialize(spark.range(7).toDF("x"), "one")
        with run_folder(spark, "inner"):
            materialize(spark.range(3).toDF("x"), "two")
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(materialize, spark.range(9).toDF("x"), "thread", spark).result()
        sample_n(one, 3, ["x"]).write.parquet(f"{tmpdir_path}/result")
        assert one.count() == 7
    assert {n.split("-")[0] for n in held(spark) - before} == {"thread"}
    assert outside.count() == 5 and other.count() == 9 and spark.read.parquet(f"{tmpdir_path}/result").count() == 3


def test_a_run_that_fails_removes_its_tables(spark):
    before = held(spark)
    with pytest.raises(ValueError), run_folder(spark, "run"):
        materialize(spark.range(7).toDF("x"), "one")
        raise ValueError
    assert held(spark) == before


def test_the_batch_job_leaves_no_intermediate_tables(spark, tmpdir_path):
    before = held(spark)
    stored = run_etl(spark, fixture_views(spark, SF_SMALL), tmpdir_path, "1998-01-01", "1998-12-31")
    assert held(spark) == before
    assert stored["vendor_summary"].count() == read_table(spark, tmpdir_path, "vendor_summary").count() > 0
    assert stored["exec_summary"].count() == 1 and stored["purchases"].count() > 0 and stored["filter_counts"].count() > 0
