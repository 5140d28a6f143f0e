"""The joined lines and the vendors' history are made once for the queries that read them several times."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def reads_lines(df):
    return any("lineitem.parquet" in f for f in df.inputFiles())


@pytest.fixture()
def unfitted(spark, monkeypatch):
    """Models that aren't fitted, and none kept from other tests or for them."""
    for kept in ("_MODELS", "_CURVES", "_HISTORIES"):
        monkeypatch.setattr(E, kept, {})
    monkeypatch.setattr(E, "fit_both", lambda train, **kw: {"train": train})
    scorecards = []
    make = E.ops.vendor_summary_from
    monkeypatch.setattr(E.ops, "vendor_summary_from", lambda *a, **kw: (scorecards.append(a), make(*a, **kw))[1])
    return scorecards


def test_one_join_and_one_history_for_the_models(spark, unfitted, monkeypatch):
    models, test = E._models(spark, SF_SMALL)
    assert not reads_lines(models["train"]) and not reads_lines(test)
    scored = []
    monkeypatch.setattr(E, "score_orders", lambda orders, vs, models, keep: scored.append(vs))
    E.q_score_orders_model(spark, SF_SMALL)
    assert len(unfitted) == 1
    columns = ["VendorNumber", "AvgLeadTimeDays", "LateDeliveryRate", "VPIScore"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(scored[0]) == rows(E._history(spark, SF_SMALL))


def test_loads_read_the_stored_lines(spark, monkeypatch):
    loads = []
    store = E.incremental.store_load
    monkeypatch.setattr(E.incremental, "store_load", lambda *a: (loads.append(a), store(*a))[1])
    E.q_scorecard_after_merge(spark, SF_SMALL)
    assert [a[1] for a in loads] == ["early", "late"]
    assert not any(reads_lines(a[2]) or reads_lines(a[3]) for a in loads)
