"""Early stopping of the boosted models."""

import math

import pytest
from pyspark.sql import functions as F

from supplyscope.plans import boosting
from supplyscope.plans.training import FEATURES, feature_columns, fit_both, fit_delay, fit_lead_time, load_models, predict, save_models


def brute_stop(losses, patience, gain):
    """Round by round, as a learner sees it: stop once the last rounds have not beaten the one before them."""
    seen = []
    for loss in losses:
        seen.append(loss)
        if len(seen) > patience:
            recent, reference = seen[-patience:], seen[-patience - 1]
            if all(not x < reference - gain for x in recent):
                break
    return len(seen)


@pytest.mark.parametrize("losses", [
    [], [1.0], [1.0] * 40, [1 / (i + 1) for i in range(40)], [abs(i - 15) for i in range(40)],
    [3, 2, 1] + [5 - 0.01 * i for i in range(40)], [5.0] + [math.nan] * 30, [10 - i if i % 9 == 0 else 20 for i in range(60)]])
@pytest.mark.parametrize("patience", [1, 3, 10])
def test_stop_round(losses, patience):
    assert boosting.stop_round(losses, patience) == brute_stop(losses, patience, boosting.LEAST_GAIN)


def test_best_round_takes_the_fewest_of_ties():
    assert boosting.best_round([3, 1, 2, 1, 0], 4) == 2
    assert boosting.best_round([math.nan, 2.0], 2) == 2


def lines(spark, n):
    """Lines whose lead time follows the quantity, with noise that can only be learnt by heart."""
    noise = F.abs(F.hash("PONumber") % 21).cast("long")
    df = spark.range(n).select(F.col("id").alias("PONumber"), F.lit(1).alias("LineNumber"), (F.col("id") % 97).alias("Brand"))
    for c in FEATURES:
        df = df.withColumn(c, (F.abs(F.hash("PONumber", F.lit(c))) % 50).cast("double"))
    days = (F.col("Quantity") / 10).cast("long") + noise
    return df.withColumns({"ActualLeadTimeDays": days, "IsDelayed": (days > 10).cast("int")})


KEYS = ["PONumber", "LineNumber", "Brand", "VendorNumber"]


def test_cut_ensemble_is_a_prefix_and_no_worse_held_out(spark, tmpdir_path):
    df = lines(spark, 3000).cache()
    held = boosting.held_out_flag(KEYS)
    train, judge = df.filter(~held), df.filter(held)
    assert 200 < judge.count() < 400
    for fit, column in ((fit_lead_time, "pred_days"), (fit_delay, "prob_delay")):
        whole = fit(train, 25, 0.8)
        cut, losses, run = boosting.cut_ensemble(whole, feature_columns(judge))
        kept = cut.stages[-1].getNumTrees
        assert len(losses) == 25 and kept <= run <= 25 and kept < 25
        assert losses[kept - 1] == min(losses[:run]) <= losses[-1]
        # The prefix is the model that so many rounds give.
        short = fit(train, kept, 0.8)
        rows = [m.transform(feature_columns(judge)).select("PONumber", column) for m in (cut, short)]
        got, want = ({r[0]: r[1] for r in x.collect()} for x in rows)
        assert got == want
        if column == "pred_days":  # the loss by round is that of the predictions
            mse = cut.transform(feature_columns(judge)).agg(
                F.avg((F.col("ActualLeadTimeDays") - F.col("pred_days")) ** 2)).first()[0]
            assert mse == pytest.approx(losses[kept - 1], rel=1e-9)
    # No rows to judge by: nothing is cut.
    same, losses, run = boosting.cut_ensemble(whole, feature_columns(judge.limit(0)))
    assert same is whole and losses == [] and run == 25


def test_models_stop_early_above_ten_thousand_rows_only(spark, tmpdir_path):
    curves = {}
    small = fit_both(lines(spark, 500), 3, KEYS, curves)
    assert curves == {} and small["reg"].stages[-1].getNumTrees == 3
    models = fit_both(lines(spark, 12_000), 4, KEYS, curves)
    assert set(curves) == {"reg", "cls"}
    for name, (losses, run, kept) in curves.items():
        assert len(losses) == 4 and models[name].stages[-1].getNumTrees == kept == boosting.best_round(losses, run)
    table = boosting.curve_table(spark, curves).collect()
    assert [(r.model, r.round) for r in table] == [(m, i) for m in ("cls", "reg") for i in range(1, 5)]
    # A cut ensemble survives saving.
    some = lines(spark, 200)
    models["reg"].stages[-1] = boosting.prefix(models["reg"].stages[-1], 2, spark)
    save_models(models, None, f"{tmpdir_path}/models")
    again, _ = load_models(spark, f"{tmpdir_path}/models")
    assert again["reg"].stages[-1].getNumTrees == 2
    columns = ["PONumber", "pred_days", "prob_delay"]
    assert sorted(predict(again, some).select(columns).collect()) == sorted(predict(models, some).select(columns).collect())
