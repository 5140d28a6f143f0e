"""Early stopping of boosted trees (G5, G6): prefixes of the ensemble judged on held-out rows.

The original holds a tenth of more than 10,000 training rows back and stops when ten rounds bring no gain.
Spark's own validation rule has no patience.  Here all rounds are fitted on the other rows, one pass over
the held-out ones gives the loss of every prefix, the patience says where fitting would have stopped, and
the ensemble is cut to its best prefix up to there."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import md5_key

# Fixed values that must equal the original job (defaults of its learner): early stopping above so many
# rows, the rounds without gain, the least gain that counts.  A tenth of the rows is held out, as hash
# prefixes from "e6666666" on.
STOPS_ABOVE_ROWS = 10_000
PATIENCE = 10
LEAST_GAIN = 1e-7
HELD_OUT_FROM = "e6666666"
HELD_OUT_SEED = 11

CURVE = "model string, round int, loss double, rounds_run int, rounds_kept int"


def held_out_flag(keys: list[str], seed: int = HELD_OUT_SEED) -> F.Column:
    """``True`` for the ~10 % of rows that judge the rounds; equal keys fall on the same side."""
    return F.substring(md5_key(keys, seed), 1, len(HELD_OUT_FROM)) >= F.lit(HELD_OUT_FROM)


def stop_round(losses: list[float], patience: int = PATIENCE, least_gain: float = LEAST_GAIN) -> int:
    """How many rounds are run: up to the first whose last ``patience`` losses are all no better than the
    one before them by ``least_gain``; all of them if there is none.

    ``losses[i]`` is the loss after round ``i + 1``.  A loss that is no number is no gain."""
    for run in range(patience + 1, len(losses) + 1):
        before = losses[run - patience - 1] - least_gain
        if not any(loss < before for loss in losses[run - patience:run]):
            return run
    return len(losses)


def best_round(losses: list[float], run: int) -> int:
    """The rounds of the smallest loss within the first ``run``, the fewest if several tie."""
    return min(range(run), key=lambda i: (losses[i] != losses[i], losses[i], i)) + 1


def prefix(model, rounds: int, spark: SparkSession):
    """The boosted model of the first ``rounds`` trees, with the same parameters."""
    if rounds >= model.getNumTrees:
        return model
    sc = spark.sparkContext
    ml, java = sc._jvm.org.apache.spark.ml, model._java_obj
    trees = sc._gateway.new_array(ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], model.treeWeights)):
        trees[i], weights[i] = tree, float(weight)
    kind = (ml.regression.GBTRegressionModel if isinstance(model, GBTRegressionModel)
            else ml.classification.GBTClassificationModel)
    cut = type(model)(kind(model.uid, trees, weights))
    cut._resetUid(model.uid)
    return model._copyValues(cut)


def cut_ensemble(fitted: PipelineModel, held_out: DataFrame) -> tuple[PipelineModel, list[float], int]:
    """The pipeline (assembler, boosted model) cut by ``held_out`` rows, the loss after each round, and
    the rounds that the patience lets run.  Without held-out rows nothing is cut."""
    assembler, model = fitted.stages
    rows = assembler.transform(held_out)
    if rows.isEmpty():
        return fitted, [], model.getNumTrees
    losses = list(model.evaluateEachIteration(rows, "squared") if isinstance(model, GBTRegressionModel)
                  else model.evaluateEachIteration(rows))
    run = stop_round(losses)
    return PipelineModel([assembler, prefix(model, best_round(losses, run), held_out.sparkSession)]), losses, run


def curve_table(spark: SparkSession, curves: dict[str, tuple[list[float], int, int]]) -> DataFrame:
    """A row for each model and round: its held-out loss, and how many rounds were run and kept."""
    rows = [(name, i + 1, float(loss), run, kept)
            for name, (losses, run, kept) in sorted(curves.items()) for i, loss in enumerate(losses)]
    return spark.createDataFrame(rows, CURVE)
