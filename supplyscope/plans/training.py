"""Training set (G1-G4), the two boosted-tree models (G5, G6), metrics (G6a), save/load.

The training set is a fixed-size sample (100,000 lines by default), so model fitting cost does
not grow with the purchase table; only the sample draw and the vendor join scan it.
"""

from __future__ import annotations

import math
import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.ml.regression import GBTRegressor

from ..functions import days_between, month_of, weekday0
from ..operators.sampling import sample_n, train_test_split
from ..session import materialize
from ..sources.versions import commit, current, names, new_version
from .boosting import STOPS_ABOVE_ROWS, cut_ensemble, held_out_flag

# Fixed values that must equal the original job ------------------------------------------
FEATURES = ["VendorNumber", "Store", "Classification", "Quantity", "PurchasePrice", "Dollars",
            "POMonth", "PODayOfWeek", "AvgLeadTimeDays", "LateDeliveryRate", "VPIScore"]
SAMPLE_SIZE = 100_000
# Fills after the vendor join (month and weekday cannot be missing after the date filter).
TRAINING_FILLS = {"AvgLeadTimeDays": 7.5, "LateDeliveryRate": 5.0, "VPIScore": 70.0,
                  "POMonth": 1, "PODayOfWeek": 1}
LEAD_TIME_RANGE = (0, 60)
DELAY_AFTER_DAYS = 10
BOOST_ROUNDS, LEARNING_RATE, MODEL_SEED = 150, 0.08, 42
# ------------------------------------------------------------------------------------------
LABEL_DAYS, LABEL_DELAY = "ActualLeadTimeDays", "IsDelayed"
# Spark trees reject missing values; a sentinel below every real value stands in for them.
MISSING = -1.0


# Row keys for the sample and the split: the driver-table stand-in has a line number; a
# purchases file without one is keyed by every column that identifies a line.
LINE_KEYS = ["PONumber", "LineNumber", "Brand", "VendorNumber"]
FILE_KEYS = ["PONumber", "Brand", "VendorNumber", "Store", "Classification", "Quantity",
             "Dollars", "PurchasePrice", "PODate", "ReceivingDate"]


def default_keys(df: DataFrame) -> list[str]:
    return LINE_KEYS if "LineNumber" in df.columns else [k for k in FILE_KEYS
                                                         if k in df.columns]


def vendor_history(vs: DataFrame) -> DataFrame:
    """The scorecard columns that are looked up per vendor (key ``_vn``), stored.

    The planner knows a stored table's size and broadcasts it under the threshold, so the lines or
    orders that look it up are not shuffled on the vendor; the scorecard is computed once."""
    return materialize(vs.select(F.col("VendorNumber").alias("_vn"), "AvgLeadTimeDays",
                                 "LateDeliveryRate", "VPIScore"), "vendor-history")


def training_features(purchases: DataFrame, vs: DataFrame, n: int | None = SAMPLE_SIZE,
                      sample_keys: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Sampled purchase lines with calendar parts, actual lead time, the vendor's history and
    the delay label (G1-G3, P1, P4, P5, J7, G3a).

    The sample is drawn before the line filters, as in the original, so fewer than ``n`` rows
    remain; ``n=None`` takes all lines.  Vendor history covers all lines (test lines included), as
    in the original.  Only the columns that training uses are drawn and stored."""
    keys = sample_keys or default_keys(purchases)
    carried = list(dict.fromkeys(keys + ["VendorNumber", "Store", "Classification", "Quantity",
                                         "PurchasePrice", "Dollars"]))
    drawn = purchases.select(*dict.fromkeys(carried + ["PODate", "ReceivingDate"]))
    s = drawn if n is None else sample_n(drawn, n, keys, seed)
    lines = (s.filter(F.col("PODate").isNotNull() & F.col("ReceivingDate").isNotNull()
                      & (F.col("Quantity") > 0) & (F.col("Dollars") > 0))
             .select(*[c for c in carried if c not in ("PODate", "ReceivingDate")],
                     month_of("PODate").cast("long").alias("POMonth"),
                     weekday0("PODate").cast("long").alias("PODayOfWeek"),
                     days_between("PODate", "ReceivingDate").cast("long").alias(LABEL_DAYS)))
    hist = vendor_history(vs)
    lo, hi = LEAD_TIME_RANGE
    return (lines.join(hist, lines["VendorNumber"].eqNullSafe(hist["_vn"]), "left").drop("_vn")
            .fillna(TRAINING_FILLS)
            .filter(F.col(LABEL_DAYS).between(lo, hi))
            .withColumn(LABEL_DELAY, (F.col(LABEL_DAYS) > DELAY_AFTER_DAYS).cast("int")))


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=[f"_f_{c}" for c in FEATURES], outputCol="features",
                           handleInvalid="keep")


def feature_columns(df: DataFrame) -> DataFrame:
    """Model inputs as doubles with missing values replaced by the sentinel."""
    return df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING))
                           for c in FEATURES})


def fit_lead_time(train: DataFrame, max_iter: int = BOOST_ROUNDS, step: float = LEARNING_RATE,
                  seed: int = MODEL_SEED, max_depth: int = 5) -> PipelineModel:
    """Boosted regression trees for the lead time in days."""
    gbt = GBTRegressor(labelCol=LABEL_DAYS, featuresCol="features", maxIter=max_iter,
                       stepSize=step, seed=seed, maxDepth=max_depth, maxBins=255,
                       minInstancesPerNode=20, predictionCol="pred_days")
    return Pipeline(stages=[_assembler(), gbt]).fit(feature_columns(train))


def fit_delay(train: DataFrame, max_iter: int = BOOST_ROUNDS, step: float = LEARNING_RATE,
              seed: int = MODEL_SEED, max_depth: int = 5) -> PipelineModel:
    """Boosted classification trees for the delay flag (G6); probability of class 1 is the risk."""
    gbt = GBTClassifier(labelCol=LABEL_DELAY, featuresCol="features", maxIter=max_iter,
                        stepSize=step, seed=seed, maxDepth=max_depth, maxBins=255,
                        minInstancesPerNode=20, predictionCol="pred_delay")
    gbt.setProbabilityCol("prob_delay").setRawPredictionCol("raw_delay")
    return Pipeline(stages=[_assembler(), gbt]).fit(feature_columns(train))


def predict(models: dict, df: DataFrame) -> DataFrame:
    """Add ``pred_days`` and ``prob_delay`` (probability vector) to rows carrying FEATURES."""
    out = feature_columns(df)
    if "reg" in models:
        out = models["reg"].transform(out).drop("features")
    if "cls" in models:
        out = models["cls"].transform(out).drop("features", "raw_delay")
    return out.drop(*[f"_f_{c}" for c in FEATURES])


def metrics_of(scored: DataFrame) -> DataFrame:
    """One-row metrics of rows that carry labels and predictions, in one aggregate.

    R², MAE and RMSE of ``pred_days`` and the accuracy of ``pred_delay``; without rows they are
    missing, and R² is 0 where the label does not vary."""
    y, p = F.col(LABEL_DAYS).cast("double"), F.col("pred_days").cast("double")
    a = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(y - p)).alias("mae"),
                   F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("var"),
                   F.avg((F.col(LABEL_DELAY).cast("double") == F.col("pred_delay")).cast("double"))
                   .alias("accuracy"))
    return a.select(F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var"))
                    .when(F.col("n") > 0, 0.0).alias("r2"),
                    "mae", F.sqrt("mse").alias("rmse"), "accuracy", F.col("n").alias("test_rows"))


def evaluate(models: dict, test: DataFrame) -> DataFrame:
    """One-row metrics: R², MAE, RMSE of the lead time and accuracy of the delay flag."""
    return metrics_of(predict(models, test))


ROWS_PER_TRAINING_PARTITION = 50_000


def fit_both(train: DataFrame, max_iter: int = BOOST_ROUNDS, keys: list[str] | None = None,
             curves: dict | None = None) -> dict:
    """Fit the two models concurrently on one persisted copy of the training rows.

    The training set is a bounded sample, so it is packed into ``ceil(rows / 50,000)``
    partitions: each boosting round is a few small jobs, and fewer, fuller tasks cut the
    per-round scheduling cost.  The two fits are independent Spark jobs, so they share the
    executors from two driver threads.  Spark ML checkpoints the boosting state every 10 rounds
    to the shared checkpoint folder, so a lost executor does not restart the fit.

    Of more than 10,000 rows a tenth (by row ``keys``) is held out and cuts both ensembles, see
    ``boosting``.  ``curves`` takes each model's losses by round, rounds run and rounds kept."""
    rows = train.count()
    parts = max(1, math.ceil(rows / ROWS_PER_TRAINING_PARTITION))
    packed = train.repartition(parts).persist()
    stops = rows > STOPS_ABOVE_ROWS
    judges = held_out_flag(keys or [k for k in default_keys(train) if k in train.columns])

    def fitted(name, fit):
        if not stops:
            return fit(packed, max_iter)
        model, losses, run = cut_ensemble(fit(packed.filter(~judges), max_iter), feature_columns(packed.filter(judges)))
        if curves is not None:
            curves[name] = (losses, run, model.stages[-1].getNumTrees)
        return model

    try:
        with ThreadPoolExecutor(max_workers=2) as pool:
            reg = pool.submit(fitted, "reg", fit_lead_time)
            cls = pool.submit(fitted, "cls", fit_delay)
            return {"reg": reg.result(), "cls": cls.result()}
    finally:
        packed.unpersist()


def train_models(purchases: DataFrame, vs: DataFrame, n: int | None = SAMPLE_SIZE,
                 max_iter: int = BOOST_ROUNDS, split_seed: int = 7,
                 sample_keys: list[str] | None = None, test_all: bool = False
                 ) -> tuple[dict, DataFrame]:
    """Training set → 80/20 split → both models → metrics on the test share.

    ``n`` bounds the lines that the models are fitted on.  By default the test share is that of the
    same lines, as in the original; ``test_all`` evaluates the test share of all lines instead (the
    split is by line keys, so none of them was fitted on)."""
    keys = sample_keys or default_keys(purchases)
    feats = training_features(purchases, vs, n, keys)
    split_keys = [k for k in keys if k in feats.columns]
    train, test = train_test_split(feats, split_keys, split_seed)
    if test_all and n is not None:
        _, test = train_test_split(training_features(purchases, vs, None, keys), split_keys, split_seed)
    models = fit_both(train, max_iter, split_keys)
    return models, evaluate(models, test)


def save_models(models: dict, metrics: DataFrame | None, path: str) -> str:
    """Both pipelines, the feature list and the metrics row as one artifact.

    They are a new version under ``path``, committed when all of it is there: a reader gets the old
    artifact or the new one, never parts of both, and a save that fails leaves the old one."""
    spark = SparkSession.getActiveSession()
    version = new_version(spark, path)
    at = os.path.join(path, version)
    for k, m in models.items():
        m.write().save(os.path.join(at, k))
    if metrics is not None:
        metrics.coalesce(1).write.parquet(os.path.join(at, "metrics"))
    manifest = [(sorted(models), FEATURES, metrics is not None)]
    (spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.json(os.path.join(at, "manifest")))
    commit(spark, path, version)
    return path


MANIFEST = "models array<string>, features array<string>, metrics boolean"


def load_models(spark: SparkSession, path: str) -> tuple[dict, DataFrame | None]:
    """Load the artifact that ``save_models`` committed last, and its metrics row if it was saved.

    A pipeline that is absent or unreadable raises, with its path in the message, and so does an artifact
    whose models were fitted on other features than this code prepares."""
    at = current(spark, path)
    saved = names(spark, os.path.join(at, "manifest"))
    manifest = spark.read.schema(MANIFEST).json(os.path.join(at, "manifest")).first() if saved else None
    if manifest is not None and list(manifest.features) != FEATURES:
        raise ValueError(f"the models at {at} take the features {list(manifest.features)}, not {FEATURES}")
    models = {}
    for k in ("reg", "cls"):
        where = os.path.join(at, k)
        try:
            models[k] = PipelineModel.load(where)
        except Exception as e:
            raise FileNotFoundError(f"no saved model can be read at {where}") from e
    where = os.path.join(at, "metrics")
    return models, spark.read.parquet(where) if names(spark, where) else None


def main(argv: list[str] | None = None) -> None:
    """``python -m supplyscope.plans.training INPUTS RESULTS MODELS [--format csv]``

    Trains on the purchases input and the stored scorecard under RESULTS (written by the ETL)
    and saves both pipelines and the metrics row under MODELS."""
    import argparse

    from ..session import build_session, run_folder
    from ..sources import read_table, read_training_purchases

    ap = argparse.ArgumentParser(prog="python -m supplyscope.plans.training")
    ap.add_argument("inputs")
    ap.add_argument("results")
    ap.add_argument("models")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--rounds", type=int, default=BOOST_ROUNDS)
    ap.add_argument("--sample", type=int, default=SAMPLE_SIZE, help="lines to draw; 0 for all")
    ap.add_argument("--test-all", action="store_true", help="evaluate all held-out lines")
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    a = ap.parse_args(argv)
    spark = build_session(shuffle_partitions=a.shuffle_partitions)
    with run_folder(spark, "training"):
        purchases = read_training_purchases(spark, a.inputs, a.format)
        vs = read_table(spark, a.results, "vendor_summary",
                        ["VendorNumber", "AvgLeadTimeDays", "LateDeliveryRate", "VPIScore"])
        models, metrics = train_models(purchases, vs, a.sample or None, a.rounds, test_all=a.test_all)
        save_models(models, metrics, a.models)
        m = metrics.first()
    print(f"r2={m.r2:.4f} mae={m.mae:.2f} rmse={m.rmse:.2f} accuracy={m.accuracy:.4f}")


if __name__ == "__main__":
    main()
