"""Training and comparison of the learners: one task per (repeat, fold, model)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import UserInputError
from .. import encode as enc
from ..profile import check_feature_count
from ..split import holdout, repeated_folds
from .models import MODELS, evaluate, independent  # noqa: F401

#: Cells of an encoded matrix that a task gets whole; the learners of ``scaled`` take larger ones over partitions.
TASK_CELLS = 20_000_000


@dataclass
class Data:
    """An encoded cohort as arrays, rows in order of their ids."""

    ids: np.ndarray
    x: np.ndarray
    t: np.ndarray
    e: np.ndarray
    test: np.ndarray
    encoder: enc.Encoder
    names: list[str]
    mode: str


def fits_task(cohort: DataFrame, names: list[str]) -> bool:
    return cohort.count() * (len(names) + 3) <= TASK_CELLS


def load(cohort: DataFrame, encoder: enc.Encoder, extra: list[str] = ()) -> pd.DataFrame:
    names = encoder.names
    if not fits_task(cohort, names):
        raise UserInputError(f"a matrix of {len(names)} columns is too large for one task; use the learners of scaled")
    return enc.encode(cohort, encoder, ["_row_id", "time", "event", *extra]).toPandas().sort_values("_row_id", ignore_index=True)


def prepare(cohort: DataFrame, features: list[str], categorical: list[str] = (), seed: int = 42, standardize: bool = True) -> Data:
    """Split, then the encoder from training rows alone; constant training columns go."""
    check_feature_count(features)
    split, mode = holdout(cohort, seed)
    encoder = enc.fit_encoder(split.filter(~F.col("is_test")), features, list(categorical), standardize)
    pdf = load(split, encoder, ["is_test"])
    test = pdf.is_test.to_numpy(bool)
    x = pdf[encoder.names].to_numpy(float)
    keep = [j for j in range(x.shape[1]) if np.ptp(x[~test, j]) > 0]
    if not keep:
        raise UserInputError("every feature is constant in the training rows")
    return Data(pdf["_row_id"].to_numpy(), x[:, keep], pdf.time.to_numpy(float), pdf.event.to_numpy(int), test, encoder, [encoder.names[j] for j in keep], mode)


def train(data: Data, model: str, **how) -> tuple[object, dict]:
    """The fitted model and its evaluation on the test rows, or on all rows where there is no holdout."""
    if model not in MODELS:
        raise UserInputError(f"unknown model {model}; one of {', '.join(MODELS)}")
    fit_on = ~data.test
    got = MODELS[model](data.x[fit_on], data.t[fit_on], data.e[fit_on], **how)
    on = data.test if data.test.any() else fit_on
    return got, {"model": model, "evaluation_mode": data.mode, "train_n": int(fit_on.sum()), "test_n": int(on.sum()), "train_events": int(data.e[fit_on].sum()), "test_events": int(data.e[on].sum()), "n_features": len(data.names), **evaluate(got, data.x[on], data.t[on], data.e[on], data.t[fit_on], data.e[fit_on])}


SCHEMA = "model string, repeat int, fold int, train_n int, test_n int, train_events int, test_events int, n_features int, c_index double, ibs double, null_ibs double, skill double, error string"


def _frame(row: dict) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.Series([row.get(c.split()[0])], dtype=object) for c in SCHEMA.split(", ")})


def _rank(rows: list[dict]) -> list[dict]:
    rows.sort(key=lambda r: (r["c_index"] is None, -(r["c_index"] or 0), r["model"]))
    return [r | {"rank": i + 1} for i, r in enumerate(rows)]


def compare(cohort: DataFrame, features: list[str], categorical: list[str] = (), models: list[str] = tuple(MODELS), seed: int = 42, **how) -> list[dict]:
    """All models on one shared split, each in a task; failures are rows with an error. A matrix that is too large for a task goes to the
    learners over partitions (``scaled``)."""
    check_feature_count(features)
    if not fits_task(cohort, enc.fit_encoder(cohort, features, list(categorical)).names):
        from . import scaled

        return scaled.compare(cohort, features, categorical, models, seed, **how)
    data = prepare(cohort, features, categorical, seed)
    spark = cohort.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m in b.model:
                try:
                    row = train(data, m, seed=seed, **how)[1]
                except ValueError as e:
                    row = {"model": m, "error": str(e)}
                yield _frame(row)

    tasks = spark.createDataFrame([(m,) for m in models], "model string").repartition(len(models), "model")
    rows = [_clean(r.asDict()) | {"evaluation_mode": data.mode} for r in tasks.mapInPandas(run, SCHEMA).collect()]
    return _rank(rows)


def _clean(row: dict) -> dict:
    return {k: None if isinstance(v, float) and math.isnan(v) else v for k, v in row.items()}


def cross_validate(cohort: DataFrame, features: list[str], categorical: list[str] = (), models: list[str] = tuple(MODELS), folds: int = 5, repeats: int = 3, seed: int = 42, **how) -> DataFrame:
    """A row per (model, repeat, fold). The raw encoder is fitted on all levels; medians, scaling and constant columns are each
    training fold's own. A matrix that is too large for a task goes to the learners over partitions."""
    check_feature_count(features)
    plain = enc.fit_encoder(cohort, features, list(categorical), False)
    if not fits_task(cohort, plain.names):
        from . import scaled

        return scaled.cross_validate(cohort, features, categorical, models, folds, repeats, seed, **how)
    pdf = load(cohort, plain)
    deal = repeated_folds(cohort.select("_row_id", "event"), folds, repeats, seed).select("_row_id", "repeat", "fold").toPandas()
    at = {r: g.sort_values("_row_id").fold.to_numpy() for r, g in deal.groupby("repeat")}
    x0, t, e = pdf[plain.names].to_numpy(float), pdf.time.to_numpy(float), pdf.event.to_numpy(int)
    spark = cohort.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for m, r, f in b[["model", "repeat", "fold"]].itertuples(index=False):
                test = at[r] == f
                mean, sd = x0[~test].mean(axis=0), x0[~test].std(axis=0)
                keep = sd > 0
                x = (x0[:, keep] - mean[keep]) / sd[keep]
                row = {"model": m, "repeat": r, "fold": f, "train_n": int((~test).sum()), "test_n": int(test.sum()), "train_events": int(e[~test].sum()), "test_events": int(e[test].sum()), "n_features": int(keep.sum())}
                try:
                    row |= evaluate(MODELS[m](x[~test], t[~test], e[~test], seed=seed + r, **how), x[test], t[test], e[test], t[~test], e[~test])
                except ValueError as err:
                    row["error"] = str(err)
                yield _frame(row)

    tasks = [(m, r, f) for m in models for r in range(repeats) for f in range(folds)]
    df = spark.createDataFrame(tasks, "model string, repeat int, fold int").repartition(min(len(tasks), 64), "model", "repeat", "fold")
    return df.mapInPandas(run, SCHEMA)


def summarise(rows: DataFrame) -> DataFrame:
    """Means over repeats of the repeats' fold means, with SD and a 2.5 to 97.5 % interval; null where any fold failed."""
    per = rows.groupBy("model", "repeat").agg(F.avg("c_index").alias("c"), F.avg("ibs").alias("ibs"), F.sum(F.col("error").isNotNull().cast("int")).alias("failed"), F.count(F.lit(1)).alias("folds"))
    out = per.groupBy("model").agg(F.avg("c").alias("c"), F.stddev_samp("c").alias("c_index_sd"), F.percentile("c", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.avg("ibs").alias("ibs"), F.sum("failed").alias("failed"), F.sum("folds").alias("evaluations"))
    ok = lambda c: F.when(F.col("failed") == 0, c)
    return out.select("model", ok(F.col("c")).alias("c_index"), ok(F.col("c_index_sd")).alias("c_index_sd"), ok(F.get("q", 0)).alias("c_index_lower"), ok(F.get("q", 1)).alias("c_index_median"), ok(F.get("q", 2)).alias("c_index_upper"), ok(F.col("ibs")).alias("ibs"), "failed", "evaluations")


def full_rank_names(data: Data) -> list[str]:
    return [data.names[j] for j in independent(data.x[~data.test])]
