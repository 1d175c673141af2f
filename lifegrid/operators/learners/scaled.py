"""Training, evaluation and comparison of the learners over partitions, for matrices that no task could hold.

The same four models as in ``models``: Cox and LASSO-Cox on the rows as they are, forest and boosting on binned features. All of them
end as the small model objects of ``models``, which go to the tasks for prediction; concordance and Brier scores are then
counted from the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import UserInputError
from .. import brier, concordance, cox
from .. import encode as enc
from ..likelihood import Sorted
from ..profile import check_feature_count
from ..split import holdout, repeated_folds
from . import histogram, lasso
from .models import Linear

MODELS = ("cox_ph", "lasso_cox", "random_survival_forest", "gradient_boosted_survival")


def time_slots(df: DataFrame, most: int = 200) -> np.ndarray:
    """The event times, or so many quantiles of them: where curves of proportional-hazards models step."""
    events = df.filter("event = 1").select(F.col("time").cast("double").alias("time"))
    got = [r.time for r in events.distinct().limit(most + 1).collect()]
    if len(got) > most:
        r = events.agg(F.percentile_approx("time", F.array(*[F.lit(i / most) for i in range(1, most + 1)]), F.lit(10_000)).alias("q"), F.max("time").alias("h")).first()
        got = [*r.q, r.h]
    return np.unique(np.array(got, float))


def fit_cox(df: DataFrame, names: list[str], **_) -> Linear:
    kept = enc.full_rank(df, names)
    got = cox.fit(df, kept)
    beta = np.zeros(len(names))
    beta[[names.index(c) for c in kept]] = got.beta
    center = np.zeros(len(names))
    center[[names.index(c) for c in kept]] = got.center
    slots = time_slots(df)
    rows = Sorted(df, [F.col(f"`{c}`").cast("double") - float(m) for c, m in zip(names, center, strict=True)], [], got.n)
    try:
        base = rows.baseline(beta, slots)
    finally:
        rows.release()
    return Linear(beta, (slots, base), center, {"loglik": got.loglik})


def fit(df: DataFrame, names: list[str], model: str, seed: int = 42, bins: int = histogram.BINS, **how):
    """A model of encoded rows: _row_id, time, event and numeric columns without nulls."""
    if model not in MODELS:
        raise UserInputError(f"unknown model {model}; one of {', '.join(MODELS)}")
    if model == "cox_ph":
        return fit_cox(df, names)
    if model == "lasso_cox":
        return lasso.fit_lasso(df, names, time_slots(df), seed)
    rows = histogram.bin_rows(df, names, bins)
    known = {"n_estimators", "max_depth", "min_leaf", "learning_rate", "features_per_node"}
    how = {k: v for k, v in how.items() if k in known and v is not None}
    try:
        if model == "random_survival_forest":
            how.pop("learning_rate", None)
            forest = histogram.fit_forest(rows, seed=seed, **how)
            forest.importance = histogram.forest_importance(df, forest, names, seed)
            return forest
        how.pop("features_per_node", None)
        return histogram.fit_boosted(rows, **how)
    finally:
        rows.release()


def evaluate(model, names: list[str], test: DataFrame, train: DataFrame, points: int = 100) -> dict:
    """Concordance on the test rows, and their integrated Brier score with its skill against the training curve."""
    times = brier.evaluation_times(train, points)
    p = histogram.predict(test, model, names, times)
    out = {"c_index": concordance.c_index(p.select("_row_id", "time", "event", "risk")), "ibs": None, "null_ibs": None, "skill": None}
    if times:
        got = brier.integrated([r.asDict() for r in brier.brier_of_curves(p.select("time", "event", "surv"), times, train).collect()])
        out |= {k: got[k] for k in ("ibs", "null_ibs", "skill")}
    return out


def fold_frames(cohort: DataFrame, test, features: list[str], categorical: list[str], standardize: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Encoded training and test rows (test: a condition) and the columns that vary in training; the encoder is of the training rows alone."""
    train = cohort.filter(~test)
    encoder = enc.fit_encoder(train, features, list(categorical), standardize)
    keep = ["_row_id", "time", "event"]
    a, b = enc.encode(train, encoder, keep), enc.encode(cohort.filter(test), encoder, keep)
    names = enc.varying(a, encoder.names)
    if not names:
        raise UserInputError("every feature is constant in the training rows")
    return a, b, names


def _counts(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).first()
    return int(r.n), int(r.e or 0)


def compare(cohort: DataFrame, features: list[str], categorical: list[str] = (), models: list[str] = MODELS, seed: int = 42, **how) -> list[dict]:
    """All models on one shared split, one after the other, each over all partitions; failures are rows with an error. Ranked as
    ``compare.compare`` ranks."""
    from .compare import _rank

    check_feature_count(features)
    split, mode = holdout(cohort, seed)
    train, test, names = fold_frames(split, F.col("is_test"), features, list(categorical))
    if mode == "apparent":
        test = train
    sizes = _counts(train), _counts(test)
    rows = []
    for m in models:
        row = {"model": m, "evaluation_mode": mode, "train_n": sizes[0][0], "test_n": sizes[1][0], "train_events": sizes[0][1], "test_events": sizes[1][1], "n_features": len(names), "c_index": None, "ibs": None, "null_ibs": None, "skill": None, "error": None}
        try:
            row |= evaluate(fit(train, names, m, seed, **how), names, test, train)
        except UserInputError as e:
            row["error"] = str(e)
        rows.append(row)
    return _rank(rows)


def cross_validate(cohort: DataFrame, features: list[str], categorical: list[str] = (), models: list[str] = MODELS, folds: int = 5, repeats: int = 3, seed: int = 42, **how) -> DataFrame:
    """A row per (model, repeat, fold), as ``compare.cross_validate`` gives them; fit after fit, each over all partitions."""
    from .compare import SCHEMA

    dealt = repeated_folds(cohort, folds, repeats, seed)
    rows = []
    for r in range(repeats):
        for f in range(folds):
            train, test, names = fold_frames(dealt.filter(F.col("repeat") == r).drop("repeat"), F.col("fold") == f, features, list(categorical))
            sizes = _counts(train), _counts(test)
            for m in models:
                row = {"model": m, "repeat": r, "fold": f, "train_n": sizes[0][0], "test_n": sizes[1][0], "train_events": sizes[0][1], "test_events": sizes[1][1], "n_features": len(names)}
                try:
                    row |= evaluate(fit(train, names, m, seed + r, **how), names, test, train)
                except UserInputError as e:
                    row["error"] = str(e)
                rows.append(row)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return cohort.sparkSession.createDataFrame([tuple(row.get(c) for c in names) for row in rows], SCHEMA)
