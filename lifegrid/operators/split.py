"""Splits that depend on row ids and a seed, never on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from .positions import numbered


def _order(seed: int):
    return F.xxhash64(F.lit(seed), F.col("_row_id"))


def ranked(cohort: DataFrame, seed: int) -> DataFrame:
    """_rank from 0 within each event class, in an order drawn from the ids; _size of the class."""
    return numbered(cohort, ["event"], [_order(seed), F.col("_row_id")], "_rank", "_size")


def holdout(cohort: DataFrame, seed: int = 42, fraction: float = 0.3, least_rows: int = 20, least_class: int = 4) -> tuple[DataFrame, str]:
    """Adds is_test, stratified by event, and says 'holdout'; 'apparent' with no test rows where there are too few rows."""
    sizes = {r.event: r["count"] for r in cohort.groupBy("event").count().collect()}
    if sum(sizes.values()) < least_rows or len(sizes) < 2 or min(sizes.values()) < least_class:
        return cohort.withColumn("is_test", F.lit(False)), "apparent"
    out = ranked(cohort, seed).withColumn("is_test", F.col("_rank") < F.ceil(F.col("_size") * fraction)).drop("_rank", "_size")
    return out, "holdout"


def folds(cohort: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold 0..k-1, dealt in turn within each event class."""
    return ranked(cohort, seed).withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "_size")


def repeated_folds(cohort: DataFrame, k: int = 5, repeats: int = 3, seed: int = 42, most_fits: int = 200) -> DataFrame:
    """The rows once for each repeat, with repeat and fold."""
    if not 2 <= k <= 10 or not 1 <= repeats <= 20 or k * repeats > most_fits:
        raise UserInputError(f"2 to 10 folds, 1 to 20 repeats, at most {most_fits} fits")
    sizes = [r["count"] for r in cohort.groupBy("event").count().collect()]
    if len(sizes) < 2 or min(sizes) < k:
        raise UserInputError(f"each event class needs at least {k} rows")
    rows = cohort.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = numbered(rows, ["repeat", "event"], [F.xxhash64(F.lit(seed) + F.col("repeat"), F.col("_row_id")), F.col("_row_id")], "_rank", "_size")
    return drawn.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "_size")


def monitor(train: DataFrame, seed: int = 42, fraction: float = 0.2, least_rows: int = 24, least_class: int = 2) -> DataFrame:
    """Adds is_monitor to training rows (they stay training rows); none where there are too few."""
    out, how = holdout(train, seed + 1, fraction, least_rows, least_class)
    return out.withColumnRenamed("is_test", "is_monitor")
