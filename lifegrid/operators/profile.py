"""Column and dataset profiles from single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..functions import outcomes
from .cohort import FLOATS, distinct_values

MAX_FEATURES = 1000
NUMBERS = (*FLOATS, "int", "bigint", "smallint", "tinyint", "boolean")


def is_number(kind: str) -> bool:
    return kind in NUMBERS or kind.startswith("decimal")


def _present(df: DataFrame, c: str) -> Column:
    x = F.col(f"`{c}`")
    return F.when(x.isNotNull() & ~F.isnan(x), x) if dict(df.dtypes)[c] in FLOATS else x


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, kind, missing, non_missing, n_unique, min, max of every column; one pass. NaN counts as missing.

    Exact distinct counts of many columns expand the rows; approximate=True uses sketches instead.
    """
    kinds = dict(df.dtypes)
    uniq = F.approx_count_distinct if approximate else F.count_distinct
    aggs = [F.count(F.lit(1)).alias("_all")]
    for i, c in enumerate(df.columns):
        x = _present(df, c)
        aggs += [F.count(x).alias(f"n{i}"), uniq(x).alias(f"u{i}")]
        if is_number(kinds[c]):
            aggs += [F.min(x).cast("double").alias(f"lo{i}"), F.max(x).cast("double").alias(f"hi{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(df.columns):
        num = is_number(kinds[c])
        date = kinds[c].startswith(("timestamp", "date"))
        kind = F.when((F.col(f"u{i}") <= 2) & F.lit(not date), "binary").otherwise("numeric" if num else "datetime" if date else "categorical")
        none = F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), (F.col("_all") - F.col(f"n{i}")).alias("missing"), F.col(f"n{i}").alias("non_missing"), F.col(f"u{i}").alias("n_unique"), (F.col(f"lo{i}") if num else none).alias("min"), (F.col(f"hi{i}") if num else none).alias("max")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def profile(df: DataFrame, preview_rows: int = 12, approximate: bool = False) -> dict:
    """The dataset's profile: columns, lists by kind, suggestions, preview."""
    cols = [r.asDict() for r in profile_columns(df, approximate).collect()]
    kinds, values = dict(df.dtypes), {}
    for c in cols:
        few = distinct_values(df, c["column"]) if c["n_unique"] <= 64 else None
        values[c["column"]] = few
        c["unique_preview"] = few[:8] if few else []
    binary = [c for c in df.columns if values[c] is not None and outcomes.binary_values(values[c])]
    order = "_row_id" if "_row_id" in df.columns else None
    head = (df.orderBy(order) if order else df).limit(preview_rows)
    hints = outcomes.suggest(df.columns)
    return {
        "n_columns": len(cols), "n_rows": cols[0]["missing"] + cols[0]["non_missing"] if cols else 0, "columns": cols,
        "numeric_columns": [c for c in df.columns if is_number(kinds[c])], "categorical_columns": [c for c in df.columns if not is_number(kinds[c])], "binary_candidate_columns": binary,
        "suggestions": hints, "feature_candidates": outcomes.feature_candidates(df.columns, hints["time_columns"], binary), "preview": [r.asDict() for r in head.collect()],
    }


def extend_profile(old: dict, df: DataFrame, approximate: bool = False) -> dict:
    """A profile after columns were only appended: just the new ones are looked at."""
    known = {c["column"] for c in old["columns"]}
    new = [c for c in df.columns if c not in known]
    if not new:
        return old
    more = profile(df.select(*[F.col(f"`{c}`") for c in new]), 0, approximate)
    out = old | {k: [*old[k], *more[k]] for k in ("columns", "numeric_columns", "categorical_columns", "binary_candidate_columns", "feature_candidates")}
    return out | {"n_columns": len(out["columns"]), "suggestions": outcomes.suggest(df.columns)}


def check_feature_count(columns: list[str], most: int = MAX_FEATURES) -> None:
    if len(columns) > most:
        raise UserInputError(f"{len(columns)} candidate features; the limit is {most}")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n with missing values as 'Missing', most first."""
    return df.groupBy(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("Missing")).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")
