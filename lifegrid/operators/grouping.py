"""Derived risk groups: labels from cut-offs that one exact aggregation gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..functions import outcomes
from .cohort import finite, require_columns

METHODS = ("median_split", "tertile_split", "quartile_split", "percentile_split", "extreme_split", "optimal_cutpoint")


@dataclass(frozen=True)
class Derived:
    """The table with the new column, its cut-offs, the counts of its labels and how it came about."""

    df: DataFrame
    column: str
    cutoffs: list[float]
    counts: list[dict]
    recipe: dict
    outcome_informed: bool = False


def percentile_values(cutoff: object, method: str) -> list[float]:
    """One or two percentages from '25', 25 or '25, 75'."""
    parts = str(cutoff if cutoff is not None else "").replace(";", ",").split(",")
    try:
        values = [float(p) for p in parts if p.strip()]
    except ValueError as e:
        raise UserInputError(f"Percentages are numbers: {cutoff}") from e
    if not 1 <= len(values) <= 2 or not all(0 < v < 100 for v in values):
        raise UserInputError(f"{method} needs one or two percentages between 0 and 100")
    return values


def quantiles(df: DataFrame, column: str, qs: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation of the finite values."""
    got = df.agg(F.percentile(finite(F.col(f"`{column}`")), F.array(*[F.lit(q) for q in qs])).alias("q")).first().q
    if not got:
        raise UserInputError(f'"{column}" has no numeric values')
    return list(got)


def unique_name(df: DataFrame, name: str) -> str:
    low = {c.lower() for c in df.columns}
    if name.lower() in low:
        raise UserInputError(f'A column named "{name}" exists already')
    return name


def bin_label(df: DataFrame, column: str, new: str, edges: list[float], labels: list[str]) -> DataFrame:
    """Right-closed bins: the label's position is how many inner edges are less than the value."""
    x = finite(F.col(f"`{column}`"))
    # the highest exceeded edge decides
    out = F.lit(labels[0])
    for e, label in zip(edges, labels[1:], strict=True):
        out = F.when(x > e, F.lit(label)).otherwise(out)
    return df.withColumn(new, F.when(x.isNotNull(), out))


def quantile_split(df: DataFrame, column: str, new: str, parts: int) -> tuple[DataFrame, list[float]]:
    """Bins between the distinct quantiles of the whole range; equal edges fall together, labels count up."""
    edges = sorted(set(quantiles(df, column, [k / parts for k in range(parts + 1)])))
    inner = edges[1:-1]
    if len(edges) < 3:
        raise UserInputError(f'"{column}" has too few distinct values to split')
    prefix = "T" if parts == 3 else "Q"
    return bin_label(df, column, new, inner, [f"{prefix}{k + 1}" for k in range(len(inner) + 1)]), inner


def derive_group(df: DataFrame, source: str, method: str, new_column: str | None = None, cutoff: object = None, lower_label: str = "Low", upper_label: str = "High", time: str | None = None, event: str | None = None, positive: object = None, **cut) -> Derived:
    """Adds a group column by one of METHODS; null sources have no label.

    median_split: above the median is upper. percentile_split with one percentage q: at or above the (100 - q)th percentile is 'Top q%', the
    rest 'Rest' (exactly 50 is the median split); with two: bottom, middle, top. extreme_split keeps both tails only.
    optimal_cutpoint scans the log-rank statistic and marks the column as outcome-informed.
    """
    require_columns(df, [source])
    if method not in METHODS:
        raise UserInputError(f"unknown method {method}")
    if source in (time, event) or outcomes.is_time_name(source):
        raise UserInputError(f'"{source}" is part of the outcome')
    new = unique_name(df, new_column or f"{source}_{method}")
    x, informed = finite(F.col(f"`{source}`").try_cast("double")), False
    if method == "median_split" or (method == "percentile_split" and percentile_values(cutoff, method) == [50.0]):
        cuts = quantiles(df, source, [0.5])
        out = bin_label(df, source, new, cuts, [lower_label, upper_label])
    elif method in ("tertile_split", "quartile_split"):
        out, cuts = quantile_split(df, source, new, 3 if method == "tertile_split" else 4)
    elif method in ("percentile_split", "extreme_split"):
        qs = percentile_values(cutoff, method)
        if method == "percentile_split" and len(qs) == 1:
            cuts = quantiles(df, source, [1 - qs[0] / 100])
            out = df.withColumn(new, F.when(x >= cuts[0], f"Top {qs[0]:g}%").when(x.isNotNull(), "Rest"))
        else:
            low, high = (qs[0], 100 - qs[0]) if len(qs) == 1 else (qs[0], 100 - qs[1]) if method == "percentile_split" or qs[0] + qs[1] <= 100 else sorted(qs)
            if low >= high:
                raise UserInputError("the two tails overlap")
            cuts = quantiles(df, source, [low / 100, high / 100])
            if cuts[0] >= cuts[1]:
                raise UserInputError("the two cut-offs fall together")
            names = (f"Bottom {low:g}%", f"Top {100 - high:g}%")
            middle = F.lit("Middle") if method == "percentile_split" else F.lit(None).cast("string")
            out = df.withColumn(new, F.when(x <= cuts[0], names[0]).when(x >= cuts[1], names[1]).when(x.isNotNull(), middle))
    else:
        from .cohort import build, with_row_id
        from .cutpoint import optimal_cutpoint

        if not time or not event:
            raise UserInputError("optimal_cutpoint needs the time and event columns")
        keyed = with_row_id(df)
        best = optimal_cutpoint(build(keyed, time, event, positive, [source]).df, source, lower_label=lower_label, upper_label=upper_label, **cut)
        cuts, informed = [best["cutpoint"]], True
        out = keyed.withColumn(new, F.when(x > cuts[0], best["label_above"]).when(x.isNotNull(), best["label_below"]))
    from .profile import value_counts

    counts = [r.asDict() for r in value_counts(out, new).limit(64).collect()]
    total = sum(c["n"] for c in counts if c["value"] != "Missing")
    counts = [c | {"share": None if c["value"] == "Missing" or not total else c["n"] / total} for c in counts]
    return Derived(out, new, cuts, counts, {"source": source, "method": method, "cutoff": cutoff, "cutoffs": cuts}, informed)
