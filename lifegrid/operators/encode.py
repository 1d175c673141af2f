"""Feature encoding: a plan fitted by one aggregation, applied by one select."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from .cohort import finite, require_columns
from .profile import is_number

MAX_LEVELS = 1000


@dataclass(frozen=True)
class Encoder:
    """numeric: column -> (median, mean, sd); categorical: column -> sorted levels, the first one being the baseline."""

    numeric: dict[str, tuple[float, float, float]]
    categorical: dict[str, list[str]]
    order: list[str]
    standardize: bool

    @property
    def names(self) -> list[str]:
        out = []
        for c in self.order:
            out += [c] if c in self.numeric else [f"{c}__{v}" for v in self.categorical[c][1:]] + [f"{c}__unknown", f"{c}__missing"]
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Encoder:
        d = json.loads(text)
        return Encoder({k: tuple(v) for k, v in d["numeric"].items()}, d["categorical"], d["order"], d["standardize"])


def fit_encoder(df: DataFrame, features: list[str], categorical: list[str] = (), standardize: bool = False) -> Encoder:
    """Declared or non-numeric features are categorical. Numeric ones are imputed by the median; mean and (population) sd
    are those of the imputed column. Levels are sorted as text."""
    require_columns(df, features)
    kinds = dict(df.dtypes)
    cats = [f for f in features if f in categorical or not is_number(kinds[f])]
    nums = [f for f in features if f not in cats]
    aggs = []
    for i, f in enumerate(nums):
        x = finite(F.col(f"`{f}`"))
        aggs += [F.percentile(x, F.lit(0.5)).alias(f"m{i}"), F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.var_pop(x).alias(f"v{i}")]
    aggs += [F.slice(F.sort_array(F.collect_set(F.col(f"`{f}`").cast("string"))), 1, MAX_LEVELS + 1).alias(f"c{i}") for i, f in enumerate(cats)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    numeric = {}
    for i, f in enumerate(nums):
        med, k = r[f"m{i}"], r[f"n{i}"]
        med = 0.0 if med is None else med
        a, v, gap = r[f"a{i}"] or 0.0, r[f"v{i}"] or 0.0, r.n - k
        mean = (k * a + gap * med) / max(r.n, 1)
        var = (k * (v + (a - mean) ** 2) + gap * (med - mean) ** 2) / max(r.n, 1)
        numeric[f] = (float(med), float(mean), float(np.sqrt(var)) or 1.0)
    levels = {f: r[f"c{i}"] for i, f in enumerate(cats)}
    for f, v in levels.items():
        if len(v) > MAX_LEVELS:
            raise UserInputError(f'"{f}" has more than {MAX_LEVELS} levels')
        if not v:
            levels[f] = []
    return Encoder(numeric, levels, list(features), standardize)


def columns(encoder: Encoder) -> list[Column]:
    out = []
    for f in encoder.order:
        if f in encoder.numeric:
            med, mean, sd = encoder.numeric[f]
            x = F.coalesce(finite(F.col(f"`{f}`")), F.lit(med))
            out.append(((x - mean) / sd if encoder.standardize else x).alias(f))
            continue
        v, levels = F.col(f"`{f}`").cast("string"), encoder.categorical[f]
        flag = lambda c, name: F.when(c, 1.0).otherwise(0.0).alias(name)
        out += [flag(v == x, f"{f}__{x}") for x in levels[1:]]
        out += [flag(v.isNotNull() & ~(v.isin(levels) if levels else F.lit(False)), f"{f}__unknown"), flag(v.isNull(), f"{f}__missing")]
    return out


def encode(df: DataFrame, encoder: Encoder, keep: list[str] = ()) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in keep], *columns(encoder))


def varying(df: DataFrame, names: list[str]) -> list[str]:
    """The columns that aren't constant, by one aggregation."""
    r = df.agg(*[(F.min(f"`{c}`") < F.max(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if r[f"v{i}"]]


def gram(df: DataFrame, names: list[str]) -> np.ndarray:
    """Moments of (1, names): sums of products by one aggregation."""
    cols = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in names]]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1)]
    r = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(cols), len(cols)))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = r[f"g{k}"] or 0.0
    return out


def full_rank(df: DataFrame, names: list[str], tolerance: float = 1e-10) -> list[str]:
    """The columns that are independent of those before them (and of a constant): Cholesky of the centred moments."""
    if not names:
        return []
    g = gram(df, names)
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0]
    scale = np.sqrt(np.maximum(np.diag(c), 0))
    keep: list[int] = []
    for j in range(len(names)):
        if scale[j] <= 0:
            continue
        a = c[np.ix_(keep, keep)] / np.outer(scale[keep], scale[keep])
        b = c[keep, j] / (scale[keep] * scale[j])
        rest = 1 - (b @ np.linalg.solve(a, b) if keep else 0)
        if rest > tolerance:
            keep.append(j)
    return [names[j] for j in keep]


def condition_number(df: DataFrame, names: list[str]) -> float:
    """Of the standardised design, from the eigenvalues of its correlations; infinite for a constant column. Beyond 1e8 only its order of magnitude is meant."""
    g = gram(df, names)
    c = g[1:, 1:] / g[0, 0] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] ** 2
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    if not (sd > 0).all():
        return float("inf")
    values = np.linalg.eigvalsh(c / np.outer(sd, sd))
    return float(np.sqrt(values[-1] / values[0])) if values[0] > 1e-16 else float("inf")
