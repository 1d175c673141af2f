"""Weighted log-rank tests from the time grid.

The observed minus expected vector and its hypergeometric covariance are sums over distinct times, so one
aggregation of the grid gives them; only the (k - 1) x (k - 1) solve is done on the driver.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import UserInputError
from ..functions.levels import ordered_levels
from ..functions.stats import bh_adjust, chi2_upper
from .timegrid import grid, kept, like, running, survival

WEIGHTS = ("logrank", "gehan_breslow", "tarone_ware", "fleming_harrington")


def weight_column(kind: str, n: Column, before: Column, fh_p: float) -> Column:
    if kind not in WEIGHTS:
        raise UserInputError(f"unknown weight {kind}; one of {', '.join(WEIGHTS)}")
    if kind == "fleming_harrington" and not 0 <= fh_p <= 5:
        raise UserInputError("fh_p must be between 0 and 5")
    return {"logrank": F.lit(1.0), "gehan_breslow": n.cast("double"), "tarone_ware": F.sqrt(n.cast("double")), "fleming_harrington": F.pow(before, F.lit(float(fh_p)))}[kind]


def pooled(g: DataFrame, keys: list[str]) -> DataFrame:
    """The pooled curve per distinct time of a grid by groups: time, n, d, surv_before; of each pair, if there is such a key."""
    whole = g.groupBy(*keys, "time").agg(F.sum("d").alias("d"), F.sum("c").alias("c"))
    whole._most_times = g._rows
    s = survival(whole, keys)
    return like(s, s.select(*keys, "time", F.col("n").alias("tn"), F.col("d").alias("td"), "surv_before"))


def score_terms(cohort: DataFrame, group: str, kind: str = "logrank", fh_p: float = 1.0, pair: str | None = None) -> DataFrame:
    """For each event time and group the rows at risk and the weight: pair, time, group, n, d, tn, td, w.

    A group's risk set at a time when it has no row is that of its next own time, taken by running sums over
    the union of the group's grid with all event times.
    """
    keys = [pair] if pair else []
    g = kept(grid(cohort, [*keys, group]), [*keys, group])
    every = pooled(g, keys)
    times = like(every, every.filter(F.col("td") > 0))
    labels = g.select(*keys, group).distinct()
    # the few groups go to the times, whose number has no bound
    slots = times.join(F.broadcast(labels), keys) if keys else times.crossJoin(F.broadcast(labels))
    full = like(times, slots.join(g, [*keys, group, "time"], "full"))
    full = running(full, [*keys, group], {"n": F.coalesce("c", F.lit(0))}, back=True).filter(F.col("td").isNotNull())
    return full.select(*keys, group, "time", "n", F.coalesce("d", F.lit(0)).alias("d"), "tn", "td", weight_column(kind, F.col("tn"), F.col("surv_before"), fh_p).alias("w"))


def logrank(cohort: DataFrame, group: str, kind: str = "logrank", fh_p: float = 1.0) -> dict:
    """{'test', 'chisq', 'df', 'p_value'} over all groups of the cohort."""
    terms = score_terms(cohort, group, kind, fh_p)
    share = F.col("n") / F.col("tn")
    spread = F.when(F.col("tn") > 1, F.col("w") ** 2 * F.col("td") * (F.col("tn") - F.col("td")) / (F.col("tn") - 1)).otherwise(0.0)
    one = terms.select(F.col(group).alias("a"), "time", "w", share.alias("pa"), spread.alias("v"), (F.col("w") * (F.col("d") - F.col("td") * share)).alias("u"))
    # one row a time with its groups, which are few; so the terms are computed once for the vector and its covariance
    each = one.groupBy("time").agg(F.first("v").alias("v"), F.collect_list(F.struct("a", "pa", "u")).alias("x"))
    two = each.select("v", "x", F.explode("x").alias("l")).select("v", "l", F.explode("x").alias("r"))
    same = F.col("l.a") == F.col("r.a")
    share_of_both = F.col("v") * F.col("l.pa") * (F.when(same, 1.0).otherwise(0.0) - F.col("r.pa"))
    sums = two.groupBy(F.col("l.a").alias("a"), F.col("r.a").alias("b")).agg(F.sum(share_of_both).alias("v"), F.sum(F.when(same, F.col("l.u"))).alias("u")).collect()
    u, v = {r.a: r.u for r in sums if r.a == r.b}, {(r.a, r.b): r.v for r in sums}
    return {"test": kind, **chi_square(u, v)}


def chi_square(u: dict, v: dict) -> dict:
    labels = sorted(u, key=str)[1:]
    vec = np.array([u[a] for a in labels])
    mat = np.array([[v[a, b] for b in labels] for a in labels])
    stat = float(vec @ np.linalg.lstsq(mat, vec, rcond=None)[0]) if len(labels) else 0.0
    return {"chisq": stat, "df": len(labels), "p_value": chi2_upper(stat, len(labels)) if labels else None}


def two_group_statistics(cohort: DataFrame, group: str, kind: str = "logrank", fh_p: float = 1.0, pair: str | None = None) -> DataFrame:
    """chisq = (observed - expected)^2 / variance of the first group by name, of every pair."""
    keys = [pair] if pair else []
    terms = score_terms(cohort, group, kind, fh_p, pair)
    first = terms.withColumn("_first", F.min(group).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1)))).filter(F.col(group) == F.col("_first"))
    share = F.col("n") / F.col("tn")
    spread = F.when(F.col("tn") > 1, F.col("w") ** 2 * F.col("td") * share * (1 - share) * (F.col("tn") - F.col("td")) / (F.col("tn") - 1)).otherwise(0.0)
    sums = first.groupBy(*keys).agg(F.sum(F.col("w") * (F.col("d") - F.col("td") * share)).alias("u"), F.sum(spread).alias("v"), F.sum("d").alias("observed"), F.sum(F.col("td") * share).alias("expected"))
    return sums.select(*keys, "observed", "expected", (F.col("u") ** 2 / F.col("v")).alias("chisq"))


#: Groups that are compared pair by pair.
MAX_GROUPS = 200


def pairwise(cohort: DataFrame, group: str, kind: str = "logrank", fh_p: float = 1.0) -> list[dict]:
    """Every pair of groups on its own two-group subset, in one plan, with adjusted p-values. Pairs grow with the square of
    the groups, so more than MAX_GROUPS are refused."""
    labels = ordered_levels(group, [r[0] for r in cohort.select(group).distinct().limit(MAX_GROUPS + 2).collect()])
    if len(labels) > MAX_GROUPS:
        raise UserInputError(f'"{group}" has more than {MAX_GROUPS} groups to compare in pairs')
    pairs = list(combinations(labels, 2))
    if not pairs:
        return []
    named = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(pairs)])
    mine = F.filter(named, lambda x: (x["a"] == F.col(group).cast("string")) | (x["b"] == F.col(group).cast("string")))
    rows = cohort.select(group, "time", "event", F.explode(mine).alias("x")).select(F.col("x.pair").alias("pair"), group, "time", "event")
    stats = {r.pair: r.chisq for r in two_group_statistics(rows, group, kind, fh_p, "pair").collect()}
    # a pair without any event has no statistic
    out = [{"comparison": f"{a} vs {b}", "chisq": x, "p_value": None if x is None else chi2_upper(x, 1), "p_adjusted": None} for (a, b), x in zip(pairs, map(stats.get, range(len(pairs))), strict=True)]
    known = [row for row in out if row["p_value"] is not None]
    for row, p in zip(known, bh_adjust([r["p_value"] for r in known]), strict=True):
        row["p_adjusted"] = p
    return out


def bh_column(df: DataFrame, p: str, out: str = "p_adjusted", keys: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg over a column; null and NaN p-values don't count and stay null. For bounded tables of tests."""
    part = [*(F.col(k) for k in keys or []), (F.col(p).isNull() | F.isnan(p)).alias("_none")]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(p))
    m = F.count(F.lit(1)).over(Window.partitionBy(*part))
    raw = df.withColumns({"_r": rank, "_m": m}).withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    low = F.min("_q").over(Window.partitionBy(*part).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn(out, F.when(F.col(p).isNotNull() & ~F.isnan(p), F.least(low, F.lit(1.0)))).drop("_r", "_m", "_q")
