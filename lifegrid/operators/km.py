"""Kaplan-Meier estimates per group, as tidy tables from one time grid."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import UserInputError
from ..functions.stats import normal_quantile, normal_two_sided
from .timegrid import grid, like, running, survival

MAX_GROUPS = 50


def loglog_interval(surv: Column, gw: Column, z: float) -> tuple[Column, Column]:
    """Log-log limits: (0, 0) at 0, the estimate itself at 1 and where the standard error is not positive."""
    log_s = F.log(surv)
    theta = F.log(-log_s)
    half = z * F.sqrt(gw) / F.abs(log_s)
    flat = (surv >= 1 - 1e-12) | gw.isNull() | (gw <= 0)

    def limit(sign: int) -> Column:
        return F.when(surv <= 0, 0.0).when(flat, surv).otherwise(F.exp(-F.exp(theta + sign * half)))

    return limit(1), limit(-1)


def curve(cohort: DataFrame, groups: list[str], confidence: float = 0.95) -> DataFrame:
    """groups, time, n_risk, n_event, survival, std_error, ci_lower, ci_upper at the event times of each group."""
    s = survival(grid(cohort, groups), groups).filter(F.col("d") > 0)
    low, high = loglog_interval(F.col("surv"), F.col("gw"), normal_quantile(0.5 + confidence / 2))
    return s.select(*groups, "time", F.col("n").alias("n_risk"), F.col("d").alias("n_event"), F.col("surv").alias("survival"), (F.col("surv") * F.sqrt("gw")).alias("std_error"), low.alias("ci_lower"), high.alias("ci_upper"))


def step_curve(cohort: DataFrame, groups: list[str], horizon: float, confidence: float = 0.95) -> DataFrame:
    """The drawn curve: from (0, 1) on, flat to the horizon where the last event comes before it."""
    c = curve(cohort, groups, confidence).select(*groups, "time", "survival", "ci_lower", "ci_upper")
    ends = cohort.select(*groups).distinct() if groups else cohort.sparkSession.range(1).select()
    first = ends.select(*groups, F.lit(0.0).alias("time"), F.lit(1.0).alias("survival"), F.lit(1.0).alias("ci_lower"), F.lit(1.0).alias("ci_upper"))
    both = first.unionByName(c)
    last = both.groupBy(*groups).agg(F.max_by(F.struct("survival", "ci_lower", "ci_upper"), "time").alias("e"), F.max("time").alias("t")).filter(F.col("t") < horizon)
    return both.unionByName(last.select(*groups, F.lit(float(horizon)).alias("time"), "e.survival", "e.ci_lower", "e.ci_upper"))


def summary(cohort: DataFrame, groups: list[str], confidence: float = 0.95) -> DataFrame:
    """groups, n, events, censored, median and its log-log limits. The median is the first event time with survival below
    one half, null if never; its limits are the least and greatest times whose log-log statistic is within z."""
    return summary_of(grid(cohort, groups), groups, confidence)


def summary_of(g: DataFrame, groups: list[str], confidence: float = 0.95) -> DataFrame:
    """``summary`` of a time grid."""
    z = normal_quantile(0.5 + confidence / 2)
    s = survival(g, groups)
    events = F.col("d") > 0
    g0 = math.log(-math.log(0.5))
    inner = (F.col("surv") > 0) & (F.col("surv") < 1) & (F.col("gw") > 0)
    stat = F.abs(F.log(-F.log("surv")) - g0) * F.abs(F.log("surv")) / F.sqrt("gw")
    near = events & inner & (stat <= z)
    out = s.groupBy(*groups).agg(
        F.sum("c").alias("n"), F.sum("d").alias("events"), F.sum(F.col("c") - F.col("d")).alias("censored"), F.max("time").alias("time_max"),
        F.min(F.when(events & (F.col("surv") < 0.5 - 1e-12), F.col("time"))).alias("median"), F.min(F.when(near, F.col("time"))).alias("median_lower"), F.max(F.when(near, F.col("time"))).alias("_last"),
    )
    # the upper limit is the first event time behind the last one that is near
    last = out.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_last").alias("_near"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    behind = s.filter(events).join(F.broadcast(last) if not groups else last, same).filter(F.col("time") > F.col("_near"))
    upper = behind.groupBy(*[F.col(f"_of_{g}") for g in groups]).agg(F.min("time").alias("median_upper"))
    both = out.join(upper, same, "left") if groups else out.crossJoin(F.broadcast(upper))  # without groups, one row with one row
    return both.select(*groups, "n", "events", "censored", "time_max", "median", "median_lower", "median_upper")


def median_follow_up(cohort: DataFrame, groups: list[str]) -> DataFrame:
    """The median of the reverse estimate, with censoring as the event; null if nothing is censored."""
    flipped = cohort.select(*groups, "time", (1 - F.col("event")).alias("event"))
    return summary(flipped, groups).select(*groups, F.col("median").alias("median_follow_up"))


def risk_table(cohort: DataFrame, groups: list[str], ticks: list[float]) -> DataFrame:
    """groups, tick, n_at_risk: one conditional sum a tick, then unpivoted."""
    sums = cohort.groupBy(*groups).agg(*[F.sum((F.col("time") >= t).cast("long")).alias(f"t{i}") for i, t in enumerate(ticks)])
    points = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tick"), F.col(f"t{i}").alias("n_at_risk")) for i, t in enumerate(ticks)]))
    return sums.select(*groups, points.alias("p")).select(*groups, "p.tick", "p.n_at_risk")


def risk_ticks(horizon: float, points: int = 6) -> list[float]:
    if not 4 <= points <= 12:
        raise UserInputError("the risk table has 4 to 12 points")
    return [round(horizon * i / (points - 1), 2) for i in range(points)]


def censor_marks(cohort: DataFrame, groups: list[str]) -> DataFrame:
    """groups, time, n_censored, survival just after each time with censored rows (events at that time included)."""
    s = survival(grid(cohort, groups), groups)
    return s.filter(F.col("c") > F.col("d")).select(*groups, "time", (F.col("c") - F.col("d")).alias("n_censored"), F.col("surv").alias("survival"))


def rmst(cohort: DataFrame, groups: list[str], horizon: float, confidence: float = 0.95) -> DataFrame:
    """groups, rmst, variance, se, ci_lower, ci_upper of the area under each curve up to horizon.

    variance = sum over event times t of (area from t on)^2 d / (n (n - d)); null where a risk set is exhausted
    before the horizon, and then se and limits are null for every group. Limits are kept within [0, horizon].
    """
    return rmst_of(grid(cohort, groups), groups, horizon, confidence)


def rmst_of(g: DataFrame, groups: list[str], horizon: float, confidence: float = 0.95) -> DataFrame:
    """``rmst`` of a time grid."""
    tau = F.lit(float(horizon))
    # only event times before the horizon change the curve within it
    s = survival(g, groups)
    every = s.select(*groups).distinct() if groups else None
    s = like(s, s.filter((F.col("d") > 0) & (F.col("time") <= tau)))
    # the area from t on is (tau - t) surv(t) less (tau - u) times the drop at each later u
    drop = (tau - F.col("time")) * (F.col("surv_before") - F.col("surv"))
    s = running(s, groups, {"_drops": drop}, back=True)
    tail = (tau - F.col("time")) * F.col("surv") - (F.col("_drops") - drop)
    term = F.when(F.col("n") > F.col("d"), F.pow(tail, F.lit(2.0)) * F.col("d") / (F.col("n").cast("double") * (F.col("n") - F.col("d"))))
    est = s.groupBy(*groups).agg((tau - F.sum(drop)).alias("rmst"), F.when(F.min(F.col("n") - F.col("d")) > 0, F.sum(term)).alias("variance"))
    if every is not None:  # a group without events before the horizon keeps the whole area, without variance 0
        est = every.join(est, groups, "left").withColumns({"variance": F.when(F.col("rmst").isNull(), 0.0).otherwise(F.col("variance")), "rmst": F.coalesce("rmst", tau)})
    hole = F.max(F.col("variance").isNull().cast("int")).over(Window.partitionBy(F.lit(1)))
    z = normal_quantile(0.5 + confidence / 2)
    est = est.withColumn("se", F.when(hole == 0, F.sqrt("variance")))
    keep = lambda c: F.greatest(F.lit(0.0), F.least(tau, c))
    return est.select(*groups, "rmst", "variance", "se", F.when(F.col("se").isNotNull(), keep(F.col("rmst") - z * F.col("se"))).alias("ci_lower"), F.when(F.col("se").isNotNull(), keep(F.col("rmst") + z * F.col("se"))).alias("ci_upper"))


def rmst_contrast(rows: list[dict], label: str, horizon: float, confidence: float = 0.95, outcome_informed: bool = False) -> dict | None:
    """First group minus second, from the two rows of ``rmst`` in label order; None unless there are two."""
    if len(rows) != 2:
        return None
    a, b = rows
    out = {"comparison": f"{a[label]} minus {b[label]}", "estimate": a["rmst"] - b["rmst"], "se": None, "z_statistic": None, "p_value": None, "ci_lower": None, "ci_upper": None, "horizon": horizon}
    if a["variance"] is None or b["variance"] is None:
        return out
    se, z = math.sqrt(a["variance"] + b["variance"]), normal_quantile(0.5 + confidence / 2)
    out |= {"se": se, "ci_lower": out["estimate"] - z * se, "ci_upper": out["estimate"] + z * se}
    if not outcome_informed:
        if se > 0:
            out |= {"z_statistic": out["estimate"] / se, "p_value": normal_two_sided(out["estimate"] / se)}
        elif out["estimate"] == 0:
            out |= {"z_statistic": 0.0, "p_value": 1.0}
    return out


@dataclass(frozen=True)
class KMResult:
    """The tables of one analysis; all but the small dictionaries stay DataFrames."""

    curve: DataFrame
    summary: DataFrame
    risk: DataFrame
    rmst: DataFrame
    contrast: dict | None
    test: dict | None
    pairwise: list[dict]
    display_horizon: float
    rmst_horizon: float


def analyse(cohort: DataFrame, group: str | None = None, confidence: float = 0.95, max_time: float | None = None, points: int = 6, weight: str = "logrank", fh_p: float = 1.0, outcome_informed: bool = False) -> KMResult:
    """The whole Kaplan-Meier request on a cohort of time, event and maybe a group column.

    The area is taken up to the horizon or the smallest group maximum, whichever is less. More than 50 groups are refused; no tests for
    groups that were derived from the outcome.
    """
    from .logrank import logrank, pairwise

    if not 0.5 < confidence < 0.999:
        raise UserInputError("confidence must be between 0.5 and 0.999")
    groups = [group] if group else []
    ends = [r["t"] for r in cohort.groupBy(*groups).agg(F.max("time").alias("t")).limit(MAX_GROUPS + 1).collect()]
    if len(ends) > MAX_GROUPS:
        raise UserInputError(f"more than {MAX_GROUPS} groups")
    if not ends or ends[0] is None:
        raise UserInputError("no analyzable rows")
    shown = float(max_time or max(ends))
    tau = max(min(shown, min(ends)), 1e-6)
    areas = rmst(cohort, groups, tau, confidence)
    contrast = test = None
    pairs: list[dict] = []
    if group and len(ends) >= 2:
        if len(ends) == 2:
            from ..functions.levels import level_key

            rows = sorted((r.asDict() for r in areas.collect()), key=lambda r: level_key(group, r[group]))
            contrast = rmst_contrast(rows, group, tau, confidence, outcome_informed)
        if not outcome_informed:
            test, pairs = logrank(cohort, group, weight, fh_p), pairwise(cohort, group, weight, fh_p)
    return KMResult(step_curve(cohort, groups, shown, confidence), summary(cohort, groups, confidence), risk_table(cohort, groups, risk_ticks(shown, points)), areas, contrast, test, pairs, shown, tau)
