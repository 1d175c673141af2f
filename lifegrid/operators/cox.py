"""Cox proportional hazards with Efron ties by a distributed Newton method.

The rows are sorted over partitions once; each step adds up the partitions' shares of score and information (see ``likelihood``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import UserInputError
from ..functions.levels import ordered_levels
from ..functions.stats import chi2_upper, fisher_combined, normal_quantile, normal_two_sided, student_two_sided
from ..scratch import written
from .likelihood import Sorted
from .timegrid import beside, by, kept, like, range_cuts, range_number, running

STAGE_COLUMNS = {"stage", "stage_group", "pathologic_stage"}


@dataclass(frozen=True)
class CoxFit:
    """beta of names on the covariates' own scale, covariance, likelihoods and how the iteration ended."""

    names: list[str]
    strata: list[str]
    beta: np.ndarray
    cov: np.ndarray
    loglik: float
    null_loglik: float
    iterations: int
    n: int
    events: int
    center: np.ndarray

    def linear(self) -> Column:
        out = F.lit(0.0)
        for c, b in zip(self.names, self.beta, strict=True):
            out = out + F.lit(float(b)) * F.col(f"`{c}`")
        return out

    def table(self, confidence: float = 0.95) -> list[dict]:
        z = normal_quantile(0.5 + confidence / 2)
        rows = []
        for c, b, v in zip(self.names, self.beta.tolist(), np.diag(self.cov).tolist(), strict=True):
            se = math.sqrt(v)
            safe = lambda x: math.exp(x) if -708 < x < 709 else None
            rows.append({"term": c, "beta": b, "hazard_ratio": safe(b), "ci_lower": safe(b - z * se), "ci_upper": safe(b + z * se), "std_error": se, "z": b / se if se else None, "p_value": normal_two_sided(b / se) if se else None})
        return rows

    def statistics(self) -> dict:
        k, lr = len(self.names), max(0.0, 2 * (self.loglik - self.null_loglik))
        return {"loglik": self.loglik, "null_loglik": self.null_loglik, "lr_chisq": lr, "lr_p": chi2_upper(lr, k), "aic": 2 * k - 2 * self.loglik, "bic": k * math.log(self.n) - 2 * self.loglik, "events_per_variable": self.events / k, "n": self.n, "events": self.events, "iterations": self.iterations}


#: Levels of a categorical covariate; each but one is a column of the fit. More are refused, none is left out.
MAX_LEVELS = 1_000


def design(df: DataFrame, covariates: list[str], categorical: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Dummy columns of categorical covariates against their reference level; other covariates as they are."""
    check_covariates(covariates)
    out, names = df, []
    kinds = dict(df.dtypes)
    for c in covariates:
        if c not in categorical and kinds[c] != "string":
            names.append(c)
            continue
        levels = ordered_levels(c, [r[0] for r in df.select(f"`{c}`").dropna().distinct().limit(MAX_LEVELS + 1).collect()])
        if len(levels) > MAX_LEVELS:
            raise UserInputError(f'"{c}" has more than {MAX_LEVELS} levels; its dummy columns would be more than a fit can hold')
        if len(levels) < 2:
            raise UserInputError(f'"{c}" is constant')
        for v in levels[1:]:
            names.append(f"{c}[{v}]")
            out = out.withColumn(names[-1], (F.col(f"`{c}`").cast("string") == v).cast("double"))
    return out, names


def check_covariates(covariates: list[str]) -> None:
    stages = [c for c in covariates if c.lower() in STAGE_COLUMNS]
    if len(stages) > 1:
        raise UserInputError("These covariates overlap: " + ", ".join(stages))


def evaluate(df: DataFrame, names: list[str], beta: np.ndarray, strata: list[str] = (), cells: int | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information of Efron's partial likelihood at beta, on the covariates' own scale."""
    rows = Sorted(df, [F.col(f"`{c}`") for c in names], list(strata), df.count(), cells)
    try:
        return rows.evaluate(np.asarray(beta, float))
    finally:
        rows.release()


def fit(df: DataFrame, names: list[str], strata: list[str] = (), max_iter: int = 30, tol: float = 1e-9, cells: int | None = None) -> CoxFit:
    """Fits numeric columns; df has time, event and the strata. Constant columns and a singular information are refused.

    Any number of distinct times will do: no grid of times is made (see ``likelihood``). cells bounds the numbers that a task holds.
    """
    strata = list(strata)
    if set(strata) & set(names):
        raise UserInputError("a column can't be both a covariate and a stratum")
    if not names:
        raise UserInputError("choose at least one covariate")
    keep = ["_row_id"] if "_row_id" in df.columns and "_row_id" not in (*names, *strata) else []
    slim = df.select(*keep, *[F.col(f"`{s}`") for s in strata], "time", "event", *[F.col(f"`{c}`").cast("double").alias(c) for c in names]).persist()  # read for the moments and for the sort
    try:
        return fit_rows(slim, names, strata, max_iter, tol, cells)
    finally:
        slim.unpersist()


def fit_rows(df: DataFrame, names: list[str], strata: list[str], max_iter: int, tol: float, cells: int | None) -> CoxFit:
    cols, p = [F.col(f"`{c}`") for c in names], len(names)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    if not r.e:
        raise UserInputError("The cohort has no events.")
    flat = [c for i, c in enumerate(names) if not r[f"s{i}"]]
    if flat:
        raise UserInputError("These covariates are constant: " + ", ".join(flat))
    center, scale = np.array([r[f"m{i}"] for i in range(p)]), np.array([r[f"s{i}"] for i in range(p)])
    rows = Sorted(df, [(c - float(m)) / float(s) for c, m, s in zip(cols, center, scale, strict=True)], strata, int(r.n), cells)
    try:
        beta, info, loglik, null, steps = newton(rows, max_iter, tol)
    finally:
        rows.release()
    return CoxFit(list(names), strata, beta / scale, np.linalg.inv(info) / np.outer(scale, scale), loglik, null, steps, int(r.n), int(r.e), center)


def newton(rows: Sorted, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """The steps of fit, each half as long as long as it overshoots: beta, information, log likelihood, that of beta 0, steps.

    Once the likelihood is flat, one more step takes beta to full precision, as steps converge with the square.
    """
    beta, step, last, null, flat = np.zeros(rows.p), np.zeros(rows.p), -math.inf, 0.0, False
    for it in range(1, max_iter + 1):
        loglik, score, info = rows.evaluate(beta)
        if it == 1:
            null = loglik
        if not math.isfinite(loglik) or loglik < last - 1e-9 * abs(last):  # overshot: half the step
            step = step / 2
            beta = beta - step
            continue
        if not np.isfinite(info).all() or np.linalg.cond(info) > 1e12:
            raise UserInputError("The model can't be estimated: covariates are collinear or separate the events.")
        was, flat = flat, it > 1 and abs(loglik - last) <= tol * (1 + abs(loglik))
        last, step = loglik, np.linalg.solve(info, score)
        if flat and (was or score @ step < 1e-18):
            return beta, info, loglik, null, it
        beta = beta + step
        if np.abs(beta).max() > 50:
            raise UserInputError("The model did not converge: a covariate separates the events.")
    raise UserInputError("The model did not converge.")


def baseline_hazard(df: DataFrame, fitted: CoxFit) -> DataFrame:
    """Breslow's baseline: strata, time, s0, d, mean of each covariate in the risk set, hazard and cumulative hazard at
    covariates of zero."""
    names, strata = fitted.names, fitted.strata
    w = F.exp(fitted.linear())
    rows = df.select(*strata, "time", "event", w.alias("w"), *[(w * F.col(f"`{c}`")).alias(f"wx{i}") for i, c in enumerate(names)])
    g = rows.groupBy(*strata, "time").agg(F.sum("event").cast("long").alias("d"), F.sum("w").alias("w"), *[F.sum(f"wx{i}").alias(f"wx{i}") for i in range(len(names))])
    xs = [f"xbar{i}" for i in range(len(names))]
    g = running(kept(g, strata), strata, {"s0": F.col("w"), **{x: F.col(f"wx{i}") for i, x in enumerate(xs)}}, back=True)
    g = like(g, g.withColumns({"hazard": F.col("d") / F.col("s0"), **{x: F.col(x) / F.col("s0") for x in xs}}))
    g = running(g, strata, {"cumulative_hazard": F.col("hazard")})
    return like(g, g.select(*strata, "time", "d", "s0", *xs, "hazard", "cumulative_hazard"))


def martingale_residuals(df: DataFrame, fitted: CoxFit) -> DataFrame:
    """df with residual = event - cumulative hazard at its time * exp(x b); every row's time is on the grid."""
    base = baseline_hazard(df, fitted)
    base = like(base, base.select(*fitted.strata, "time", "cumulative_hazard"))
    return df.join(beside(base), [*fitted.strata, "time"]).withColumn("residual", F.col("event") - F.col("cumulative_hazard") * F.exp(fitted.linear())).drop("cumulative_hazard")


def schoenfeld(df: DataFrame, fitted: CoxFit) -> DataFrame:
    """Event rows with scaled residuals r0.. = number of events * covariance * (x - risk set mean)."""
    return residuals(df, fitted, baseline_hazard(df, fitted), ["_row_id", "time"])


def residuals(df: DataFrame, fitted: CoxFit, base: DataFrame, keep: list[str]) -> DataFrame:
    ev = df.filter(F.col("event") == 1).join(beside(base), [*fitted.strata, "time"])
    raw = [F.col(f"`{c}`") - F.col(f"xbar{i}") for i, c in enumerate(fitted.names)]
    scaled = []
    for i in range(len(raw)):
        s = F.lit(0.0)
        for j, x in enumerate(raw):
            s = s + float(fitted.cov[i, j] * fitted.events) * x
        scaled.append(s.alias(f"r{i}"))
    return ev.select(*keep, *scaled)


def average_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """df plus rank, the average rank of the row's v among those of its keys, from counts of ranges (part) and places within
    a range; no task holds more than a range. An odd range has one value, so its rows share a rank and aren't brought together."""
    sizes = df.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select(*keys, "part", "size", (F.sum("size").over(by(keys).orderBy("part")) - F.col("size")).alias("start"))
    # at most 2 * MAX_RANGES rows a key
    x, odd = df.join(F.broadcast(starts), [*keys, "part"]), F.col("part") % 2 == 1
    order = Window.partitionBy(*keys, "part").orderBy("v")
    upto = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = x.filter(~odd).withColumn("rank", F.col("start") + (F.rank().over(order) + upto) / 2.0)
    return inside.unionByName(x.filter(odd).withColumn("rank", F.col("start") + (F.col("size") + 1) / 2.0)).drop("size", "start")


def time_ranks(base: DataFrame, strata: list[str]) -> DataFrame:
    """time and rt, the average rank of an event at that time among all events, from the grid of ``baseline_hazard``."""
    d = base.filter(F.col("d") > 0)
    for s in strata:
        d = d.filter(F.col(f"`{s}`").isNotNull())
    g = running(kept(d.groupBy("time").agg(F.sum("d").alias("d")), []), [], {"upto": F.col("d")})
    return like(g, g.select("time", (F.col("upto") - (F.col("d") - 1) / 2.0).alias("rt")))


def ph_tests(df: DataFrame, fitted: CoxFit) -> dict:
    """Spearman's correlation of scaled residuals with time for each term (at least 4 events), and Fisher's combination. Times
    are ranked on their grid, the residuals of all terms together."""
    terms = range(len(fitted.names))
    slim = written(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*fitted.strata, "time", "event", *fitted.names])]))
    base = baseline_hazard(slim, fitted)
    base = like(base, base.join(beside(time_ranks(base, fitted.strata)), "time"))
    res = residuals(slim, fitted, base, ["rt"]).select("rt", *[F.round(f"r{i}", 12).alias(f"r{i}") for i in terms]).persist()
    cuts = range_cuts(res, [f"r{i}" for i in terms], fitted.events)
    parts = res.select("rt", *[range_number(F.col(f"r{i}"), cuts[i]).alias(f"p{i}") for i in terms], *[f"r{i}" for i in terms])
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("term"), F.col(f"p{i}").alias("part"), F.col(f"r{i}").alias("v")) for i in terms])).alias("x")
    both = average_ranks(parts.select("rt", x).select("rt", "x.*").filter(F.col("v").isNotNull()), ["term"]).withColumnRenamed("rank", "rr")
    found = {r.term: r for r in both.groupBy("term").agg(F.corr("rt", "rr").alias("rho"), F.count(F.lit(1)).alias("n"), F.min("rr").alias("lo"), F.max("rr").alias("hi")).collect()}
    res.unpersist()
    rows = []
    for i, c in enumerate(fitted.names):
        s = found.get(i)
        if s is None or s.n < 4 or s.rho is None or s.lo == s.hi:
            rows.append({"term": c, "rho": None, "p_value": None})
            continue
        rho = max(-1.0, min(1.0, s.rho))
        rows.append({"term": c, "rho": rho, "p_value": 0.0 if abs(rho) == 1 else student_two_sided(rho * math.sqrt((s.n - 2) / (1 - rho * rho)), s.n - 2)})
    combined = fisher_combined([r["p_value"] for r in rows if r["p_value"] is not None])
    return {"terms": rows, "global": None if combined is None else {"chisq": combined[0], "p_value": combined[1]}}


def stability(df: DataFrame, names: list[str], strata: list[str] = ()) -> dict:
    """Constant columns, dummies with events on one side only, levels under 5 rows, events per variable."""
    x = [F.col(f"`{c}`") for c in names]
    aggs = [F.sum("event").alias("e"), F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(x):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.sum((c == 1).cast("long")).alias(f"k{i}"), F.sum(((c == 1) & (F.col("event") == 1)).cast("long")).alias(f"e{i}"), F.sum((~c.isin(0.0, 1.0)).cast("long")).alias(f"o{i}")]
    r = df.agg(*aggs).first()
    dummy = [i for i in range(len(names)) if not r[f"o{i}"]]
    out = {
        "constant": [c for i, c in enumerate(names) if r[f"lo{i}"] == r[f"hi{i}"]],
        "one_sided": [names[i] for i in dummy if 0 < r[f"k{i}"] < r.n and (r[f"e{i}"] in (0, r[f"k{i}"]) or r.e - r[f"e{i}"] in (0, r.n - r[f"k{i}"]))],
        "small_levels": [names[i] for i in dummy if min(r[f"k{i}"], r.n - r[f"k{i}"]) < 5],
        "events_per_variable": r.e / max(1, len(names)),
    }
    if strata:
        s = df.groupBy(*strata).agg(F.sum("event").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e") == 0).cast("long")).alias("zero"), F.sum((F.col("e") == 1).cast("long")).alias("one")).first()
        out |= {"strata": s.n, "strata_without_events": s.zero or 0, "strata_with_one_event": s.one or 0}
    return out


#: Condition number of the standardised design from which a caution is given.
MAX_CONDITION = 30.0


def narrative(table: list[dict], stats: dict, ph: dict, stable: dict) -> dict:
    """A status and its reasons, from the bounded results."""
    cautions = [f"{c} has events on one side only" for c in stable["one_sided"]] + [f"{c} has a level under 5 rows" for c in stable["small_levels"]]
    epv = stats["events_per_variable"]
    if epv < 10:
        cautions.append(f"{epv:.1f} events per variable" + (" is very low" if epv < 5 else " is low"))
    cautions += [f"the hazard of {r['term']} seems to change over time (p = {r['p_value']:.3g})" for r in ph["terms"] if r["p_value"] is not None and r["p_value"] < 0.05]
    if stable.get("condition_number", 0) > MAX_CONDITION:
        cautions.append(f"the covariates are nearly dependent (condition number {stable['condition_number']:.3g})")
    cautions += [f"the interval of {r['term']} is very wide" for r in table if r["ci_lower"] and r["ci_upper"] and r["ci_upper"] / r["ci_lower"] >= 8]
    strong = [r for r in table if r["p_value"] is not None and r["p_value"] < 0.05]
    status = "caution" if epv < 5 or stable["one_sided"] else "review" if cautions else "robust"
    return {"status": status, "strengths": [f"{r['term']}: hazard ratio {r['hazard_ratio']:.3g}, p = {r['p_value']:.3g}" for r in strong if r["hazard_ratio"] is not None], "cautions": cautions}


def analyse(df: DataFrame, covariates: list[str], categorical: list[str] = (), strata: list[str] = (), confidence: float = 0.95, resamples: int = 0, panels: bool = True) -> dict:
    """The whole Cox request: ratios, statistics, proportional-hazards tests, stability, residual panels, concordance (unstratified only)
    with its interval by influence, or by so many resamples if asked."""
    from .concordance import bootstrap_interval, c_index, jackknife_interval
    from .encode import condition_number
    from .trends import martingale_panels, schoenfeld_panels

    d, names = design(df, covariates, categorical)
    stable = stability(d, names, list(strata)) | {"condition_number": condition_number(d, names)}
    fitted = fit(d, names, strata)
    ph, table, stats = ph_tests(d, fitted), fitted.table(confidence), fitted.statistics()
    out = {"fit": fitted, "table": table, "statistics": stats, "ph": ph, "stability": stable, "c_index": None, "c_index_interval": None, "narrative": narrative(table, stats, ph, stable)}
    if panels:
        numeric = [c for c in covariates if c in names]
        out |= {"ph_panels": schoenfeld_panels(d, fitted), "martingale_panels": martingale_panels(d, fitted, numeric)}
    if not strata:
        risk = d.select("_row_id", "time", "event", fitted.linear().alias("risk"))
        out |= {"c_index": c_index(risk), "c_index_interval": bootstrap_interval(risk, resamples, confidence) if resamples else jackknife_interval(risk, confidence)}
    return out
