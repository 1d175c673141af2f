"""The LASSO-Cox path at any size: all penalties advance together, each by proximal Newton steps.

A pass over the sorted rows (see ``likelihood``) evaluates every penalty that has not converged: its likelihood and score, and the
information among the covariates that its screen lets through. The screen is the strong rule: a covariate whose score at the next larger
penalty is below 2 alpha - alpha' is left out, and taken in if the optimality conditions say so later. The small quadratic
problems are solved by coordinate descent on the driver, each from the solution of the larger penalty before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import UserInputError
from ..concordance import influence, pair_table
from ..likelihood import Sorted
from .models import Linear


def quadratic(beta: np.ndarray, score: np.ndarray, info: np.ndarray, alpha: float, start: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The least of 1/2 (b - beta)' info (b - beta) - score' (b - beta) + alpha |b|, by coordinate descent from start."""
    b = start.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            if info[j, j] <= 1e-14:
                continue
            z = score[j] - info[j] @ (b - beta) + info[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - alpha, 0.0) / info[j, j]
            most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-12:
            break
    return b


def lasso_path(rows: Sorted, n: int, alphas: np.ndarray, passes: int = 60, tol: float = 1e-9) -> np.ndarray:
    """Coefficients (penalties x covariates) of the standardised covariates, for falling alphas; the loss is the negative Breslow log
    likelihood over n."""
    p, count = rows.p, len(alphas)
    ((loglik, score, info),) = rows.evaluate_many([np.zeros(p)], [np.arange(p)])
    zero = np.abs(score) / n
    at = [(loglik, score, info, np.arange(p))] * count
    before = np.append(max(alphas[0], zero.max()), alphas[:-1])
    betas = np.zeros((count, p))
    sets = [np.flatnonzero(zero >= 2 * a - b) for a, b in zip(alphas, before, strict=True)]
    sets = [np.array([int(zero.argmax())]) if not len(s) else s for s in sets]
    best, held, done = np.full(count, np.inf), betas.copy(), np.zeros(count, bool)
    for _ in range(passes):
        for k in np.flatnonzero(~done):
            loglik, score, info, of = at[k]
            value = -loglik / n + alphas[k] * np.abs(betas[k]).sum()
            if not np.isfinite(value) or value > best[k] + 1e-12 * (1 + abs(best[k])):  # overshot: half of the step
                betas[k] = (betas[k] + held[k]) / 2
                continue
            held[k], best[k] = betas[k], value
            g = score / n
            live = betas[k] != 0
            wrong = np.where(live, np.abs(g - alphas[k] * np.sign(betas[k])), np.maximum(np.abs(g) - alphas[k], 0.0))
            if wrong.max() <= tol:
                done[k] = True
                continue
            inner = np.isin(of, sets[k])
            s = of[inner]
            sub = info[np.ix_(inner, inner)] / n
            start = betas[k][s]
            if k and not live.any():
                start = betas[k - 1][s]
            new = np.zeros(p)
            new[s] = quadratic(betas[k][s], g[s], sub, alphas[k], start)
            betas[k] = new
            # what the conditions or the larger penalty's score let in for the next pass
            sets[k] = np.union1d(np.flatnonzero((new != 0) | (np.abs(g) > alphas[k] + tol)), sets[k][np.abs(g[sets[k]]) >= 2 * alphas[k] - before[k]])
        todo = np.flatnonzero(~done)
        if not len(todo):
            return betas
        for k, got in zip(todo, rows.evaluate_many([betas[k] for k in todo], [sets[k] for k in todo]), strict=True):
            at[k] = (*got, sets[k])
    raise UserInputError("The LASSO path did not converge.")


def standardised(df: DataFrame, names: list[str]) -> tuple[list, np.ndarray, np.ndarray, int]:
    cols = [F.col(f"`{c}`").cast("double") for c in names]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    if not r.e:
        raise UserInputError("The cohort has no events.")
    mean, sd = (np.array([r[f"{a}{i}"] for i in range(len(names))]) for a in "ms")
    sd = np.where(sd > 0, sd, 1.0)
    return [(c - float(m)) / float(s) for c, m, s in zip(cols, mean, sd, strict=True)], mean, sd, int(r.n)


def alphas_of(rows: Sorted, n: int, count: int = 40, ratio: float = 0.01) -> np.ndarray:
    ((_, score, _),) = rows.evaluate_many([np.zeros(rows.p)], [np.empty(0, np.int64)])
    top = max(np.abs(score).max() / n, 1e-8)
    return np.geomspace(top, top * ratio, count)


def fit_lasso(df: DataFrame, names: list[str], slots: np.ndarray, seed: int = 42, count: int = 40) -> Linear:
    """The alpha is the largest one whose concordance on an inner quarter (by hash, events and others apart) is within one standard error,
    by influence, of the best; the coefficients are of all rows."""
    u = F.pmod(F.xxhash64("_row_id", "event", F.lit(seed)), F.lit(4)) == 0
    cols, mean, sd, n = standardised(df, names)
    scaled = df.select("_row_id", "time", "event", *[c.alias(f"z{i}") for i, c in enumerate(cols)], u.alias("test")).persist()
    zs = [F.col(f"z{i}") for i in range(len(names))]
    try:
        train, test = scaled.filter(~F.col("test")), scaled.filter("test")
        sizes = scaled.groupBy("test").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).collect()
        known = {r.test: r for r in sizes}
        usable = n >= 20 and all(known.get(k) is not None and known[k].e for k in (True, False))
        whole = Sorted(scaled, zs, [], n)
        try:
            best, alphas = count - 1, None
            if usable:
                rows = Sorted(train, zs, [], known[False].n)
                try:
                    alphas = alphas_of(rows, known[False].n, count)
                    path = lasso_path(rows, known[False].n, alphas)
                finally:
                    rows.release()
                risks = [sum((F.lit(float(b)) * z for b, z in zip(beta, zs, strict=True) if b), F.lit(0.0)) for beta in path]
                each = test.select("time", "event", F.posexplode(F.array(*risks)).alias("penalty", "risk"))
                cuts = ([], [])  # ranges are by key here: each penalty's rows are cut by its own task
                c = np.full(count, 0.5)
                for r in pair_table(each, ["penalty"], cuts=cuts if known[True].n < 200_000 else None).collect():
                    c[r.penalty] = 0.5 if r.c_index is None else r.c_index
                top = int(c.argmax())
                error = influence(test.select("_row_id", "time", "event", risks[top].alias("risk")))
                best = int(np.flatnonzero(c >= c[top] - (error["std_error"] if error else 0.0))[0])
            else:
                alphas = alphas_of(whole, n, count)
            betas = lasso_path(whole, n, alphas)
            # all rows may need a smaller alpha than the inner ones for a first coefficient
            best = next((k for k in range(best, count) if betas[k].any()), best)
            base = whole.baseline(betas[best], slots)
        finally:
            whole.release()
    finally:
        scaled.unpersist()
    return Linear(betas[best] / sd, (slots, base), mean, {"alpha": float(alphas[best])})
