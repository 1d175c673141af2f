"""The optimal cut-point of a covariate by the log-rank statistic.

For the rows above a cut, observed minus expected events is a sum of martingale residuals, so it accumulates along
the sorted covariate. The variance is a sum over rows less a sum over pairs of rows of W(min of their times); a row adds W at its own time for all
rows above it that are later, and W at their times for the others. These are counts over two orders, and they are taken by ranges
of both: equal (value, time) rows are one cell; each pair of cells is counted within its range of values, else within its range of times, else
from the table of both ranges. The sums along the covariate go by ranges as well. So no task holds more than a range, and nothing that grows with the rows
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from ..functions.stats import chi2_upper, mixed
from ..scratch import written
from .positions import numbered
from .timegrid import at_risk, kept, like, range_cuts, range_number, running

#: Rows up to which each permutation is scanned in one task; more go through ``scan``, one permutation after the other.
TASK_ROWS = 200_000


def above(x: np.ndarray, t: np.ndarray, k: np.ndarray, kw: np.ndarray, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each cell, over the cells of greater x: the sum of kw where t is not later (earlier, if strict), and of k where it is later.

    Two values of x part at one bit of their rank: for each bit, the cells with it unset look up those of the same higher bits with it
    set, in order of t.
    """
    early, late = np.zeros(len(x)), np.zeros(len(x))
    if not len(x):
        return early, late
    levels = int(t.max()) + 1
    for bit in range(int(x.max()).bit_length()):
        high = (x >> bit) & 1 == 1
        base = (x >> (bit + 1)) * levels
        key = base + t
        place = np.flatnonzero(high)[np.argsort(key[high], kind="stable")]
        at, ask = key[place], ~high
        n, w = (np.concatenate([[0.0], np.cumsum(v[place])]) for v in (k, kw))
        start, end = np.searchsorted(at, base[ask]), np.searchsorted(at, base[ask] + levels)
        upto = np.searchsorted(at, key[ask], side="right")
        early[ask] += w[np.searchsorted(at, key[ask]) if strict else upto] - w[start]
        late[ask] += n[end] - n[upto]
    return early, late


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 0 in the order of the columns, the first one first; equal rows share one."""
    if len(columns) == 1:
        return np.unique(columns[0], return_inverse=True)[1].astype(np.int64)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def pair_sums(cells: DataFrame, cuts: tuple[list[float], list[float]]) -> DataFrame:
    """x, time and s of every cell (x, time, k, w): the sum over all cells behind it, by x and then by time, of their k times w at the earlier
    one of both times."""
    marked = cells.withColumns({"xr": range_number(F.col("x"), cuts[0]), "tr": range_number(F.col("time"), cuts[1])})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t, k, w = (pdf[c].to_numpy(float) for c in ("x", "time", "k", "w"))
        early, late = above(ranks(x, t), ranks(t), k, k * w)
        return pdf[["x", "time"]].assign(s=early + w * late)

    schema = "x double, time double, s double"
    same = marked.filter("xr % 2 = 0").groupBy("xr").applyInPandas(within, schema)
    if not cuts[0]:
        return same
    # an odd range has one value of x: what is behind a cell is later
    odd = marked.filter("xr % 2 = 1")
    one = running(odd, ["xr"], {"later": F.col("k")}, back=True).select("x", "time", (F.col("w") * (F.col("later") - F.col("k"))).alias("s"))
    coarse = marked.groupBy("tr", "time", "xr").agg(F.sum("k").cast("double").alias("k"), F.first("w").alias("w"))

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, t, k, w = (pdf[c].to_numpy(float) for c in ("xr", "time", "k", "w"))
        early, late = above(ranks(x), ranks(t), k, k * w)
        return pdf[["xr", "time"]].assign(s2=early + w * late)

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        early, late = above(ranks(pdf.xr.to_numpy()), ranks(pdf.tr.to_numpy()), pdf.k.to_numpy(float), pdf.kw.to_numpy(float), strict=True)
        return pdf[["xr", "tr"]].assign(early=early, late=late)

    table = marked.groupBy("xr", "tr").agg(F.sum("k").cast("double").alias("k"), F.sum(F.col("k") * F.col("w")).alias("kw"))
    x = marked.join(same.unionByName(one), ["x", "time"], "left").join(coarse.groupBy("tr").applyInPandas(beside, "xr int, time double, s2 double"), ["xr", "time"], "left")
    x = x.join(table.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(apart, "xr int, tr int, early double, late double"), ["xr", "tr"], "left")  # at most (2 * MAX_RANGES + 1)^2 rows
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.select("x", "time", (zero("s") + zero("s2") + zero("early") + F.col("w") * zero("late")).alias("s"))


def cells_of(cohort: DataFrame, variable: str) -> DataFrame:
    """x, time, k (rows) and e (events) of the distinct (x, time) with a numeric x, as a written table: the one reading of the cohort."""
    rows = cohort.select(F.col(f"`{variable}`").cast("double").alias("x"), F.col("time").cast("double").alias("time"), "event").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    return written(rows.groupBy("x", "time").agg(F.count(F.lit(1)).alias("k"), F.sum("event").cast("long").alias("e")))


def statistics(cells: DataFrame) -> DataFrame:
    """below, x, n, events and chisq of the rows of at least each value x, from ``cells_of``; below is the next lower value."""
    g = at_risk(cells.groupBy("time").agg(F.sum("e").alias("d"), F.sum("k").alias("c")), [])
    d, n = F.col("d"), F.col("n").cast("double")
    v = F.when(n > 1, d * (n - d) / (n - 1)).otherwise(0.0)
    g = running(g, [], {"h": d / n, "a": v / n, "w": v / (n * n)}).select("time", "h", "a", "w")
    cells = written(cells.join(g, "time"))
    cuts = range_cuts(cells, ["x", "time"])
    s = pair_sums(cells.select("x", "time", F.col("k").cast("double").alias("k"), "w"), (cuts[0], cuts[1]))
    both, k = cells.join(s, ["x", "time"]), F.col("k").cast("double")
    levels = both.groupBy("x").agg(F.sum("k").alias("k"), F.sum("e").alias("e"), F.sum(k * F.col("h")).alias("kh"), F.sum(k * F.col("a")).alias("ka"), F.sum(k * k * F.col("w") + 2 * k * F.col("s")).alias("q"))
    levels = kept(levels.withColumnRenamed("x", "time"), [])  # running sums along x
    up = running(levels, [], {"n": F.col("k"), "events": F.col("e"), "h": F.col("kh"), "a": F.col("ka"), "pairs": F.col("q")}, back=True)
    up = running(like(levels, up), [], {"place": F.lit(1).cast("long")})
    lower = up.select((F.col("place") + 1).alias("place"), F.col("time").alias("below"))
    u, var = F.col("events") - F.col("h"), F.col("a") - F.col("pairs")
    chisq = F.when(var > 1e-12, u * u / var).otherwise(0.0)
    return up.join(lower, "place").select("below", F.col("time").alias("x"), "n", "events", chisq.alias("chisq"))


def scan(cohort: DataFrame, variable: str, min_fraction: float = 0.1) -> DataFrame:
    """cutpoint, n_below, n_above, events_below, events_above, chisq for every midpoint of neighbouring values that leaves the
    least fraction of rows and an event on either side."""
    check_fraction(min_fraction)
    return scan_cells(cells_of(cohort, variable), variable, min_fraction)


def check_fraction(min_fraction: float) -> None:
    if not 0.02 <= min_fraction <= 0.45:
        raise UserInputError("the least group fraction is between 0.02 and 0.45")


def scan_cells(cells: DataFrame, variable: str, min_fraction: float) -> DataFrame:
    """``scan`` of the cells of ``cells_of``."""
    size = cells.agg(F.sum("k").alias("n"), F.sum("e").alias("e")).first()
    if not size.n:
        raise UserInputError(f'"{variable}" has no numeric values')
    n, e = F.lit(size.n), F.lit(size.e)
    least = max(1, math.ceil(min_fraction * size.n))
    s = statistics(cells).filter((F.col("n") >= least) & (n - F.col("n") >= least) & (F.col("events") >= 1) & (e - F.col("events") >= 1))
    whole = {"n_below": n - F.col("n"), "n_above": F.col("n"), "events_below": e - F.col("events"), "events_above": F.col("events")}
    return s.select(((F.col("x") + F.col("below")) / 2).alias("cutpoint"), *[c.cast("long").alias(k) for k, c in whole.items()], "chisq")


def greatest(x: np.ndarray, t: np.ndarray, e: np.ndarray, least: int) -> float | None:
    """The greatest statistic of ``scan`` over rows in one place; None without a cut."""
    times, at = np.unique(t, return_inverse=True)
    d, c = np.bincount(at, e, len(times)), np.bincount(at, minlength=len(times)).astype(float)
    n = np.cumsum(c[::-1])[::-1]
    v = np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1), 0.0)
    h, a, w = np.cumsum(d / n)[at], np.cumsum(v / n)[at], np.cumsum(v / n**2)[at]
    order = np.lexsort((t, x))
    x, at, e, h, a, w = (y[order] for y in (x, at, e, h, a, w))
    ones = np.ones(len(x))
    early, late = above(np.arange(len(x)), at.astype(np.int64), ones, w)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))[1:]  # cuts below each value but the least
    back = lambda y: np.cumsum(y[::-1])[::-1][first]
    size, events = back(ones), back(e.astype(float))
    u, var = events - back(h), back(a) - back(w + 2 * (early + w * late))
    ok = (size >= least) & (len(x) - size >= least) & (events >= 1) & (e.sum() - events >= 1) & (var > 1e-12)
    return float((u[ok] ** 2 / var[ok]).max()) if ok.any() else None


def permutation_statistics(cohort: DataFrame, variable: str, min_fraction: float, permutations: int, seed: int) -> list[float]:
    """The greatest statistic of each permutation that has a cut. A permutation orders the rows by a hash of their ids and gives the values, in
    their own order, to the rows in that one: the same one at any size and on any partitions."""
    rows = written(cohort.select(F.xxhash64("_row_id").alias("key"), F.col(f"`{variable}`").cast("double").alias("x"), F.col("time").cast("double").alias("time"), "event").filter(F.col("x").isNotNull() & ~F.isnan("x")))
    n = rows.count()
    if n <= TASK_ROWS:
        least = max(1, math.ceil(min_fraction * n))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            p = int(pdf.permutation.iloc[0])
            pdf = pdf.iloc[np.lexsort((pdf.key, mixed(pdf.key.to_numpy(), p, seed).astype(np.int64)))]
            s = greatest(np.sort(pdf.x.to_numpy()), pdf.time.to_numpy(), pdf.event.to_numpy(int), least)
            return pd.DataFrame({"s": pd.array([s], dtype="Float64")})

        each = rows.withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
        return [r.s for r in each.groupBy("permutation").applyInPandas(one, "s double").collect() if r.s is not None]
    values = numbered(rows.select("x"), [], [F.col("x")]).select("position", "x")
    rows, out = rows.select("key", "time", "event"), []
    for p in range(permutations):

        def drawn(batches: Iterator[pd.DataFrame], p: int = p) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(draw=mixed(b.key.to_numpy(), p, seed).astype(np.int64))

        order = numbered(rows.mapInPandas(drawn, "key long, time double, event int, draw long"), [], [F.col("draw"), F.col("key")])
        s = scan(order.join(values, "position"), "x", min_fraction).agg(F.max("chisq")).first()[0]
        out += [] if s is None else [s]
    return out


def optimal_cutpoint(cohort: DataFrame, variable: str, min_fraction: float = 0.1, permutations: int = 0, seed: int = 42, lower_label: str = "Low", upper_label: str = "High") -> dict:
    """The cut-point of the greatest statistic (the least one of equals), its labels by survival, and, if asked, the
    permutation p of the maximum, (extreme + 1) / (valid + 1).

    The side of the longer median survival gets lower_label, as the lower risk; an unreached median is longer than any, and
    if both are unreached the larger area decides.
    """
    from . import km

    if not 0 <= permutations <= 500:
        raise UserInputError("at most 500 permutations")
    check_fraction(min_fraction)
    cells = cells_of(cohort, variable)
    best = scan_cells(cells, variable, min_fraction).orderBy(F.desc(F.round("chisq", 9)), "cutpoint").limit(1).collect()
    if not best:
        raise UserInputError(f'"{variable}" has no cut-point with enough rows and events on both sides')
    b = best[0].asDict()
    sides = kept(cells.groupBy((F.col("x") > b["cutpoint"]).alias("side"), "time").agg(F.sum("e").alias("d"), F.sum("k").alias("c")), ["side"])
    med = {r.side: r.median for r in km.summary_of(sides, ["side"]).collect()}
    ends = min(r[0] for r in sides.groupBy("side").agg(F.max("time")).select("max(time)").collect())
    area = {r.side: r.rmst for r in km.rmst_of(sides, ["side"], ends).collect()}
    key = lambda s: (math.inf if med[s] is None else med[s], area[s] if med[True] is None and med[False] is None else 0.0)
    swap = key(True) > key(False)
    out = b | {"p_value": chi2_upper(b["chisq"], 1), "label_above": lower_label if swap else upper_label, "label_below": upper_label if swap else lower_label, "median_above": med[True], "median_below": med[False]}
    if permutations:
        stats = permutation_statistics(cohort, variable, min_fraction, permutations, seed)
        out["permutation_p"] = (sum(s >= b["chisq"] - 1e-9 for s in stats) + 1) / (len(stats) + 1)
    return out
