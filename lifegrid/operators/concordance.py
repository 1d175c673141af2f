"""Harrell's concordance, with intervals by its influence function and by resampling.

Pairs count where the earlier time is an event and the other time is strictly later; equal risks count one half.
Equal (time, event, risk) rows are first merged to one with a count. Times and risks are then cut into ranges, and each pair is
counted once: inside its range of times; else inside its range of risks, from counts by range of times; else from the
table of both ranges. No task holds more than a range.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_quantile
from ..scratch import written
from .timegrid import range_cuts, range_number


def pair_counts(time: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float, float]:
    """(concordant, tied, comparable) pairs, with rows counted weight times.

    Two times part at one bit of their rank: for each bit, the rows with it unset look up the rows of the same higher bits
    with it set, in order of risk.
    """
    if not len(time):
        return 0.0, 0.0, 0.0
    t, r = np.unique(time, return_inverse=True)[1], np.unique(risk, return_inverse=True)[1]
    w = np.ones(len(t)) if weight is None else np.asarray(weight, float)
    order = np.argsort(r, kind="stable")
    t, r, w, dead = t[order].astype(np.int64), r[order].astype(np.int64), w[order], np.asarray(event)[order] == 1
    levels = int(r[-1]) + 1
    conc = tied = comp = 0.0
    for bit in range(int(t.max()).bit_length()):
        late = (t >> bit) & 1 == 1
        ask = ~late & dead
        key = (t[late] >> (bit + 1)) * levels + r[late]
        place = np.argsort(key, kind="stable")
        key, upto = key[place], np.concatenate([[0.0], np.cumsum(w[late][place])])
        base = (t[ask] >> (bit + 1)) * levels
        start, end = (upto[np.searchsorted(key, b)] for b in (base, base + levels))
        low, high = (upto[np.searchsorted(key, base + r[ask], side)] for side in ("left", "right"))
        conc += float(w[ask] @ (low - start))
        tied += float(w[ask] @ (high - low))
        comp += float(w[ask] @ (end - start))
    return conc, tied, comp


def row_counts(time: np.ndarray, event: np.ndarray, risk: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``pair_counts`` counts, by row: weights of the rows with which each makes a (concordant, tied, comparable) pair, whether as
    the earlier or as the later one."""
    out = np.zeros((3, len(time)))
    if not len(time):
        return tuple(out)
    t, r = np.unique(time, return_inverse=True)[1].astype(np.int64), np.unique(risk, return_inverse=True)[1].astype(np.int64)
    dead, levels = np.asarray(event) == 1, int(r.max()) + 1
    for bit in range(int(t.max()).bit_length()):
        late = (t >> bit) & 1 == 1
        base = (t >> (bit + 1)) * levels
        # an early event's partners are the late rows of its higher bits; a late row's, the early events
        for mine, others, lower in ((~late & dead, late, True), (late, ~late & dead, False)):
            place = np.flatnonzero(others)[np.argsort((base + r)[others], kind="stable")]
            key, upto = (base + r)[place], np.concatenate([[0.0], np.cumsum(weight[place])])
            start, end = (upto[np.searchsorted(key, b)] for b in (base[mine], base[mine] + levels))
            low, high = (upto[np.searchsorted(key, (base + r)[mine], side)] for side in ("left", "right"))
            out[:, mine] += np.stack([low - start if lower else end - high, high - low, end - start])
    return tuple(out)


def index_of(counts: tuple[float, float, float]) -> float | None:
    conc, tied, comp = counts
    return (conc + 0.5 * tied) / comp if comp else None


def counted(df: DataFrame) -> DataFrame:
    """The rows that count: with a time, an event and a finite risk."""
    return df.filter(F.col("risk").isNotNull() & ~F.isnan("risk") & F.col("time").isNotNull() & F.col("event").isNotNull())


def ranges(df: DataFrame) -> tuple[list[float], list[float]]:
    """Cuts of times and of risks, over the distinct (time, risk) of df."""
    times, risks = range_cuts(counted(df).select("time", "risk").distinct(), ["time", "risk"])
    return times, risks


def pair_table(df: DataFrame, keys: list[str] = (), weight: str | None = None, cuts: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """keys, concordant, tied, comparable, c_index of a table of time, event and risk. Rows without a finite risk don't count;
    others count once, or weight times. The cuts come from the merged rows unless given; they never change a result."""
    keys = list(keys)
    merged = counted(df).groupBy(*keys, F.col("time").cast("double").alias("time"), "event", F.col("risk").cast("double").alias("risk"))
    merged = merged.agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("k"))
    if cuts is None:
        merged = written(merged)  # for the cuts and for the three counts
    times, risks = range_cuts(merged, ["time", "risk"]) if cuts is None else cuts
    marked = merged.withColumns({"tr": range_number(F.col("time"), times), "rr": range_number(F.col("risk"), risks)})
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "concordant double, tied double, comparable double"

    def counts(rows: DataFrame, inside: list[str], time: str, risk: str, use: tuple[int, int, int]) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            c = pair_counts(pdf[time].to_numpy(float), pdf.event.to_numpy(), pdf[risk].to_numpy(float), pdf.k.to_numpy(float))
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{n: [x * u] for n, x, u in zip(("concordant", "tied", "comparable"), c, use, strict=True)}})

        return rows.groupBy(*keys, *inside).applyInPandas(run, schema)

    # an odd range of times has one time, so no pair inside it
    parts = counts(marked.filter("tr % 2 = 0"), ["tr"], "time", "risk", (1, 1, 1))
    if times:
        coarse = marked.groupBy(*keys, "rr", "risk", "tr", "event").agg(F.sum("k").alias("k"))
        cells = marked.groupBy(*keys, "rr", "tr", "event").agg(F.sum("k").alias("k"))
        table = counts(cells.withColumn("_all", F.lit(0)), ["_all"], "tr", "rr", (1, 0, 1))
        parts = parts.unionByName(counts(coarse, ["rr"], "tr", "risk", (1, 1, 0))).unionByName(table)
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("concordant", "tied", "comparable")])
    if not keys:
        sums = sums.filter(F.col("comparable").isNotNull())
    share = F.when(F.col("comparable") > 0, (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable"))
    return sums.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("concordant", "tied", "comparable")], share.alias("c_index"))


def c_index(df: DataFrame) -> float | None:
    r = pair_table(df).first()
    return None if r is None else r.c_index


def table_counts(tr: np.ndarray, rr: np.ndarray, event: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row_counts`` of cells by the numbers of their ranges of times and of risks, from sums over the whole table of both."""
    shape = (int(tr.max()) + 1, int(rr.max()) + 1)
    every, dead = np.zeros(shape), np.zeros(shape)
    np.add.at(every, (tr, rr), weight)
    np.add.at(dead, (tr, rr), np.where(event == 1, weight, 0.0))
    late = np.cumsum(every[::-1], axis=0)[::-1] - every  # rows of later ranges of times, by range of risks
    early = np.cumsum(dead, axis=0) - dead  # events of earlier ones
    lower, higher = np.cumsum(late, axis=1) - late, np.cumsum(early[:, ::-1], axis=1)[:, ::-1] - early
    counts = [(lower, higher), (late, early), (late.sum(axis=1, keepdims=True) + 0 * late, early.sum(axis=1, keepdims=True) + 0 * early)]
    return tuple(np.where(event == 1, first[tr, rr], 0.0) + second[tr, rr] for first, second in counts)


def influence(df: DataFrame, cuts: tuple[list[float], list[float]] | None = None) -> dict | None:
    """c_index and its standard error by the infinitesimal jackknife, in one pass over the merged rows; None without a comparable pair.

    A row in a share of agree of its comparable pairs moves the index by (agree - c_index * comparable) / all pairs; the
    variance is the sum of the squares. Each row's pairs are counted as in ``pair_table``: within its range of times, within its range of
    risks, and by the table of both ranges. The rows go to their ranges of times and on to their ranges of risks with what has been
    counted, so no count is joined to its row again; those of a risk that is a range of its own stay where they are.
    """
    merged = written(counted(df).groupBy(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), F.col("risk").cast("double").alias("risk")).agg(F.count(F.lit(1)).cast("double").alias("k")))
    times, risks = range_cuts(merged, ["time", "risk"]) if cuts is None else cuts
    marked = merged.withColumns({"tr": range_number(F.col("time"), times), "rr": range_number(F.col("risk"), risks)}).persist()
    columns = ["tr", "rr", "event", "risk", "k"]

    def in_times(pdf: pd.DataFrame) -> pd.DataFrame:
        conc, tied, comp = row_counts(pdf.time.to_numpy(float), pdf.event.to_numpy(), pdf.risk.to_numpy(float), pdf.k.to_numpy(float))
        return pdf[columns].assign(n=conc + 0.5 * tied, c=comp)

    def in_table(pdf: pd.DataFrame) -> pd.DataFrame:
        conc, tied, comp = table_counts(*(pdf[c].to_numpy() for c in ("tr", "rr", "event", "k")))
        # an odd range of risks has one risk, so all its pairs of other times are ties
        return pdf[["rr", "tr", "event"]].assign(nt=conc + np.where(pdf.rr % 2 == 1, 0.5 * tied, 0.0), ct=comp)

    def in_risks(pdf: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        conc, tied, _ = row_counts(pdf.tr.to_numpy(float), pdf.event.to_numpy(), pdf.risk.to_numpy(float), pdf.k.to_numpy(float))
        pdf = pdf.merge(table, on=["rr", "tr", "event"], how="left")
        n, c, k = pdf.n.to_numpy() + conc + 0.5 * tied + pdf.nt.to_numpy(), pdf.c.to_numpy() + pdf.ct.to_numpy(), pdf.k.to_numpy()
        return pd.DataFrame({a: [float(k @ v)] for a, v in (("n", n), ("c", c), ("nn", n * n), ("nc", n * c), ("cc", c * c))})

    names = ("n", "c", "nn", "nc", "cc")
    try:
        # an odd range of times has one time, so no pair inside it
        x = marked.filter("tr % 2 = 0").groupBy("tr").applyInPandas(in_times, "tr int, rr int, event int, risk double, k double, n double, c double")
        x = x.unionByName(marked.filter("tr % 2 = 1").select(*columns, F.lit(0.0).alias("n"), F.lit(0.0).alias("c")))
        cells = marked.groupBy("rr", "tr", "event").agg(F.sum("k").alias("k")).withColumn("_all", F.lit(0))  # at most 2 * (2 * MAX_RANGES + 1)^2 rows
        table = written(cells.groupBy("_all").applyInPandas(in_table, "rr int, tr int, event int, nt double, ct double"))
        sums = x.filter("rr % 2 = 0").groupBy("rr").cogroup(table.filter("rr % 2 = 0").groupBy("rr")).applyInPandas(in_risks, ", ".join(f"{a} double" for a in names))
        if risks:
            one = x.filter("rr % 2 = 1").join(table.filter("rr % 2 = 1"), ["rr", "tr", "event"])
            n, c, k = F.col("n") + F.col("nt"), F.col("c") + F.col("ct"), F.col("k")
            sums = sums.unionByName(one.select((k * n).alias("n"), (k * c).alias("c"), (k * n * n).alias("nn"), (k * n * c).alias("nc"), (k * c * c).alias("cc")))
        r = sums.agg(*[F.sum(a).alias(a) for a in names]).first()
    finally:
        marked.unpersist()
    if not r.c:
        return None
    index, pairs = r.n / r.c, r.c / 2
    return {"c_index": index, "std_error": math.sqrt(max(0.0, r.nn - 2 * index * r.nc + index * index * r.cc)) / pairs, "comparable": pairs}


def jackknife_interval(df: DataFrame, confidence: float = 0.95) -> tuple[float, float] | None:
    """Normal interval of the index, within 0 and 1, for fixed risks; None for under 10 rows or under 5 events, as for the
    bootstrap, whose standard error it comes close to without resampling any row."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).first()
    if size.n < 10 or size.e is None or size.e < 5 or (got := influence(df)) is None:
        return None
    half = normal_quantile(0.5 + confidence / 2) * got["std_error"]
    return max(0.0, got["c_index"] - half), min(1.0, got["c_index"] + half)


def resample_weight(row: Column, resample: Column, seed: int) -> Column:
    """A Poisson draw of mean 1, from the hash of row, resample and seed: how often the row is in the resample."""
    u = F.shiftrightunsigned(F.xxhash64(row, resample, F.lit(seed)), 11) * F.lit(2.0**-53)
    below = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(17)])
    weight = F.lit(0)
    for p in below.tolist():
        weight = weight + (u >= p).cast("int")
    return weight


def bootstrap_interval(df: DataFrame, resamples: int = 200, confidence: float = 0.95, seed: int = 42) -> tuple[float, float] | None:
    """Percentile interval over resampled rows with their risks fixed, at any number of rows; df has _row_id, time, event, risk.
    None for under 10 rows, under 5 events or too few valid resamples. Each row is drawn by its own Poisson weight, so that
    no task needs the others."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("e")).first()
    if size.n < 10 or size.e is None or size.e < 5:
        return None
    drawn = df.select("_row_id", "time", "event", "risk", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("resample"))
    drawn = drawn.withColumn("times_drawn", resample_weight(F.col("_row_id"), F.col("resample"), seed)).filter("times_drawn > 0")
    got = [r.c_index for r in pair_table(drawn, ["resample"], "times_drawn", ranges(df)).select("c_index").collect() if r.c_index is not None]
    if len(got) < max(10, 0.3 * resamples):
        return None
    low = (1 - confidence) / 2
    return float(np.quantile(got, low)), float(np.quantile(got, 1 - low))
