"""Rules of a signature search over any number of cells.

Rows shrink to cells of (time, event, pattern of the indicators) with counts, which lie over partitions in order of time. All rules
are scored together: a partition knows the counts of each rule by time, the sums of the partitions behind it give the risk sets
(as in ``likelihood``), and what comes back is a few numbers a rule. Resamples draw a weight for every cell where it lies, from a
seed for its block of BLOCK cells in the global order, so no draw depends on the partitions: bootstraps and subsamples by cell, and for permutations
how many of a cell's rows are in the rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_upper, normal_quantile
from .likelihood import ADDED, EDGE, Edge, added, behind
from .positions import numbered

#: Cells that share a seed, and numbers that a partition's task holds.
BLOCK, CELLS = 4_096, 8_000_000
#: Bits of a word of a pattern; rules and resamples that one pass takes.
WORD, RULES, DRAWS = 62, 128, 8


class Cells:
    """A partition's cells: times, events, counts and indicator columns."""

    def __init__(self, t: pa.Table, words: int, indicators: int):
        t = t.combine_chunks()
        self.part = t.column("part")[0].as_py()
        self.time, self.event, self.k, self.block = (t.column(c).to_numpy() for c in ("time", "event", "k", "block"))
        self.event = self.event == 1
        bits = [t.column(f"b{w}").to_numpy() for w in range(words)]
        self.has = np.stack([(bits[i // WORD] >> (i % WORD)) & 1 == 1 for i in range(indicators)], axis=1)
        self.starts = np.flatnonzero(np.append(True, self.time[1:] != self.time[:-1]))

    def masks(self, rules: list[tuple[tuple[int, ...], str]]) -> np.ndarray:
        return np.stack([self.has[:, list(c)].all(axis=1) if op == "AND" else self.has[:, list(c)].any(axis=1) for c, op in rules], axis=1)

    def drawn(self, rules: list, how: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the cells, and of their rows in each rule, for a draw: ('all',), ('boot', seed, i, share), ('part', seed, i, share) or
        ('permute', seed, i, sizes as shares of the rows)."""
        inside = self.masks(rules)
        if how[0] == "all":
            return self.k.astype(float), inside * self.k[:, None].astype(float)
        kind, seed, i, share = how
        w = np.empty(len(self.k)) if kind != "permute" else self.k.astype(float)
        mine = np.empty(inside.shape) if kind == "permute" else None
        cuts = np.flatnonzero(np.append(True, self.block[1:] != self.block[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(self.k)), strict=True):
            rng = np.random.default_rng([seed, {"boot": 1, "part": 2, "permute": 3}[kind], i, int(self.block[a])])
            k = self.k[a:b]
            if kind == "boot":
                w[a:b] = rng.poisson(k * share)
            elif kind == "part":
                w[a:b] = rng.binomial(k, share)
            else:
                mine[a:b] = rng.binomial(k[:, None], share[None, :])
        return w, inside * w[:, None] if mine is None else mine

    def by_time(self, w: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, ...]:
        """Events, rows at the time, and both in each rule, by time."""
        add = lambda v: np.add.reduceat(v, self.starts, axis=0)
        return add(np.where(self.event, w, 0.0)), add(w), add(np.where(self.event[:, None], mine, 0.0)), add(mine)

    def edge(self, w: np.ndarray, mine: np.ndarray) -> tuple:
        d, c, d1, c1 = self.by_time(w, mine)
        at = lambda i: (float(d[i]), float(d[i]), d1[i].tobytes())
        return (self.part, "", float(self.time[0]), float(self.time[-1]), float(c.sum()), c1.sum(axis=0).tobytes(), *at(0), *at(-1))

    def risk(self, w: np.ndarray, mine: np.ndarray, o) -> tuple[np.ndarray, ...]:
        """Events, rows at risk, and both in each rule, at the times with events that this partition owns; and those times."""
        d, c, d1, c1 = self.by_time(w, mine)
        n, n1 = np.cumsum(c[::-1])[::-1], np.cumsum(c1[::-1], axis=0)[::-1]
        if o is not None:
            n, n1 = n + o.after[0], n1 + o.after[1]
            if o.tie is not None:
                d[-1], d1[-1] = o.tie[0], o.tie[2]
            if not o.owned:
                d[0] = 0.0
        own = d > 0
        return d[own], n[own], d1[own], n1[own], self.time[self.starts][own]


def logrank_sums(d, n, d1, n1) -> np.ndarray:
    q = n1 / n[:, None]
    v = np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1), 0.0)
    return np.stack([(d1 - d[:, None] * q).sum(axis=0), (v[:, None] * q * (1 - q)).sum(axis=0), d1.sum(axis=0), np.full(d1.shape[1], d.sum())])


def cox_sums(d, n, d1, n1, beta: np.ndarray) -> np.ndarray:
    """Score and information of each rule's log hazard ratio, with Efron's ties."""
    r = np.exp(beta)
    s1, e1 = n1 * r, d1 * r
    s0, e0 = n[:, None] - n1 + s1, d[:, None] - d1 + e1
    score, info = d1.sum(axis=0), np.zeros(len(beta))
    for step in range(int(np.ceil(d.max())) if len(d) else 0):
        m = d > step
        f = (step / d[m])[:, None]
        u = (s1[m] - f * e1[m]) / (s0[m] - f * e0[m])
        score -= u.sum(axis=0)
        info += (u * (1 - u)).sum(axis=0)
    return np.stack([score, info])


class Patterns:
    """The cells of a cohort, kept in storage until ``release``. Rows with a null in any candidate column are left out."""

    def __init__(self, cohort: DataFrame, tests: list, held: int | None = None):
        self.indicators, self.words = len(tests), max(1, math.ceil(len(tests) / WORD))
        bits = []
        for w in range(self.words):
            total = F.lit(0).cast("long")
            for i, test in enumerate(tests[w * WORD : (w + 1) * WORD]):
                total = total + F.when(test, F.lit(1 << i).cast("long")).otherwise(F.when(test.isNotNull(), F.lit(0).cast("long")))
            bits.append(total.alias(f"b{w}"))
        names = [f"b{w}" for w in range(self.words)]
        rows = cohort.select(F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), *bits).dropna()
        cells = numbered(rows.groupBy("time", "event", *names).agg(F.count(F.lit(1)).alias("k")), [], [F.col(c) for c in ("time", "event", *names)])
        size = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("event")).alias("e")).first()
        self.n, self.events = int(size.n or 0), int(size.e or 0)
        self.parts = max(1, math.ceil(size.cells * (RULES + self.indicators) / (held or CELLS)))
        dealt = cells.withColumn("block", F.floor(F.col("position") / BLOCK)).repartitionByRange(self.parts, "block").sortWithinPartitions("position")
        self.df = dealt.select("time", "event", "k", "block", *names, F.spark_partition_id().alias("part")).persist()

    def release(self) -> None:
        self.df.unpersist()

    def each(self, run, schema: str) -> DataFrame:
        words, indicators, names = self.words, self.indicators, [x.split()[0] for x in schema.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                with np.errstate(all="ignore"):
                    for row in run(Cells(pa.Table.from_batches(held), words, indicators)):
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        return self.df.mapInArrow(task, schema)

    def outside(self, rules: list, draws: list[tuple]) -> list[dict]:
        if self.parts == 1:
            return [{} for _ in draws]
        rows = self.each(lambda c: ((k, *c.edge(*c.drawn(rules, how))) for k, how in enumerate(draws)), "k int, " + EDGE).collect()
        return [behind([Edge(*r[1:]) for r in rows if r[0] == k]) for k in range(len(draws))]

    def total(self, rules: list, draws: list[tuple], outside: list[dict], run) -> list[np.ndarray]:
        """For each draw the sum over partitions of run(k, d, n, d1, n1), an array with a column for each rule."""
        sent = self.df.sparkSession.sparkContext.broadcast(outside)

        def one(c: Cells) -> Iterator[tuple]:
            out = [run(k, *c.risk(*c.drawn(rules, how), sent.value[k].get(c.part))[:4]) for k, how in enumerate(draws)]
            yield c.part, np.stack(out).tobytes()

        shares = self.each(one, "part int, sums binary")
        if self.parts > ADDED:
            shares = shares.withColumn("part", F.floor(F.col("part") / math.ceil(self.parts / ADDED)).cast("int")).groupBy("part").applyInArrow(added, "part int, sums binary")
        got = np.sum([np.frombuffer(bytes(r["sums"])) for r in sorted(shares.collect(), key=lambda r: r["part"])], axis=0)
        sent.unpersist()
        return list(got.reshape(len(draws), -1, len(rules)))

    def sizes(self, rules: list, draws: list[tuple]) -> list[np.ndarray]:
        """For each draw: rows in each rule, all rows, events in each rule, all events."""

        def one(c: Cells) -> Iterator[tuple]:
            out = []
            for how in draws:
                w, mine = c.drawn(rules, how)
                each = np.ones(len(rules))
                out.append(np.stack([mine.sum(axis=0), w.sum() * each, mine[c.event].sum(axis=0), w[c.event].sum() * each]))
            yield c.part, np.stack(out).tobytes()

        got = np.sum([np.frombuffer(bytes(r["sums"])) for r in self.each(one, "part int, sums binary").collect()], axis=0)
        return list(got.reshape(len(draws), 4, len(rules)))

    def medians(self, rules: list, outside: dict) -> tuple[list, list]:
        """Median survival in and out of each rule."""
        how = ("all",)

        def logs(c: Cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d, n, d1, n1, times = c.risk(*c.drawn(rules, how), outside.get(c.part))
            d0, n0 = d[:, None] - d1, n[:, None] - n1
            part = lambda a, b: np.where(a > 0, np.where(a < b, np.log1p(-a / np.maximum(b, 1e-300)), -np.inf), 0.0)
            return part(d1, n1), part(d0, n0), times

        sums = {r["part"]: np.frombuffer(bytes(r["sums"])).reshape(2, -1) for r in self.each(lambda c: [(c.part, np.stack([x.sum(axis=0) for x in logs(c)[:2]]).tobytes())], "part int, sums binary").collect()}
        upto, so_far = {}, np.zeros((2, len(rules)))
        for part in sorted(sums):
            upto[part], so_far = so_far, so_far + sums[part]
        sent = self.df.sparkSession.sparkContext.broadcast(upto)

        def first(c: Cells) -> Iterator[tuple]:
            *both, times = logs(c)
            out = []
            for x, start in zip(both, sent.value[c.part], strict=True):
                low = np.exp(np.cumsum(x, axis=0) + start) < 0.5 - 1e-12
                out.append(np.where(low.any(axis=0), times[low.argmax(axis=0)], np.inf) if len(times) else np.full(x.shape[1], np.inf))
            yield c.part, np.stack(out).tobytes()

        got = np.min([np.frombuffer(bytes(r["sums"])).reshape(2, -1) for r in self.each(first, "part int, sums binary").collect()], axis=0)
        sent.unpersist()
        return tuple([None if math.isinf(v) else float(v) for v in row] for row in got)

    def score(self, rules: list, least: int, least_events: int) -> list[dict]:
        """The rows of ``signature.score_rules``, rule ids from 0."""
        out, draws = [], [("all",)]
        for start in range(0, len(rules), RULES):
            some = rules[start : start + RULES]
            (size,) = self.sizes(some, draws)
            ok = [i for i in range(len(some)) if min(size[0, i], size[1, i] - size[0, i]) >= least and min(size[2, i], size[3, i] - size[2, i]) >= least_events]
            if not ok:
                continue
            kept = [some[i] for i in ok]
            outside = self.outside(kept, draws)
            (sums,) = self.total(kept, draws, outside, lambda _, d, n, d1, n1: logrank_sums(d, n, d1, n1))
            inner, outer = self.medians(kept, outside[0])
            for j, i in enumerate(ok):
                chisq = float(sums[0, j] ** 2 / sums[1, j]) if sums[1, j] > 1e-12 else 0.0
                n1, n, d1, d = (int(v) for v in size[:, i])
                out.append({"rule_id": start + i, "n_in": n1, "events_in": d1, "n_out": n - n1, "events_out": d - d1, "chisq": chisq, "p_value": chi2_upper(chisq, 1), "median_in": inner[j], "median_out": outer[j]})
        return out

    def hazard_ratios(self, rules: list, draws: list[tuple], outside: list[dict], steps: int = 25) -> list[list]:
        """(log ratio, standard error) of each rule in each draw, None where it can't be estimated."""
        beta = [np.zeros(len(rules)) for _ in draws]
        found: list[list] = [[None] * len(rules) for _ in draws]
        done = [np.zeros(len(rules), bool) for _ in draws]
        for _ in range(steps):
            at = [b.copy() for b in beta]
            for k, sums in enumerate(self.total(rules, draws, outside, lambda k, d, n, d1, n1, at=at: cox_sums(d, n, d1, n1, at[k]))):
                for r in np.flatnonzero(~done[k]):
                    score, info = sums[:, r]
                    if not np.isfinite(score) or not info > 1e-12 or abs(beta[k][r]) > 30:
                        done[k][r] = True
                        continue
                    step = score / info
                    if abs(step) < 1e-9 * (1 + abs(beta[k][r])):
                        done[k][r], found[k][r] = True, (float(beta[k][r]), float(1 / math.sqrt(info)))
                        continue
                    beta[k][r] += max(-5.0, min(5.0, step))
            if all(d.all() for d in done):
                break
        return found

    def resample(self, chosen: list[tuple[int, tuple]], how: dict) -> dict[int, dict]:
        """What ``signature.resample_rule`` gives, for all chosen (rule id, rule) together."""
        out: dict[int, dict] = {}
        z = normal_quantile(0.975)
        for start in range(0, len(chosen), RULES):
            ids, rules = zip(*chosen[start : start + RULES], strict=True)
            rules = list(rules)
            every = [("all",)]
            outside = self.outside(rules, every)
            (whole,) = self.total(rules, every, outside, lambda _, d, n, d1, n1: logrank_sums(d, n, d1, n1))
            (base,) = self.hazard_ratios(rules, every, outside)
            (size,) = self.sizes(rules, every)
            seen = np.where(whole[1] > 1e-12, whole[0] ** 2 / np.maximum(whole[1], 1e-300), 0.0)
            limits = lambda g: tuple(math.exp(max(-700.0, min(700.0, v))) for v in (g[0], g[0] - z * g[1], g[0] + z * g[1]))
            tally = {kind: np.zeros((3, len(rules))) for kind in ("boot", "part")}  # hits, same direction, done
            for kind, rounds, share in (("boot", how["bootstrap"], how["bootstrap_fraction"]), ("part", how["validation"], how["validation_fraction"])):
                for a in range(0, rounds, DRAWS):
                    draws = [(kind, how["seed"], i, share) for i in range(a, min(a + DRAWS, rounds))]
                    behind_ = self.outside(rules, draws)
                    sums = self.total(rules, draws, behind_, lambda _, d, n, d1, n1: logrank_sums(d, n, d1, n1))
                    for s, u, ratios in zip(self.sizes(rules, draws), sums, self.hazard_ratios(rules, draws, behind_), strict=True):
                        for r, g in enumerate(ratios):
                            n1, n, d1, d = s[:, r]
                            if g is None or min(n1, n - n1) < how["least"] * n / self.n or min(d1, d - d1) < 1:
                                continue
                            p, hr = chi2_upper(float(u[0, r] ** 2 / u[1, r]) if u[1, r] > 1e-12 else 0.0, 1), limits(g)
                            hit = p < how["alpha"] if kind == "boot" else p <= how["alpha"] and (hr[1] > 1 or hr[2] < 1)
                            tally[kind][:, r] += (hit, base[r] is not None and (g[0] > 0) == (base[r][0] > 0), 1)
            beyond = np.zeros(len(rules))
            for a in range(0, how["permutations"], DRAWS):
                draws = [("permute", how["seed"], i, size[0] / size[1]) for i in range(a, min(a + DRAWS, how["permutations"]))]
                for u in self.total(rules, draws, self.outside(rules, draws), lambda _, d, n, d1, n1: logrank_sums(d, n, d1, n1)):
                    beyond += np.where(u[1] > 1e-12, u[0] ** 2 / np.maximum(u[1], 1e-300), 0.0) >= seen - 1e-9
            for r, rid in enumerate(ids):
                hr = limits(base[r]) if base[r] else (None, None, None)
                row = {"rule_id": rid, "hazard_ratio": hr[0], "ci_lower": hr[1], "ci_upper": hr[2]}
                for kind, name, rounds in (("boot", "bootstrap", how["bootstrap"]), ("part", "validation", how["validation"])):
                    hits, same, done = tally[kind][:, r]
                    row[f"{name}_support"], row[f"{name}_skipped"] = (hits / done if done else None), int(rounds - done)
                    if kind == "boot":
                        row["direction"] = same / done if done else None
                row["permutation_p"] = float((beyond[r] + 1) / (how["permutations"] + 1)) if how["permutations"] else None
                out[rid] = row
        return out
