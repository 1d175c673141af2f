"""Efron's partial likelihood over rows that lie sorted by (stratum, time) in partitions.

The rows are sorted once. Each evaluation then reads them where they lie, without a shuffle, in at most three passes:

1. every partition sums w and w x over its first and its last stratum, the only ones that other partitions may continue;
2. with the sums of the partitions behind it, it knows all its risk sets, and so the hazard steps of its times;
3. with the steps of the partitions before it, it knows each row's cumulative hazard, and so its share of likelihood,
   score and information.

A time that many rows share may lie in several partitions: its first one takes its events and its likelihood, with the
tied sums of the others. What reaches the driver is one or two rows of sums a partition, never times or rows.

Within a tie of d events, with risk sums S and tied sums E, the step l has phi_l = S0 - l / d E0. Its mean (S1 - l / d E1) / phi_l is
u + v / phi_l with u = E1 / E0 and v = S1 - S0 u, so that a tie needs only the scalars sum log phi, sum 1 / phi, sum 1 / phi^2 and
sum (l / d) / phi. The second moments of the risk sets, summed over all times, are the moments of the rows weighted by their
cumulative hazards: one product X' W X, whatever the number of times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a partition that a task holds.
CELLS = 4_000_000
#: Steps of ties that a task takes at a time.
TIE_STEPS = 2_000_000
#: Partitions' results that the driver adds up; more are added up in tasks first.
ADDED = 64

Sums = tuple[float, np.ndarray]


def stratum(strata: list[str]) -> Column:
    """One text for the values of the strata; nulls are a value of their own."""
    out = F.lit("")
    for s in strata:
        v = F.col(f"`{s}`").cast("string")
        out = F.concat(out, F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return out


class Sorted:
    """Rows of time, event and standardised covariates, sorted over partitions and kept in storage until ``release``."""

    def __init__(self, df: DataFrame, x: list[Column], strata: list[str], rows: int, cells: int | None = None):
        self.p = len(x)
        self.parts = max(1, math.ceil(rows * (self.p + 4) / (cells or CELLS)))
        # what tells tied rows apart, so that no time has to lie in one partition
        salt = F.xxhash64("_row_id") if "_row_id" in df.columns else F.monotonically_increasing_id()
        cols = [F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)]]
        flat = df.select(stratum(strata).alias("g"), *cols, salt.alias("salt"))
        if self.parts == 1:
            dealt = flat.drop("salt").repartition(1).sortWithinPartitions("g", "time")
        else:
            dealt = flat.repartitionByRange(self.parts, "g", "time", "salt").sortWithinPartitions("g", "time").drop("salt")
        self.df = dealt.withColumn("part", F.spark_partition_id()).persist()

    def release(self) -> None:
        self.df.unpersist()

    def each(self, run, schema: str) -> DataFrame:
        """run(Block) over each partition's rows; it yields tuples in the order of schema."""
        p, names = self.p, [x.split()[0] for x in schema.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                with np.errstate(all="ignore"):
                    out = list(run(Block(pa.Table.from_batches(held), p)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return self.df.mapInArrow(task, schema)

    def evaluate(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood, score and information at beta (of the standardised covariates)."""
        outside: dict[int, Outside] = {}
        if self.parts > 1:
            edges = [Edge(*r) for r in self.each(lambda b: b.edges(beta), EDGE).collect()]
            outside = behind(edges)
            sent = self.df.sparkSession.sparkContext.broadcast(outside)
            steps = [tuple(r) for r in self.each(lambda b: b.steps(beta, sent.value.get(b.part)), "part int, first_g string, last_g string, first double, last double, correction double").collect()]
            sent.unpersist()
            before(outside, steps)
        sent = self.df.sparkSession.sparkContext.broadcast(outside)
        p, total = self.p, self.sum_of(lambda b: b.share(beta, sent.value.get(b.part)))
        sent.unpersist()
        return float(total[0]), total[1 : p + 1], total[p + 1 :].reshape(p, p)

    def sum_of(self, run) -> np.ndarray:
        """The sum over partitions of run(Block), an array each; many partitions are added up in tasks first."""
        shares = self.each(lambda b: [(b.part, run(b).tobytes())], "part int, sums binary")
        if self.parts > ADDED:
            width = math.ceil(self.parts / ADDED)
            shares = shares.withColumn("part", F.floor(F.col("part") / width).cast("int")).groupBy("part").applyInArrow(added, "part int, sums binary")
        return np.sum([np.frombuffer(bytes(r["sums"])) for r in sorted(shares.collect(), key=lambda r: r["part"])], axis=0)

    def evaluate_many(self, betas: list[np.ndarray], sets: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each beta, Breslow's log likelihood, score, and information among the covariates of its set: all in the same passes."""
        outside = self.outside_of(betas, sets)
        sent = self.df.sparkSession.sparkContext.broadcast(outside)
        sizes = [1 + self.p + len(s) ** 2 for s in sets]
        flat = self.sum_of(lambda b: np.concatenate([b.breslow(beta, s, o.get(b.part)) for beta, s, o in zip(betas, sets, sent.value, strict=True)]))
        sent.unpersist()
        out, at = [], 0
        for n, s in zip(sizes, sets, strict=True):
            v, at = flat[at : at + n], at + n
            out.append((float(v[0]), v[1 : self.p + 1], v[self.p + 1 :].reshape(len(s), len(s))))
        return out

    def outside_of(self, betas: list[np.ndarray], sets: list[np.ndarray]) -> list[dict]:
        if self.parts == 1:
            return [{} for _ in betas]
        edges = self.each(lambda b: ((k, *e) for k, (beta, s) in enumerate(zip(betas, sets, strict=True)) for e in b.edges(beta, s)), "k int, " + EDGE).collect()
        outside = [behind([Edge(*r[1:]) for r in edges if r[0] == k]) for k in range(len(betas))]
        sent = self.df.sparkSession.sparkContext.broadcast(outside)
        steps = self.each(
            lambda b: ((k, *e) for k, (beta, s) in enumerate(zip(betas, sets, strict=True)) for e in b.breslow_steps(beta, s, sent.value[k].get(b.part))),
            "k int, part int, first_g string, last_g string, first double, last double, correction double",
        ).collect()
        sent.unpersist()
        for k, o in enumerate(outside):
            before(o, [tuple(r[1:]) for r in steps if r[0] == k])
        return outside

    def baseline(self, beta: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Breslow's cumulative hazard at the slots, for rows without strata."""
        none = np.empty(0, np.int64)
        (outside,) = self.outside_of([beta], [none])

        def steps(b: Block) -> np.ndarray:
            d, s0 = b.risk_sets(beta, outside.get(b.part), none)[2:6:3]
            h = np.where(d > 0, d / s0, 0.0)
            return np.bincount(np.searchsorted(slots, b.time[b.starts]), h, len(slots) + 1)

        return np.cumsum(self.sum_of(steps)[: len(slots)])


def added(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    total = np.sum([np.frombuffer(x) for x in t.column("sums").to_pylist()], axis=0)
    return pa.table({"part": t.column("part")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


EDGE = "part int, g string, first double, last double, w double, x binary, d_first double, e0_first double, e1_first binary, d_last double, e0_last double, e1_last binary"


class Edge:
    """A partition's part of its first or its last stratum: its sums, and those of the events at its first and last time."""

    def __init__(self, part, g, first, last, w, x, d_first, e0_first, e1_first, d_last, e0_last, e1_last):
        self.part, self.g, self.first, self.last, self.w, self.x = part, g, first, last, w, np.frombuffer(bytes(x))
        self.at = {first: (d_first, e0_first, np.frombuffer(bytes(e1_first))), last: (d_last, e0_last, np.frombuffer(bytes(e1_last)))}


class Outside:
    """What a partition has to know of the others.

    after: sums over the later partitions' rows of its last stratum. owned: whether its first time begins here. tie: events of its
    last time in all partitions, if it owns that one and others share it. hazard: of its first stratum, from the partitions before. correction:
    Efron's share at its first time, if that one begins elsewhere.
    """

    def __init__(self, p: int):
        self.after: Sums = (0.0, np.zeros(p))
        self.owned, self.tie, self.hazard, self.correction, self.owner = True, None, 0.0, 0.0, None


def behind(edges: list[Edge]) -> dict[int, Outside]:
    edges = sorted(edges, key=lambda e: (e.part, e.g.encode()))
    out = {e.part: Outside(len(e.x)) for e in edges}
    owner: dict[tuple, int] = {}
    ties: dict[tuple, tuple] = {}
    for e in edges:
        for t, (d, e0, e1) in e.at.items():
            owner.setdefault((e.g, t), e.part)
            a = ties.get((e.g, t))
            ties[e.g, t] = (d, e0, e1) if a is None else (a[0] + d, a[1] + e0, a[2] + e1)
    parts: dict[int, list[Edge]] = {}
    for e in edges:
        parts.setdefault(e.part, []).append(e)
    run_g, w, x = None, 0.0, None
    for part in sorted(parts, reverse=True):
        first, last = parts[part][0], parts[part][-1]
        o = out[part]
        if last.g == run_g:
            o.after = (w, x)
        if owner[last.g, last.last] == part:
            o.tie = ties[last.g, last.last]
        if owner[first.g, first.first] != part:
            o.owned, o.owner = False, owner[first.g, first.first]
        # what continues to the left is the part's first stratum
        if first.g == run_g and first is last:
            w, x = w + first.w, x + first.x
        else:
            run_g, w, x = first.g, first.w, first.x
    return out


def before(outside: dict[int, Outside], steps: list[tuple]) -> None:
    run_g, hazard = None, 0.0
    corrections = {s[0]: s[5] for s in steps}
    for part, first_g, last_g, first, last, _ in sorted(steps, key=lambda s: s[0]):
        o = outside[part]
        if first_g == run_g:
            o.hazard = hazard
        if not o.owned:
            o.correction = corrections[o.owner]
        hazard = last + (hazard if first_g == last_g == run_g else 0.0)
        run_g = last_g


def tie_sums(s0: np.ndarray, e0: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each tie: sums over its d steps of log phi, 1 / phi, 1 / phi^2 and (l / d) / phi. A task takes TIE_STEPS steps at a time."""
    out, some = np.zeros((4, len(d))), d > 0
    s0, e0, d = s0[some], e0[some], d[some]
    sums, ends = np.zeros((4, len(d))), np.cumsum(d)
    total = int(ends[-1]) if len(d) else 0
    for lo in range(0, total, TIE_STEPS):
        hi = min(lo + TIE_STEPS, total)
        a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        begin = ends[a:b] - d[a:b]
        counts = (np.minimum(ends[a:b], hi) - np.maximum(begin, lo)).astype(np.int64)
        of = np.repeat(np.arange(a, b), counts)
        share = (np.arange(lo, hi) - np.repeat(begin, counts)) / d[of]
        phi = s0[of] - share * e0[of]
        at = np.append(0, np.cumsum(counts)[:-1]).astype(np.int64)
        for k, v in enumerate((np.log(phi), 1 / phi, 1 / phi**2, share / phi)):
            sums[k, a:b] += np.add.reduceat(v, at)
    out[:, some] = sums
    return tuple(out)


class Block:
    """The rows of one partition, with the starts of its times and strata."""

    def __init__(self, t: pa.Table, p: int):
        g = t.column("g").combine_chunks().dictionary_encode()
        g = g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g
        codes = g.indices.to_numpy()
        self.part = t.column("part")[0].as_py()
        self.first_g, self.last_g = t.column("g")[0].as_py(), t.column("g")[-1].as_py()
        self.time, self.event = t.column("time").to_numpy(), t.column("event").to_numpy() == 1
        self.x = np.column_stack([t.column(f"x{i}").to_numpy() for i in range(p)])
        new = np.append(True, codes[1:] != codes[:-1])
        self.starts = np.flatnonzero(new | np.append(True, self.time[1:] != self.time[:-1]))
        self.strata = np.searchsorted(self.starts, np.flatnonzero(new))  # each stratum's first time

    def weighed(self, beta: np.ndarray, some: np.ndarray | None = None):
        """eta, w, and by time d, E0, E1, and w and w x of all rows; x of the covariates of some, by default all."""
        eta = self.x @ beta
        w = np.exp(eta)
        we, x = np.where(self.event, w, 0.0), self.x if some is None else self.x[:, some]
        add = lambda v: np.add.reduceat(v, self.starts, axis=0)
        return eta, w, add(self.event.astype(float)), add(we), add(x * we[:, None]), add(w), add(x * w[:, None])

    def edges(self, beta: np.ndarray, some: np.ndarray | None = None) -> Iterator[tuple]:
        _, _, d, e0, e1, w, wx = self.weighed(beta, some)
        bounds = np.append(self.strata, len(self.starts))
        for k in sorted({0, len(self.strata) - 1}):
            a, b = bounds[k], bounds[k + 1]
            at = lambda i: (float(d[i]), float(e0[i]), e1[i].tobytes())
            yield (self.part, self.first_g if k == 0 else self.last_g, float(self.time[self.starts[a]]), float(self.time[self.starts[b - 1]]), float(w[a:b].sum()), wx[a:b].sum(axis=0).tobytes(), *at(a), *at(b - 1))

    def risk_sets(self, beta: np.ndarray, o: Outside | None, some: np.ndarray | None = None):
        """eta, w, and by time: d (0 where another partition owns it), E0, E1, S0, S1."""
        eta, w, d, e0, e1, s0, s1 = self.weighed(beta, some)
        if o is not None and o.tie is not None:
            d[-1], e0[-1], e1[-1] = o.tie
        bounds = np.append(self.strata, len(self.starts))
        c0, c1 = (np.concatenate([np.cumsum(s[::-1], axis=0)[::-1], np.zeros_like(s[:1])]) for s in (s0, s1))
        sizes = np.diff(bounds)
        s0, s1 = c0[:-1] - np.repeat(c0[bounds[1:]], sizes), c1[:-1] - np.repeat(c1[bounds[1:]], sizes, axis=0)
        if o is not None:
            s0[bounds[-2] :] += o.after[0]
            s1[bounds[-2] :] += o.after[1]
            if not o.owned:
                d[0] = 0
        return eta, w, d, e0, e1, s0, s1

    def steps(self, beta: np.ndarray, o: Outside | None) -> Iterator[tuple]:
        """The hazard steps of the first and the last stratum, and Efron's correction at the last time."""
        _, _, d, e0, _, s0, _ = self.risk_sets(beta, o)
        _, h1, _, corr = tie_sums(s0, e0, d)
        first = self.strata[1] if len(self.strata) > 1 else len(self.starts)
        yield self.part, self.first_g, self.last_g, float(h1[:first].sum()), float(h1[self.strata[-1] :].sum()), float(corr[-1])

    def share(self, beta: np.ndarray, o: Outside | None) -> np.ndarray:
        """The partition's part of log likelihood, score and information, one after the other."""
        eta, w, d, e0, e1, s0, s1 = self.risk_sets(beta, o)
        log, h1, h2, corr = tie_sums(s0, e0, d)
        own = d > 0
        u = e1[own] / e0[own, None]
        v = s1[own] - s0[own, None] * u
        loglik = eta[self.event].sum() - log.sum()
        score = self.x[self.event].sum(axis=0) - (d[own, None] * u + h1[own, None] * v).sum(axis=0)
        cross = (u * h1[own, None]).T @ v
        means = (u * d[own, None]).T @ u + cross + cross.T + (v * h2[own, None]).T @ v
        if o is not None and not o.owned:
            corr[0] = o.correction
        counts = np.diff(np.append(self.starts, len(self.time)))
        weight = w * (self.hazards(h1, o) - np.where(self.event, np.repeat(corr, counts), 0.0))
        info = (self.x * weight[:, None]).T @ self.x - means
        return np.concatenate([[loglik], score, info.ravel()])

    def hazards(self, h: np.ndarray, o: Outside | None) -> np.ndarray:
        """Each row's cumulative hazard from the steps by time."""
        upto = np.cumsum(h)
        sizes = np.diff(np.append(self.strata, len(self.starts)))
        out = upto - np.repeat(np.append(0.0, upto)[self.strata], sizes)
        if o is not None:
            out[: sizes[0]] += o.hazard
        return np.repeat(out, np.diff(np.append(self.starts, len(self.time))))

    def breslow_steps(self, beta: np.ndarray, some: np.ndarray, o: Outside | None) -> Iterator[tuple]:
        _, _, d, _, _, s0, _ = self.risk_sets(beta, o, some)
        h = np.where(d > 0, d / s0, 0.0)
        first = self.strata[1] if len(self.strata) > 1 else len(self.starts)
        yield self.part, self.first_g, self.last_g, float(h[:first].sum()), float(h[self.strata[-1] :].sum()), 0.0

    def breslow(self, beta: np.ndarray, some: np.ndarray, o: Outside | None) -> np.ndarray:
        """Log likelihood, score, and information among some covariates, with Breslow's ties, one after the other."""
        eta, w, d, _, _, s0, s1 = self.risk_sets(beta, o, some)
        own = d > 0
        h = np.where(own, d / s0, 0.0)
        weight, x = w * self.hazards(h, o), self.x[:, some]
        loglik = eta[self.event].sum() - (d[own] * np.log(s0[own])).sum()
        score = self.x.T @ (self.event - weight)
        info = (x * weight[:, None]).T @ x - (s1[own] * (d[own] / s0[own] ** 2)[:, None]).T @ s1[own]
        return np.concatenate([[loglik], score, info.ravel()])
