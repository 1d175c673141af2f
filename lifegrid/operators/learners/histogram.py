"""Survival forests and boosting at any size: trees grown level by level from histograms of binned features.

Features are cut at quantiles into at most ``BINS`` bins, a byte each; rows lie sorted by time over partitions and stay there. To grow a
level, each task finds its rows' nodes from the trees so far and counts; the counts of all tasks are added up, and the best
split of each node follows from them. So no task holds the matrix, rows never move, and what comes back is as large as the trees.

A forest counts rows and events by (tree, node, feature, bin, slot of time) and splits by the log-rank statistic; the draws of a
tree are Poisson weights by the hash of row, tree and seed. Boosting sums the Cox gradient by (node, feature, bin);
risk sets and cumulative hazards run through the partitions as in ``likelihood``, so each row's gradient is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...errors import UserInputError
from ...functions.stats import mixed
from ..likelihood import ADDED, EDGE, Edge, added, before, behind
from .models import Boosted, Forest, Tree, permutation_importance

BINS = 32
#: Slots of time of a forest's counts: event times, or so many quantiles of them.
SLOTS = 64
#: Bytes of codes that a task holds.
BYTES = 32_000_000
#: Trees whose sum is kept as a column at a time, in boosting.
REFRESH = 10


class Rows:
    """A partition's rows: codes, slots of time, and the starts of its distinct times."""

    def __init__(self, t: pa.Table, p: int):
        t = t.combine_chunks()
        self.part = t.column("part")[0].as_py()
        self.key = t.column("key").to_numpy().astype(np.uint64)
        self.time, self.event, self.eta = t.column("time").to_numpy(), t.column("event").to_numpy() == 1, t.column("eta").to_numpy()
        self.codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, p)
        self.starts = np.flatnonzero(np.append(True, self.time[1:] != self.time[:-1]))

    def weights(self, trees: list[Tree], rate: float) -> np.ndarray:
        return np.exp(self.eta + added_up(trees, rate, self.codes))

    def edges(self, w: np.ndarray) -> tuple:
        none = b""
        add = lambda v: np.add.reduceat(v, self.starts)
        d, e0 = add(self.event.astype(float)), add(np.where(self.event, w, 0.0))
        at = lambda i: (float(d[i]), float(e0[i]), none)
        return (self.part, "", float(self.time[0]), float(self.time[-1]), float(w.sum()), none, *at(0), *at(-1))

    def steps(self, w: np.ndarray, o) -> np.ndarray:
        """Breslow's hazard step of each distinct time, 0 where another partition owns it."""
        d, s0 = (np.add.reduceat(v, self.starts) for v in (self.event.astype(float), w))
        s0 = np.cumsum(s0[::-1])[::-1]
        if o is not None:
            s0 = s0 + o.after[0]
            if o.tie is not None:
                d[-1] = o.tie[0]
            if not o.owned:
                d[0] = 0.0
        return d / s0

    def gradient(self, w: np.ndarray, o) -> np.ndarray:
        hazard = np.cumsum(self.steps(w, o)) + (o.hazard if o is not None else 0.0)
        return self.event - w * np.repeat(hazard, np.diff(np.append(self.starts, len(self.time))))


def added_up(trees: list[Tree], rate: float, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes))
    for tree in trees:
        out += rate * np.array([0.0 if v is None else v for v in tree.leaves])[tree.apply(codes)]
    return out


def poisson(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson weights of mean 1 from a hash."""
    below = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])
    return np.searchsorted(below, (mixed(key, tree, seed) >> np.uint64(11)).astype(float) * 2.0**-53, side="right")


@dataclass
class Binned:
    """The binned rows, kept in storage until ``release``; cuts are the thresholds of each feature, slots the times of a forest's counts."""

    df: DataFrame
    names: list[str]
    cuts: list[np.ndarray]
    slots: np.ndarray
    parts: int
    n: int

    def release(self) -> None:
        self.df.unpersist()

    def each(self, run, schema: str, df: DataFrame | None = None) -> DataFrame:
        """run(Rows) over each partition yields tuples in the order of schema."""
        p, names = len(self.names), [x.split()[0] for x in schema.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                for row in run(Rows(pa.Table.from_batches(held), p)):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        return (self.df if df is None else df).mapInArrow(task, schema)

    def total(self, run, df: DataFrame | None = None) -> np.ndarray:
        """The sum over partitions of run(Rows), an array each; many partitions are added up in tasks first."""
        each = self.each(lambda r: [(r.part, np.ascontiguousarray(run(r), float).tobytes())], "part int, sums binary", df)
        if self.parts > ADDED:
            width = math.ceil(self.parts / ADDED)
            each = each.withColumn("part", F.floor(F.col("part") / width).cast("int")).groupBy("part").applyInArrow(added, "part int, sums binary")
        return np.sum([np.frombuffer(bytes(r["sums"])) for r in sorted(each.collect(), key=lambda r: r["part"])], axis=0)

    def raw(self, tree: Tree) -> Tree:
        """The tree with thresholds on the features' own scale: code <= bin is the same as value <= cut."""
        th = [float(self.cuts[f][int(b)]) if f >= 0 else None for f, b in zip(tree.feature, tree.threshold, strict=True)]
        return Tree(tree.feature, th, tree.left, tree.right, tree.leaves)


def bin_rows(df: DataFrame, names: list[str], bins: int = BINS, slots: int = SLOTS, held: int | None = None, cuts: list[list[float]] | None = None) -> Binned:
    """df has _row_id, time, event and numeric columns without nulls. Cuts are approximate quantiles unless given; each ends a bin."""
    if not 2 <= bins <= 256:
        raise UserInputError("2 to 256 bins")
    cols = [F.col(f"`{c}`").cast("double") for c in names]
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"h{i}") for i, c in enumerate(cols)]).first()
    if not r.n:
        raise UserInputError("no rows")
    cuts = [np.array(sorted({x for x in (r[f"q{i}"] or [] if cuts is None else cuts[i]) if x < r[f"h{i}"]})) for i in range(len(names))]
    events = df.filter("event = 1").select(F.col("time").cast("double").alias("time"))
    known = [x.time for x in events.distinct().limit(slots + 1).collect()]
    if len(known) > slots:
        known = events.agg(F.percentile_approx("time", F.array(*[F.lit(i / slots) for i in range(1, slots + 1)]), F.lit(10_000)).alias("q"), F.max("time").alias("h")).first()
        known = [*known.q, known.h]
    if not known:
        raise UserInputError("The cohort has no events.")
    parts = max(1, math.ceil(r.n * (len(names) + 32) / (held or BYTES)))
    flat = df.select(F.xxhash64("_row_id").alias("key"), F.col("time").cast("double").alias("time"), F.col("event").cast("int").alias("event"), *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    dealt = (flat.repartition(1) if parts == 1 else flat.repartitionByRange(parts, "time", "key")).sortWithinPartitions("time", "key").withColumn("part", F.spark_partition_id())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.column_stack([np.searchsorted(c, b.column(f"x{i}").to_numpy()) for i, c in enumerate(cuts)]).astype(np.uint8)
            offsets = np.arange(0, codes.size + 1, len(cuts), dtype=np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "time", "event", "part")), packed, pa.array(np.zeros(b.num_rows))], ["key", "time", "event", "part", "codes", "eta"])

    coded = dealt.mapInArrow(code, "key long, time double, event int, part int, codes binary, eta double").persist()
    return Binned(coded, list(names), cuts, np.unique(np.array(known, float)), parts, int(r.n))


# forest


def slot_counts(r: Rows, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many slots each row is at risk in, and its event's slot: events move to the slot at or behind them."""
    at = np.searchsorted(slots, r.time)
    return np.where(r.event, at + 1, np.searchsorted(slots, r.time, side="right")), at


def chosen_features(seed: int, tree: int, node: int, p: int, per: int) -> list[int]:
    return list(range(p)) if per >= p else sorted(np.random.default_rng([seed, tree, node]).choice(p, per, replace=False).tolist())


def node_counts(r: Rows, trees: list[Tree], active: list[list[int]], slots: np.ndarray, bins: int, per: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """tree, node and the counts (feature, bin, [rows at risk in k slots for k = 0.., events by slot]) of a partition."""
    k, at = slot_counts(r, slots)
    t, p = len(slots), r.codes.shape[1]
    for i, (tree, nodes) in enumerate(zip(trees, active, strict=True)):
        if not nodes:
            continue
        number = np.full(len(tree.feature), -1)
        number[nodes] = np.arange(len(nodes))
        of, w = number[tree.apply(r.codes)], poisson(r.key, i, seed)
        rows = np.flatnonzero((of >= 0) & (w > 0))
        of, w, ev = of[rows], w[rows], r.event[rows]
        features = np.array([chosen_features(seed, i, n, p, per) for n in nodes])
        out = np.zeros((len(nodes), features.shape[1], bins, 2 * t + 1), np.uint32)
        for j in range(features.shape[1]):
            cell = of * bins + r.codes[rows, features[of, j]]
            out[:, j, :, : t + 1] = np.bincount(cell * (t + 1) + k[rows], w, len(nodes) * bins * (t + 1)).reshape(len(nodes), bins, t + 1)
            out[:, j, :, t + 1 :] = np.bincount(cell[ev] * t + at[rows][ev], w[ev], len(nodes) * bins * t).reshape(len(nodes), bins, t)
        for n, counts in zip(nodes, out, strict=True):
            if counts.any():
                yield i, n, counts


def nelson(at_risk: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.cumsum(np.where(d > 0, d / np.maximum(at_risk, 1), 0.0))


def logrank_gains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The log-rank statistic of every split (feature, bin), the rows on its left, and at risk and events by slot on its left."""
    t = (counts.shape[2] - 1) // 2
    left = np.cumsum(counts.astype(float), axis=1)
    size = left[:, :, : t + 1].sum(axis=2)
    at_risk = lambda c: c[..., ::-1].cumsum(axis=-1)[..., ::-1][..., 1:]
    n1, d1 = at_risk(left[:, :, : t + 1]), left[:, :, t + 1 :]
    n, d = n1[:, -1:, :], d1[:, -1:, :]
    v = np.where(n > 1, d * (n - d) / np.maximum(n - 1, 1), 0.0)
    q = np.divide(n1, n, out=np.zeros_like(n1), where=n > 0)
    var = (v * q * (1 - q)).sum(axis=2)
    return np.where(var > 1e-12, (d1 - d * q).sum(axis=2) ** 2 / np.maximum(var, 1e-300), 0.0), size, n1, d1


def root_scan(rows: Binned) -> DataFrame:
    """feature, cut, n_left and chisq of every split of all rows, each counted once: what a tree chooses from at its root."""
    bins, slots, p = max(len(c) for c in rows.cuts) + 1, rows.slots, len(rows.names)

    def count(r: Rows) -> np.ndarray:
        k, at = slot_counts(r, slots)
        t, ev = len(slots), r.event
        out = np.zeros((p, bins, 2 * t + 1))
        for j in range(p):
            cell = r.codes[:, j].astype(np.int64)
            out[j, :, : t + 1] = np.bincount(cell * (t + 1) + k, minlength=bins * (t + 1)).reshape(bins, t + 1)
            out[j, :, t + 1 :] = np.bincount(cell[ev] * t + at[ev], minlength=bins * t).reshape(bins, t)
        return out

    gains, size, _, _ = logrank_gains(rows.total(count).reshape(p, bins, -1))
    found = [(name, float(c), int(size[j, b]), float(gains[j, b])) for j, name in enumerate(rows.names) for b, c in enumerate(rows.cuts[j])]
    return rows.df.sparkSession.createDataFrame(found, "feature string, cut double, n_left long, chisq double")


def best_logrank(counts: np.ndarray, least: int) -> tuple[int, int, float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """The split (position of the feature, bin) of the greatest log-rank statistic with at least so many rows on either side, its
    statistic (0: none), cumulative hazards of the node and both sides, and the rows of both."""
    gain, size, n1, d1 = logrank_gains(counts)
    n, d, whole = n1[:, -1:, :], d1[:, -1:, :], size[:, -1:]
    gain = np.where((size >= least) & (whole - size >= least), gain, 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    own = nelson(n[0, 0], d[0, 0])
    return int(f), int(b), float(gain[f, b]), own, nelson(n1[f, b], d1[f, b]), nelson(n[f, 0] - n1[f, b], d[f, 0] - d1[f, b]), float(size[f, b]), float(whole[f, 0] - size[f, b])


def fit_forest(rows: Binned, n_estimators: int = 100, max_depth: int = 6, min_leaf: int = 6, seed: int = 42, features_per_node: int | None = None) -> Forest:
    """All trees grow a level together: one pass over the rows and one over the counts by (tree, node)."""
    p, t = len(rows.names), len(rows.slots)
    per = features_per_node or max(1, int(math.sqrt(p)))
    bins = max(len(c) for c in rows.cuts) + 1
    trees = [Tree() for _ in range(n_estimators)]
    active = [[tree.add()] for tree in trees]
    spark, slots = rows.df.sparkSession, rows.slots

    def split(g: pa.Table) -> pa.Table:
        counts = np.sum([np.frombuffer(x, np.uint32).astype(np.int64) for x in g.column("counts").to_pylist()], axis=0).reshape(-1, bins, 2 * t + 1)
        f, b, gain, own, one, other, n1, n2 = best_logrank(counts, min_leaf)
        tree, node = g.column("tree")[0].as_py(), g.column("node")[0].as_py()
        feature = chosen_features(seed, tree, node, p, per)[f]
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()), "bin": pa.array([b], pa.int32()), "gain": [gain], "own": raw(own), "one": raw(one), "other": raw(other), "n1": [n1], "n2": [n2]})

    for level in range(max_depth):
        if not any(active):
            break
        sent = spark.sparkContext.broadcast((trees, active))

        def count(r: Rows, sent=sent) -> Iterator[tuple]:
            for tree, node, counts in node_counts(r, *sent.value, slots, bins, per, seed):
                yield tree, node, counts.tobytes()

        found = rows.each(count, "tree int, node int, counts binary").groupBy("tree", "node").applyInArrow(split, "tree int, node int, feature int, bin int, gain double, own binary, one binary, other binary, n1 double, n2 double").collect()
        sent.unpersist()
        active = [[] for _ in trees]
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            tree, node = trees[r["tree"]], r["node"]
            if level == 0:
                tree.leaves[node] = np.frombuffer(bytes(r["own"]))
            if r["gain"] <= 1e-12:
                continue
            tree.feature[node], tree.threshold[node], tree.leaves[node] = r["feature"], float(r["bin"]), None
            tree.left[node], tree.right[node] = tree.add(), tree.add()
            for child, leaf, n in ((tree.left[node], r["one"], r["n1"]), (tree.right[node], r["other"], r["n2"])):
                tree.leaves[child] = np.frombuffer(bytes(leaf))
                if n >= 2 * min_leaf:
                    active[r["tree"]].append(child)
    return Forest([rows.raw(x) for x in trees], rows.slots)


# boosting


def boosting_outside(rows: Binned, df: DataFrame, trees: list[Tree], rate: float) -> dict:
    """What each partition has to know of the others for its gradients."""
    if rows.parts == 1:
        return {}
    edges = [Edge(*r) for r in rows.each(lambda r: [r.edges(r.weights(trees, rate))], EDGE, df).collect()]
    outside = behind(edges)
    sent = rows.df.sparkSession.sparkContext.broadcast(outside)

    def steps(r: Rows) -> list[tuple]:
        h = float(r.steps(r.weights(trees, rate), sent.value.get(r.part)).sum())
        return [(r.part, "", "", h, h, 0.0)]

    found = rows.each(steps, "part int, first_g string, last_g string, first double, last double, correction double", df).collect()
    sent.unpersist()
    before(outside, [tuple(x) for x in found])
    return outside


def best_mean(sums: np.ndarray, least: int) -> tuple[int, int, float]:
    """The split of a node from (feature, bin, [gradient sum, rows]) that lowers the squared error most; gain 0: none."""
    left = np.cumsum(sums, axis=1)
    s1, n1, s, n = left[:, :, 0], left[:, :, 1], left[:, -1:, 0], left[:, -1:, 1]
    ok = (n1 >= least) & (n - n1 >= least)
    gain = np.where(ok, s1**2 / np.maximum(n1, 1) + (s - s1) ** 2 / np.maximum(n - n1, 1) - s**2 / np.maximum(n, 1), 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b), float(gain[f, b])


def fit_boosted(rows: Binned, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, min_leaf: int = 10) -> Boosted:
    """Regression trees on the Cox gradient; one pass over the rows for each level of each tree, and two for its risk sets."""
    p, bins, spark = len(rows.names), max(len(c) for c in rows.cuts) + 1, rows.df.sparkSession
    trees: list[Tree] = []
    used = np.zeros(p)
    df, kept = rows.df, 0

    def level_sums(r: Rows, new: list[Tree], tree: Tree, nodes: list[int], outside: dict) -> np.ndarray:
        g = r.gradient(r.weights(new, learning_rate), outside.get(r.part))
        number = np.full(len(tree.feature), -1)
        number[nodes] = np.arange(len(nodes))
        of = number[tree.apply(r.codes)]
        some = of >= 0
        out = np.zeros((len(nodes), p, bins, 2))
        for j in range(p):
            cell = of[some] * bins + r.codes[some, j]
            out[:, j, :, 0] = np.bincount(cell, g[some], len(nodes) * bins).reshape(-1, bins)
            out[:, j, :, 1] = np.bincount(cell, minlength=len(nodes) * bins).reshape(-1, bins)
        return out

    def refreshed() -> DataFrame:
        """The rows with the sum of all trees so far, from the first rows anew: no chain of steps builds up."""
        done = list(trees)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, p)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "time", "event", "part", "codes")), pa.array(added_up(done, learning_rate, codes))], ["key", "time", "event", "part", "codes", "eta"])

        return rows.df.mapInArrow(add, rows.df.schema).persist()

    try:
        for _ in range(n_estimators):
            new = trees[kept:]
            outside = boosting_outside(rows, df, new, learning_rate)
            sent = spark.sparkContext.broadcast(outside)
            tree = Tree()
            nodes = [tree.add()]
            for level in range(max_depth):
                sums = rows.total(lambda r: level_sums(r, new, tree, nodes, sent.value), df).reshape(len(nodes), p, bins, 2)  # noqa: B023
                nxt = []
                for node, s in zip(nodes, sums, strict=True):
                    if level == 0:
                        tree.leaves[node] = float(s[0, :, 0].sum() / max(s[0, :, 1].sum(), 1))
                    f, b, gain = best_mean(s, min_leaf)
                    if gain <= 1e-12:
                        continue
                    tree.feature[node], tree.threshold[node], tree.leaves[node] = f, float(b), None
                    tree.left[node], tree.right[node] = tree.add(), tree.add()
                    used[f] += 1
                    for child, part in ((tree.left[node], s[f, : b + 1]), (tree.right[node], s[f, b + 1 :])):
                        tree.leaves[child] = float(part[:, 0].sum() / max(part[:, 1].sum(), 1))
                        if part[:, 1].sum() >= 2 * min_leaf:
                            nxt.append(child)
                nodes = nxt
                if not nodes:
                    break
            sent.unpersist()
            trees.append(tree)
            if len(trees) - kept >= REFRESH:
                old, df, kept = df, refreshed(), len(trees)
                df.count()
                if old is not rows.df:
                    old.unpersist()
        new, slots = trees[kept:], rows.slots
        outside = boosting_outside(rows, df, new, learning_rate)

        def hazards(r: Rows) -> np.ndarray:
            h = r.steps(r.weights(new, learning_rate), outside.get(r.part))
            return np.bincount(np.searchsorted(slots, r.time[r.starts])[h > 0], h[h > 0], len(slots) + 1)

        base = np.cumsum(rows.total(hazards, df)[: len(slots)])
    finally:
        if df is not rows.df:
            df.unpersist()
    return Boosted([rows.raw(x) for x in trees], learning_rate, (rows.slots, base), used / max(used.sum(), 1))


# prediction


def predict(df: DataFrame, model, names: list[str], times: list[float] = ()) -> DataFrame:
    """_row_id, time, event and risk, and, if times are given, surv: the survival at each."""
    keep = ["_row_id", "time", "event"]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", risk double" + (", surv array<double>" if len(times) else "")
    sent = df.sparkSession.sparkContext.broadcast((model, np.array(times, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at = sent.value
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(len(keep), b.num_columns)]).astype(float)
            cols = [*b.columns[: len(keep)], pa.array(m.risk(x), pa.float64())]
            if len(at):
                cols.append(pa.array(list(m.survival(x, at)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, [*keep, "risk", *(["surv"] if len(at) else [])])

    return df.select(*keep, *[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(run, schema)


def forest_importance(df: DataFrame, forest: Forest, names: list[str], seed: int = 42, rows: int = 120) -> np.ndarray:
    """Permutation importance over the rows of least hash, so many as the importance of the small forest takes."""
    some = df.orderBy(F.xxhash64("_row_id", F.lit(seed)), "_row_id").select("time", "event", *[F.col(f"`{c}`").cast("double") for c in names]).limit(rows).toPandas()
    return permutation_importance(forest, some[names].to_numpy(float), some.time.to_numpy(float), some.event.to_numpy(int), seed)
