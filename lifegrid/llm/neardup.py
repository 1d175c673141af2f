"""Near-duplicate classes by ProbMinHash, banding and verification.

The weight of a 5-word shingle is how often a text holds it. Each shingle sends a Poisson process of
arrivals, of its weight as rate, to random slots of a signature; a slot keeps the shingle that came
first. A shingle is done when its next arrival is later than all slots' first ones. The share of equal slots estimates the
probability Jaccard similarity J_P of two weighted sets, which then is computed exactly for candidates.

Texts of equal weighted sets are one node. Nodes that share a band form a bucket; links are sought
so that every pair in a bucket is either verified, already connected, or proven unlike:

1. Each bucket's most popular node (whose buckets hold the most) is verified with all others.
2. For nodes of buckets still in several components, rarest shingles first, let the first shingle that two of them share
   have the mass p before it in a node of mass m. What stands before it isn't shared, so that
   J_P <= 1 / (1 + p / (m - p) + q / (n - q)) for masses m, n and p, q before it. Pairs of different components that share a shingle where this allows the
   threshold are compared; so only a node's first fifth of mass is looked at, and no other pair can be alike. Then a bitmap of each
   set says how much of either is not in the other at least, which puts the same bound on them. What both allow is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_side, table
from .pieces import groups, hold
from .shingles import counted, mix, shingle_hashes, word_hashes

SLOTS_A_BAND = 5
BANDS = 25
#: Longs in the bitmap of a set of shingles.
MAP = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, w, _ = word_hashes(texts)
    return counted(*shingle_hashes(d, w))


def signatures(n: int, d: np.ndarray, h: np.ndarray, weight: np.ndarray, slots: int) -> np.ndarray:
    """n x slots ids of the shingles that arrived first."""
    first = np.full(n * slots, np.inf)
    ids = np.zeros(n * slots, np.uint64)
    time, at = np.zeros(len(h)), np.arange(len(h))
    step = np.uint64(0)
    while len(at):
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            u = mix(h[at] + step * _GOLD)
            v = mix(u ^ np.uint64(0xD1B54A32D192ED03))
        time[at] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[at]
        cell = d[at] * slots + (v % np.uint64(slots)).astype(np.int64)
        t = time[at]
        sooner = t < first[cell]
        np.minimum.at(first, cell[sooner], t[sooner])
        won = sooner & (first[cell] == t)
        ids[cell[won]] = h[at[won]]
        last = first.reshape(n, slots).max(axis=1)
        at = at[t < last[d[at]]]  # early termination
    return ids.reshape(n, slots)


def prob_jaccard(hx: np.ndarray, cx: np.ndarray, hy: np.ndarray, cy: np.ndarray) -> float:
    """Exact J_P = sum over shared i of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = cx[i].astype(float), cy[j].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below = cx.sum() - x.sum() + np.cumsum(x)
    above = cy.sum() - np.cumsum(y)  # those of larger y / x, and those only y has
    return float(np.sum(1.0 / (below / x + above / y)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = SLOTS_A_BAND * BANDS
    hold(("signatures",), dict)
    for whole in batches:
        texts = whole.column("text").to_pylist()
        for a, z in groups(texts):
            n = z - a
            d, h, c = weighted_sets(texts[a:z])
            f1, f2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            with np.errstate(over="ignore"):
                one = mix(h + c.astype(np.uint64) * _GOLD)
                np.add.at(f1, d, one)
                np.add.at(f2, d, mix(one ^ np.uint64(0xA0761D6478BD642F)))
                sig = signatures(n, d, h, c.astype(np.float64), slots).reshape(n, BANDS, SLOTS_A_BAND)
                band = np.zeros((n, BANDS), np.uint64)
                for k in range(SLOTS_A_BAND):
                    band = mix(band * _GOLD + sig[:, :, k])
            has = np.bincount(d, minlength=n) > 0
            flat = pa.array(band.reshape(-1).view(np.int64))
            cols = [pa.array(f1.view(np.int64), mask=~has), pa.array(f2.view(np.int64), mask=~has), pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), flat)]
            yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(a, n), *cols], ["doc_id", "f1", "f2", "bands"])


def _verify(threshold: float):
    """Rows of a, b, text in order: a leader's row (b is null), then those that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("verify",), dict)
        leader: tuple = ()
        for whole in batches:
            a, b, texts = (whole.column(c).to_pylist() for c in ("a", "b", "text"))
            hit = np.zeros(len(a), bool)
            for start, end in groups(texts):
                d, h, c = weighted_sets(texts[start:end])
                edge = np.searchsorted(d, np.arange(end - start + 1))
                for i in range(start, end):
                    mine = slice(edge[i - start], edge[i - start + 1])
                    if b[i] is None:
                        leader = (h[mine].copy(), c[mine].copy())
                    else:
                        hit[i] = prob_jaccard(*leader, h[mine], c[mine]) >= threshold
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([whole.column("a").filter(keep), whole.column("b").filter(keep)], ["a", "b"])

    return run


def links(pairs: DataFrame, docs: DataFrame, threshold: float, at_once: int = 200) -> DataFrame:
    """The pairs (a, b) of node ids whose exact similarity is at least threshold.

    The text of b goes with its pair; that of a goes once for each about at_once of its pairs, before them in the order in
    which tasks read, so that a popular a is spread over tasks and is hashed once in each.
    """
    need = small_side(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(need, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / at_once).cast("int").alias("slots"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("s"), "b")
    others = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "s", "b", "text")
    leaders = many.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("s"), F.lit(None).cast("long").alias("b"), "text")
    return others.unionByName(leaders).repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first()).mapInArrow(_verify(threshold), "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (its component's least node) of the nodes of edges (a, b): least labels of neighbours,
    then the labels' labels, until nothing changes. Each round is a written table."""
    both = scratch.put(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("cb"))
        low = label.join(near, "node").select("node", F.least("comp", "cb").alias("low"), F.col("comp").alias("was"))
        jump = low.join(label.select(F.col("node").alias("low"), F.col("comp").alias("next")), "low").select("node", F.least("low", "next").alias("comp"), "was")
        new = scratch.put(jump, "labels")
        changed = new.filter(F.col("comp") != F.col("was")).limit(1).count()
        scratch.drop(label)
        label = new
        if not changed:
            return label.select("node", "comp")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text: its shingles, how often it holds each, and a bitmap in which each shingle sets one bit."""
    for whole in batches:
        texts = whole.column("text").to_pylist()
        for a, z in groups(texts):
            d, h, c = weighted_sets(texts[a:z])
            ends = np.searchsorted(d, np.arange(z - a + 1)).astype(np.int32)
            bits = np.zeros((z - a, MAP), np.uint64)
            spot = h % np.uint64(MAP * 64)
            np.bitwise_or.at(bits, (d, (spot // np.uint64(64)).astype(np.int64)), np.uint64(1) << (spot % np.uint64(64)))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (h.view(np.int64), c.astype(np.int64))]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a) * MAP + 1, MAP, dtype=np.int32)), pa.array(bits.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(a, z - a), *lists, flat], ["node", "h", "c", "bits"])


def may_be_alike(p: Column, m: Column, q: Column, n: Column, threshold: float) -> Column:
    """Whether 1 / (1 + p / (m - p) + q / (n - q)), the most that J_P can be if masses p of m and q of n aren't shared, reaches
    the threshold. As p / (m - p) = m / (m - p) - 1, each term stands here once."""
    return m / (m - p + 1e-9) + n / (n - q + 1e-9) <= 1 / threshold + 1 + 1e-6


def alike_by_prefix(sets: DataFrame, comps: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes of different components that may be alike: see step 2 above.

    sets is the written table of ``_sets``, comps a row (node, comp) for each node.
    """
    each = sets.select("node", F.explode(F.arrays_zip("h", "c")).alias("s")).select("node", "s.h", "s.c")
    df = each.groupBy("h").agg(F.count("*").alias("df"))
    inside = Window.partitionBy("node")
    before = F.coalesce(F.sum("c").over(inside.orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = each.join(df, "h").select("node", "h", "df", before.cast("double").alias("p"), F.sum("c").over(inside).cast("double").alias("m"))
    zero = F.lit(0.0)
    first = first.filter(may_be_alike(F.col("p"), F.col("m"), zero, F.col("m"), threshold) & (F.col("df") > 1)).drop("df").join(comps, "node")
    first = scratch.put(first, "prefixes")
    mixed = scratch.put(first.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h"), "mixed")
    first = first.join(mixed, "h", "left_semi").join(sets.select("node", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(MAP)]), "node")
    x, y = first.alias("x"), first.alias("y")
    col = lambda t, c: F.col(f"{t}.{c}")
    lacks = lambda s, t: sum((F.bit_count(col(s, f"b{i}").bitwiseAND(F.bitwise_not(col(t, f"b{i}")))) for i in range(MAP)), F.lit(0)).cast("double")
    other = (col("x", "h") == col("y", "h")) & (col("x", "node") < col("y", "node")) & (col("x", "comp") != col("y", "comp"))
    by_order = may_be_alike(col("x", "p"), col("x", "m"), col("y", "p"), col("y", "m"), threshold)
    by_bits = may_be_alike(lacks("x", "y"), col("x", "m"), lacks("y", "x"), col("y", "m"), threshold)
    return x.join(y, other & by_order & by_bits).select(col("x", "node").alias("a"), col("y", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) of every row of docs.

    A class is a connected component of links: J_P of the weighted 5-word shingle sets >= threshold,
    among pairs that share a band (at similarity 0.8 a pair shares none with probability 5e-5). A text of 1 to 4 words has
    one shingle of all its words; texts without words (null, empty, blank) are alone in their class. doc_id identifies a
    document: rows repeated with the same id are one, and of different texts of one id the least is compared. Rows of null id come back with
    class null. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select("doc_id", "text")
    sig = scratch.put(rows.filter(F.col("doc_id").isNotNull()).mapInArrow(_sign, "doc_id long, f1 long, f2 long, bands array<long>"), "signatures")
    nodes = sig.filter(F.col("f1").isNotNull()).groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    each = nodes.select("node", F.posexplode("bands").alias("k", "band")).select("node", F.xxhash64("k", "band").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
    shared = scratch.put(each.join(sizes, "bucket").select("bucket", "node", "size"), "buckets")
    popular = shared.groupBy("node").agg(F.sum("size").alias("pop"))
    ranked = scratch.put(shared.join(popular, "node").select("bucket", "node", "size", "pop"), "ranked")
    scratch.drop(shared)
    leader = ranked.groupBy("bucket").agg(F.max_by("node", F.struct("pop", -F.col("node"))).alias("leader"))
    stars = ranked.join(leader, "bucket").filter(F.col("node") != F.col("leader")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    found = scratch.put(links(scratch.put(stars, "stars"), rows, threshold), "links")
    comp = components(found, scratch)
    # buckets that are not one component yet; in those of two nodes the only pair is verified
    parts = ranked.filter(F.col("size") > 2).join(comp, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    parts = scratch.put(parts, "parts")
    mixed = parts.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket")
    open_ = scratch.put(parts.join(mixed, "bucket", "left_semi").select("node", "comp").distinct(), "open")
    wanted = small_side(open_.select(F.col("node").alias("doc_id")))
    texts = rows.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = scratch.put(texts.mapInArrow(_sets, "node long, h array<long>, c array<long>, bits array<long>"), "sets")
    rest = scratch.put(alike_by_prefix(sets, open_, threshold, scratch), "rest")
    more = scratch.put(links(rest, rows, threshold), "links")
    if more.limit(1).count():
        comp = components(found.union(more), scratch)
    by_set = nodes.select("f1", "f2", "node").join(comp, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("class_id"))
    known = sig.select("doc_id", "f1", "f2").join(by_set, ["f1", "f2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    nulls = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return known.unionByName(nulls)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without those that have a near duplicate of smaller id; rows of null id stay."""
    classes = near_duplicates(docs, threshold).filter(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    return docs.join(classes, "doc_id", "left_anti")


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
