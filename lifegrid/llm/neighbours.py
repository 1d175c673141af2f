"""Approximate nearest neighbours by counting collisions on single projections (query-aware hashing).

Every block of vectors keeps, for each of ``projections`` random lines, its vectors' projections as a
sorted array. A query opens a window around its own projection on each line, of half width ``factor`` times the
radius; virtual rehashing widens all windows step by step (radius times ``growth``), and only what a step adds is
counted. A vector that falls into the windows of at least ``threshold`` lines is verified by its exact cosine. A query is done in
a block when its k-th best verified distance is within the radius, for then a nearer vector would have collided on
enough lines with high probability, or when all vectors are verified.

A vector at distance d collides on a line with probability P(|Z| <= factor * radius / d), Z standard normal. With factor 1.9 and
256 lines the threshold stands 1.1 standard deviations below the expected collisions at d = radius. The first radius comes from the
block's own k-th distances at a few probes; where its windows hold more than half of the lines' entries, what lies outside of them is counted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two (which is exact), so that squares neither overflow nor vanish; cosines don't change."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


class Block:
    """The sorted projections of one block of vectors, and the vectors for verification."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, factor: float, k: int, seed: int = 5):
        self.ids, self.vectors, self.factor, self.k = ids, scaled(vectors), factor, k
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = (self.vectors / self.norms[:, None]).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((vectors.shape[1], projections)).astype(np.float32)
        at = (unit @ self.lines).T
        self.order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, self.order, axis=1)
        share = math.erf(factor / math.sqrt(2))
        self.threshold = math.ceil(share * projections - 1.1 * math.sqrt(share * (1 - share) * projections))
        self.verified = self.asked = 0
        probes = rng.choice(len(ids), min(32, len(ids)), replace=False)
        cosines = np.sort(unit[probes] @ unit.T, axis=1)[:, max(0, len(ids) - 1 - k)]
        self.start = max(0.05, 0.85 * float(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * cosines)), 0.25)))

    def search(self, owns: np.ndarray, queries: np.ndarray, growth: float):
        """For each query the ids and cosines of the k best found, best first, ties to smaller ids. One row of the id in owns
        and the query's vector is its own and no candidate. No unit vectors are more than 2 apart: what the last window leaves is verified too, if need be."""
        radii = self.start * growth ** np.arange(max(1, math.ceil(math.log(2 / self.start, growth)) + 1))
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        centres = (queries / norms[:, None]).astype(np.float32) @ self.lines
        around = centres[:, :, None] + self.factor * np.concatenate([-radii[::-1], radii]).astype(np.float32)
        # windows[query, line] = positions of the falling lower and the rising upper ends
        windows = np.stack([np.searchsorted(s, around[:, i]) for i, s in enumerate(self.sorted)], axis=1)
        for own, q, norm, window in zip(owns, queries, norms, windows, strict=True):
            yield self._expand(own, q, float(norm), window, radii)

    def _expand(self, own: int, q: np.ndarray, norm: float, window: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, r, k = len(self.ids), len(radii), self.k
        seen = np.zeros(n, bool)
        mine = np.flatnonzero(self.ids == own)
        mine = mine[(self.vectors[mine] == q).all(axis=1)][:1]
        seen[mine] = True
        ids, cosines = np.empty(0, np.int64), np.empty(0)
        low, high = window[:, r - 1], window[:, r]
        if 2 * (high - low).sum() > n * len(self.order):
            outside = [x for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True) for x in (o[:a], o[b:])]
            counts = len(self.order) - np.bincount(np.concatenate(outside), minlength=n)
        else:
            counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low.tolist(), high.tolist(), strict=True)]), minlength=n)
        for j in range(r + 1):
            if 0 < j < r:
                a, b = window[:, r - 1 - j], window[:, r + j]
                new = [x for o, a0, a1, b0, b1 in zip(self.order, a.tolist(), low.tolist(), high.tolist(), b.tolist(), strict=True) for x in (o[a0:a1], o[b0:b1])]
                counts += np.bincount(np.concatenate(new), minlength=n)
                low, high = a, b
            fresh = np.flatnonzero((counts >= self.threshold) & ~seen) if j < r else np.flatnonzero(~seen)
            if len(fresh):
                seen[fresh] = True
                cos = (self.vectors[fresh] * q).sum(axis=1) / (self.norms[fresh] * norm)
                ids, cosines = np.concatenate([ids, self.ids[fresh]]), np.concatenate([cosines, cos])
                best = np.lexsort((ids, -cosines))[:k]
                ids, cosines = ids[best], cosines[best]
            if j < r and len(ids) == k and math.sqrt(max(0.0, 2 - 2 * cosines[-1])) <= radii[j]:
                break
        self.verified += int(seen.sum()) - len(mine)
        self.asked += 1
        return ids, cosines


def valid(v):
    """A vector that takes part: not null, no null, NaN or infinite component, not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = 256, factor: float = 1.9, growth: float = 1.02, block_rows: int = 16_384, query_rows: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors by cosine.

    Both have vec_id and embedding; a query's own row (one of its vec_id and vector) is no candidate. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do rows of null vec_id; vectors of different length are never compared. Fewer
    candidates than k give fewer rows. Repeated rows are candidates each, but one query; one vec_id with several vectors
    is a query for each of them. Blocks of vectors meet blocks of queries, so no task holds
    more than block_rows vectors and query_rows queries, each about; every row is indexed. Other columns are not read.
    """
    def clean(t):
        v = F.col("embedding")
        return t.filter(F.col("vec_id").isNotNull() & valid(v)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))

    base = clean(vectors)
    asked = clean(queries).dropDuplicates(["vec_id", "v"]).withColumn("h", F.xxhash64("v"))
    n, m = base.count(), asked.count()
    blocks, parts = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    deal = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    left = base.withColumns({"d": deal("vec_id", blocks), "q": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = asked.withColumns({"q": deal("vec_id", parts), "d": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t.column("v").combine_chunks()
        return t.column("vec_id").to_numpy(), v.values.to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(np.float64)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out_q, out_h, out_v, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(a) and len(b):
            block = Block(*matrix(a), projections, factor, k)
            owns, queries = matrix(b)
            hashes = b.column("h").to_numpy()
            for at in range(0, len(owns), 64):
                some = owns[at : at + 64]
                for own, h, (ids, cos) in zip(some, hashes[at : at + 64], block.search(some, queries[at : at + 64], growth), strict=True):
                    out_q.append(np.full(len(ids), own))
                    out_h.append(np.full(len(ids), h))
                    out_v.append(ids)
                    out_s.append(cos)
        return pa.table({"query_id": np.concatenate(out_q), "h": np.concatenate(out_h), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})

    keys = ["dim", "d", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, h long, vec_id long, score double")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
