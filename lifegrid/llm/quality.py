"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear model on features of the text by the non-negative
unbiased risk (Kiryo et al. 2017)

    pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1)),

where the class prior pi, the share of positives in unlabelled text, is estimated from a first model's scores: above
any threshold, the share of unlabelled text is at least pi times that of positives (best bin of Garg et al. 2021).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, numbered_schema, table
from .pieces import groups, hold
from .shingles import shingle_hashes, word_hashes

#: Kinds of bytes whose rates are features; every other byte is of the last kind.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "?", "|", "#*", "%$&", "<>{}[]", "=+-_/\\@", "'\"()", ":;"]
HASHED = 1024
DENSE = len(KINDS) + 1 + 10
WIDTH = DENSE + HASHED
_KIND = np.full(256, len(KINDS), np.uint8)
for _k, _chars in enumerate(KINDS):
    _KIND[list(_chars.encode())] = _k
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[48:58] = 48  # any digit


def _distinct(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    if not len(d):
        return np.zeros(n)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    return np.bincount(d[new], minlength=n).astype(float)


def features(texts: list[str | None]) -> np.ndarray:
    """n x WIDTH features of the texts alone: rates of byte kinds, words and repeats, and hashed byte pairs."""
    raws = [(t or "").encode() for t in texts]
    n = len(raws)
    sizes = np.array([len(r) for r in raws], np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    b = np.frombuffer(b"".join(raws), np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    total = np.maximum(sizes, 1).astype(float)
    kinds = np.bincount(doc * (len(KINDS) + 1) + _KIND[b], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    out[:, : len(KINDS) + 1] = np.sqrt(kinds / total[:, None])
    if len(b) > 1:
        f = _FOLD[b]
        pair = (f[:-1] * np.uint32(0x9E3779B1) + f[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(22)
        same = doc[1:] == doc[:-1]
        counts = np.bincount(doc[:-1][same] * HASHED + pair[same].astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        out[:, DENSE:] = np.sqrt(counts / total[:, None])
    d, w, width = word_hashes(texts)
    words = np.bincount(d, minlength=n).astype(float)
    some = np.maximum(words, 1)
    ds, hs = shingle_hashes(d, w)
    shingles = np.maximum(np.bincount(ds, minlength=n), 1).astype(float)
    mean = np.bincount(d, width, n) / some
    again = np.bincount(d[1:][(d[1:] == d[:-1]) & (w[1:] == w[:-1])], minlength=n) if len(d) else np.zeros(n)
    extra = [
        np.log1p(words) / 10, np.minimum(words, 20) / 20, mean / 10, np.sqrt(np.maximum(np.bincount(d, width.astype(float) ** 2, n) / some - mean**2, 0)) / 10,
        again / some, 1 - _distinct(d, w, n) / some, np.sqrt(1 - _distinct(ds, hs, n) / shingles), 1 - _distinct(ds, hs, n) / shingles,
        np.sqrt(np.bincount(d, width > 20, n) / some), (words == 0).astype(float),
    ]
    for k, x in enumerate(extra):
        out[:, len(KINDS) + 1 + k] = x
    return out


@dataclass(frozen=True)
class Quality:
    """A fitted model; score = 1 / (1 + exp(-(x - mean) / scale @ weights - bias))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int, l2: float, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Non-negative risk with the logistic loss, by Adam on whole gradients. Where the negative part falls below
    zero, a step is made against it alone, as the method has it."""
    p, u, w, bias = p.astype(np.float32, copy=False), u.astype(np.float32, copy=False), np.zeros(p.shape[1], np.float32), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for k in range(1, steps + 1):
        zp, zu = p @ w + np.float32(bias), u @ w + np.float32(bias)
        sp, su = (1 / (1 + np.exp(-np.clip(z, -60, 60))) for z in (zp, zu))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # all in single precision: a double vector would make a double copy of the whole matrix
        gu, gn = su / np.float32(len(u)), sp * np.float32(prior / len(p))
        if negative < 0:
            gw, gb = -(u.T @ gu - p.T @ gn), -(gu.sum() - gn.sum())
        else:
            gp = (sp - 1) * np.float32(prior / len(p))
            gw, gb = p.T @ (gp - gn) + u.T @ gu, gp.sum() - gn.sum() + gu.sum()
        g = np.append(gw + np.float32(l2) * w, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, bias = w - step[:-1].astype(np.float32), bias - float(step[-1])
    return w, bias


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """The best bin: the least upper bound of share(U >= c) / share(P >= c) over thresholds c."""
    cuts = np.unique(np.quantile(sp, np.linspace(0.0, 0.98, 99)))
    qp = np.array([(sp >= c).mean() for c in cuts])
    qu = np.array([(su >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(40.0) / (2 * len(su))) + np.sqrt(np.log(40.0) / (2 * len(sp)))
    best = int(np.argmin(qu / qp + slack / qp))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, l2: float = 1e-2) -> Quality:
    """Standardises by the unlabelled sample (in place), estimates the prior on halves that the first model hasn't seen, then fits."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.maximum(scale, np.float32(0.01))
    p, u = positive, unlabelled
    for x in (p, u):
        x -= mean
        x /= scale
        np.clip(x, -8, 8, out=x)
    w, b = _minimise(p[::2], u[::2], 0.5, steps // 2, 1e-3)
    prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b)
    w, b = _minimise(p, u, prior, steps, l2)
    return Quality(mean, scale, w, b, prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for a, z in groups(texts):
            x = features(texts[a:z])
            yield pa.RecordBatch.from_arrays([b.column("positive").slice(a, z - a), pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "x"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model as one row, from all rows of positive and x; none if there are only positives or none."""
    hold(("fit",), dict)
    flags, parts = [np.empty(0, bool)], [np.empty((0, WIDTH), np.float32)]
    for b in batches:
        flags.append(np.asarray(b.column("positive").to_pylist(), bool))
        parts.append(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float32).reshape(-1, WIDTH))
    flag, x = np.concatenate(flags), np.concatenate(parts)
    parts.clear()
    if not flag.any() or flag.all():
        return
    order = np.lexsort((x[:, 5], x[:, 0], x[:, DENSE - 10]))  # an order that doesn't depend on the partitions
    p, u = x[order[flag[order]]], x[order[~flag[order]]]
    del x
    m = fit(p, u)
    row = [pa.array([a.astype("<f4").tobytes()], pa.binary()) for a in (m.mean, m.scale, m.weights)]
    yield pa.RecordBatch.from_arrays([*row, pa.array([m.bias]), pa.array([m.prior])], ["mean", "scale", "weights", "bias", "prior"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Quality | None:
    """Fits on at most ``sample`` positives (labels.quality = 1) and ``sample`` documents taken as unlabelled text,
    those of the least hashes of doc_id; held-out and null ids are left out of both. No model without a positive.

    One task fits on these at most 2 * sample rows of features (4 KB each); only the model goes to the driver.
    """
    first = lambda t: t.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = first(labels.filter(F.col("quality") == 1)).select("doc_id", F.lit(True).alias("p"))
    any_ = first(docs).select("doc_id", F.lit(True).alias("u"))
    wanted = F.broadcast(one.join(any_, "doc_id", "full"))  # at most twice sample rows of three small columns
    chosen = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", F.explode(F.array_compact(F.array(F.when(F.col("p"), True), F.when(F.col("u"), False)))).alias("positive"))
    rows = chosen.mapInArrow(_vectors, "positive boolean, x binary").repartition(1)
    got = rows.mapInArrow(_fit_rows, "mean binary, scale binary, weights binary, bias double, prior double").collect()
    if not got:
        return None
    m = got[0]
    return Quality(*[np.frombuffer(bytes(m[c]), "<f4") for c in ("mean", "scale", "weights")], m.bias, m.prior)


def score_documents(docs: DataFrame, model: Quality | None, limit: float = 0.3, keep_text: bool = False) -> DataFrame:
    """docs (without text unless asked) plus score and predicted. Null and empty texts are scored as empty ones.

    Without a model (no trusted positives) every score is 0.5. Repeated rows give repeated rows; columns of docs
    named like the new ones are replaced, all others pass through.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != "text")]
    inner = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(("quality",), dict)
        for whole in batches:
            texts = whole.column("text").to_pylist()
            for a, z in groups(texts):
                s = model.score(features(texts[a:z])) if model else np.full(z - a, 0.5)
                yield pa.RecordBatch.from_arrays([*[whole.column(c).slice(a, z - a) for c in inner], pa.array(s, pa.float64()), pa.array((s >= limit).astype(np.int32), pa.int32())], [*inner, "score", "predicted"])

    rows = numbered(docs, keep, F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, numbered_schema(docs, keep, "score double", "predicted int")).toDF(*keep, "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
