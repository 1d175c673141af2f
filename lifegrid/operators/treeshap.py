"""Shapley values of forests and boosted trees.

A leaf is reached by the features on its path: each is passed (1) or not (0) by a row, and where it is unknown, by the share of training
rows that pass. So a leaf's part of the prediction is a product over the features of its path, and its Shapley values follow from the
coefficients of a polynomial with one factor a feature. These are taken for whole batches of rows, leaf by leaf; the trees go
to the tasks, rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UserInputError
from .learners.models import Boosted, Forest, Tree


def leaf_values(model) -> list[np.ndarray]:
    """What each node of each tree adds to the risk."""
    if isinstance(model, Forest):
        return [np.array([0.0 if v is None else float(np.sum(v)) / len(model.trees) for v in t.leaves]) for t in model.trees]
    if isinstance(model, Boosted):
        return [model.rate * np.array([0.0 if v is None else float(v) for v in t.leaves]) for t in model.trees]
    raise UserInputError("the tree explainer takes forests and boosted trees")


def node_counts(trees: list[Tree], x: np.ndarray) -> list[np.ndarray]:
    """Rows of x in each node of each tree."""
    out = []
    for t in trees:
        n = np.bincount(t.apply(x), minlength=len(t.feature)).astype(float)
        for node in range(len(t.feature) - 1, -1, -1):  # children stand behind their parents
            if t.feature[node] >= 0:
                n[node] = n[t.left[node]] + n[t.right[node]]
        out.append(n)
    return out


def paths(tree: Tree, cover: np.ndarray) -> list[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Each leaf with the features of its path, their open lower and closed upper bounds, and the share of rows that pass each."""
    out, todo = [], [(0, {})]
    while todo:
        node, known = todo.pop()
        f = tree.feature[node]
        if f < 0:
            names = sorted(known)
            out.append((node, names, *(np.array([known[k][i] for k in names]) for i in range(3))))
            continue
        low, high, share = known.get(f, (-np.inf, np.inf, 1.0))
        th = tree.threshold[node]
        for child, bounds in ((tree.left[node], (low, min(high, th))), (tree.right[node], (max(low, th), high))):
            part = cover[child] / cover[node] if cover[node] > 0 else 0.5
            todo.append((child, known | {f: (*bounds, share * part)}))
    return out


def shapley(trees: list[Tree], covers: list[np.ndarray], values: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Contributions (rows x features) and the expected risk; a row's contributions and the expectation add up to its risk."""
    phi, base = np.zeros(x.shape), 0.0
    for tree, cover, value in zip(trees, covers, values, strict=True):
        for leaf, names, low, high, share in paths(tree, cover):
            m = len(names)
            base += value[leaf] * float(np.prod(share))
            if not m or value[leaf] == 0:
                continue
            passed = ((x[:, names] > low) & (x[:, names] <= high)).astype(float)
            weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
            for i in range(m):
                # coefficients of the product over the other features of (share + passed t)
                c = np.zeros((len(x), m))
                c[:, 0] = 1.0
                for j in range(m):
                    if j != i:
                        c[:, 1:] = c[:, 1:] * share[j] + c[:, :-1] * passed[:, j : j + 1]
                        c[:, 0] *= share[j]
                phi[:, names[i]] += value[leaf] * (passed[:, i] - share[i]) * (c @ weights)
    return phi, base


def _matrix(b: pa.RecordBatch, skip: int) -> np.ndarray:
    return np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(skip, b.num_columns)]).astype(float)


def covers_of(df: DataFrame, model, names: list[str]) -> list[np.ndarray]:
    """Rows of df in each node, counted in tasks."""
    sent = df.sparkSession.sparkContext.broadcast(model.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                n = np.concatenate(node_counts(sent.value, _matrix(b, 0)))
                total = n if total is None else total + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    got = [np.frombuffer(bytes(r.n)) for r in df.select(*[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(run, "n binary").collect()]
    total = np.sum(got, axis=0) if got else np.ones(sum(len(t.feature) for t in model.trees))
    return np.split(total, np.cumsum([len(t.feature) for t in model.trees])[:-1])


def explain_rows(df: DataFrame, model, names: list[str], background: DataFrame | None = None) -> DataFrame:
    """_row_id, base and contributions (an array in the order of names) of every row; shares come from the background rows, by default df's own."""
    values = leaf_values(model)
    covers = covers_of(df if background is None else background, model, names)
    sent = df.sparkSession.sparkContext.broadcast((model.trees, covers, values))
    kind = df.schema["_row_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                phi, base = shapley(*sent.value, _matrix(b, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, base)), pa.array(list(phi), pa.list_(pa.float64()))], ["_row_id", "base", "contributions"])

    return df.select("_row_id", *[F.col(f"`{c}`").cast("double") for c in names]).mapInArrow(run, f"_row_id {kind}, base double, contributions array<double>")


def mean_contributions(df: DataFrame, model, names: list[str], background: DataFrame | None = None) -> list[dict]:
    """feature and mean_abs_shap over all rows, greatest first."""
    each = explain_rows(df, model, names, background).select(F.posexplode("contributions").alias("k", "v"))
    found = {r.k: r.v for r in each.groupBy("k").agg(F.avg(F.abs("v")).alias("v")).collect()}
    return [{"feature": names[k], "mean_abs_shap": found[k]} for k in sorted(found, key=lambda k: (-found[k], k))]
