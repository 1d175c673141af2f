"""Histogram trees over partitions against trees grown in one place on the same bins."""

import numpy as np
import pytest

from lifegrid.operators import concordance, likelihood
from lifegrid.operators.learners import histogram, models


def cohort(spark, n=500, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 2, n)]).astype(float)
    t = np.ceil(6 * rng.exponential(np.exp(-0.8 * x[:, 0] - 0.5 * x[:, 2])))
    t[::3] = 4.0
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b), *map(float, r)) for i, (a, b, r) in enumerate(zip(t, e, x, strict=True))], "_row_id long, time double, event int, a double, b double, c double")
    return df.repartition(4), x, t, e


def flat(rows):
    """All partitions' rows in one place, in their order."""
    import pyarrow as pa

    got = rows.df.toPandas().sort_values(["part", "time", "key"])
    return histogram.Rows(pa.Table.from_pandas(got, preserve_index=False), len(rows.names))


def shape(tree, node=0):
    if tree.feature[node] < 0:
        return ("leaf",)
    return (tree.feature[node], round(tree.threshold[node], 9), shape(tree, tree.left[node]), shape(tree, tree.right[node]))


@pytest.fixture(params=[None, 4_000])
def binned(spark, request, monkeypatch):
    monkeypatch.setattr(histogram, "ADDED", 3)
    df, x, t, e = cohort(spark)
    rows = histogram.bin_rows(df, ["a", "b", "c"], bins=12, held=request.param)
    assert rows.parts == (1 if request.param is None else 5)
    yield rows, df, x, t, e
    rows.release()


def test_cuts_are_thresholds(binned):
    rows, _, x, t, e = binned
    r = flat(rows)
    assert sorted(zip(r.time, r.event, strict=True)) == sorted(zip(t, e == 1, strict=True))
    want = np.column_stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(rows.cuts)])
    assert sorted(map(tuple, r.codes.tolist())) == sorted(map(tuple, want.tolist()))
    for i, c in enumerate(rows.cuts):
        for k, cut in enumerate(c):
            assert ((want[:, i] <= k) == (x[:, i] <= cut)).all()


def test_forest_splits_as_one_tree(binned):
    rows, df, *_ = binned
    forest = histogram.fit_forest(rows, n_estimators=3, max_depth=4, min_leaf=10, seed=7, features_per_node=3)
    r = flat(rows)
    for i, tree in enumerate(forest.trees):
        w = histogram.poisson(r.key, i, 7)
        ids = np.repeat(np.arange(len(w)), w)
        x, t, e = r.codes[ids].astype(float), r.time[ids], r.event[ids].astype(int)
        grown = grow_locally(x, t, e, rows.slots, 4, 10)
        assert shape(rows.raw(grown)) == shape(tree)
        for node, f in enumerate(tree.feature):
            if f < 0:
                assert len(tree.leaves[node]) == len(rows.slots) and (np.diff(tree.leaves[node]) >= 0).all()
        at, here = tree.apply(raw_values(rows, r)), grown.apply(x)
        for leaf in np.unique(here)[:3]:
            some = here == leaf
            times, d, n, _ = models.grid(t[some], e[some])
            want = models.step_at((times, np.cumsum(d / n)), rows.slots, 0.0)
            np.testing.assert_allclose(tree.leaves[at[ids[np.flatnonzero(some)[0]]]], want, rtol=1e-9)
    c = concordance.c_index(histogram.predict(df, forest, rows.names).select("_row_id", "time", "event", "risk"))
    assert c > 0.6


def raw_values(rows, r):
    """Some value of each bin."""
    tops = [np.append(c, (c[-1] if len(c) else 0.0) + 1) for c in rows.cuts]
    return np.column_stack([tops[i][r.codes[:, i]] for i in range(len(tops))])


def grow_locally(x, t, e, slots, depth, least):
    """The learner for one place, with the log-rank of whole rows."""
    from lifegrid.operators import local

    def score(ids, sides):
        return np.array([local.logrank(t[ids], e[ids], s) for s in sides])

    return models.grow(x, score, lambda ids: 0.0, np.arange(len(x)), depth, least, lambda rng: range(x.shape[1]), np.random.default_rng(0))


def test_boosting_gradients_and_trees(binned, monkeypatch):
    rows, df, *_ = binned
    monkeypatch.setattr(histogram, "REFRESH", 3)
    got = histogram.fit_boosted(rows, n_estimators=8, max_depth=2, min_leaf=15)
    r = flat(rows)
    want = models.fit_boosted(r.codes.astype(float), r.time, r.event.astype(int), n_estimators=8, max_depth=2, min_leaf=15)
    assert [shape(rows.raw(x)) for x in want.trees] == [shape(x) for x in got.trees]
    x = raw_values(rows, r)
    np.testing.assert_allclose(got.risk(x), want.risk(r.codes.astype(float)), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got.survival(x[:9], rows.slots), want.survival(r.codes[:9].astype(float), rows.slots), rtol=1e-8)


def test_gradients_equal_local_ones(spark):
    df, *_ = cohort(spark)
    rows = histogram.bin_rows(df, ["a", "b", "c"], held=3_000)
    try:
        outside = histogram.boosting_outside(rows, rows.df, [], 0.1)
        found = rows.each(lambda r: [(r.part, r.gradient(r.weights([], 0.1), outside.get(r.part)).tobytes())], "part int, g binary").collect()
        got = np.concatenate([np.frombuffer(bytes(x["g"])) for x in sorted(found, key=lambda x: x["part"])])
        r = flat(rows)
        np.testing.assert_allclose(got, models.cox_gradient(np.zeros(len(r.time)), r.time, r.event.astype(int))[1], atol=1e-12)
        assert len(found) > 5 and likelihood.CELLS > 0
    finally:
        rows.release()


def test_empty_and_eventless(spark):
    df, *_ = cohort(spark)
    for bad in (df.filter("time < 0"), df.selectExpr("_row_id", "time", "0 as event", "a")):
        with pytest.raises(histogram.UserInputError):
            histogram.bin_rows(bad, ["a"])


@pytest.mark.parametrize("cells", [None, 700])
def test_lasso_path_over_partitions(spark, cells):
    from pyspark.sql import functions as F

    from lifegrid.operators.learners import lasso

    rng = np.random.default_rng(3)
    n, p = 400, 8
    x = rng.standard_normal((n, p))
    x[:, 1] += 0.7 * x[:, 0]
    t = np.ceil(8 * rng.exponential(np.exp(-0.8 * x[:, 0] + 0.5 * x[:, 3])))
    e = rng.integers(0, 2, n)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    df = spark.createDataFrame([(i, float(a), int(b), *map(float, r)) for i, (a, b, r) in enumerate(zip(t, e, x, strict=True))], "_row_id long, time double, event int, " + ", ".join(f"x{i} double" for i in range(p)))
    rows = likelihood.Sorted(df, [F.col(f"x{i}") for i in range(p)], [], n, cells)
    try:
        assert rows.parts == (1 if cells is None else 7)
        alphas = models.alpha_path(x, t, e, 12)
        assert lasso.alphas_of(rows, n, 12) == pytest.approx(alphas, rel=1e-12)
        got = lasso.lasso_path(rows, n, alphas)
        want = np.array(models.lasso_path(x, t, e, alphas, 2000))
        np.testing.assert_allclose(got, want, atol=2e-5)
        for a, b in zip(alphas, got, strict=True):
            g = x.T @ models.cox_gradient(x @ b, t, e)[1] / n
            assert np.abs(g - a * np.sign(b))[b != 0].max(initial=0) < 1e-8 and np.abs(g)[b == 0].max(initial=0) < a + 1e-8
        slots = np.unique(t[e == 1])
        times, hazard = models.breslow(x @ got[-1], t, e)
        np.testing.assert_allclose(rows.baseline(got[-1], slots), models.step_at((times, hazard), slots, 0.0), rtol=1e-10)
    finally:
        rows.release()


def test_comparison_over_partitions(spark, monkeypatch):
    """A matrix that no task may hold goes to the learners over partitions; they rank subjects about as the others do."""
    from lifegrid.operators import brier
    from lifegrid.operators.learners import compare, scaled

    df, *_ = cohort(spark, 400)
    df = df.withColumnRenamed("c", "kind")
    small = {r["model"]: r for r in compare.compare(df, ["a", "b", "kind"], n_estimators=4, max_depth=2)}
    monkeypatch.setattr(compare, "TASK_CELLS", 100)
    large = {r["model"]: r for r in compare.compare(df, ["a", "b", "kind"], n_estimators=4, max_depth=2)}
    assert set(small) == set(large) == set(scaled.MODELS)
    for m, r in large.items():
        assert r["error"] is None and abs(r["c_index"] - small[m]["c_index"]) < 0.08 and abs(r["ibs"] - small[m]["ibs"]) < 0.03, m
        assert (r["train_n"], r["test_n"], r["test_events"]) == (small[m]["train_n"], small[m]["test_n"], small[m]["test_events"])
    assert large["cox_ph"]["c_index"] == pytest.approx(small["cox_ph"]["c_index"], abs=1e-6)
    assert large["cox_ph"]["ibs"] == pytest.approx(small["cox_ph"]["ibs"], abs=1e-6)
    got = scaled.cross_validate(df, ["a", "kind"], models=["cox_ph"], folds=2, repeats=1).collect()
    assert [(r.repeat, r.fold, r.error) for r in got] == [(0, 0, None), (0, 1, None)] and all(r.c_index > 0.6 for r in got)
    assert brier.TINY < 1
