"""The tree explainer against enumeration, and explanations that reuse fitted models."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from lifegrid.operators import explain, treeshap
from lifegrid.operators.learners import compare, models
from lifegrid.plans.requests import ModelRequest, Service


def data(n=120, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(1)
    t = np.ceil(9 * rng.exponential(np.exp(-x[:, 0] + 0.6 * x[:, 1] * x[:, 2])))
    return x, t, rng.integers(0, 2, n)


def conditional(tree, cover, value, row, known, node=0):
    """The expected value where only the known features are passed as the row does."""
    f = tree.feature[node]
    if f < 0:
        return value[node]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        return conditional(tree, cover, value, row, known, a if row[f] <= tree.threshold[node] else b)
    return sum(cover[c] / cover[node] * conditional(tree, cover, value, row, known, c) for c in (a, b))


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_shapley_values_equal_enumeration(kind):
    x, t, e = data()
    model = models.fit_forest(x, t, e, n_estimators=3, max_depth=4) if kind == "forest" else models.fit_boosted(x, t, e, n_estimators=4, max_depth=3)
    values, covers = treeshap.leaf_values(model), treeshap.node_counts(model.trees, x)
    phi, base = treeshap.shapley(model.trees, covers, values, x[:6])
    np.testing.assert_allclose(base + phi.sum(axis=1), model.risk(x[:6]), rtol=1e-9)
    p = x.shape[1]
    for row, got in zip(x[:3], phi, strict=False):
        game = {s: sum(conditional(tr, c, v, row, set(s)) for tr, c, v in zip(model.trees, covers, values, strict=True)) for k in range(p + 1) for s in combinations(range(p), k)}
        for i in range(p):
            rest = [j for j in range(p) if j != i]
            want = sum(factorial(k) * factorial(p - k - 1) / factorial(p) * (game[tuple(sorted((*s, i)))] - game[s]) for k in range(p) for s in combinations(rest, k))
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_rows_are_explained_in_tasks(spark):
    x, t, e = data()
    model = models.fit_boosted(x, t, e, n_estimators=5)
    names = list("abcd")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "_row_id long, a double, b double, c double, d double").repartition(5)
    want, base = treeshap.shapley(model.trees, treeshap.node_counts(model.trees, x), treeshap.leaf_values(model), x)
    got = {r._row_id: r for r in treeshap.explain_rows(df, model, names).collect()}
    np.testing.assert_allclose(np.array([got[i].contributions for i in range(len(x))]), want, atol=1e-12)
    assert got[0].base == pytest.approx(base)
    means = treeshap.mean_contributions(df, model, names)
    assert {m["feature"]: m["mean_abs_shap"] for m in means} == {n: pytest.approx(v) for n, v in zip(names, np.abs(want).mean(axis=0), strict=True)}
    assert treeshap.explain_rows(df.limit(0), model, names, df).count() == 0
    with pytest.raises(treeshap.UserInputError):
        treeshap.leaf_values(models.fit_cox(x, t, e))


def test_second_explanation_fits_nothing(spark, monkeypatch):
    s = Service(spark)
    key = s.load_example(200)
    r = ModelRequest(dataset_id=key, time_column="os_months", event_column="os_event", features=["age", "stage"], n_estimators=10)
    fits = []
    train = compare.train
    monkeypatch.setattr(compare, "train", lambda *a, **k: fits.append(a[1]) or train(*a, **k))
    first = s.shap(r, "gradient_boosted_survival")
    assert first == s.shap(r, "gradient_boosted_survival") and fits == ["gradient_boosted_survival"]
    assert len(s.partial_dependence(r, "gradient_boosted_survival", "age", 5)) == 5 and len(fits) == 1
    s.shap(r, "cox_ph")
    assert fits == ["gradient_boosted_survival", "cox_ph"]
    s.fits.most = 1
    s.fits.put("other", 1)
    assert s.fits.get("other") == 1 and len(s.fits.tables) == 1
    s.shap(r, "cox_ph")
    assert len(fits) == 3


def test_cox_request(spark):
    from lifegrid.plans.requests import CoxRequest

    s = Service(spark)
    got = s.cox(CoxRequest(dataset_id=s.load_example(220), time_column="os_months", event_column="os_event", covariates=["age", "stage"]))
    assert got["c_index_interval"][0] < got["c_index"] < got["c_index_interval"][1] and got["martingale_panels"][0]["term"] == "age"


def test_time_slices_read_the_cohort_once(spark):
    rng = np.random.default_rng(3)
    data = [(float(t), int(e), float(a)) for t, e, a in zip(rng.integers(1, 40, 200), rng.integers(0, 2, 200), rng.random(200), strict=True)]
    df, seen = spark.createDataFrame(data, "time double, event int, a double"), spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = explain.time_slice_importance(df.mapInArrow(watch, df.schema), ["a"], times=[8.0, 20.0]).collect()
    assert [r.t for r in got] == [8.0, 20.0] and seen.value == 200
