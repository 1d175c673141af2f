"""Rules over partitions of cells against the version in tasks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifegrid.operators import local, patterns, signature


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    n = 320
    x, z, y = rng.random(n), rng.normal(size=n), rng.choice(["u", "v", "w"], n)
    t = np.ceil(12 * rng.exponential(np.where((x > 0.5) & (y == "v"), 0.3, 1.0)))
    t[::3] = 5.0
    e = (rng.random(n) < 0.8).astype(int)
    rows = [(i, float(a), int(b), float(c), float(d), f) for i, (a, b, c, d, f) in enumerate(zip(t, e, x, z, y, strict=True))]
    return spark.createDataFrame(rows, "_row_id long, time double, event int, x double, z double, y string").repartition(3).cache()


@pytest.fixture(params=[None, 6_000])
def both(cohort, request, monkeypatch):
    """The same rules scored in tasks that have all cells, and over partitions."""
    monkeypatch.setattr(patterns, "BLOCK", 16)
    monkeypatch.setattr(patterns, "RULES", 20)
    columns = ["x", "z", "y"]
    found = signature.indicators(cohort, columns, 20)
    todo = signature.rules(found, 2)
    c = signature.cells(cohort, found)
    p = patterns.Patterns(cohort, [i.test() for i in found], request.param)
    assert p.n == 320 and (p.parts == 1) == (request.param is None)
    yield todo, c, p
    p.release()


def test_scores(both):
    todo, c, p = both
    want = {r["rule_id"]: r for r in signature.score_rules(c, [(i, *r) for i, r in enumerate(todo)], 20, 5)}
    got = {r["rule_id"]: r for r in p.score(todo, 20, 5)}
    assert want.keys() == got.keys() and len(got) > 30
    for i, r in got.items():
        for k, v in r.items():
            assert v == (pytest.approx(want[i][k], rel=1e-9, abs=1e-12) if isinstance(v, float) else want[i][k]), (i, k)


def test_draws_do_not_depend_on_partitions(cohort, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 16)
    found = signature.indicators(cohort, ["x", "y"], 20)
    rules = signature.rules(found, 1)
    draws = [("boot", 1, 0, 1.0), ("part", 1, 3, 0.5), ("permute", 1, 2, np.full(len(rules), 0.4))]
    seen = []
    for held in (None, 6_000):
        p = patterns.Patterns(cohort, [i.test() for i in found], held)
        outside = p.outside(rules, draws)
        seen.append((p.sizes(rules, draws), p.total(rules, draws, outside, lambda _, d, n, d1, n1: patterns.logrank_sums(d, n, d1, n1)), p.hazard_ratios(rules, draws[:2], outside[:2])))
        p.release()
    for a, b in zip(seen[0], seen[1], strict=True):
        np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-8)
    boot, part, permute = seen[0][0]
    assert 230 < boot[1, 0] < 410 and 120 < part[1, 0] < 200 and permute[1, 0] == 320 and abs(permute[0].mean() - 128) < 25


def test_resampling(both):
    todo, c, p = both
    how = {"alpha": 0.05, "bootstrap": 6, "permutations": 9, "validation": 4, "bootstrap_fraction": 1.0, "validation_fraction": 0.5, "seed": 3, "least": 20}
    chosen = [(r["rule_id"], todo[r["rule_id"]]) for r in sorted(p.score(todo, 20, 5), key=lambda r: -r["chisq"])[:25]]
    got = p.resample(chosen, how)
    for rid, (combo, op) in chosen[:6]:
        m = signature.rule_mask(c.bits.to_numpy(np.int64), combo, op)
        fit = local.cox_newton(m.astype(float)[:, None], c.time.to_numpy(float), c.event.to_numpy(int), c.k.to_numpy(float))
        assert math.log(got[rid]["hazard_ratio"]) == pytest.approx(fit[0][0], abs=1e-6)
        assert math.log(got[rid]["ci_upper"] / got[rid]["ci_lower"]) == pytest.approx(2 * 1.959964 * math.sqrt(fit[1][0, 0]), rel=1e-4)
    best = got[chosen[0][0]]
    assert best["bootstrap_support"] == 1 and best["direction"] == 1 and best["permutation_p"] == 0.1 and best["validation_support"] > 0.5
    assert all(0 < r["permutation_p"] <= 1 for r in got.values())


def test_search_over_partitions(cohort, monkeypatch):
    how = {"bootstrap": 4, "permutations": 19, "validation": 4}
    small = signature.discover(cohort, ["x", "z", "y"], **how)
    monkeypatch.setattr(signature, "TASK_CELLS", 10)
    large = signature.discover(cohort, ["x", "z", "y"], **how)
    assert large["rules"][0]["rule"] == small["rules"][0]["rule"] and large["tested"] == small["tested"]
    assert large["rules"][0]["significant"] and large["rules"][0]["chisq"] == pytest.approx(small["rules"][0]["chisq"])
    labels = signature.apply_rule(cohort.withColumn("x", F.when(F.col("_row_id") > 0, F.col("x"))), large)
    assert labels.count() == 320


def test_many_indicators(spark):
    """More indicators than a word of bits."""
    df = spark.range(200).selectExpr("id as _row_id", "cast(1 + id % 17 as double) as time", "cast(id % 3 > 0 as int) as event", *[f"(id * {i + 3}) % 101 / 1.0 as f{i}" for i in range(24)])
    found = signature.indicators(df, [f"f{i}" for i in range(24)], 10)
    assert len(found) > 62 and signature.cells(df, found) is None
    p = patterns.Patterns(df, [i.test() for i in found])
    got = {r["rule_id"]: r for r in p.score(signature.rules(found, 1), 8, 3)}
    pdf = df.toPandas()
    for i in (0, 63, len(found) - 1):
        m = pdf[found[i].column].to_numpy() > found[i].value
        assert got[i]["chisq"] == pytest.approx(local.logrank(pdf.time.to_numpy(), pdf.event.to_numpy(), m), rel=1e-9)
    p.release()
