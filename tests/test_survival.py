"""Estimators against published values, closed forms and naive algorithms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifegrid.errors import NotFoundError, UserInputError
from lifegrid.functions import levels, outcomes, stats
from lifegrid.operators import brier, cohort, concordance, cox, cutpoint, encode, grouping, km, likelihood, local, logrank, profile, signature, split, table_one, timegrid
from lifegrid.operators.learners import deep, models
from lifegrid.sources import exports, readers, store, synthetic

SIX_MP = "6,6,6,6+,7,9+,10,10+,11+,13,16,17+,19+,20+,22,23,25+,32+,32+,34+,35+"
PLACEBO = "1,1,2,2,3,4,4,5,5,8,8,8,8,11,11,12,12,15,17,22,23"


def rows(spark, time, event, **more):
    names = list(more)
    data = [(i, float(t), int(e), *(more[k][i] for k in names)) for i, (t, e) in enumerate(zip(time, event, strict=True))]
    kind = lambda v: "string" if isinstance(v[0], str) else "double"
    return spark.createDataFrame(data, ", ".join(["_row_id long", "time double", "event int", *[f"{k} {kind(more[k])}" for k in names]])).repartition(3)


@pytest.fixture(scope="module")
def freireich(spark):
    t, e, g = [], [], []
    for name, text in (("6-MP", SIX_MP), ("placebo", PLACEBO)):
        for x in text.split(","):
            t.append(float(x.strip("+")))
            e.append(int("+" not in x))
            g.append(name)
    return rows(spark, t, e, arm=g).cache()


@pytest.mark.parametrize(("kind", "chisq"), [("logrank", 16.792941), ("gehan_breslow", 13.457852), ("tarone_ware", 15.123575), ("fleming_harrington", 14.457151)])
def test_weighted_logrank(freireich, kind, chisq):
    got = logrank.logrank(freireich, "arm", kind)
    assert got["chisq"] == pytest.approx(chisq, abs=1e-6) and got["df"] == 1
    assert logrank.pairwise(freireich, "arm", kind)[0]["chisq"] == pytest.approx(chisq, abs=1e-6)


def test_loglog_limits(spark):
    got = {r.time: (r.ci_lower, r.ci_upper) for r in km.curve(rows(spark, [1, 2, 3, 4, 5], [1, 1, 0, 1, 1]), []).collect()}
    for t, want in {1: (0.20380926, 0.96917979), 2: (0.12573018, 0.88175641), 4: (0.01230153, 0.71921802), 5: (0, 0)}.items():
        assert got[t] == pytest.approx(want, abs=1e-6)


def test_all_events_end_at_zero(spark):
    last = sorted(km.curve(rows(spark, [1, 2, 3, 4], [1] * 4), []).collect(), key=lambda r: r.time)[-1]
    assert (last.survival, last.ci_lower, last.ci_upper) == (0, 0, 0)


def test_rmst_exhausted_and_horizon(spark):
    r = km.analyse(rows(spark, [1, 1, 2, 2], [1] * 4, g=list("AABB")), "g", max_time=2)
    assert all(x.se is None and x.ci_lower is None for x in r.rmst.collect())
    assert r.contrast["estimate"] == 0 and r.contrast["p_value"] is None and r.contrast["ci_lower"] is None
    r = km.analyse(rows(spark, [5, 8, 11, 18, 20, 24], [1, 0, 1, 1, 0, 0], g=list("AAABBB")), "g")
    assert (r.display_horizon, r.rmst_horizon) == (24, 11)
    assert sorted(x.tick for x in r.risk.filter("g = 'A'").collect()) == [0, 4.8, 9.6, 14.4, 19.2, 24]


def test_rmst_without_events_before_horizon(spark):
    got = {r.g: r for r in km.rmst(rows(spark, [1, 3, 9, 9], [1, 0, 1, 0], g=list("AABB")), ["g"], 3.0).collect()}
    assert (got["A"].rmst, got["B"].rmst, got["B"].variance) == (2.0, 3.0, 0.0)


def test_partitions_do_not_matter(freireich):
    a, b = (sorted(map(tuple, km.summary(freireich.repartition(n), ["arm"]).collect())) for n in (1, 7))
    assert a == b and [r[5] for r in a] == [23.0, 8.0]


def test_follow_up_of_uncensored(spark):
    assert km.median_follow_up(rows(spark, [1, 2], [1, 1]), []).first()[0] is None


def test_bh():
    got = stats.bh_adjust([0.01, 0.05, float("nan"), 0.20])
    assert got[:2] == pytest.approx([0.03, 0.075]) and math.isnan(got[2]) and got[3] == pytest.approx(0.2)


def test_bh_column(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.05), (3, None), (4, 0.2)], "i int, p double")
    assert [r.p_adjusted for r in logrank.bh_column(df, "p").orderBy("i").collect()] == [pytest.approx(0.03), pytest.approx(0.075), None, pytest.approx(0.2)]


def test_distributions():
    assert stats.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert stats.chi2_upper(100, 10) == pytest.approx(5.449702e-17, rel=1e-6)
    assert stats.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert stats.spearman([1, 2, 3, 4, 5], [5, 6, 7, 8, 7])[0] == pytest.approx(0.8207826817)


def code(values, positive=None):
    try:
        return outcomes.event_coding(values, positive)
    except UserInputError:
        return "error"


def test_event_coding():
    assert code(["0", "1", "event", "censored"], 1) == {"0": 0, "1": 1, "event": 1, "censored": 0}
    assert code([1, 0, "dead", "alive", "maybe"], 1) == "error"
    assert code([0, 1, 2], 1) == "error" and code([0, 1], 0) == "error" and code([1, 2], 2) == {1: 0, 2: 1}
    assert code(["alive", "cancer_death", "other_death"], "death") == "error"
    for p in (None, "deceased", 1):
        assert code(["0:LIVING", "1:DECEASED"], p) == {"0:LIVING": 0, "1:DECEASED": 1}
    assert code(["p", "q"], "q") == {"p": 0, "q": 1} and code(["p", "q", "r"], "q") == "error" and code([]) == "error"


def test_roles():
    assert outcomes.suggest(["os_months", "os_event", "stage", "age"]) == {"time_columns": ["os_months"], "event_columns": ["os_event"], "group_columns": ["stage"]}
    with pytest.raises(UserInputError):
        outcomes.check_pair("os_months", "pfs_event")


def test_level_order():
    assert levels.ordered_levels("smoking_status", ["Current Smoker", "Lifelong Non-smoker", "Former Smoker"])[0] == "Lifelong Non-smoker"
    assert levels.ordered_levels("kras_status", ["Mutated", "Wildtype"])[0] == "Wildtype"
    assert levels.ordered_levels("stage_group", ["unknown", "Stage III", "Stage I", "Stage II"]) == ["Stage I", "Stage II", "Stage III", "unknown"]
    assert levels.ordered_levels("dose", ["10", "9", "100"]) == ["9", "10", "100"]


def test_cohort_counters(spark):
    df = spark.createDataFrame([(12.0, 1, 60.0), (float("inf"), 0, 61.0), (24.0, 1, None), (36.0, 0, 63.0)], "os_months double, os_event int, age double")
    c = cohort.build(df, "os_months", "os_event", extras=["age"], strict_roles=True)
    assert c.audit == {"rows_with_infinite_values": 1, "dropped_missing_rows": 2, "dropped_nonpositive_time_rows": 0, "n": 2, "events": 1}
    with pytest.raises(NotFoundError):
        cohort.build(df, "os_months", "nope")
    with pytest.raises(UserInputError, match="positive"):
        cohort.build(df.withColumn("os_months", F.lit(-1.0)), "os_months", "os_event")
    assert cohort.event_equivalents(df.unionAll(df).withColumn("died", F.col("os_event").cast("string")), "os_event") == ["died"]
    assert cohort.preview(df, "os_months", "os_event", ["age"])["missing_by_covariate"] == {"age": 1}


def naive_c(t, e, r):
    num = den = 0
    for i in range(len(t)):
        for j in range(len(t)):
            if e[i] and t[j] > t[i]:
                den += 1
                num += 1 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0
    return num / den


def test_concordance(spark):
    t, e, r = [5, 8, 10, 12, 14, 20], [1, 0, 1, 1, 0, 1], [0.9, 0.2, 0.7, 0.6, 0.3, 0.1]
    assert concordance.c_index(rows(spark, t, e, risk=r)) == naive_c(t, e, r)
    assert concordance.c_index(rows(spark, t, [0] * 6, risk=r)) is None
    rng = np.random.default_rng(0)
    t, e, r = rng.integers(1, 15, 80), rng.integers(0, 2, 80), rng.integers(0, 9, 80).astype(float)
    assert concordance.index_of(concordance.pair_counts(t, e, r)) == pytest.approx(naive_c(t, e, r))
    low, high = concordance.bootstrap_interval(rows(spark, t, e, risk=r.tolist()), 40)
    assert low < naive_c(t, e, r) < high


def test_concordance_by_ranges(spark, monkeypatch):
    """Many small ranges, with a time and a risk that a third of the rows share, count the same pairs; so do weights and keys."""
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 20)
    rng = np.random.default_rng(5)
    n = 300
    t, e, r = rng.exponential(9, n).round(1) + 1, rng.integers(0, 2, n), rng.normal(size=n).round(1)
    t[::3], r[1::3] = 7.0, 0.5
    df = rows(spark, t, e, risk=r.tolist(), side=[str(i % 2) for i in range(n)])
    cuts = concordance.ranges(df)
    assert len(cuts[0]) > 3 and 7.0 in cuts[0] and 0.5 in cuts[1]
    assert concordance.c_index(df) == pytest.approx(naive_c(t, e, r), abs=1e-12)
    got = {x.side: x.c_index for x in concordance.pair_table(df, ["side"], cuts=cuts).collect()}
    assert got == {str(k): pytest.approx(naive_c(t[k::2], e[k::2], r[k::2]), abs=1e-12) for k in (0, 1)}
    twice = concordance.pair_table(df.withColumn("k", F.lit(2)), weight="k").first()
    assert twice.c_index == pytest.approx(naive_c(t, e, r), abs=1e-12) and twice.comparable == 4 * concordance.pair_table(df).first().comparable
    empty = df.filter("time < 0")
    assert concordance.c_index(empty) is None and concordance.bootstrap_interval(empty, 10) is None


def test_bootstrap_weights_are_poisson(spark):
    w = spark.range(20_000).select(concordance.resample_weight(F.col("id"), F.lit(1), 42).alias("w")).toPandas().w
    assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06 and abs((w == 0).mean() - np.exp(-1)) < 0.015


def test_running_sums_without_groups_equal_grouped_ones(spark, monkeypatch):
    rng = np.random.default_rng(6)
    t, e = np.concatenate([rng.exponential(900, 400), [1, 2, 4, 8, 8 - 1e-12, 1024.0, 1e-9]]), rng.integers(0, 2, 407)
    e[np.argmax(t)] = 1  # the last risk set is exhausted
    df = rows(spark, t, e, g=["x"] * 407)
    order = ["n", "d", "surv", "surv_before", "gw"]
    one = timegrid.survival(timegrid.grid(df, []), [])
    a = one.orderBy("time").toPandas()
    b = timegrid.survival(timegrid.grid(df, ["g"]), ["g"]).orderBy("time").toPandas()
    np.testing.assert_allclose(a[order].to_numpy(float), b[order].to_numpy(float), rtol=1e-9)
    assert a.surv.iloc[-1] == 0 and np.isnan(a.gw.iloc[-1])
    with monkeypatch.context() as m:
        m.setattr(timegrid, "RANGE_ROWS", 10)
        c = timegrid.survival(timegrid.grid(df, ["g"]), ["g"])
        np.testing.assert_allclose(a[order].to_numpy(float), c.orderBy("time").toPandas()[order].to_numpy(float), rtol=1e-9)
        one = timegrid.survival(timegrid.grid(df, []), [])
        np.testing.assert_allclose(a[order].to_numpy(float), one.orderBy("time").toPandas()[order].to_numpy(float), rtol=1e-9)
    # every window over the grid has a range to be partitioned by; the others run over one row a range
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    own = [line for line in plan.splitlines() if "Window [" in line and "_from_" not in line]
    assert own and all("_range" in line for line in own)
    later = timegrid.survival_at(df, spark.createDataFrame([(0.0,), (5.0,), (1e6,)], "time double")).toPandas().set_index("time").surv
    times, s = local.survival_curve(t, e)
    assert later[0.0] == 1 and later[1e6] == 0 and later[5.0] == pytest.approx(s[np.searchsorted(times, 5.0, side="right") - 1])


def test_time_range_never_falls(spark):
    t = np.sort(np.concatenate([np.geomspace(1e-6, 1e9, 5_000), *[[2.0**k, np.nextafter(2.0**k, 0), np.nextafter(2.0**k, 1e300)] for k in range(-20, 30)]]))
    got = spark.createDataFrame([(float(x),) for x in t], "t double").select("t", timegrid.time_range(F.col("t")).alias("r")).toPandas().sort_values("t").r.to_numpy()
    assert (np.diff(got) >= 0).all()


def test_average_ranks_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 15)
    v = np.random.default_rng(7).integers(0, 40, 200).astype(float)
    v[::3] = 11.0
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    (cuts,) = timegrid.range_cuts(df, ["v"])
    assert len(cuts) > 3
    got = cox.average_ranks(df.withColumn("part", timegrid.range_number(F.col("v"), cuts)), []).toPandas().set_index("v")["rank"].to_dict()
    assert got == {x: stats.average_ranks(v.tolist())[v.tolist().index(x)] for x in set(v.tolist())}


def test_cox_matches_local_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    t = np.ceil(4 * rng.exponential(np.exp(-0.6 * x[:, 0])))
    e = rng.integers(0, 2, 300)
    df = rows(spark, t, e, a=x[:, 0].tolist(), b=x[:, 1].tolist())
    fit = cox.fit(df, ["a", "b"])
    beta, cov, ll = local.cox_newton(x, t, e)
    assert fit.beta == pytest.approx(beta, abs=1e-7) and fit.cov == pytest.approx(cov, rel=1e-5) and fit.loglik == pytest.approx(ll)
    assert abs(cox.martingale_residuals(df, fit).agg(F.sum("residual")).first()[0]) < 2  # Breslow's hazard for an Efron fit
    ph = cox.ph_tests(df, fit)
    s = cox.schoenfeld(df, fit).toPandas()
    assert ph["terms"][0]["rho"] == pytest.approx(stats.spearman(s.time.tolist(), s.r0.round(12).tolist())[0], abs=1e-9)
    strat = cox.fit(df.withColumn("s", F.pmod("_row_id", F.lit(2))), ["a"], ["s"])
    assert strat.n == 300
    with pytest.raises(UserInputError):
        cox.fit(df.withColumn("c", F.col("a") * 2), ["a", "c"])
    with pytest.raises(UserInputError):
        cox.fit(df.withColumn("c", F.lit(1.0)), ["c"])


def test_group_derivation(spark):
    df = rows(spark, range(1, 7), [1, 0] * 3, age=[1.0, 2.0, 2.0, 2.0, 3.0, 4.0])
    of = lambda method, cut=None: [r.g for r in grouping.derive_group(df, "age", method, "g", cut).df.orderBy("_row_id").collect()]
    assert of("median_split") == of("percentile_split", 50) == ["Low"] * 4 + ["High"] * 2
    # the quartiles are 2, 2, 2.75: three distinct bins
    assert of("quartile_split") == ["Q1", "Q1", "Q1", "Q1", "Q3", "Q3"]
    assert of("extreme_split", 20) == ["Bottom 20%", "Bottom 20%", "Bottom 20%", "Bottom 20%", "Top 20%", "Top 20%"]
    with pytest.raises(UserInputError):
        grouping.derive_group(df, "age", "median_split", "age")
    with pytest.raises(UserInputError):
        grouping.derive_group(df, "time", "median_split", "g", time="time")


def test_encoder_unseen(spark):
    a = spark.createDataFrame([("I", 1.0), ("I", None), ("II", 3.0)], "stage string, x double")
    e = encode.fit_encoder(a, ["stage", "x"])
    assert e.names == ["stage__II", "stage__unknown", "stage__missing", "x"]
    b = spark.createDataFrame([("III", 5.0), ("I", float("inf")), (None, 1.0)], "stage string, x double")
    assert [tuple(r) for r in encode.encode(b, encode.Encoder.from_json(e.to_json())).collect()] == [(0, 1, 0, 5), (0, 0, 0, 2), (0, 0, 1, 1)]
    c = spark.createDataFrame([(float(i), float(i * i), float(2 * i + 1)) for i in range(9)], "a double, b double, c double")
    assert encode.full_rank(c, ["a", "b", "c"]) == ["a", "b"] and encode.varying(c.withColumn("k", F.lit(1.0)), ["a", "k"]) == ["a"]


def test_splits(spark):
    df = rows(spark, range(1, 101), [int(i % 3 == 0) for i in range(100)])
    a, mode = split.holdout(df)
    ids = lambda d, c: sorted(r[0] for r in d.filter(c).select("_row_id").collect())
    assert mode == "holdout" and ids(a, "is_test") == ids(split.holdout(df.repartition(1))[0], "is_test")
    assert {(r.event, r.n) for r in a.filter("is_test").groupBy("event").agg(F.count("*").alias("n")).collect()} == {(1, 11), (0, 20)}
    assert split.holdout(df.limit(10))[1] == "apparent"
    sizes = [r["count"] for r in split.folds(df, 5).groupBy("fold").count().collect()]
    assert sorted(sizes)[0] >= 19 and split.repeated_folds(df, 5, 2).count() == 200


def test_cutpoint_scan_and_permutations(spark):
    rng = np.random.default_rng(4)
    x, t, e = rng.integers(0, 30, 200).astype(float), rng.integers(1, 20, 200), rng.integers(0, 2, 200)
    df = rows(spark, t, e, x=x.tolist())
    got = {r.cutpoint: r.chisq for r in cutpoint.scan(df, "x", 0.1).collect()}
    for c, v in got.items():
        assert v == pytest.approx(local.logrank(t.astype(float), e, x > c), abs=1e-9)
    assert len(got) >= 20
    best = cutpoint.optimal_cutpoint(df, "x", permutations=19)
    assert best["chisq"] == pytest.approx(max(got.values())) and 0.05 <= best["permutation_p"] <= 1


def test_signature(spark):
    rng = np.random.default_rng(5)
    x, y = rng.random(240), rng.choice(["u", "v", "w"], 240)
    t = np.ceil(20 * rng.exponential(np.where((x > 0.5) & (y == "v"), 0.2, 1.0)))
    df = rows(spark, t, [1] * 240, x=x.tolist(), y=y.tolist())
    got = signature.discover(df, ["x", "y"], bootstrap=6, permutations=19, validation=6)
    best = got["rules"][0]
    assert "y = v" in best["rule"] and "AND" in best["rule"] and best["significant"] and best["permutation_p"] == 0.05
    labels = signature.apply_rule(df.withColumn("x", F.when(F.col("_row_id") > 0, F.col("x"))), got)
    assert labels.filter("_row_id = 0").first().signature is None


def test_tables_and_profile(spark):
    df = spark.createDataFrame([("a", 1.0, "u"), ("a", None, "v"), ("b", float("nan"), None), ("b", 4.0, "u"), (None, 9.0, "u")], "g string, x double, c string")
    t = {r["Variable"]: r for r in table_one.table_one(df, ["x", "c"], "g")}
    assert t["N"] == {"Variable": "N", "Overall": "4", "a": "2", "b": "2"} and t["c: u"]["a"] == "1 (50.0%)" and t["c: Missing"]["b"] == "1"
    p = {r.column: r for r in profile.profile_columns(df).collect()}
    assert (p["x"].missing, p["x"].n_unique, p["x"].max, p["g"].kind) == (2, 3, 9.0, "binary")
    old = profile.profile(df)
    assert [c["column"] for c in profile.extend_profile(old, df.withColumn("d", F.lit(1)))["columns"]] == ["g", "x", "c", "d"]


def test_learners_rank_subjects():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((160, 3))
    t, c = rng.exponential(np.exp(-1.2 * x[:, 0])), rng.exponential(3, 160)
    t, e = np.minimum(t, c), (t <= c).astype(int)
    for fit in [*models.MODELS.values(), *deep.deep_models().values()]:
        m = fit(x, t, e, n_estimators=10, epochs=40, bins=10)
        s = m.survival(x[:5], np.array([0.0, 0.5, 2.0]))
        assert models.evaluate(m, x, t, e, t, e)["c_index"] > 0.68 and (np.diff(s, axis=1) <= 1e-12).all() and m.importance.shape == (3,)


def test_deep_gradients():
    rng = np.random.default_rng(1)
    t, e, z = rng.integers(1, 9, 12).astype(float), rng.integers(0, 2, 12), rng.standard_normal((12, 6))
    k = deep.bins_of(t, np.linspace(0, 8, 6))
    cases = [(lambda v: deep.cox_loss(v[:, 0], t, e), 1), (lambda v: deep.deephit_loss(v, k, e), 6), (lambda v: deep.mtlr_loss(v, k, e), 5)]
    for f, width in cases:
        v = z[:, :width].copy()
        g = f(v)[1].reshape(12, width)
        for i, j in [(0, 0), (5, width - 1), (11, 0)]:
            d = np.zeros_like(v)
            d[i, j] = 1e-6
            assert (f(v + d)[0] - f(v - d)[0]) / 2e-6 == pytest.approx(g[i, j], abs=1e-6)


def test_brier_without_censoring():
    t, e = np.array([1.0, 2, 3, 4]), np.ones(4, int)
    got = local.brier_skill(t, e, lambda ts: (t[:, None] > ts).astype(float), t, e)
    assert got["ibs"] == 0 and got["skill"] == 1


def test_sources(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("﻿a;b ;B\n1;é;3\n".encode())
    df = readers.load(spark, str(p))
    assert df.columns == ["a", "b", "B_2"] and df.first().b == "é"
    p.write_bytes("a,b\n1,é\n".encode("latin-1"))
    assert readers.load(spark, str(p)).first().b == "é"
    for bad in ("x.doc", "missing.csv"):
        with pytest.raises(UserInputError):
            readers.load(spark, str(tmp_path / bad))
    c = synthetic.make_cohort(spark, 300)
    assert c.count() == 300 and sorted(map(str, c.collect())) == sorted(map(str, synthetic.make_cohort(spark, 300, partitions=5).collect()))
    now = [0.0]
    s = store.DatasetStore(2, 10, lambda: now[0])
    k = [s.put(c.limit(i), "x") for i in (1, 2, 3)]
    with pytest.raises(NotFoundError):
        s.get(k[0])
    now[0] = 11
    with pytest.raises(NotFoundError):
        s.get(k[2])


def test_exports():
    rows_ = [{"a": "=1+1", "b": 0.5}, {"a": "x|y_%", "b": None}]
    assert exports.to_csv(rows_, caption="t") == "# t\na,b\n'=1+1,0.5\nx|y_%,\n"
    assert "x\\|y_%" in exports.to_markdown(rows_) and r"x|y\_\%" in exports.to_latex(rows_)
    assert exports.to_docx(rows_)[:2] == b"PK"
    for text, safe in ((" =cmd", "' =cmd"), ("-1.5", "-1.5"), ("@x", "'@x"), ("- ", "'- "), ("a=b", "a=b"), ("", ""), (" ", " ")):
        assert exports.plain_text(text) == safe
    assert "| ' =cmd |\n" in exports.to_markdown([{"a": " =cmd"}]) and "| --- |" in exports.to_markdown([{"a": " =cmd"}])


def test_many_levels_and_groups(spark):
    """No level or group is left out: 300 levels give 299 columns, 60 groups all their pairs; too many are refused."""
    df = spark.range(3000).selectExpr("id as _row_id", "cast(1 + id % 97 as double) as time", "cast(id % 3 = 0 as int) as event", "concat('site', id % 300) as site", "concat('g', id % 60) as g", "concat('x', id) as many")
    _, names = cox.design(df, ["site"])
    assert len(names) == 299 and len(set(names)) == 299
    with pytest.raises(UserInputError):
        cox.design(df, ["many"])
    pairs = logrank.pairwise(df, "g")
    known = [p for p in pairs if p["p_value"] is not None]  # two in three groups have no event here
    assert len(pairs) == 60 * 59 // 2 and len(known) == len(pairs) - 40 * 39 // 2 and all(0 <= p["p_value"] <= p["p_adjusted"] <= 1 for p in known)
    with pytest.raises(UserInputError):
        logrank.pairwise(df, "site")


def tied(spark, n=600, seed=8):
    """Rows with many ties, one time that a third shares, fine times and a hot stratum."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 2)).round(2)
    t = np.where(rng.random(n) < 0.5, rng.integers(1, 9, n), rng.exponential(5, n) + 0.1)
    t[::3] = 4.0
    e = rng.integers(0, 2, n)
    g = np.array([["hot", "hot", "hot", "b", None, "c"][i % 6] if i > 9 else f"single{i}" for i in range(n)], dtype=object)
    df = spark.createDataFrame([(i, float(a), int(b), float(c), float(d), h) for i, (a, b, (c, d), h) in enumerate(zip(t, e, x, g, strict=True))], "_row_id long, time double, event int, a double, b double, g string")
    return df.repartition(3), t, e, x, g


def naive_efron(t, e, x, g, beta):
    loglik, score, info = 0.0, np.zeros(2), np.zeros((2, 2))
    w = np.exp(x @ beta)
    names = [str(v) for v in g]
    for s in set(names):
        of = np.array([v == s for v in names])
        for time in set(t[of & (e == 1)]):
            risk, dead = of & (t >= time), of & (t == time) & (e == 1)
            d = dead.sum()
            loglik += (x[dead] @ beta).sum()
            score += x[dead].sum(axis=0)
            for k in range(d):
                part = np.where(dead, 1 - k / d, 1.0) * risk * w
                s0, s1 = part.sum(), part @ x
                loglik -= np.log(s0)
                score -= s1 / s0
                info += (x * part[:, None]).T @ x / s0 - np.outer(s1, s1) / s0**2
    return loglik, score, info


@pytest.mark.parametrize("strata", [[], ["g"]])
@pytest.mark.parametrize("cells", [60, 900, None])
def test_likelihood_over_partitions(spark, strata, cells, monkeypatch):
    """Partitions of ten rows, through which ties and strata run, give the sums of the definition."""
    monkeypatch.setattr(likelihood, "ADDED", 8)
    monkeypatch.setattr(likelihood, "TIE_STEPS", 50)
    df, t, e, x, g = tied(spark)
    beta = np.array([0.4, -0.3])
    got = cox.evaluate(df, ["a", "b"], beta, strata, cells)
    want = naive_efron(t, e, x, g if strata else ["all"] * len(t), beta)
    for a, b in zip(got, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-10, atol=1e-9)


def test_fit_does_not_depend_on_partitions(spark):
    df, t, e, x, _ = tied(spark)
    one, many = cox.fit(df, ["a", "b"]), cox.fit(df, ["a", "b"], cells=300)
    beta, cov, ll = local.cox_newton(x, t, e)
    for f in (one, many):
        np.testing.assert_allclose(f.beta, beta, rtol=1e-8)
        np.testing.assert_allclose(f.cov, cov, rtol=1e-7)
        assert f.loglik == pytest.approx(ll, rel=1e-12)
    assert one.iterations == many.iterations


def test_influence_of_concordance(spark, monkeypatch):
    """Row counts by ranges equal the naive ones; the error is near that of resampling."""
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 25)
    rng = np.random.default_rng(9)
    n = 300
    t, e, r = rng.exponential(9, n).round(1) + 1, rng.integers(0, 2, n), rng.normal(size=n).round(1)
    t[::3], r[1::3] = 7.0, 0.5
    agree, comparable = np.zeros(n), np.zeros(n)
    for i in range(n):
        for j in range(n):
            if e[i] and t[j] > t[i]:
                s = 1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0
                for k in (i, j):
                    agree[k] += s
                    comparable[k] += 1
    c = agree.sum() / comparable.sum()
    want = np.sqrt(((agree - c * comparable) ** 2).sum()) / (comparable.sum() / 2)
    df = rows(spark, t, e, risk=r.tolist())
    assert len(concordance.ranges(df)[0]) > 3
    for cuts in (None, ([], [])):
        got = concordance.influence(df, cuts)
        assert got["c_index"] == pytest.approx(c, abs=1e-12) and got["std_error"] == pytest.approx(want, rel=1e-9)
    a, b = concordance.jackknife_interval(df), concordance.bootstrap_interval(df, 200)
    assert (a[1] - a[0]) == pytest.approx(b[1] - b[0], rel=0.2)
    assert concordance.influence(df.filter("time < 0")) is None and concordance.jackknife_interval(df.limit(5)) is None


def test_row_counts_add_up_to_pairs():
    rng = np.random.default_rng(3)
    t, e, r, w = rng.integers(0, 30, 500), rng.integers(0, 2, 500), rng.integers(0, 20, 500), rng.integers(1, 4, 500).astype(float)
    by_row = concordance.row_counts(t, e, r, w)
    assert [float(w @ x) / 2 for x in by_row] == pytest.approx(concordance.pair_counts(t, e, r, w))


def test_estimates_by_ranges_equal_those_by_windows(spark, monkeypatch):
    """Summaries, areas, curves and log-rank of groups with many times, one of them null and hot."""
    rng = np.random.default_rng(12)
    n = 400
    t, e = rng.exponential(20, n).round(1) + 0.1, rng.integers(0, 2, n)
    g = [None if i % 3 else ["a", "b", "a vs b"][i % 9 // 3] for i in range(n)]
    df = spark.createDataFrame([(i, float(a), int(b), c) for i, (a, b, c) in enumerate(zip(t, e, g, strict=True))], "_row_id long, time double, event int, g string").cache()
    named = df.filter("g is not null")

    def all_of():
        return [
            sorted(map(tuple, km.summary(df, ["g"]).collect()), key=str), sorted(map(tuple, km.rmst(df, ["g"], 30.0).collect()), key=str), sorted(map(tuple, km.rmst(df, [], 30.0).collect())),
            sorted(map(tuple, km.curve(df, ["g"]).collect()), key=str), logrank.logrank(named, "g", "fleming_harrington"), logrank.pairwise(named, "g"), sorted(map(tuple, km.summary(df, []).collect())),
        ]

    small = all_of()
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 15)
    large = all_of()

    def close(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)
        if isinstance(a, (list, tuple)):
            return len(a) == len(b) and all(map(close, a, b))
        return a == pytest.approx(b, rel=1e-9, abs=1e-12) if isinstance(a, float) else a == b

    assert all(map(close, small, large))
    assert len({p["comparison"] for p in small[5]}) == 3
    only = local.survival_curve(t, e)
    grid_t = np.append(only[0][only[0] <= 30], 30.0)
    area = grid_t[0] + float((np.diff(grid_t) * only[1][: len(grid_t) - 1]).sum())
    assert small[2][0][0] == pytest.approx(area, rel=1e-9)


def test_nothing_stays_in_storage(spark):
    """Grids are written, not kept in storage, and fits release their rows."""
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    df = rows(spark, range(1, 61), [1, 0, 1] * 20, risk=[float(i % 7) for i in range(60)])
    km.summary(df, []).collect()
    cox.baseline_hazard(df, cox.fit(df, ["risk"])).collect()
    concordance.jackknife_interval(df)
    logrank.logrank(df.withColumn("g", F.col("_row_id") % 2), "g")
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) <= before


def test_written_grids_go(spark):
    from lifegrid import scratch

    df = rows(spark, range(1, 21), [1, 0] * 10)
    before = len(scratch._written)
    with scratch.released():
        assert km.summary(df, []).first().n == 20
        folder = scratch._written[-1][1].removeprefix("file://")
        import os

        assert len(scratch._written) > before and os.path.isdir(folder)
    assert len(scratch._written) == before and not os.path.exists(folder)


def test_pairs_are_keyed_by_position(spark):
    """Groups whose names read like pairs keep their own statistics."""
    labels = ["a", "b vs c", "a vs b", "c"]
    t, e = np.random.default_rng(3).integers(1, 30, 200).astype(float), [1] * 200
    df = rows(spark, t, e, g=[labels[i % 4] for i in range(200)])
    got = logrank.pairwise(df, "g")
    assert len(got) == 6
    from itertools import combinations

    want = []
    for a, b in combinations(levels.ordered_levels("g", labels), 2):
        some = np.array([labels[i % 4] in (a, b) for i in range(200)])
        want.append(local.logrank(t[some], np.ones(some.sum()), np.array([labels[i % 4] == a for i in range(200)])[some]))
    assert [p["chisq"] for p in got] == pytest.approx(want)


def test_cutpoint_by_ranges(spark, monkeypatch):
    """Ranges of ten cells, with a value and a time that a third of the rows share, give the naive statistics; permutations at any size
    are the same ones."""
    rng = np.random.default_rng(14)
    n = 250
    x, t, e = rng.normal(size=n).round(1), rng.integers(1, 25, n).astype(float), rng.integers(0, 2, n)
    x[::3], t[1::3] = 0.3, 9.0
    df = rows(spark, t, e, x=x.tolist()).cache()
    small = {r.cutpoint: tuple(r) for r in cutpoint.scan(df, "x", 0.05).collect()}
    p = cutpoint.optimal_cutpoint(df, "x", 0.05, permutations=3)["permutation_p"]
    drawn = sorted(cutpoint.permutation_statistics(df, "x", 0.05, 2, 1))
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 10)
    monkeypatch.setattr(cutpoint, "TASK_ROWS", 10)
    large = {r.cutpoint: tuple(r) for r in cutpoint.scan(df, "x", 0.05).collect()}
    assert small.keys() == large.keys() and len(small) > 15
    for c, got in large.items():
        assert got[5] == pytest.approx(local.logrank(t, e, x > c), rel=1e-9) and got[:5] == small[c][:5]
        assert got[1:5] == ((x < c).sum(), (x > c).sum(), e[x < c].sum(), e[x > c].sum())
    assert sorted(cutpoint.permutation_statistics(df, "x", 0.05, 2, 1)) == pytest.approx(drawn, rel=1e-9)
    assert 0.25 <= p <= 1


def counted_rows(spark, df):
    """df and an accumulator of how many of its rows have been read."""
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(watch, df.schema), seen


def test_optimal_cutpoint_reads_the_cohort_once(spark):
    rng = np.random.default_rng(9)
    n = 400
    x, t, e = rng.integers(0, 30, n), rng.integers(1, 60, n), rng.integers(0, 2, n)
    df = rows(spark, t, e, x=(x + 0.0).tolist()).cache()
    watched, seen = counted_rows(spark, df)
    got = cutpoint.optimal_cutpoint(watched, "x")
    assert seen.value == n
    side = df.withColumn("side", F.col("x") > got["cutpoint"])
    med = {r.side: r.median for r in km.summary(side, ["side"]).collect()}
    assert (got["median_above"], got["median_below"]) == (med[True], med[False])
    assert cutpoint.optimal_cutpoint(watched, "x", permutations=3) | {"permutation_p": 0} == got | {"permutation_p": 0} and seen.value == 3 * n  # once more for the permutations


def test_ph_tests_read_the_cohort_once(spark):
    rng = np.random.default_rng(4)
    n = 300
    x, t = rng.integers(0, 9, n) + 0.0, np.ceil(9 * rng.exponential(1, n))
    df = rows(spark, t, rng.integers(0, 2, n), x=x.tolist(), s=[str(i % 2) for i in range(n)]).withColumnRenamed("x", "a[b c]").cache()
    for strata in ([], ["s"]):
        fit = cox.fit(df, ["a[b c]"], strata)
        watched, seen = counted_rows(spark, df)
        ph = cox.ph_tests(watched, fit)
        assert seen.value == n
        s = cox.schoenfeld(df, fit).toPandas()
        assert ph["terms"][0]["rho"] == pytest.approx(stats.spearman(s.time.tolist(), s.r0.round(12).tolist())[0], abs=1e-9)


def test_range_numbers_of_many_cuts(spark):
    cuts = [float(x) for x in range(0, 2000, 2)]
    df = spark.createDataFrame([(-0.0,), (-1.0,), (3.0,), (4.0,), (1998.0,), (5e9,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    marked = df.select("v", timegrid.range_number(F.col("v"), cuts).alias("r"))
    assert [r.r for r in marked.collect()] == [1, 0, 4, 5, 1999, 2000, 2000, 0, 2000]
    assert len(marked._jdf.queryExecution().optimizedPlan().toString()) < 2000  # the plan doesn't grow with the cuts


def test_brier_joins_by_count(spark, monkeypatch):
    """Curves of a small grid are sent to the rows; predictions and rows meet in as many tasks as they need."""
    rng = np.random.default_rng(6)
    n = 200
    df = rows(spark, rng.integers(1, 30, n), rng.integers(0, 2, n), s=rng.random(n).tolist()).cache()
    p = df.select("_row_id", F.explode(F.array(F.lit(5.0), F.lit(11.0))).alias("t"), F.col("s").alias("surv"))
    want = sorted(map(tuple, brier.brier_table(df, p).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(brier, "JOIN_ROWS", 7)
        out = brier.brier_table(df, p)
        got, plan = sorted(map(tuple, out.collect())), out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [pytest.approx(w) for w in want] and [r[1] for r in got] == [n, n]
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 1 and "_row_id" in joins[0] and sum("REPARTITION_BY_NUM" in line and ", 58)" in line for line in plan.splitlines()) == 2


def test_influence_reads_once_and_with_common_risks(spark, monkeypatch):
    monkeypatch.setattr(timegrid, "RANGE_ROWS", 12)
    rng = np.random.default_rng(8)
    n = 160
    t, e, r = rng.integers(1, 25, n), rng.integers(0, 2, n), rng.integers(0, 15, n) / 2.0
    t[::4], r[::3] = 9, 3.5
    df = rows(spark, t, e, risk=r.tolist()).cache()
    watched, seen = counted_rows(spark, df)
    got = concordance.influence(watched)
    assert seen.value == n
    score = (r[:, None] > r) + 0.5 * (r[:, None] == r)
    pair = (t[:, None] < t) & (e[:, None] == 1)
    num, com = (pair * score).sum(1) + (pair * score).sum(0), pair.sum(1) + pair.sum(0)
    c = num.sum() / com.sum()
    assert got["c_index"] == pytest.approx(c) and got["comparable"] == pair.sum()
    assert got["std_error"] == pytest.approx(math.sqrt(((num - c * com) ** 2).sum()) / pair.sum(), rel=1e-9)
    table = concordance.pair_table(watched).first()
    assert table.comparable == pair.sum() and table.c_index == pytest.approx(c) and seen.value == 2 * n
