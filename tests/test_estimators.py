"""Estimators on panels with planted effects, and brute-force checks."""

import numpy as np
import pandas as pd
import pytest

from stancepanel.operators import did, matching, synth


def staggered(effect, units=24, years=10, seed=1):
    rng = np.random.default_rng(seed)
    a, t = rng.normal(size=units), rng.normal(size=years)
    rows = []
    for i in range(units):
        cohort = 0 if i % 4 == 0 else 2003 + i % 4
        for k in range(years):
            year = 2000 + k
            on = cohort > 0 and year >= cohort
            rows.append((i, year, cohort, int(on), a[i] + t[k] + (effect(cohort, year - cohort) if on else 0)))
    return pd.DataFrame(rows, columns=["unit", "year", "cohort", "d", "y"])


@pytest.fixture(scope="module")
def constant(spark):
    return spark.createDataFrame(staggered(lambda g, e: 2.0)).cache()


@pytest.fixture(scope="module")
def varying_frame():
    return staggered(lambda g, e: 1.0 + (g - 2003) + 0.5 * e)


@pytest.fixture(scope="module")
def varying(spark, varying_frame):
    return spark.createDataFrame(varying_frame).cache()


def test_event_study_recovers_constant_effect(constant):
    p = did.event_study(constant, "y", "unit", "year").toPandas()
    post = p[(p["rel_year"] >= 0)]
    assert np.allclose(post["estimate"], 2, atol=1e-6)
    assert np.allclose(p[p["rel_year"] < -1]["estimate"], 0, atol=1e-6)


def test_group_time_effects_are_exact(varying):
    got = did.att_gt(varying, "y", "unit", "year").toPandas()
    want = [1 + (g - 2003) + 0.5 * (t - g) if t >= g else 0.0 for g, t in zip(got["cohort"], got["time"])]
    assert np.allclose(got["att"], want, atol=1e-9)


def test_group_time_error_matches_unit_influence(spark):
    f = staggered(lambda g, e: 1.0, seed=3)
    f["y"] += np.random.default_rng(9).normal(size=len(f))
    got = did.att_gt(spark.createDataFrame(f), "y", "unit", "year").toPandas()
    row = got[(got["cohort"] == 2005) & (got["time"] == 2007)].iloc[0]
    wide = f.pivot(index="unit", columns="year", values="y")
    c = f.groupby("unit")["cohort"].first()
    diff = wide[2007] - wide[2004]
    treated, control = diff[c == 2005], diff[(c == 0) | (c > 2007)]
    var = (((treated - treated.mean()) / len(treated)) ** 2).sum() + (((control - control.mean()) / len(control)) ** 2).sum()
    assert np.isclose(row["att"], treated.mean() - control.mean())
    assert np.isclose(row["se"], np.sqrt(var))


def test_simple_and_dynamic_weights(varying, varying_frame):
    g = did.GroupTime(varying, "y", "unit", "year")
    att, _ = g.simple()
    sizes = varying_frame[varying_frame["cohort"] > 0].groupby("cohort")["unit"].nunique()
    cells = [(c, t) for c in sizes.index for t in range(2001, 2010) if t >= c and
             any(x == 0 or x > t for x in varying_frame["cohort"].unique() if x != c)]
    want = np.average([1 + (c - 2003) + 0.5 * (t - c) for c, t in cells], weights=[sizes[c] for c, _ in cells])
    assert np.isclose(att, want)
    path = g.dynamic().toPandas().set_index("rel_year")["estimate"]
    assert np.isclose(path[0], np.average([1 + (c - 2003) for c in sizes.index], weights=sizes.values))


def test_sun_abraham_path_and_total(varying, varying_frame):
    path, (att, _) = did.sun_abraham(varying, "y", "unit", "year")
    path = path.toPandas().set_index("rel_year")["estimate"]
    f = varying_frame[varying_frame["cohort"] > 0]
    f = f.assign(e=f["year"] - f["cohort"], tau=1 + (f["cohort"] - 2003) + 0.5 * (f["year"] - f["cohort"]))
    for e in range(0, 5):
        assert np.isclose(path[e], f[f["e"] == e]["tau"].mean(), atol=1e-6)
    assert np.isclose(att, f[f["e"] >= 0]["tau"].mean(), atol=1e-6)


def test_imputation_path(varying, varying_frame):
    path = did.imputation(varying, "y", "unit", "year", draws=10).toPandas().set_index("rel_year")
    f = varying_frame[varying_frame["cohort"] > 0]
    f = f.assign(e=f["year"] - f["cohort"], tau=1 + (f["cohort"] - 2003) + 0.5 * (f["year"] - f["cohort"]))
    for e in range(0, 5):
        assert np.isclose(path.loc[e, "estimate"], f[f["e"] == e]["tau"].mean(), atol=1e-6)
    assert np.allclose(path.loc[-3:-1, "estimate"], 0, atol=1e-6)
    assert path.loc[0:4, "se"].notna().all()


def test_cohort_options(spark):
    f = pd.DataFrame({"unit": [1, 1, 1, 2, 2, 2, 3, 3, 3], "year": [1, 2, 3] * 3, "d": [0, 1, 0, 1, 1, 1, 0, 0, 0]})
    df = spark.createDataFrame(f)
    got = did.cohorts(df, "unit", "year", "d").groupBy("unit").agg({"cohort": "max"}).toPandas()
    assert dict(got.values) == {1: 2, 2: 0, 3: 0}
    kept = did.cohorts(df, "unit", "year", "d", drop_always_treated=True).select("unit").distinct().toPandas()
    assert sorted(kept["unit"]) == [1, 3]
    assert {r["unit"]: r["n_reversals"] for r in did.reversals(df, "unit", "year", "d").collect()} == {1: 1, 2: 0, 3: 0}


def brute_match(f, lag, size, lead, covs):
    wide = {c: f.pivot(index="unit", columns="year", values=c) for c in ["y", "d", *covs]}
    out = []
    for t in sorted(f["year"].unique()):
        if t - lag not in wide["d"].columns or t + lead not in wide["d"].columns:
            continue
        past = [t - i for i in range(1, lag + 1)]
        inv = {s: np.linalg.inv(np.cov(np.array([wide[c][s] for c in covs]))) for s in past}
        for u in wide["d"].index:
            d = wide["d"].loc[u]
            if not (d[t] == 1 and d[t - 1] == 0 and all(d[t + k] == 1 for k in range(lead + 1))):
                continue
            cand = []
            for v in wide["d"].index:
                e = wide["d"].loc[v]
                if v != u and e[t] == 0 and all(e[s] == d[s] for s in past):
                    dist = np.mean([np.sqrt(delta @ inv[s] @ delta) for s in past
                                    for delta in [np.array([wide[c].loc[u, s] - wide[c].loc[v, s] for c in covs])]])
                    cand.append((dist, v))
            if cand:
                near = [v for _, v in sorted(cand)[:size]]
                y = wide["y"]
                out.append(y.loc[u, t + lead] - y.loc[u, t - 1] - np.mean([y.loc[v, t + lead] - y.loc[v, t - 1] for v in near]))
    return np.mean(out), len(out)


@pytest.mark.parametrize("lag", [1, 2])
def test_panel_matching_against_brute_force(spark, lag):
    f = staggered(lambda g, e: 1.5, seed=5)
    rng = np.random.default_rng(2)
    f["c1"], f["c2"] = rng.normal(size=len(f)), rng.normal(size=len(f))
    f["y"] += 0.3 * f["c1"]
    got = matching.panel_match(spark.createDataFrame(f), "unit", "year", "d", "y", ["c1", "c2"], lag=lag, leads=[2],
                               size=5, draws=50).toPandas().iloc[0]
    want, n = brute_match(f, lag, 5, 2, ["c1", "c2"])
    assert np.isclose(got["att"], want) and got["n_treated"] == n and got["se"] > 0


def test_unique_history_has_no_matches(spark):
    f = pd.DataFrame({"unit": [1, 1, 1, 2, 2, 2], "year": [1, 2, 3] * 2, "d": [0, 0, 1, 1, 1, 1],
                      "y": [1., 2, 3, 4, 5, 6], "c": [1., 2, 3, 4, 5, 7]})
    assert matching.panel_match(spark.createDataFrame(f), "unit", "year", "d", "y", ["c"], leads=[0]).count() == 0


def test_synthetic_control_recovers_weights(spark):
    rng = np.random.default_rng(7)
    years, donors = range(2000, 2015), 12
    paths = rng.normal(size=(donors, len(years))).cumsum(axis=1) + rng.normal(size=(donors, 1)) * 5
    rows = [(f"d{j}", y, 0, paths[j, k]) for j in range(donors) for k, y in enumerate(years)]
    mix = {"A": (0.3, 0, 0.7, 1), "B": (0.5, 5, 0.5, 9)}
    for name, (wa, a, wb, b) in mix.items():
        start = 2010 if name == "A" else 2008
        for k, y in enumerate(years):
            rows.append((name, y, int(y >= start), wa * paths[a, k] + wb * paths[b, k] + (3.0 if y >= start else 0)))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "year", "d", "y"]))
    w = synth.synthetic_weights(df, "unit", "year", "d", "y")
    got = {(r["treated"], r["donor"]): r["weight"] for r in w.collect()}
    assert np.isclose(got[("A", "d0")], 0.3, atol=1e-4) and np.isclose(got[("A", "d1")], 0.7, atol=1e-4)
    assert np.isclose(got[("B", "d5")], 0.5, atol=1e-4) and np.isclose(got[("B", "d9")], 0.5, atol=1e-4)
    total = w.groupBy("treated").agg({"weight": "sum"}).toPandas().iloc[:, 1]
    assert np.allclose(total, 1)
    gap = synth.synthetic_paths(df, w, "unit", "year", "y").toPandas()
    pre = gap[gap["year"] < gap["treat_year"]]["gap"]
    post = gap[gap["year"] >= gap["treat_year"]]["gap"]
    assert np.allclose(pre, 0, atol=1e-3) and np.allclose(post, 3, atol=1e-3)


def test_synthetic_control_is_optimal(spark):
    """Against a dense projected-gradient solution when no exact mixture exists."""
    rng = np.random.default_rng(11)
    donors, years = 15, range(2000, 2012)
    paths = rng.normal(size=(donors, len(years)))
    y = rng.normal(size=len(years))
    rows = [(j, t, 0, paths[j, k]) for j in range(donors) for k, t in enumerate(years)]
    rows += [(99, t, int(t >= 2009), y[k]) for k, t in enumerate(years)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["unit", "year", "d", "y"]))
    got = {r["donor"]: r["weight"] for r in synth.synthetic_weights(df, "unit", "year", "d", "y").collect()}
    A, b = paths[:, :9].T, y[:9]
    w = np.full(donors, 1 / donors)
    step = 1 / np.linalg.norm(A, 2) ** 2
    for _ in range(50000):
        v = w - step * A.T @ (A @ w - b)
        u = np.sort(v)[::-1]
        css = np.cumsum(u) - 1
        k = np.nonzero(u - css / np.arange(1, donors + 1) > 0)[0][-1]
        w = np.maximum(v - css[k] / (k + 1), 0)
    mine = np.array([got.get(j, 0.0) for j in range(donors)])
    assert np.sum((A @ mine - b) ** 2) <= np.sum((A @ w - b) ** 2) + 1e-7


def test_synthetic_control_missing_rules(spark):
    rows = [("a", t, 0, float(t % 3)) for t in range(6)] + [("b", t, 0, None if t == 1 else 1.0) for t in range(6)]
    rows += [("t", t, int(t >= 4), None if t == 0 else 1.0) for t in range(6)]
    df = spark.createDataFrame(rows, "unit string, year int, d int, y double")
    w = synth.synthetic_weights(df, "unit", "year", "d", "y").collect()
    assert [(r["donor"], r["weight"]) for r in w] == [("a", 1.0)]
    assert synth.synthetic_weights(df, "unit", "year", "d", "y", max_missing_treated=0).count() == 0
