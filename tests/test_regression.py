"""Fixed-effects fits against dense least squares."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stancepanel.operators import many_levels as ml
from stancepanel.operators import regression as rg


def dense(frame, y, x, effects, weights=None, cluster=None, hetero=False, n_nested=None):
    w = frame[weights].to_numpy(float) if weights else np.ones(len(frame))
    cols = [frame[c].to_numpy(float) for c in x]
    blocks = [pd.get_dummies(frame[e]).to_numpy(float) for e in effects] or [np.ones((len(frame), 1))]
    X = np.column_stack(cols + blocks)
    Y = frame[y].to_numpy(float)
    bread = np.linalg.pinv(X.T @ (X * w[:, None]))
    beta = bread @ X.T @ (w * Y)
    e = Y - X @ beta
    k = len(x) + (sum(b.shape[1] for b in blocks) - (len(blocks) - 1))
    n = len(frame)
    if hetero:
        s = X * (w * e)[:, None]
        v = bread @ (s.T @ s) @ bread * n / (n - k)
    elif cluster is not None:
        s = pd.DataFrame(X * (w * e)[:, None]).groupby(frame[cluster].to_numpy()).sum().to_numpy()
        g = len(s)
        v = bread @ (s.T @ s) @ bread * g / (g - 1) * (n - 1) / (n - (k if n_nested is None else n_nested))
    else:
        v = bread * (w * e * e).sum() / (n - k)
    return beta[:len(x)], np.sqrt(np.diag(v))[:len(x)]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(4)
    n = 900
    f = pd.DataFrame({"a": rng.integers(0, 120, n), "t": rng.integers(0, 7, n), "f": rng.integers(0, 4, n),
                      "g": rng.integers(0, 15, n), "x1": rng.normal(size=n), "x2": rng.normal(size=n),
                      "w": rng.integers(1, 6, n).astype(float)})
    f["x1"] += 0.3 * f["a"] % 3 + 0.2 * f["t"]
    f["y"] = 2 * f["x1"] - f["x2"] + 0.1 * f["a"] + f["t"] + rng.normal(size=n) * (1 + f["g"] / 5)
    return f


def check(table, beta, se):
    got = table.toPandas()
    assert np.allclose(got["estimate"], beta, atol=1e-8)
    assert np.allclose(got["se"], se, rtol=1e-7)


@pytest.mark.parametrize("absorb,effects", [("a", ["t"]), ("a", ["t", "f"]), (None, ["t"]), (None, ["t", "f"]),
                                            ("a", []), (None, [])])
@pytest.mark.parametrize("vcov", ["iid", "hetero", "cluster"])
def test_matches_dense(spark, frame, absorb, effects, vcov):
    all_fx = ([absorb] if absorb else []) + effects
    table = rg.fixed_effects(spark.createDataFrame(frame), "y", ["x1", "x2"], absorb, effects, vcov=vcov,
                             cluster="g" if vcov == "cluster" else None, weights="w")
    beta, se = dense(frame, "y", ["x1", "x2"], all_fx, "w", "g" if vcov == "cluster" else None, vcov == "hetero")
    check(table, beta, se)


def test_nested_effects_do_not_count(spark, frame):
    f = frame.assign(c=frame["a"] % 20)
    table = rg.fixed_effects(spark.createDataFrame(f), "y", ["x1"], "a", ["t"], cluster="c")
    k = 1 + 7  # regressor and years; units are nested in clusters
    check(table, *dense(f, "y", ["x1"], ["a", "t"], None, "c", n_nested=k))


def test_many_models_in_one_fit(spark, frame):
    table = rg.fixed_effects(spark.createDataFrame(frame), "y", ["x1", "x2"], "a", ["t"], by="f",
                             cluster="g").toPandas()
    for f, part in frame.groupby("f"):
        beta, se = dense(part, "y", ["x1", "x2"], ["a", "t"], None, "g")
        got = table[table["model"] == str(f)]
        assert np.allclose(got["estimate"], beta, atol=1e-8) and np.allclose(got["se"], se, rtol=1e-6)


def test_constant_within_unit_is_not_estimable(spark, frame):
    f = frame.assign(x2=frame["a"] % 5, x3=frame["x1"] * 2)
    got = rg.fixed_effects(spark.createDataFrame(f), "y", ["x1", "x2", "x3"], "a", ["t"]).toPandas()
    assert got["estimate"].isna().tolist() == [False, True, True]


def test_too_few_rows_give_no_model(spark, frame):
    assert rg.ols(spark.createDataFrame(frame), "y", ["x1"], min_rows=1000).count() == 0


def test_reported_dummies(spark, frame):
    table = rg.fixed_effects(spark.createDataFrame(frame), "y", ["x1"], "a", ["t"], dummies={"f": 2},
                             vcov="hetero").toPandas().set_index("term")
    f = frame.assign(**{f"f{i}": (frame["f"] == i).astype(float) for i in (0, 1, 3)})
    beta, se = dense(f, "y", ["x1", "f0", "f1", "f3"], ["a", "t"], hetero=True)
    got = table.loc[["x1", "f::0", "f::1", "f::3"]]
    assert np.allclose(got["estimate"], beta, atol=1e-8) and np.allclose(got["se"], se, rtol=1e-7)


def test_p_value():
    assert math.isclose(rg.t_p_value(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(rg.t_p_value(12.7062047, 1), 0.05, rel_tol=1e-6)


def test_level_limit(spark, frame):
    """The dense model refuses; the operator goes on with the sparse one."""
    with pytest.raises(ValueError, match="absorb the largest"):
        rg.FixedEffectsModel(spark.createDataFrame(frame), "y", ["x1"], None, ["a"], max_levels=50)
    table = rg.fixed_effects(spark.createDataFrame(frame), "y", ["x1", "x2"], "a", ["t", "f"], cluster="g", weights="w",
                             max_levels=5)
    check(table, *dense(frame, "y", ["x1", "x2"], ["a", "t", "f"], "w", "g"))


@pytest.mark.parametrize("effects,vcov", [(["a", "g"], "iid"), (["g", "a", "t"], "hetero"), (["a", "g", "f"], "cluster"),
                                          (["a"], "cluster"), ([], "hetero")])
def test_many_levels_match_dense(spark, frame, effects, vcov):
    """Unbalanced large effects; clusters may nest an effect."""
    f = frame.assign(c=frame["a"] % 20)
    nested = 2 + (sum(f[e].nunique() for e in effects[1:]) + 1 - (len(effects) - 1)) if effects else None
    got = ml.ManyLevelModel(spark.createDataFrame(f), "y", ["x1", "x2"], effects, weights="w", vcov=vcov,
                            cluster="c" if vcov == "cluster" else None).table()
    check(got, *dense(f, "y", ["x1", "x2"], effects, "w", "c" if vcov == "cluster" else None, vcov == "hetero",
                      n_nested=nested))


def test_many_levels_by_model_and_what_is_not_estimable(spark, frame):
    f = frame.assign(x2=frame["a"] % 5)
    got = ml.ManyLevelModel(spark.createDataFrame(f), "y", ["x1", "x2"], ["a", "t"], by="f", cluster="g").table().toPandas()
    for label, part in f.groupby("f"):
        beta, se = dense(part, "y", ["x1"], ["a", "t"], None, "g")
        own = got[got["model"] == str(label)].set_index("term")
        assert np.isnan(own.loc["x2", "estimate"])
        assert np.isclose(own.loc["x1", "estimate"], beta[0], atol=1e-7) and np.isclose(own.loc["x1", "se"], se[0], rtol=1e-6)
    assert ml.ManyLevelModel(spark.createDataFrame(f), "y", ["x1"], ["a", "t"], min_rows=1000).table().count() == 0


def test_two_effects_of_a_hundred_thousand_levels(spark):
    """A known effect under two effects with far more levels than a moment matrix could hold, on a sparse graph."""
    rows = spark.range(400_000).select(
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100_000)).alias("a"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(100_000)).alias("b"),
        (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000).alias("u"),
        (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1000)) / 1000 - 0.5).alias("noise"))
    rows = rows.select("a", "b", (F.col("u") + F.col("a") % 7 / 10 + F.col("b") % 5 / 10).alias("x"), "u", "noise").select(
        "*", (3 * F.col("x") + F.col("a") % 11 - F.col("b") % 13 + F.col("noise")).alias("y"))
    model = ml.ManyLevelModel(rows, "y", ["x"], ["a", "b"], cluster="a", tolerance=1e-6)
    (r,) = model.records()
    assert abs(r["estimate"] - 3) < 5 * r["se"] and r["se"] < 0.01 and model.taken < 60
