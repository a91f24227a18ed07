"""Synthetic controls for all treated units at once (H operators).

The weights minimise the distance between a treated unit's pre-treatment path
and a convex combination of donor paths. That is the point of least norm in
the hull of the donor gaps, found by column generation: Spark prices every
donor against the current residuals (a distributed matrix product with a
per-batch minimum), and the driver re-solves over the few donors chosen so far,
at most one more than the number of pre-treatment years.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.operators.panel import transitions
from stancepanel.sources.lexicon import small_table


def donor_pool(panel: DataFrame, unit: str, treatment: str) -> DataFrame:
    """H1: units that are never treated (and observed at least once)."""
    return panel.groupBy(unit).agg(F.max(treatment).alias("m")).where(F.col("m") == 0).select(unit)


def balanced_panel(panel: DataFrame, unit: str, time: str) -> DataFrame:
    """H2: every unit in every year of the panel's range, absent cells NULL."""
    ends = panel.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("e")).scalar()
    grid = panel.select(unit).distinct().withColumn(time, F.explode(F.sequence(ends["lo"], ends["hi"])))
    return grid.join(panel, [unit, time], "left")


def treated_units(panel: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """Units with a transition: first year seen and year of the first transition."""
    moves = transitions(panel, unit, time, treatment, "_t")
    return moves.groupBy(unit).agg(
        F.min(time).alias("first_year"), F.min(F.when(F.col("_t") == 1, F.col(time))).alias("treat_year")
    ).where(F.col("treat_year").isNotNull())


def _windows(treated: DataFrame, time: str, max_windows: int = 100_000) -> DataFrame:
    """Distinct pre-treatment windows, one row per window and year (a small local table)."""
    got = treated.select("first_year", "treat_year").distinct().limit(max_windows + 1).collect()
    if len(got) > max_windows:
        raise ValueError("too many distinct pre-treatment windows")
    rows = [(r[0], r[1], t) for r in got for t in range(r[0], r[1])]
    cols = list(zip(*rows)) or [[], [], []]
    return small_table(treated.sparkSession, dict(zip(("first_year", "treat_year", time), map(list, cols))),
                       {c: pa.int32() for c in ("first_year", "treat_year", time)})


def _pre_period(panel: DataFrame, unit: str, time: str, treatment: str, outcome: str) -> DataFrame:
    """Outcomes before treatment: of treated units, and of donors in each distinct window.

    Treated units that share a window share its donors, so treated units and
    donors are never paired.
    """
    treated = treated_units(panel, unit, time, treatment)
    own = panel.join(treated, unit).where(F.col(time) < F.col("treat_year")).withColumn("role", F.lit("treated"))
    pool = panel.join(donor_pool(panel, unit, treatment), unit, "left_semi")
    donors = pool.join(_windows(treated, time), time).withColumn("role", F.lit("donor"))
    keep = ["first_year", "treat_year", unit, "role", outcome]
    return own.select(*keep).unionByName(donors.select(*keep))


def pre_period_coverage(panel: DataFrame, unit: str, time: str, treatment: str, outcome: str) -> DataFrame:
    """H3: per pre-treatment window and unit (treated or donor): its years and observed outcomes."""
    rows = _pre_period(panel, unit, time, treatment, outcome)
    return rows.groupBy("first_year", "treat_year", unit, "role").agg(F.count(outcome).alias("n_observed")).withColumn(
        "n_pre", F.col("treat_year") - F.col("first_year"))


def eligible(coverage: DataFrame, max_missing_treated: int = 2) -> DataFrame:
    """H3: treated units with few gaps; donors without any."""
    allowed = F.when(F.col("role") == "treated", max_missing_treated).otherwise(0)
    return coverage.where((F.col("n_pre") - F.col("n_observed") <= allowed) & (F.col("n_observed") > 0))


def pre_means(panel: DataFrame, coverage: DataFrame, unit: str, time: str, treatment: str,
              outcome: str) -> DataFrame:
    """H4: mean outcome before treatment for each eligible unit and window."""
    keys = ["first_year", "treat_year", unit, "role"]
    return (_pre_period(panel, unit, time, treatment, outcome).groupBy(*keys)
            .agg(F.avg(outcome).alias("pre_mean")).join(coverage.select(*keys), keys, "left_semi"))


def least_norm_weights(columns: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """Convex weights of the point of least norm in the hull of the columns (Wolfe's method).

    The rounds end at the optimality gap `tol`; weights that do not get there are an error.
    """
    n = columns.shape[1]
    gram = columns.T @ columns
    scale = max(float(np.max(np.diag(gram))), 1e-300)
    active = [int(np.argmin(np.diag(gram)))]
    w = np.zeros(n)
    w[active[0]] = 1.0
    for _ in range(50 * (n + 1)):
        grad = gram @ w
        j = int(np.argmin(grad))
        if grad[j] >= float(w @ grad) - tol * scale or j in active:
            break
        active.append(j)
        while True:
            sub = gram[np.ix_(active, active)]
            kkt = np.block([[sub, np.ones((len(active), 1))], [np.ones((1, len(active))), np.zeros((1, 1))]])
            target = np.linalg.lstsq(kkt, np.append(np.zeros(len(active)), 1.0), rcond=None)[0][:-1]
            if np.all(target > 1e-14):
                w[:] = 0
                w[active] = target
                break
            now = w[active]
            falling = target <= 1e-14
            step = float(np.min(now[falling] / np.maximum(now[falling] - target[falling], 1e-300)))
            moved = now + min(max(step, 0.0), 1.0) * (target - now)
            moved[moved < 1e-14] = 0.0
            w[:] = 0
            w[active] = moved
            active = [a for a, m in zip(active, moved) if m > 0]
    else:
        raise RuntimeError("the optimality gap of the weights stays open")
    return w / w.sum()


def synthetic_weights(panel: DataFrame, unit: str, time: str, treatment: str, outcome: str,
                      max_missing_treated: int = 2, predictor: str = "path", tol: float = 1e-9,
                      max_treated: int = 5000, max_times: int = 2000) -> DataFrame:
    """H5: donor weights of every treated unit: treated, treat_year, donor, weight."""
    spark = panel.sparkSession
    cases = treated_units(panel, unit, time, treatment).limit(max_treated + 1).collect()
    times = sorted(r[0] for r in panel.select(time).distinct().limit(max_times + 1).collect())
    if len(cases) > max_treated or len(times) > max_times:
        raise ValueError("too many treated units or years for the driver")
    span = range(times[0], times[-1] + 1) if times else range(0)
    series = F.array(*[F.max(F.when(F.col(time) == t, F.col(outcome).cast("double"))) for t in span])
    keys = small_table(spark, {unit: [c[unit] for c in cases]}) if cases else None
    wide = panel.groupBy(unit).agg(series.alias("s"), F.max(treatment).alias("m"))
    own = {} if keys is None else {r[unit]: np.array([np.nan if v is None else v for v in r["s"]]) for r in
                                   wide.join(keys, unit, "left_semi").select(unit, "s").collect()}
    targets = {}
    for c in cases:
        window = [i for i, t in enumerate(span) if c["first_year"] <= t < c["treat_year"]]
        y = own[c[unit]][window]
        if window and np.isnan(y).sum() <= max_missing_treated and not np.isnan(y).all():
            targets[c[unit]] = (window, y, c["treat_year"])
    donors = wide.where("m = 0").select(unit, "s").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = _generate_columns(donors, unit, targets, predictor, tol)
    finally:
        donors.unpersist()
    cols = list(zip(*rows)) or [[], [], [], []]
    kind = {"string": pa.string(), "int": pa.int32()}.get(dict(panel.dtypes)[unit], pa.int64())
    return small_table(spark, dict(zip(("treated", "treat_year", "donor", "weight"), map(list, cols))),
                       {"treated": kind, "donor": kind, "treat_year": pa.int32(), "weight": pa.float64()})


def _features(s, window, y, predictor):
    """Gap of donor paths to the treated path, one row per donor; NaN marks an unusable donor."""
    part = s[:, window]
    gap = part[:, ~np.isnan(y)] - y[~np.isnan(y)]
    gap[np.isnan(part).any(axis=1)] = np.nan
    return gap.mean(axis=1, keepdims=True) if predictor == "mean" else gap


def _generate_columns(donors, unit, targets, predictor, tol):
    kind = dict(donors.dtypes)[unit]
    state = {u: {"names": [], "gaps": [], "w": None, "x": None} for u in targets}
    order, open_ = list(targets), set(targets)

    while open_:
        goals = [(order.index(u), *targets[u][:2], state[u]["x"]) for u in open_]

        def price(frames, goals=goals):
            for frame in frames:
                if not len(frame):
                    continue
                s = np.array([[np.nan if v is None else v for v in row] for row in frame["s"]], float)
                best = []
                for at, window, y, x in goals:
                    gap = _features(s, window, y, predictor)
                    cost = (gap * gap).sum(axis=1) if x is None else gap @ x
                    if not np.isnan(cost).all():
                        i = int(np.nanargmin(cost))
                        best.append((at, frame[unit].iloc[i], float(cost[i]), list(s[i])))
                yield pd.DataFrame(best, columns=["at", "donor", "cost", "series"])

        schema = f"at int, donor {kind}, cost double, series array<double>"
        got = donors.mapInPandas(price, schema).groupBy("at").agg(
            F.min_by(F.struct("donor", "series"), F.struct("cost", "donor")).alias("b"),
            F.min("cost").alias("cost")).collect()
        found = {order[r["at"]]: r for r in got}
        for u in list(open_):
            st, r = state[u], found.get(u)
            if r is None:  # no usable donor
                open_.discard(u)
                continue
            window, y, _ = targets[u]
            series = np.array([[np.nan if v is None else v for v in r["b"]["series"]]])
            norm = float(st["x"] @ st["x"]) if st["x"] is not None else np.inf
            scale = float((y[~np.isnan(y)] ** 2).sum()) or 1.0
            if st["x"] is not None and (r["cost"] >= norm - tol * scale or r["b"]["donor"] in st["names"]):
                open_.discard(u)
                continue
            st["names"].append(r["b"]["donor"])
            st["gaps"].append(_features(series, window, y, predictor)[0])
            columns = np.array(st["gaps"]).T
            st["w"] = least_norm_weights(columns)
            st["x"] = columns @ st["w"]
    return [(u, int(targets[u][2]), name, float(w)) for u, st in state.items() if st["w"] is not None
            for name, w in zip(st["names"], st["w"]) if w > 0]


def synthetic_paths(panel: DataFrame, weights: DataFrame, unit: str, time: str, outcome: str) -> DataFrame:
    """H5: actual, synthetic and gap per treated unit and year; NULL where a donor is missing."""
    donors = panel.select(F.col(unit).alias("donor"), time, F.col(outcome).alias("y"))
    size = weights.groupBy("treated").agg(F.count(F.lit(1)).alias("_k"))
    synthetic = weights.join(donors, "donor").groupBy("treated", "treat_year", time).agg(
        F.sum(F.col("weight") * F.col("y")).alias("_s"), F.count("y").alias("_n"))
    synthetic = synthetic.join(size, "treated").withColumn(
        "synthetic", F.when(F.col("_n") == F.col("_k"), F.col("_s"))).drop("_s", "_n", "_k")
    actual = panel.select(F.col(unit).alias("treated"), time, F.col(outcome).alias("actual"))
    return synthetic.join(actual, ["treated", time], "left").withColumn(
        "gap", F.col("actual") - F.col("synthetic"))


def weights_report(weights: DataFrame, at_least: float = 0.001) -> DataFrame:
    """H6: donor weights above a floor, largest first within a case."""
    return weights.where(F.col("weight") > at_least).orderBy("treated", F.desc("weight"), "donor")


def report_window(paths: DataFrame, time: str, before: int = 15, after: int = 10) -> DataFrame:
    """H6: years near treatment."""
    return paths.where((F.col(time) >= F.col("treat_year") - before) & (F.col(time) <= F.col("treat_year") + after))
