"""Difference-in-differences estimators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.functions.scalars import clamp
from stancepanel.operators.panel import transitions
from stancepanel.operators.regression import FixedEffectsModel
from stancepanel.sources.lexicon import small_table


def cohorts(df: DataFrame, unit: str, time: str, treatment: str, drop_always_treated: bool = False,
            name: str = "cohort") -> DataFrame:
    """Year of the first 0 to 1 transition, 0 for units without one.

    Units treated from their first row on have no transition and count as never
    treated, unless `drop_always_treated`.
    """
    moves = transitions(df, unit, time, treatment, "_t")
    first = moves.groupBy(unit).agg(
        F.coalesce(F.min(F.when(F.col("_t") == 1, F.col(time))), F.lit(0)).alias(name),
        F.min(F.struct(time, treatment))[treatment].alias("_first"))
    if drop_always_treated:
        first = first.where((F.col(name) > 0) | (F.col("_first") != 1))
    return df.join(first.drop("_first"), unit)


def reversals(df: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """Treated rows after which treatment is lost, per unit (cohorts treat it as absorbing)."""
    off = transitions(df.withColumn("_off", 1 - F.col(treatment)), unit, time, "_off", "_t")
    return off.groupBy(unit).agg(F.sum("_t").alias("n_reversals"))


def event_study(df: DataFrame, y: str, unit: str, time: str, cohort: str = "cohort", x=(), k: int = 5,
                reference: int = -1, vcov: str = "hetero", **options) -> DataFrame:
    """G1: two-way fixed effects with binned relative years, treated units only."""
    rows = df.where(F.col(cohort) > 0).withColumn("rel_year", clamp(F.col(time) - F.col(cohort), -k, k))
    table = FixedEffectsModel(rows, y, x, unit, [time], {"rel_year": reference}, vcov=vcov, **options).table()
    return _path(table, "rel_year::", "TWFE")


def _path(table: DataFrame, prefix: str, method: str) -> DataFrame:
    part = table.where(F.col("term").startswith(prefix))
    rel = F.regexp_replace("term", prefix, "").cast("double").cast("int")
    return with_interval(part.select(F.lit(method).alias("method"), rel.alias("rel_year"), "estimate", "se"))


def with_interval(df: DataFrame) -> DataFrame:
    """Normal 95 percent interval around `estimate`."""
    return df.withColumns({"ci_lower": F.col("estimate") - 1.96 * F.col("se"),
                           "ci_upper": F.col("estimate") + 1.96 * F.col("se")})


# -- Callaway and Sant'Anna --------------------------------------------------------------------------

def att_gt(df: DataFrame, y: str, unit: str, time: str, cohort: str = "cohort") -> DataFrame:
    """Group-time effects with not-yet-treated controls and a varying base period.

    Four-mean differences from one cohort x time table. Cohorts treated in the
    first period are dropped; cohorts after the last period are never treated.
    Standard errors are sums of squared unit influences, from a second pass.
    """
    return GroupTime(df, y, unit, time, cohort).table()


class GroupTime:
    """Group-time effects and their aggregates; design tables are cohorts x times."""

    def __init__(self, df: DataFrame, y: str, unit: str, time: str, cohort: str = "cohort",
                 max_cells: int = 1_000_000):
        self.spark = df.sparkSession
        rows = df.where(F.col(y).isNotNull()).select(
            F.col(unit).alias("unit"), F.col(time).cast("int").alias("t"),
            F.col(cohort).cast("int").alias("g"), F.col(y).cast("double").alias("y"))
        span = rows.agg(F.min("t"), F.max("t")).first()
        g = F.when(F.col("g") > span[1], 0).otherwise(F.col("g"))
        self.rows = rows.withColumn("g", g).where((F.col("g") == 0) | (F.col("g") > span[0]))
        got = self.rows.groupBy("g", "t").agg(F.count("y").alias("n"), F.avg("y").alias("m")) \
            .limit(max_cells + 1).collect()
        if len(got) > max_cells:
            raise ValueError("too many cohort x time cells")
        self.cells = {(r["g"], r["t"]): (r["n"], r["m"]) for r in got}
        sizes = self.rows.select("unit", "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
        self.units = {r["g"]: r["n"] for r in sizes}
        self.effects = self._effects()

    def _mean(self, groups, t):
        found = [self.cells[(g, t)] for g in groups if (g, t) in self.cells]
        n = sum(c[0] for c in found)
        return (n, sum(c[0] * c[1] for c in found) / n) if n else (0, float("nan"))

    def _effects(self):
        times = sorted({t for _, t in self.cells})
        groups = sorted({g for g, _ in self.cells})
        out = []
        for g in [g for g in groups if g > 0]:
            before = [t for t in times if t < g]
            if not before:
                continue
            for last, t in zip(times, times[1:]):
                base = before[-1] if t >= g else last
                control = [c for c in groups if c != g and (c == 0 or c > max(t, base))]
                parts = [([g], t, 1), ([g], base, -1), (control, t, -1), (control, base, 1)]
                means = [self._mean(c, s) for c, s, _ in parts]
                if all(n for n, _ in means):
                    out.append({"g": g, "t": t, "base": base, "parts": parts, "means": means,
                                "att": sum(sign * m for (_, m), (_, _, sign) in zip(means, parts))})
        return out

    def _design(self, weights: dict[str, np.ndarray]) -> DataFrame:
        """Rows (name, g, t): slope and shift so that a unit's influence is sum(slope * y - shift)."""
        sums: dict[tuple, list[float]] = {}
        for name, w in weights.items():
            for e, wk in zip(self.effects, w):
                if wk == 0:
                    continue
                for (groups, s, sign), (n, m) in zip(e["parts"], e["means"]):
                    for c in groups:
                        if (c, s) in self.cells:
                            cell = sums.setdefault((name, c, s), [0.0, 0.0])
                            cell[0] += wk * sign / n
                            cell[1] += wk * sign * m / n
        keys = list(sums)
        return small_table(self.spark, {
            "name": [k[0] for k in keys], "g": [k[1] for k in keys], "t": [k[2] for k in keys],
            "slope": [sums[k][0] for k in keys], "shift": [sums[k][1] for k in keys]},
            {"name": pa.string(), "g": pa.int32(), "t": pa.int32()})

    def errors(self, weights: dict[str, np.ndarray]) -> dict[str, float]:
        """Standard errors of weighted sums of effects (weights taken as fixed)."""
        influence = self.rows.join(self._design(weights), ["g", "t"]).groupBy("name", "unit").agg(
            F.sum(F.col("slope") * F.col("y") - F.col("shift")).alias("v"))
        got = influence.groupBy("name").agg(F.sum(F.col("v") * F.col("v")).alias("q")).collect()
        return {r["name"]: math.sqrt(r["q"]) for r in got}

    def table(self, errors: bool = True) -> DataFrame:
        k = len(self.effects)
        se = self.errors({str(i): np.eye(k)[i] for i in range(k)}) if errors and k else {}
        return small_table(self.spark, {
            "cohort": [e["g"] for e in self.effects], "time": [e["t"] for e in self.effects],
            "base": [e["base"] for e in self.effects], "att": [e["att"] for e in self.effects],
            "se": [se.get(str(i)) for i in range(k)]},
            {"cohort": pa.int32(), "time": pa.int32(), "base": pa.int32(), "att": pa.float64(), "se": pa.float64()})

    def _aggregate(self, wanted: dict, errors: bool = True):
        """Averages of chosen effects, each weighted by its cohort's number of units."""
        att = np.array([e["att"] for e in self.effects])
        size = np.array([float(self.units.get(e["g"], 0)) for e in self.effects])
        weights = {}
        for name, chosen in wanted.items():
            w = np.where(chosen, size, 0.0)
            if w.sum() > 0:
                weights[name] = w / w.sum()
        se = self.errors(weights) if errors and weights else {}
        return [(name, float(w @ att), se.get(name)) for name, w in weights.items()]

    def dynamic(self, low: int = -5, high: int = 5, errors: bool = True) -> DataFrame:
        """Average effect by years since treatment."""
        rel = np.array([e["t"] - e["g"] for e in self.effects])
        rows = self._aggregate({str(e): rel == e for e in range(low, high + 1)}, errors)
        return with_interval(small_table(self.spark, {
            "method": ["Callaway & Sant'Anna"] * len(rows), "rel_year": [int(r[0]) for r in rows],
            "estimate": [r[1] for r in rows], "se": [r[2] for r in rows]},
            {"rel_year": pa.int32(), "se": pa.float64(), "method": pa.string(), "estimate": pa.float64()}))

    def simple(self, errors: bool = True) -> tuple[float | None, float | None]:
        """Average over all treated group-time effects."""
        rows = self._aggregate({"all": np.array([e["t"] >= e["g"] for e in self.effects])}, errors)
        return rows[0][1:] if rows else (None, None)


# -- Sun and Abraham -----------------------------------------------------------------------------------

def sun_abraham(df: DataFrame, y: str, unit: str, time: str, cohort: str = "cohort", x=(), k: int = 5,
                reference: int = -1, vcov: str = "hetero", **options) -> tuple[DataFrame, tuple]:
    """Cohort x relative-year effects averaged by cohort shares; path and overall effect.

    Returns the path within k years and (att, se) over all treated cells.
    """
    rel = F.col(time) - F.col(cohort)
    label = F.when((F.col(cohort) > 0) & (rel != reference),
                   F.concat_ws("#", F.col(cohort).cast("int"), rel.cast("int")))
    rows = df.withColumn("_cell", label).dropna(subset=[y, *x])
    model = FixedEffectsModel(rows, y, x, unit, [time], {"_cell": None}, vcov=vcov, **options)
    counts = {r["_cell"]: r["n"] for r in rows.where("_cell IS NOT NULL").groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    (s,) = model.solutions
    cov = s.cov
    cells = [(i, int(t.split("::")[1].split("#")[1]), counts.get(t.split("::")[1], 0))
             for i, t in enumerate(s.terms) if t.startswith("_cell::") and s.estimable[i]]

    def average(chosen):
        w = np.zeros(len(s.terms))
        for i, _, n in chosen:
            w[i] = n
        if w.sum() == 0:
            return None
        w /= w.sum()
        return float(w @ s.beta), float(math.sqrt(max(w @ cov @ w, 0)))

    path = [(e, average([c for c in cells if c[1] == e])) for e in range(-k, k + 1)]
    path = [(e, *r) for e, r in path if r]
    table = small_table(df.sparkSession, {
        "method": ["Sun & Abraham"] * len(path), "rel_year": [p[0] for p in path],
        "estimate": [p[1] for p in path], "se": [p[2] for p in path]},
        {"rel_year": pa.int32(), "method": pa.string(), "estimate": pa.float64(), "se": pa.float64()})
    return with_interval(table), average([c for c in cells if c[1] >= 0]) or (None, None)


# -- Borusyak, Jaravel and Spiess ---------------------------------------------------------------------

def imputation(df: DataFrame, y: str, unit: str, time: str, cohort: str = "cohort", horizons=range(0, 6),
               pretrends=range(-5, 0), draws: int = 0) -> DataFrame:
    """Outcomes without treatment are imputed from effects fitted on untreated rows.

    Pre-trends are relative-year effects among untreated rows. With `draws`,
    standard errors of the horizons come from a unit bootstrap with Poisson
    weights that depend only on (unit, draw); otherwise they are NULL.
    """
    rows = df.where(F.col(y).isNotNull()).withColumn("_rel", F.when(F.col(cohort) > 0, F.col(time) - F.col(cohort)))
    untreated = rows.where(F.col("_rel").isNull() | (F.col("_rel") < 0))
    treated = rows.where(F.col("_rel") >= 0).where(F.col("_rel").isin(list(horizons)))
    model = FixedEffectsModel(untreated, y, [], unit, [time])
    gap = model.predict_effects(treated, "_fit").withColumn("_gap", F.col(y) - F.col("_fit"))
    post = gap.groupBy(F.col("_rel").cast("int").alias("rel_year")).agg(F.avg("_gap").alias("estimate"))
    post = post.withColumn("se", F.lit(None).cast("double"))
    if draws:
        post = post.drop("se").join(_bootstrap_se(untreated, treated, y, unit, time, draws), "rel_year", "left")
    out = post
    if pretrends:
        pre = untreated.withColumn("_pre", F.when(F.col("_rel").isin(list(pretrends)), F.col("_rel").cast("int")))
        table = FixedEffectsModel(pre, y, [], unit, [time], {"_pre": None}, vcov="cluster", cluster=unit).table()
        out = out.unionByName(_path(table, "_pre::", "").select("rel_year", "estimate", "se"))
    return with_interval(out.select(F.lit("Borusyak et al.").alias("method"), "rel_year", "estimate", "se"))


def poisson_weight(*key) -> Column:
    """Poisson(1) draw that is a pure function of its key, so a lost task redraws the same value."""
    u = (F.pmod(F.xxhash64(*key), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    draw, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 10):
        total += term
        draw = draw + F.when(u > total, 1).otherwise(0)
        term /= k
    return draw.cast("double")


def _bootstrap_se(untreated, treated, y, unit, time, draws):
    def drawn(df):
        numbered = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        return numbered.withColumn("_w", poisson_weight(F.col(unit), F.col("draw"))).where("_w > 0")
    model = FixedEffectsModel(drawn(untreated), y, [], unit, [time], weights="_w", by="draw")
    gap = model.predict_effects(drawn(treated), "_fit", by="draw")
    per_draw = gap.groupBy("draw", F.col("_rel").cast("int").alias("rel_year")).agg(
        (F.sum(F.col("_w") * (F.col(y) - F.col("_fit"))) / F.sum("_w")).alias("e"))
    return per_draw.groupBy("rel_year").agg(F.stddev_samp("e").alias("se"))


# -- comparison ---------------------------------------------------------------------------------------

def comparison(rows: list[tuple[str, float | None, float | None]], spark) -> DataFrame:
    """One row per method with effect, error and 95 percent interval."""
    table = small_table(spark, {"method": [r[0] for r in rows], "estimate": [r[1] for r in rows],
                                "se": [r[2] for r in rows]},
                        {"estimate": pa.float64(), "se": pa.float64()})
    return with_interval(table)


def mean_of_horizons(path: DataFrame, method: str) -> DataFrame:
    """Mean effect over post horizons; error is the root mean squared error of the horizons."""
    return with_interval(path.where("rel_year >= 0").agg(
        F.lit(method).alias("method"), F.avg("estimate").alias("estimate"),
        F.sqrt(F.avg(F.col("se") * F.col("se"))).alias("se")).select("method", "estimate", "se"))


def stacked_paths(*paths: DataFrame) -> DataFrame:
    """Event-study paths of several methods, one below the other."""
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out
