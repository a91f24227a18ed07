"""Least squares with fixed effects, exactly and without iteration (F operators).

A model has at most one high-cardinality effect (`absorb`: author, unit) and
any number of low-cardinality ones (`effects`: year, field; `dummies`: effects
whose coefficients are wanted). Spark reduces the rows to cells
(unit x levels), cells to one moment matrix of size regressors + levels, and
only that matrix reaches the driver, which solves it. A second pass sends unit
means and coefficients back to the rows for robust standard errors.

`by` fits many models in the same jobs: each distinct value is one model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.functions.scalars import significance_stars
from stancepanel.sources.lexicon import small_table
from stancepanel.sources.tables import require_columns

TOLERANCE = 1e-9


def _log_beta_half(a: float) -> float:
    """log B(a, 1/2). The two large log-gammas are replaced by their asymptotic difference where they would cancel."""
    if a < 1e5:
        return math.lgamma(a) + math.lgamma(0.5) - math.lgamma(a + 0.5)
    return math.lgamma(0.5) - 0.5 * math.log(a) + 1 / (8 * a) - 1 / (192 * a ** 3)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function, from the front until it no longer changes."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m = d, 1
    while True:
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15 or m > 10_000_000:
            return value
        m += 1


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t: the incomplete beta function of df / (df + t^2) at (df / 2, 1 / 2)."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    a, odds = df / 2, t * t / df
    if odds == 0:
        return 1.0
    if math.isinf(odds):
        return 0.0
    rest = odds / (1 + odds)
    front = math.exp(-a * math.log1p(odds) + 0.5 * math.log(rest) - _log_beta_half(a))
    if 1 / (1 + odds) < (a + 1) / (a + 2.5):
        return min(1.0, front * _beta_fraction(1 / (1 + odds), a, 0.5) / a)
    return max(0.0, 1 - front * _beta_fraction(rest, 0.5, a) / 0.5)


class TooManyLevels(ValueError):
    """The levels of the low-cardinality effects do not fit the dense moment matrix."""


@dataclass
class Solution:
    """One solved model on the driver; all arrays are small."""

    by: str
    n: int
    terms: list[str]
    estimable: np.ndarray
    beta: np.ndarray
    bread: np.ndarray
    gamma: np.ndarray
    means: np.ndarray
    rss: float
    tss: float
    n_params: int
    nested_params: int
    se: np.ndarray | None = None
    cov: np.ndarray | None = None
    df: float = float("nan")
    scales: np.ndarray = field(default_factory=lambda: np.zeros(0))


class FixedEffectsModel:
    """Fit on construction; `table()` gives one row per model and term."""

    def __init__(self, df: DataFrame, y: str, x=(), absorb=None, effects=(), dummies=None,
                 weights: str | None = None, cluster: str | None = None, vcov: str | None = None,
                 by: str | None = None, min_rows: int = 1, max_levels: int = 5000,
                 small_sample: bool = True):
        self.spark = df.sparkSession
        self.x, self.y = list(x), y
        self.absorb = [absorb] if isinstance(absorb, str) else list(absorb or [])
        self.dummies = dict(dummies or {})
        self.effects = list(effects)
        self.dims = [*self.dummies, *self.effects]
        self.vcov = vcov or ("cluster" if cluster else "iid")
        self.cluster, self.min_rows, self.small_sample = cluster, min_rows, small_sample
        self.z, self.many = [*self.x, y], by is not None
        require_columns(df, [c for c in [*self.z, *self.absorb, *self.dims, weights, cluster, by] if c])

        rows = self._rows(df, weights, by).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.levels = self._levels(rows, max_levels)
            means = self._means(rows)
            if not means:
                self.solutions: list[Solution] = []
                return
            self.coded = self._coded(rows, means)
            self.solutions = self._solve(means)
            if self.vcov != "iid":
                self._robust()
            else:
                self._classical()
        finally:
            rows.unpersist()

    # -- preparation ---------------------------------------------------------------------------

    def _rows(self, df, weights, by):
        unit = (F.lit(0) if not self.absorb else F.col(self.absorb[0]) if len(self.absorb) == 1
                else F.concat_ws("\u0001", *self.absorb))
        needed = [*self.z, *self.absorb, *self.effects, *([self.cluster] if self.cluster else []),
                  *([weights] if weights else []), *([by] if by else [])]
        complete = df.dropna(subset=list(dict.fromkeys(needed)))
        return complete.select(
            (F.col(by).cast("string") if by else F.lit("all")).alias("_by"), unit.alias("_a"),
            *[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(self.z)],
            *[(F.when(F.col(c) != self.dummies[c], F.col(c)) if self.dummies.get(c) is not None
               else F.col(c)).cast("string").alias(f"_l{i}") for i, c in enumerate(self.dims)],
            (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("_w"),
            (F.col(self.cluster) if self.cluster else F.lit(0)).alias("_c"))

    def _levels(self, rows, max_levels):
        """Level index per dimension; refuses effects with too many levels."""
        if not self.dims:
            return []
        pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(f"_l{i}").alias("v"))
                          for i in range(len(self.dims))])
        found = rows.select(F.explode(pairs).alias("p")).select("p.*").where("v IS NOT NULL").distinct()
        seen = [(r["d"], r["v"]) for r in found.limit(max_levels + 1).collect()]
        if len(seen) > max_levels:
            raise TooManyLevels(f"more than {max_levels} effect levels; absorb the largest effect instead")

        def order(v):
            try:
                return (0, float(v), v)
            except ValueError:
                return (1, 0.0, v)
        return [sorted((v for d, v in seen if d == i), key=order) for i in range(len(self.dims))]

    def _means(self, rows):
        got = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"),
                                      *[F.sum(F.col("_w") * F.col(f"_z{i}")).alias(f"s{i}")
                                        for i in range(len(self.z))]).collect()
        return {r["_by"]: (r["n"], r["w"], np.array([r[f"s{i}"] / r["w"] for i in range(len(self.z))]))
                for r in got if r["n"] >= self.min_rows and r["w"] > 0}

    def _coded(self, rows, means):
        """Rows with centred values and integer levels (-1: reference level)."""
        k = len(self.z)
        if self.many:
            table = small_table(self.spark, {"_by": list(means), **{
                f"_m{i}": [float(m[2][i]) for m in means.values()] for i in range(k)}})
            rows = rows.join(table, "_by")
        else:
            (only,) = means.values()
            rows = rows.withColumns({f"_m{i}": F.lit(float(only[2][i])) for i in range(k)})
        for i, levels in enumerate(self.levels):
            codes = small_table(self.spark, {f"_l{i}": levels, f"_d{i}": list(range(len(levels)))},
                                {f"_l{i}": pa.string(), f"_d{i}": pa.int32()})
            rows = rows.join(codes, f"_l{i}", "left")
        return rows.select("_by", "_a", "_w", "_c",
                           *[(F.col(f"_z{i}") - F.col(f"_m{i}")).alias(f"_z{i}") for i in range(k)],
                           *[F.coalesce(f"_d{i}", F.lit(-1)).alias(f"_d{i}") for i in range(len(self.dims))])

    def _cells(self):
        dims = [f"_d{i}" for i in range(len(self.dims))]
        cells = self.coded.groupBy("_by", "_a", *dims).agg(
            F.sum("_w").alias("_w"), *[F.sum(F.col("_w") * F.col(f"_z{i}")).alias(f"_z{i}")
                                       for i in range(len(self.z))])
        if not self.absorb:
            return cells
        # Cells of a unit side by side; a unit has at most one cell per level combination.
        return cells.repartition("_by", "_a").sortWithinPartitions("_by", "_a")

    # -- moment matrix -------------------------------------------------------------------------

    def _solve(self, means):
        k, p = len(self.z), self._size()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        square = {r["_by"]: r for r in self.coded.groupBy("_by").agg(*[
            F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"q{i}_{j}")
            for i, j in pairs]).collect()}
        plus, minus, units = self._moments(p)
        out = []
        for by, (n, w, mean) in means.items():
            g, m = plus.get(by, np.zeros((p, p))), minus.get(by, np.zeros((p, p)))
            for i, j in pairs:
                g[i, j] = g[j, i] = square[by][f"q{i}_{j}"]
            out.append(self._solution(by, n, mean, g, m, units.get(by, 1)))
        return out

    def _size(self):
        return len(self.z) + sum(map(len, self.levels))

    def _offsets(self):
        starts, at = [], len(self.z)
        for levels in self.levels:
            starts.append(at)
            at += len(levels)
        return starts

    def _moments(self, p):
        k, starts, grouped = len(self.z), self._offsets(), bool(self.absorb)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            plus: dict[str, np.ndarray] = {}
            minus: dict[str, np.ndarray] = {}
            count: dict[str, int] = {}
            for part in whole_units(frames, grouped):
                for by, cells in part.groupby("_by", sort=False):
                    u, hot = design(cells, k, starts, p)
                    w = cells["_w"].to_numpy()
                    g = plus.setdefault(by, np.zeros((p, p)))
                    m = minus.setdefault(by, np.zeros((p, p)))
                    cross = u[:, :k].T @ hot
                    g[:k, k:] += cross
                    g[k:, :k] += cross.T
                    g[k:, k:] += hot.T @ (hot * w[:, None])
                    if grouped:
                        u[:, k:] = hot * w[:, None]
                        sums, total = unit_sums(cells["_a"].to_numpy(), u, w)
                        m += sums.T @ (sums / total[:, None])
                        count[by] = count.get(by, 0) + len(total)
                    else:
                        u[:, k:] = hot * w[:, None]
                        total_row = np.concatenate([u.sum(axis=0), [w.sum()]])
                        count[by] = 1
                        yield long_rows(by, "t", total_row)
            for by in plus:
                yield long_rows(by, "g", plus[by].ravel())
                if grouped:
                    yield long_rows(by, "m", minus[by].ravel())
                    yield long_rows(by, "n", np.array([float(count[by])]))

        sums = (self._cells().mapInPandas(run, "by string, kind string, pos long, val double")
                .groupBy("by", "kind", "pos").agg(F.sum("val").alias("val")).toPandas())
        plus, minus, units, totals = {}, {}, {}, {}
        for (by, kind), rows in sums.groupby(["by", "kind"]):
            vec = np.zeros(p + 1 if kind == "t" else 1 if kind == "n" else p * p)
            vec[rows["pos"].to_numpy()] = rows["val"].to_numpy()
            if kind == "g":
                plus[by] = vec.reshape(p, p)
            elif kind == "m":
                minus[by] = vec.reshape(p, p)
            elif kind == "n":
                units[by] = int(vec[0])
            else:
                totals[by] = vec
        for by, vec in totals.items():
            minus[by] = np.outer(vec[:p], vec[:p]) / vec[p]
        return plus, minus, units

    def _index(self):
        """Positions of wanted terms, the outcome and nuisance levels in the moment matrix."""
        k, starts = len(self.z), self._offsets()
        n_dummy = len(self.dummies)
        reported = [starts[d] + i for d in range(n_dummy) for i in range(len(self.levels[d]))]
        nuisance = [starts[d] + i for d in range(n_dummy, len(self.dims)) for i in range(len(self.levels[d]))]
        names = [*self.x, *[f"{self.dims[d]}::{v}" for d in range(n_dummy) for v in self.levels[d]]]
        return [*range(k - 1), *reported], k - 1, nuisance, names

    def _solution(self, by, n, mean, plus, minus, units):
        want, y, nuisance, names = self._index()
        g = plus - minus
        total = np.diag(plus).copy()
        target = [*want, y]
        gamma = np.zeros((len(nuisance), len(target)))
        reduced = g[np.ix_(target, target)]
        if nuisance:
            dd = g[np.ix_(nuisance, nuisance)]
            values, vectors = np.linalg.eigh(dd)
            keep = values > max(values.max(), 0) * 1e-10
            inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
            gamma = inverse @ g[np.ix_(nuisance, target)]
            reduced = reduced - g[np.ix_(target, nuisance)] @ gamma
        kx = len(want)
        estimable, beta, bread = reduced_solution(reduced, total[want])
        rss = max(float(reduced[kx, kx] - beta @ reduced[:kx, kx]), 0.0)
        seen = [sum(total[self._offsets()[d] + i] > 0 for i in range(len(self.levels[d])))
                for d in range(len(self.dummies), len(self.dims))]
        sizes = ([units] if self.absorb else []) + seen
        full = int(estimable.sum()) + (sum(sizes) - (len(sizes) - 1) if sizes else 1)
        return Solution(by, n, names, estimable, beta, bread, gamma, mean, rss, float(total[y]), full, full,
                        scales=total)

    # -- standard errors -----------------------------------------------------------------------

    def _classical(self):
        for s in self.solutions:
            s.df = s.n - s.n_params
            variance = s.rss / s.df if s.df > 0 else float("nan")
            s.cov = s.bread * variance
            s.se = np.sqrt(np.diag(s.cov))

    def unit_offsets(self) -> DataFrame:
        """Per (model, unit): mean of each target minus the mean of its level effects."""
        k, starts, p = len(self.z), self._offsets(), self._size()
        want, y, nuisance, _ = self._index()
        target = [*want, y]
        gammas = {s.by: s.gamma for s in self.solutions}

        def run(frames):
            for part in whole_units(frames, True):
                for by, cells in part.groupby("_by", sort=False):
                    if by not in gammas:
                        continue
                    u, hot = design(cells, k, starts, p)
                    w = cells["_w"].to_numpy()
                    u[:, k:] = hot * w[:, None]
                    keys = cells["_a"].to_numpy()
                    sums, total = unit_sums(keys, u, w)
                    mean = sums / total[:, None]
                    off = mean[:, target] - mean[:, nuisance] @ gammas[by]
                    yield pd.DataFrame({"_by": by, "_a": keys[first_of_unit(keys)], "_off": list(off)})

        kind = dict(self.coded.dtypes)["_a"]
        return self._cells().mapInPandas(run, f"_by string, _a {kind}, _off array<double>")

    def _residual_rows(self):
        """Rows with what is needed to rebuild residualised regressors and errors."""
        if not self.absorb:
            return self.coded.withColumn("_off", F.lit(None).cast("array<double>"))
        return self.coded.join(self.unit_offsets(), ["_by", "_a"])

    def _residuals(self):
        """Function: frame of one model -> (residualised regressors, weight * error)."""
        k, starts, p = len(self.z), self._offsets(), self._size()
        want, y, nuisance, _ = self._index()
        target, grouped = [*want, y], bool(self.absorb)
        solved = {s.by: (s.gamma, s.beta, s.scales, s.n) for s in self.solutions}

        def compute(by, rows):
            gamma, beta, scales, n = solved[by]
            u, hot = design(rows, k, starts, p)
            u[:, k:] = hot
            values = u[:, target] - u[:, nuisance] @ gamma
            if grouped:
                values = values - np.stack(rows["_off"].to_numpy())
            else:
                values = values - constants[by]
            w = rows["_w"].to_numpy()
            error = values[:, -1] - values[:, :-1] @ beta
            return values[:, :-1], w * error

        constants = {}
        if not grouped:
            for s in self.solutions:
                mean = np.zeros(p)
                mean[k:] = self._level_share(s.by)
                constants[s.by] = mean[target] - mean[nuisance] @ s.gamma
        return compute

    def _level_share(self, by):
        """Weighted share of each level in a model without an absorbed effect."""
        s = next(s for s in self.solutions if s.by == by)
        return s.scales[len(self.z):] / self._weight[by]

    def _robust(self):
        if not self.solutions:
            return
        if not self.absorb:
            self._weight = {r["_by"]: r["w"] for r in
                            self.coded.groupBy("_by").agg(F.sum("_w").alias("w")).collect()}
        compute, known = self._residuals(), {s.by for s in self.solutions}
        kx = len(self.solutions[0].terms)
        rows = self._residual_rows()
        if self.vcov == "hetero":
            def meat_rows(frames):
                meat: dict[str, np.ndarray] = {}
                for frame in frames:
                    for by, part in frame.groupby("_by", sort=False):
                        if by in known:
                            values, we = compute(by, part)
                            scores = values * we[:, None]
                            meat[by] = meat.get(by, np.zeros((kx, kx))) + scores.T @ scores
                for by, m in meat.items():
                    yield long_rows(by, "h", m.ravel())

            got = (rows.mapInPandas(meat_rows, "by string, kind string, pos long, val double")
                   .groupBy("by", "pos").agg(F.sum("val").alias("val")).toPandas())
            meats = {}
            for by, part in got.groupby("by"):
                vec = np.zeros(kx * kx)
                vec[part["pos"].to_numpy()] = part["val"].to_numpy()
                meats[by] = (vec.reshape(kx, kx), None)
        else:
            meats = self._cluster_meat(rows, compute, known, kx)
            self._count_nested()
        for s in self.solutions:
            meat, g = meats.get(s.by, (np.zeros((kx, kx)), 0))
            v = s.bread @ meat @ s.bread
            if self.vcov == "hetero":
                s.df = s.n - s.n_params
                factor = s.n / s.df if s.df > 0 else float("nan")
            else:
                s.df = g - 1
                left = s.n - s.nested_params
                factor = (g / (g - 1) * (s.n - 1) / left) if g > 1 and left > 0 else float("nan")
            s.cov = v * (factor if self.small_sample else 1.0)
            s.se = np.sqrt(np.maximum(np.diag(s.cov), 0))

    def _cluster_meat(self, rows, compute, known, kx):
        kind = dict(self.coded.dtypes)["_c"]
        names = [f"s{i}" for i in range(kx)]

        def score_rows(frames):
            for frame in frames:
                for by, part in frame.groupby("_by", sort=False):
                    if by in known:
                        values, we = compute(by, part)
                        scores = pd.DataFrame(values * we[:, None], columns=names)
                        sums = scores.groupby(part["_c"].to_numpy()).sum().reset_index(names="_c")
                        yield sums.assign(_by=by)[["_by", "_c", *names]]

        schema = f"_by string, _c {kind}, " + ", ".join(f"{n} double" for n in names)
        per_cluster = rows.mapInPandas(score_rows, schema).groupBy("_by", "_c").agg(
            *[F.sum(n).alias(n) for n in names])
        pairs = [(i, j) for i in range(kx) for j in range(i, kx)]
        got = per_cluster.groupBy("_by").agg(F.count(F.lit(1)).alias("g"), *[
            F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs]).collect()
        meats = {}
        for r in got:
            m = np.zeros((kx, kx))
            for i, j in pairs:
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
            meats[r["_by"]] = (m, r["g"])
        return meats

    def _count_nested(self):
        """Parameters that count once effects nested in the cluster are left out."""
        checks = ([("_a", None)] if self.absorb else []) + [
            (f"_d{d}", d) for d in range(len(self.dummies), len(self.dims))]
        for s in self.solutions:
            s.nested_params = int(s.estimable.sum()) + (0 if checks else 1)
        tables = {}
        for column, _ in checks:
            got = self.coded.groupBy("_by", column).agg(
                (F.min("_c") == F.max("_c")).alias("one")).groupBy("_by").agg(
                F.min(F.col("one").cast("int")).alias("nested"), F.count(F.lit(1)).alias("size")).collect()
            tables[column] = {r["_by"]: (r["nested"], r["size"]) for r in got}
        for s in self.solutions:
            if not checks:
                continue
            info = [tables[c][s.by] for c, _ in checks]
            outside = sum(size for nested, size in info if not nested)
            inside = sum(1 for nested, _ in info if nested)
            s.nested_params += max(outside + inside - (len(info) - 1), 1)

    # -- results -------------------------------------------------------------------------------

    def records(self) -> list[dict]:
        out = []
        for s in self.solutions:
            for i, term in enumerate(s.terms):
                ok = bool(s.estimable[i])
                est, se = (float(s.beta[i]), float(s.se[i])) if ok else (None, None)
                t = est / se if ok and se and math.isfinite(se) and se > 0 else None
                p = t_p_value(t, s.df) if t is not None else None
                out.append({"model": s.by, "term": term, "estimate": est,
                            "se": se if se is not None and math.isfinite(se) else None, "t": t,
                            "p": p if p is not None and math.isfinite(p) else None, "n": int(s.n),
                            "r2": 1 - s.rss / s.tss if s.tss > 0 else None,
                            "sd_y": math.sqrt(s.tss / (s.n - 1)) if s.n > 1 else None})
        return out

    def table(self) -> DataFrame:
        """model, term, estimate, se, t, p, n, r2, sd_y; not estimable terms are NULL."""
        types = {"model": pa.string(), "term": pa.string(), "n": pa.int64()}
        names = ["model", "term", "estimate", "se", "t", "p", "n", "r2", "sd_y"]
        rows = self.records()
        return small_table(self.spark, {c: [r[c] for r in rows] for c in names},
                           {c: types.get(c, pa.float64()) for c in names})

    def level_effects(self) -> DataFrame:
        """model, effect, level, value: outcome effects of nuisance levels (up to a constant)."""
        rows = []
        for s in self.solutions:
            at = 0
            for d in range(len(self.dummies), len(self.dims)):
                for level in self.levels[d]:
                    rows.append((s.by, self.dims[d], level, float(s.gamma[at, -1])))
                    at += 1
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return small_table(self.spark, dict(zip(("model", "effect", "level", "value"), map(list, cols))),
                           {"model": pa.string(), "effect": pa.string(), "level": pa.string(), "value": pa.float64()})

    def predict_effects(self, df: DataFrame, name: str = "fitted", by: str | None = None) -> DataFrame:
        """Unit plus level effect for rows of `df`; rows of unseen units or levels drop out.

        Only for models without regressors (the imputation estimator).
        """
        unit, key = self.absorb[0], ["_by"] if by else []
        out = df.withColumn("_by", F.col(by).cast("string")) if by else df
        offsets = self.unit_offsets().select(*key, F.col("_a").alias(unit), F.element_at("_off", -1).alias("_u"))
        out = out.join(offsets, [*key, unit])
        if by:
            means = small_table(self.spark, {"_by": [s.by for s in self.solutions],
                                             "_m": [float(s.means[-1]) for s in self.solutions]},
                                {"_by": pa.string(), "_m": pa.float64()})
            out = out.join(means, "_by")
        else:
            out = out.withColumn("_m", F.lit(float(self.solutions[0].means[-1])))
        fitted = F.col("_u") + F.col("_m")
        effects = self.level_effects().withColumnRenamed("model", "_by")
        for e in self.effects:
            part = effects.where(F.col("effect") == e).select(
                *key, F.col("level").alias(f"_k_{e}"), F.col("value").alias(f"_v_{e}"))
            out = out.withColumn(f"_k_{e}", F.col(e).cast("string")).join(part, [*key, f"_k_{e}"])
            fitted = fitted + F.col(f"_v_{e}")
        return out.withColumn(name, fitted).drop(
            "_u", "_m", "_by", *[f"_k_{e}" for e in self.effects], *[f"_v_{e}" for e in self.effects])


def reduced_solution(reduced: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which regressors are estimable, their coefficients and the inverse of their moments.

    `reduced` holds the moments of regressors and outcome (last) without the effects, `total` the regressors' own sums of
    squares; a regressor that the effects and those before it explain is not estimable.
    """
    kx = len(total)
    estimable = np.zeros(kx, bool)
    chosen: list[int] = []
    for i in range(kx):
        pivot = reduced[i, i]
        if chosen:
            c = reduced[np.ix_(chosen, [i])]
            pivot = pivot - float((c.T @ np.linalg.solve(reduced[np.ix_(chosen, chosen)], c))[0, 0])
        if total[i] > 0 and pivot > TOLERANCE * total[i]:
            chosen.append(i)
            estimable[i] = True
    beta, bread = np.zeros(kx), np.zeros((kx, kx))
    if chosen:
        sub = np.ix_(chosen, chosen)
        inv = np.linalg.inv(reduced[sub])
        beta[chosen] = inv @ reduced[chosen, kx]
        bread[sub] = inv
    return estimable, beta, bread


# -- numpy helpers that run inside tasks ---------------------------------------------------------

def long_rows(by, kind, vec):
    at = np.flatnonzero(vec)
    return pd.DataFrame({"by": by, "kind": kind, "pos": at, "val": vec[at]})


def design(frame, k, starts, p):
    """Values in the first k columns of an (n, p) array, and the 0/1 level columns apart."""
    u = np.zeros((len(frame), p))
    for i in range(k):
        u[:, i] = frame[f"_z{i}"].to_numpy()
    hot = np.zeros((len(frame), p - k))
    rows = np.arange(len(frame))
    for d, start in enumerate(starts):
        codes = frame[f"_d{d}"].to_numpy()
        on = codes >= 0
        hot[rows[on], start - k + codes[on]] = 1.0
    return u, hot


def first_of_unit(keys):
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def unit_sums(keys, u, w):
    first = first_of_unit(keys)
    return np.add.reduceat(u, first, axis=0), np.add.reduceat(w, first)


def whole_units(frames, grouped):
    """Batches that never split a unit; the last unit of a batch waits for the next one."""
    held = None
    for frame in frames:
        if not grouped:
            yield frame
            continue
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame["_a"] == frame["_a"].iloc[-1]) & (frame["_by"] == frame["_by"].iloc[-1])
        held = frame[last]
        if not last.all():
            yield frame[~last]
    if held is not None and len(held):
        yield held


# -- operators on top of the model ----------------------------------------------------------------

def ols(df: DataFrame, y: str, x, weights: str | None = None, **options) -> DataFrame:
    """least squares with an intercept."""
    return FixedEffectsModel(df, y, x, weights=weights, **options).table()


def fixed_effects(df: DataFrame, y: str, x, absorb=None, effects=(), **options) -> DataFrame:
    """One or several fixed effects; weights, clustered or robust errors.

    Effects of more levels than the moment matrix takes (`max_levels`) are solved as a sparse system in Spark.
    """
    try:
        return FixedEffectsModel(df, y, x, absorb, effects, **options).table()
    except TooManyLevels:
        if options.get("dummies"):
            raise
    from stancepanel.operators.many_levels import ManyLevelModel

    options.pop("max_levels", None)
    if isinstance(absorb, (list, tuple)) and len(absorb) > 1:
        df = df.withColumn("_unit", F.concat_ws("\u0001", *absorb))
        absorb = "_unit"
    first = [absorb] if isinstance(absorb, str) else list(absorb or [])
    return ManyLevelModel(df, y, x, [*first, *effects], **options).table()


def interaction(df: DataFrame, y: str, x: str, z: str, absorb=None, effects=(), **options) -> DataFrame:
    """x, z and their product `x:z`."""
    product = f"{x}:{z}"
    return fixed_effects(df.withColumn(product, F.col(x) * F.col(z)), y, [x, z, product], absorb,
                         effects, **options)


def split_battery(df: DataFrame, splits: dict, y: str, x, absorb=None, effects=(), min_units: int = 0,
                  unit: str = "iso3", **options) -> DataFrame:
    """the same model on many subsets in one set of jobs.

    `splits` maps a label to a boolean column; each row goes to every subset it
    belongs to. Subsets under `min_rows` (option) or `min_units` give no row.
    """
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in splits.items()]))
    rows = df.withColumn("split", F.explode(labels))
    if min_units:
        enough = rows.groupBy("split").agg(F.countDistinct(unit).alias("u")).where(F.col("u") >= min_units)
        rows = rows.join(enough.select("split"), "split", "left_semi")
    return fixed_effects(rows, y, x, absorb, effects, by="split", **options)


def treatment_grid(df: DataFrame, outcomes, treatments, absorb=None, effects=(), **options) -> DataFrame:
    """one single-regressor model per outcome x treatment; each uses its own complete rows."""
    models = F.array(*[F.struct(F.lit(f"{y} ~ {x}").alias("model"), F.col(y).cast("double").alias("_y"),
                                F.col(x).cast("double").alias("_x")) for y in outcomes for x in treatments])
    keep = list(dict.fromkeys([*([absorb] if isinstance(absorb, str) else absorb or []), *effects,
                               *[options[o] for o in ("cluster", "weights") if options.get(o)]]))
    rows = df.select(*keep, F.explode(models).alias("m")).select(*keep, "m.*")
    return fixed_effects(rows, "_y", ["_x"], absorb, effects, by="model", **options)


def lag_scan(df: DataFrame, values: DataFrame, keys, time: str, treatment: str, y: str, lags,
             absorb=None, effects=(), **options) -> DataFrame:
    """the model with the treatment taken k years earlier, for every k in one set of jobs."""
    shifted = values.select(*keys, F.explode(F.array(*map(F.lit, lags))).alias("lag"), time,
                            F.col(treatment).alias("_lagged"))
    shifted = shifted.withColumn(time, F.col(time) + F.col("lag"))
    rows = df.join(shifted, [*keys, time])
    return fixed_effects(rows, y, ["_lagged"], absorb, effects, by="lag", **options)


def lagged_specifications(df: DataFrame, y: str, x, lags, absorb=None, effects=(), **options) -> DataFrame:
    """contemporaneous and lagged versions of one model, each on its complete rows.

    Lag 0 is the column itself; lag k uses `<column>_lag<k>`.
    """
    def column(c, k):
        return F.col(c if k == 0 else f"{c}_lag{k}").cast("double").alias(c)
    specs = F.array(*[F.struct(F.lit(k).alias("lag"), *[column(c, k) for c in x]) for k in lags])
    keep = list(dict.fromkeys([y, *([absorb] if isinstance(absorb, str) else absorb or []), *effects,
                               *[options[o] for o in ("cluster", "weights") if options.get(o)]]))
    rows = df.select(*keep, F.explode(specs).alias("m")).select(*keep, "m.*")
    return fixed_effects(rows, y, list(x), absorb, effects, by="lag", **options)


def with_and_without(df: DataFrame, y: str, x: str, controls, absorb=None, effects=(), **options) -> DataFrame:
    """effect of x without and with control columns."""
    plain = fixed_effects(df, y, [x], absorb, effects, **options).withColumn("model", F.lit("no controls"))
    full = fixed_effects(df, y, [x, *controls], absorb, effects, **options).withColumn(
        "model", F.lit("with controls"))
    return plain.unionByName(full)


def with_markers(table: DataFrame) -> DataFrame:
    """significance stars and the effect in standard deviations of the outcome."""
    return table.withColumns({"stars": significance_stars("p"),
                              "effect_sd": F.try_divide(F.col("estimate"), F.col("sd_y"))})


def standardised_coefficients(df: DataFrame, y: str, x, top: int | None = None, **options) -> DataFrame:
    """Least squares with coefficients in standard deviations, largest first."""
    table = ols(df, y, x, **options)
    spread = df.dropna(subset=[y, *x]).agg(*[F.stddev_samp(c).alias(c) for c in [y, *x]]).first()
    scale = small_table(df.sparkSession, {"term": list(x), "ratio": [
        spread[c] / spread[y] if spread[y] else None for c in x]}, {"ratio": pa.float64()})
    out = table.join(scale, "term").withColumn("standardised", F.col("estimate") * F.col("ratio")).drop("ratio")
    return out if top is None else out.orderBy(F.abs("standardised").desc_nulls_last(), "term").limit(top)
