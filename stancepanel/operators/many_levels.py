"""Least squares with any number of large fixed effects (F2-F4, F6-F9 beyond a level limit).

Nothing is dense in the levels. The first effect is removed by its own means; what is left is a sparse system over the
levels of the others, whose matrix is never built: one application sends level values to the cells (level combinations)
by joins, takes the first effect's means out, and sums back by `groupBy`. Conjugate gradients solve it for all columns
and models together; the driver holds a few scalars a model. Rows are then cleared of all effects, and the reduced
regression, its errors and their clusters are plain aggregations.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.operators.regression import FixedEffectsModel, Solution, reduced_solution
from stancepanel.sources.lexicon import small_table
from stancepanel.sources.tables import require_columns, scratch_folder, stage


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again, so that rounds do not pile up in one plan."""
    return stage(df, f"{name}-{uuid.uuid4().hex}", scratch_folder(df.sparkSession))


class ManyLevelModel(FixedEffectsModel):
    """Fit on construction; `table()` and `records()` are those of the dense model.

    `tolerance` is the share of the first residual's norm at which the rounds end, for every model and column; a fit
    that does not get there in `rounds` is an error. Rows with a null in any used column are left out. Levels are
    compared as text; parameters are counted as one per level, less one for each effect after the first.
    """

    def __init__(self, df: DataFrame, y: str, x, effects, weights: str | None = None, cluster: str | None = None,
                 vcov: str | None = None, by: str | None = None, min_rows: int = 1, small_sample: bool = True,
                 tolerance: float = 1e-9, rounds: int = 500):
        self.spark, self.y, self.x = df.sparkSession, y, list(x)
        self.effects, self.cluster, self.small_sample = list(effects), cluster, small_sample
        self.vcov = vcov or ("cluster" if cluster else "iid")
        self.tolerance, self.rounds, self.taken = tolerance, rounds, 0
        self.k = len(self.x) + 1
        self.columns = [f"_z{j}" for j in range(self.k)]
        self.levels_ = [f"_e{i}" for i in range(len(self.effects))]
        used = [*self.x, y, *self.effects, *[c for c in (weights, cluster, by) if c]]
        require_columns(df, used)
        rows = df.dropna(subset=list(dict.fromkeys(used))).select(
            (F.col(by).cast("string") if by else F.lit("all")).alias("_by"),
            *[F.col(c).cast("double").alias(f"_z{j}") for j, c in enumerate([*self.x, y])],
            *[F.col(c).cast("string").alias(f"_e{i}") for i, c in enumerate(self.effects)],
            (F.col(weights).cast("double") if weights else F.lit(1.0)).alias("_w"),
            (F.col(cluster) if cluster else F.lit(0)).alias("_c"))
        totals = rows.groupBy("_by").agg(F.count("*").alias("_n"), F.sum("_w").alias("_sw"), *[
            (F.sum(F.col("_w") * F.col(z)) / F.sum("_w")).alias(f"_m{j}") for j, z in enumerate(self.columns)])
        totals = totals.where((F.col("_n") >= min_rows) & (F.col("_sw") > 0))
        self.rows = _kept(rows.join(totals, "_by").select("_by", *self.levels_, "_w", "_c", "_n", *[
            (F.col(z) - F.col(f"_m{j}")).alias(z) for j, z in enumerate(self.columns)]), "fit-rows")
        self.cells = _kept(self.rows.groupBy("_by", *self.levels_).agg(F.sum("_w").alias("_w"), *[
            F.sum(F.col("_w") * F.col(z)).alias(z) for z in self.columns]), "fit-cells")
        self.solutions = self._fit(self._cleared())

    # -- the effects -----------------------------------------------------------------------------

    def _sums(self, cells: DataFrame, names) -> DataFrame:
        """_by, _i, _l and the sums of `names` for each level of the effects after the first."""
        parts = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(e).alias("_l")) for i, e in enumerate(self.levels_) if i])
        return (cells.select("_by", F.explode(parts).alias("_p"), *names).groupBy("_by", "_p._i", "_p._l")
                .agg(*[F.sum(c).alias(c) for c in names]))

    def _less_means(self, cells: DataFrame, names) -> DataFrame:
        """Cells with weighted sums `names` less the first effect's means."""
        own = cells.groupBy("_by", "_e0").agg(F.sum("_w").alias("_aw"), *[F.sum(c).alias(f"_a{c}") for c in names])
        return cells.join(own, ["_by", "_e0"]).withColumns({
            c: F.col(c) - F.col("_w") * F.col(f"_a{c}") / F.col("_aw") for c in names})

    def _at_levels(self, cells: DataFrame, levels: DataFrame, names, out) -> DataFrame:
        """Each row with the sums of its levels' values `names`, as columns `out`."""
        total = {o: F.lit(0.0) for o in out}
        for i, e in enumerate(self.levels_):
            if i:
                held = levels.where(F.col("_i") == i).select("_by", F.col("_l").alias(e), *[
                    F.col(n).alias(f"{o}_{i}") for n, o in zip(names, out)])
                cells = cells.join(held, ["_by", e])
                total = {o: total[o] + F.col(f"{o}_{i}") for o in out}
        return cells.withColumns(total).drop(*[f"{o}_{i}" for o in out for i in range(1, len(self.levels_))])

    def _applied(self, levels: DataFrame) -> DataFrame:
        """Levels with q: the sparse matrix times p."""
        p, q = [f"p{j}" for j in range(self.k)], [f"q{j}" for j in range(self.k)]
        cells = self._at_levels(self.cells.select("_by", *self.levels_, "_w"), levels, p, q)
        cells = cells.withColumns({c: F.col("_w") * F.col(c) for c in q})
        return levels.join(self._sums(self._less_means(cells, q), q), ["_by", "_i", "_l"])

    def _dots(self, levels: DataFrame, left: str, right: str, scaled: bool = False) -> dict[str, np.ndarray]:
        """Per model the products of two vectors, column by column; with `scaled` divided by the levels' weights."""
        got = levels.groupBy("_by").agg(*[F.sum(F.col(f"{left}{j}") * F.col(f"{right}{j}") / (
            F.col("d") if scaled else F.lit(1.0))).alias(f"s{j}") for j in range(self.k)]).collect()
        return {r["_by"]: np.array([r[f"s{j}"] for j in range(self.k)]) for r in got}

    def _with(self, levels: DataFrame, name: str, values: dict[str, np.ndarray]) -> DataFrame:
        table = small_table(self.spark, {"_by": list(values)} | {
            f"{name}{j}": [float(v[j]) for v in values.values()] for j in range(self.k)}, {"_by": pa.string()})
        return levels.join(table, "_by")

    def _cleared(self) -> DataFrame:
        """Rows whose columns are cleared of all effects."""
        if not self.effects:
            return self.rows.withColumns({f"_r{j}": F.col(z) for j, z in enumerate(self.columns)})
        theta = self._theta() if len(self.effects) > 1 else None
        names = [f"_f{j}" for j in range(self.k)]
        cells, rows = self.cells, self.rows
        if theta is not None:
            held = [f"t{j}" for j in range(self.k)]
            cells, rows = (self._at_levels(part, theta, held, names) for part in (cells, rows))
        else:
            cells, rows = (part.withColumns({n: F.lit(0.0) for n in names}) for part in (cells, rows))
        own = cells.groupBy("_by", "_e0").agg(*[(F.sum(F.col(z) - F.col("_w") * F.col(n)) / F.sum("_w")).alias(f"_u{j}")
                                                for j, (z, n) in enumerate(zip(self.columns, names))])
        return rows.join(own, ["_by", "_e0"]).withColumns({
            f"_r{j}": F.col(z) - F.col(n) - F.col(f"_u{j}") for j, (z, n) in enumerate(zip(self.columns, names))})

    def _theta(self) -> DataFrame:
        """Level values (t) of the effects after the first, by conjugate gradients scaled by the levels' weights."""
        k, keys = range(self.k), ["_by", "_i", "_l"]
        right = self._sums(self._less_means(self.cells, self.columns), ["_w", *self.columns])
        levels = _kept(right.select(*keys, F.col("_w").alias("d"), *[F.lit(0.0).alias(f"t{j}") for j in k],
                                    *[F.col(f"_z{j}").alias(f"r{j}") for j in k],
                                    *[(F.col(f"_z{j}") / F.col("_w")).alias(f"p{j}") for j in k]), "levels")
        rho = self._dots(levels, "r", "r", scaled=True)
        scale = self.rows.groupBy("_by").agg(*[F.sum(F.col("_w") * F.col(z) * F.col(z)).alias(z) for z in self.columns])
        goal = {r["_by"]: self.tolerance ** 2 * np.array([r[z] for z in self.columns]) for r in scale.collect()}
        while any((rho[by] > goal[by]).any() for by in rho):
            if self.taken == self.rounds:
                raise RuntimeError(f"effects not solved in {self.rounds} rounds")
            self.taken += 1
            levels = _kept(self._applied(levels), "applied")
            curve = self._dots(levels, "p", "q")
            step = {by: np.where((rho[by] > goal[by]) & (curve[by] > 0), rho[by] / np.where(curve[by] > 0, curve[by], 1), 0)
                    for by in rho}
            moved = self._with(levels, "a", step).select(*keys, "d", *[F.col(f"p{j}") for j in k], *[
                (F.col(f"t{j}") + F.col(f"a{j}") * F.col(f"p{j}")).alias(f"t{j}") for j in k], *[
                (F.col(f"r{j}") - F.col(f"a{j}") * F.col(f"q{j}")).alias(f"r{j}") for j in k])
            after = self._dots(moved, "r", "r", scaled=True)
            turn = {by: np.where(rho[by] > 0, after[by] / np.where(rho[by] > 0, rho[by], 1), 0) for by in rho}
            levels = _kept(self._with(moved, "b", turn).select(*keys, "d", *[f"t{j}" for j in k], *[f"r{j}" for j in k], *[
                (F.col(f"r{j}") / F.col("d") + F.col(f"b{j}") * F.col(f"p{j}")).alias(f"p{j}") for j in k]), "levels")
            rho = after
        return levels

    # -- the reduced regression --------------------------------------------------------------------

    def _fit(self, rows: DataFrame) -> list[Solution]:
        cleared = [f"_r{j}" for j in range(self.k)]
        rows = _kept(rows.select("_by", "_w", "_c", "_n", *cleared, *self.columns, *self.levels_), "cleared")
        pairs = [(i, j) for i in range(self.k) for j in range(i, self.k)]
        got = rows.groupBy("_by").agg(F.first("_n").alias("n"), *[
            F.sum(F.col("_w") * F.col(z) * F.col(z)).alias(f"t{j}") for j, z in enumerate(self.columns)], *[
            F.sum(F.col("_w") * F.col(cleared[i]) * F.col(cleared[j])).alias(f"g{i}_{j}") for i, j in pairs]).collect()
        out = []
        levels = self._level_counts(rows)
        for r in sorted(got, key=lambda r: r["_by"]):
            gram = np.zeros((self.k, self.k))
            for i, j in pairs:
                gram[i, j] = gram[j, i] = r[f"g{i}_{j}"]
            total = np.array([r[f"t{j}"] for j in range(self.k)])
            estimable, beta, bread = reduced_solution(gram, total[:-1])
            rss = max(float(gram[-1, -1] - beta @ gram[:-1, -1]), 0.0)
            sizes = levels[r["_by"]]
            less = len(sizes) - 1 if sizes else -1
            outside = sum(n for n, nested in sizes if not nested) + sum(nested for _, nested in sizes)
            chosen = int(estimable.sum())
            out.append(Solution(r["_by"], r["n"], list(self.x), estimable, beta, bread, np.zeros((0, self.k)), np.zeros(self.k),
                                rss, float(total[-1]), chosen + sum(n for n, _ in sizes) - less,
                                chosen + (max(outside - less, 1) if sizes else 1)))
        self._errors(rows, out, cleared)
        return out

    def _level_counts(self, rows: DataFrame) -> dict[str, list[tuple[int, bool]]]:
        """Per model and effect the number of levels, and whether each lies in one cluster."""
        found: dict[str, list[tuple[int, bool]]] = {}
        for e in self.levels_:
            for r in rows.groupBy("_by", e).agg((F.min("_c") == F.max("_c")).alias("one")).groupBy("_by").agg(
                    F.count("*").alias("n"), F.every("one").alias("nested")).collect():
                found.setdefault(r["_by"], []).append((r["n"], bool(r["nested"]) and self.vcov == "cluster"))
        return found if found else {r["_by"]: [] for r in rows.select("_by").distinct().collect()}

    def _errors(self, rows: DataFrame, solutions: list[Solution], cleared) -> None:
        if self.vcov == "iid":
            for s in solutions:
                s.df = s.n - s.n_params
                s.cov = s.bread * (s.rss / s.df if s.df > 0 else float("nan"))
                s.se = np.sqrt(np.diag(s.cov))
            return
        if not solutions:
            return
        m = len(self.x)
        table = small_table(self.spark, {"_by": [s.by for s in solutions]} | {
            f"_b{j}": [float(s.beta[j]) for s in solutions] for j in range(m)}, {"_by": pa.string()})
        error = F.col(cleared[-1]) - sum((F.col(f"_b{j}") * F.col(cleared[j]) for j in range(m)), F.lit(0.0))
        scores = rows.join(table, "_by").select("_by", "_c", *[
            (F.col("_w") * error * F.col(cleared[j])).alias(f"s{j}") for j in range(m)])
        if self.vcov == "cluster":
            scores = scores.groupBy("_by", "_c").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(m)])
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        meats = {r["_by"]: r for r in scores.groupBy("_by").agg(F.count("*").alias("g"), *[
            F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).collect()}
        for s in solutions:
            meat, g = np.zeros((m, m)), meats[s.by]["g"]
            for i, j in pairs:
                meat[i, j] = meat[j, i] = meats[s.by][f"m{i}_{j}"]
            if self.vcov == "hetero":
                s.df = s.n - s.n_params
                factor = s.n / s.df if s.df > 0 else float("nan")
            else:
                s.df, left = g - 1, s.n - s.nested_params
                factor = g / (g - 1) * (s.n - 1) / left if g > 1 and left > 0 else float("nan")
            s.cov = s.bread @ meat @ s.bread * (factor if self.small_sample else 1.0)
            s.se = np.sqrt(np.maximum(np.diag(s.cov), 0))
