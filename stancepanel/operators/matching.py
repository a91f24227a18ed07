"""Panel matching on treatment history."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.operators.did import poisson_weight
from stancepanel.sources.lexicon import small_table


def whitened(df: DataFrame, time: str, covariates, max_times: int = 5000) -> DataFrame:
    """Covariates turned per period so that Euclidean distance is Mahalanobis distance.

    Only the covariance matrix of each period reaches the driver.
    """
    pairs = [(a, b) for i, a in enumerate(covariates) for b in covariates[i:]]
    complete = df.dropna(subset=list(covariates))
    got = complete.groupBy(time).agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs]) \
        .limit(max_times + 1).collect()
    if len(got) > max_times:
        raise ValueError(f"more than {max_times} periods")
    k, table = len(covariates), {"_time": []} | {f"_w{i}_{j}": [] for i in range(len(covariates))
                                                 for j in range(len(covariates))}
    for r in got:
        cov = np.zeros((k, k))
        for i, a in enumerate(covariates):
            for j, b in enumerate(covariates):
                cov[i, j] = (r[f"{a}|{b}"] if i <= j else r[f"{b}|{a}"]) or 0.0
        values, vectors = np.linalg.eigh(cov)
        scale = np.where(values > max(values.max(), 0) * 1e-12, values, np.inf) ** -0.5
        turn = vectors * scale
        table["_time"].append(r[time])
        for i in range(k):
            for j in range(k):
                table[f"_w{i}_{j}"].append(float(turn[i, j]))
    turns = small_table(df.sparkSession, table, {c: pa.float64() for c in table if c != "_time"})
    turned = df.join(turns, F.col(time) == F.col("_time"))
    return turned.withColumns({f"_q{j}": sum((F.col(c) * F.col(f"_w{i}_{j}") for i, c in enumerate(covariates)),
                                            F.lit(0.0)) for j in range(k)}).drop(*table)


def matched_sets(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, covariates,
                 lag: int = 1, leads=range(1, 6), size: int = 5, forbid_reversal: bool = True) -> DataFrame:
    """Each treated row with its nearest controls: same period, same treatment history.

    One row per (treated row, control). Controls are compared only inside the
    block (period, history), and Spark keeps the best `size` per treated row
    before the shuffle (a group limit), so pairs are never stored.
    """
    w = Window.partitionBy(unit).orderBy(time)
    k = len(covariates)

    def at(c, shift):
        near = F.lead(F.struct(time, c), shift).over(w) if shift > 0 else F.lag(F.struct(time, c), -shift).over(w)
        return F.when(near[time] == F.col(time) + shift, near[c]) if shift else F.col(c)

    turned = whitened(df, time, covariates)
    rows = turned.select(
        unit, time, F.col(treatment).alias("_now"),
        F.array(*[at(treatment, -i) for i in range(1, lag + 1)]).alias("_history"),
        F.array(*[at(f"_q{j}", -i) for i in range(1, lag + 1) for j in range(k)]).alias("_q"),
        F.array(*[at(outcome, f) - at(outcome, -1) for f in leads]).alias("_d"),
        F.array(*[at(treatment, f) for f in range(0, max([0, *leads]) + 1)]).alias("_future"))
    rows = rows.where(~F.exists("_history", lambda v: v.isNull()) & ~F.exists("_q", lambda v: v.isNull()))
    stays = ~F.exists("_future", lambda v: v.eqNullSafe(0)) if forbid_reversal else F.lit(True)
    treated = rows.where((F.col("_now") == 1) & (F.get("_history", F.lit(0)) == 0) & stays).select(
        F.col(unit).alias("treated"), time, "_history", F.col("_q").alias("tq"), F.col("_d").alias("td"))
    controls = rows.where(F.col("_now") == 0).select(
        F.col(unit).alias("control"), time, "_history", F.col("_q").alias("cq"), F.col("_d").alias("cd"))
    steps = [F.sqrt(sum(((F.get("tq", F.lit(i * k + j)) - F.get("cq", F.lit(i * k + j))) ** 2 for j in range(k)),
                        F.lit(0.0))) for i in range(lag)]
    distance = sum(steps, F.lit(0.0)) / lag
    best = Window.partitionBy("treated", time).orderBy("distance", "control")
    return (treated.join(controls, [time, "_history"]).where(F.col("treated") != F.col("control"))
            .withColumn("distance", distance).withColumn("_r", F.row_number().over(best))
            .where(F.col("_r") <= size).drop("_r", "tq", "cq", "_history"))


def panel_match(df: DataFrame, unit: str, time: str, treatment: str, outcome: str, covariates,
                lag: int = 1, leads=range(1, 6), size: int = 5, forbid_reversal: bool = True,
                draws: int = 0) -> DataFrame:
    """Average effect on the treated per lead; placebo effects with negative leads.

    With `draws`, a unit bootstrap gives standard errors and percentile
    intervals: matched sets stay fixed, units get Poisson weights.
    """
    leads = list(leads)
    pairs = matched_sets(df, unit, time, treatment, outcome, covariates, lag, leads, size, forbid_reversal)
    long = pairs.select("treated", time, "control", F.posexplode(F.arrays_zip("td", "cd")).alias("i", "d")).where(
        F.col("d.td").isNotNull() & F.col("d.cd").isNotNull())
    sets = Window.partitionBy("treated", time, "i")
    weighted = long.withColumn("w", 1.0 / F.count(F.lit(1)).over(sets))
    # A unit adds its own change once per treated row and loses its share as a control.
    parts = weighted.select("i", F.explode(F.array(
        F.struct(F.col("treated").alias("unit"), (F.col("w") * F.col("d.td")).alias("num"), F.col("w").alias("den")),
        F.struct(F.col("control").alias("unit"), (-F.col("w") * F.col("d.cd")).alias("num"), F.lit(0.0).alias("den"))
    )).alias("p")).groupBy("i", "p.unit").agg(F.sum("p.num").alias("num"), F.sum("p.den").alias("den"))
    lead = F.element_at(F.array(*map(F.lit, leads)), F.col("i") + 1).alias("lead")
    out = parts.groupBy("i").agg((F.sum("num") / F.sum("den")).alias("att"),
                                 F.round(F.sum("den")).cast("bigint").alias("n_treated"))
    if draws:
        drawn = parts.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
            "c", poisson_weight(F.col("unit"), F.col("b")))
        atts = drawn.groupBy("i", "b").agg(
            F.try_divide(F.sum(F.col("c") * F.col("num")), F.sum(F.col("c") * F.col("den"))).alias("a"))
        # One value per draw and lead, so the percentile buffer is bounded by `draws`.
        spread = atts.groupBy("i").agg(F.stddev_samp("a").alias("se"),
                                       F.percentile("a", F.lit(0.025)).alias("ci_lower"),
                                       F.percentile("a", F.lit(0.975)).alias("ci_upper"))
        out = out.join(spread, "i", "left")
    return out.select(lead, *out.columns[1:])
