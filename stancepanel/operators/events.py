"""Event windows, candidate events, placebo boundaries (E operators).

An event is expanded to the few years of its window and meets the panel by
equality on (unit, time): no range join, and the fan-out is the window length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.functions.scalars import flag, standardise, text_mentions
from stancepanel.operators.panel import transitions
from stancepanel.operators.regression import FixedEffectsModel, ols


def transition_events(panel: DataFrame, unit: str, time: str, treatment: str) -> DataFrame:
    """All 0 to 1 transitions as (unit, event_year)."""
    return transitions(panel, unit, time, treatment).where("transition = 1").select(
        unit, F.col(time).alias("event_year"))


def event_windows(rows: DataFrame, events: DataFrame, unit: str, time: str, k: int,
                  keep_start: bool = True) -> DataFrame:
    """Rows within k years of an event, with `rel_year`; a row may serve several events."""
    years = events.withColumn("rel_year", F.explode(F.sequence(F.lit(-k), F.lit(k))))
    if not keep_start:
        years = years.where("rel_year <> 0")
    years = years.withColumn(time, (F.col("event_year") + F.col("rel_year")).cast("int"))
    return rows.join(years, [unit, time])


def event_path(windows: DataFrame, outcome: str) -> DataFrame:
    """Mean outcome and rows by relative year."""
    return windows.groupBy("rel_year").agg(F.avg(outcome).alias(f"mean_{outcome}"), F.count(F.lit(1)).alias("n"))


def event_path_z(windows: DataFrame, outcomes) -> DataFrame:
    """Mean z-scores by relative year; moments come from the stacked windows."""
    z = standardise(windows, list(outcomes))
    return z.groupBy("rel_year").agg(*[F.avg(f"{c}_z").alias(f"mean_{c}_z") for c in outcomes],
                                     F.count(F.lit(1)).alias("n"))


def candidate_events(windows: DataFrame, unit: str, outcome: str, at_least: int = 3) -> DataFrame:
    """Events with enough observed outcomes before and after."""
    seen = F.col(outcome).isNotNull()
    return windows.groupBy(unit, "event_year").agg(
        F.count_if(seen & (F.col("rel_year") < 0)).alias("n_pre"),
        F.count_if(seen & (F.col("rel_year") > 0)).alias("n_post")).where(
        (F.col("n_pre") >= at_least) & (F.col("n_post") >= at_least))


def _side(value: str, before: bool) -> Column:
    return F.avg(F.when((F.col("rel_year") < 0) if before else (F.col("rel_year") > 0), F.col(value)))


def spell_changes(documents: DataFrame, events: DataFrame, context: DataFrame, unit: str, time: str,
                  outcomes, treatment: str, window: int = 3, min_docs: int = 10) -> DataFrame:
    """Change of document means and of the treatment around the start of a spell."""
    keys = [unit, "event_year"]
    docs = event_windows(documents, events.select(*keys).distinct(), unit, time, window, keep_start=False)
    changes = docs.groupBy(*keys).agg(
        F.count_if(F.col("rel_year") < 0).alias("n_pre"), F.count_if(F.col("rel_year") > 0).alias("n_post"),
        *[e for c in outcomes for e in (_side(c, True).alias(f"{c}_pre"), _side(c, False).alias(f"{c}_post"))],
        *[(_side(c, False) - _side(c, True)).alias(f"{c}_change") for c in outcomes])
    changes = changes.where((F.col("n_pre") >= min_docs) & (F.col("n_post") >= min_docs))
    moved = event_windows(context, events.select(*keys).distinct(), unit, time, window, keep_start=False)
    moved = moved.groupBy(*keys).agg((_side(treatment, False) - _side(treatment, True)).alias(f"{treatment}_change"))
    return changes.join(moved, keys, "left")


def boundary_changes(cells: DataFrame, boundaries: DataFrame, unit: str, time: str, value: str, n: str,
                     window: int = 3, min_docs: int = 10) -> DataFrame:
    """E5: change of the n-weighted mean around a boundary year."""
    rows = event_windows(cells, boundaries, unit, time, window, keep_start=False)
    pre, post = F.col("rel_year") < 0, F.col("rel_year") > 0

    def total(side, c):
        return F.sum(F.when(side, c))
    w, wx = F.col(n), F.col(n) * F.col(value)
    sums = rows.groupBy(*boundaries.columns).agg(
        total(pre, w).alias("n_pre"), total(post, w).alias("n_post"),
        total(pre, wx).alias("_pre"), total(post, wx).alias("_post"))
    kept = sums.where((F.col("n_pre") >= min_docs) & (F.col("n_post") >= min_docs))
    return kept.select(*boundaries.columns, (F.col("_post") / F.col("n_post") - F.col("_pre") / F.col("n_pre"))
                       .alias("change"), F.least("n_pre", "n_post").alias("n_min"))


def placebo_boundaries(units: DataFrame, real: DataFrame, unit: str, first: int, last: int) -> DataFrame:
    """Every (unit, year) of the range that is not a real boundary."""
    grid = units.select(unit).distinct().withColumn(
        "event_year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return grid.join(real.select(unit, "event_year"), [unit, "event_year"], "left_anti")


def compare_changes(real: DataFrame, placebo: DataFrame, change: str = "change") -> DataFrame:
    """Sizes of change at real and placebo boundaries, with Welch's t on absolute change."""
    both = real.select(F.lit("r").alias("k"), change).unionByName(placebo.select(F.lit("p").alias("k"), change))

    def of(kind, c):
        return F.when(F.col("k") == kind, c)
    size, signed = F.abs(change), F.col(change)
    stats = both.agg(*[e for k, name in (("r", "real"), ("p", "placebo")) for e in (
        F.count(of(k, size)).alias(f"n_{name}"), F.avg(of(k, size)).alias(f"abs_{name}"),
        F.avg(of(k, signed)).alias(f"mean_{name}"), F.var_samp(of(k, size)).alias(f"_v_{name}"))])
    a, b = F.col("_v_real") / F.col("n_real"), F.col("_v_placebo") / F.col("n_placebo")
    return stats.withColumns({
        "t": F.try_divide(F.col("abs_real") - F.col("abs_placebo"), F.sqrt(a + b)),
        "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n_real") - 1) + b * b / (F.col("n_placebo") - 1))}
    ).drop("_v_real", "_v_placebo")


def typed_starts(starts: DataFrame, ends: DataFrame, unit: str, notes, pattern: str,
                 name: str = "by_coup") -> DataFrame:
    """Spell starts matched to the end of the spell before, flagged by its notes."""
    typed = ends.where(F.col("endyear").isNotNull()).select(
        unit, (F.col("endyear") + 1).alias("event_year"), flag(text_mentions(pattern, *notes)).alias(name))
    return starts.join(typed, [unit, "event_year"]).groupBy(unit, "event_year").agg(F.max(name).alias(name))


def event_regression(changes: DataFrame, outcome: str, treatment: str) -> DataFrame:
    """Event-level slope, weighted by the smaller side's documents."""
    return ols(changes.withColumn("_w", F.least("n_pre", "n_post")), outcome, [treatment], weights="_w")


def same_author_effect(documents: DataFrame, events: DataFrame, unit: str, time: str, author: str,
                       outcome: str, window: int = 3, min_authors: int = 20) -> DataFrame:
    """Post-event effect inside authors seen on both sides, for all events at once."""
    rows = event_windows(documents.where(F.col(author).isNotNull()), events, unit, time, window, keep_start=False)
    rows = rows.withColumn("post", flag(F.col("rel_year") > 0)).withColumn(
        "event", F.concat_ws(" ", unit, "event_year"))
    both = rows.groupBy("event", author).agg(F.min("post").alias("lo"), F.max("post").alias("hi")).where("lo < hi")
    enough = both.groupBy("event").agg(F.count(F.lit(1)).alias("n_authors")).where(F.col("n_authors") >= min_authors)
    kept = (rows.join(both.select("event", author), ["event", author], "left_semi")
            .join(enough.select("event"), "event", "left_semi"))
    return FixedEffectsModel(kept, outcome, ["post"], author, cluster=author, by="event").table()
