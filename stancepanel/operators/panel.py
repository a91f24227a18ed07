"""Panels: lags, transitions, cells, papers, careers (W, A13-A16, D11-D17, J).

Windows partition by the panel unit and order by time. In a unit-year panel a
unit has one row per year, so a window group is as long as the time axis; on
document-grain tables the same questions are aggregates plus a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancepanel.functions.numbering import number_rows
from stancepanel.functions.scalars import country_key, flag
from stancepanel.sources.lexicon import map_codes


def row_lags(df: DataFrame, unit: str, time: str, columns, lags, gap_safe: bool = False) -> DataFrame:
    """Lagged columns `<column>_lag<k>`.

    By default a lag counts rows, so a missing year shifts it. With `gap_safe`
    it counts time: the value of exactly `time - k`, else NULL.
    """
    w = Window.partitionBy(unit).orderBy(time)

    def lagged(c, k):
        if not gap_safe:
            return F.lag(c, k).over(w)
        near = [F.lag(F.struct(time, c), j).over(w) for j in range(1, k + 1)]
        return F.coalesce(*[F.when(s[time] == F.col(time) - k, s[c]) for s in near])
    return df.withColumns({f"{c}_lag{k}": lagged(c, k) for c in columns for k in lags})


def key_shift_lag(df: DataFrame, values: DataFrame, keys, time: str, column: str, k: int,
                  name: str | None = None) -> DataFrame:
    """Lag by joining on the shifted time key; rows without a lagged value drop out."""
    shifted = values.select(*keys, (F.col(time) + k).alias(time), F.col(column).alias(name or f"{column}_lag{k}"))
    return df.join(shifted, [*keys, time])


def transitions(df: DataFrame, unit: str, time: str, treatment: str, name: str = "transition") -> DataFrame:
    """1 in a row whose treatment is 1 after a row with treatment 0, else 0."""
    before = F.lag(treatment, 1).over(Window.partitionBy(unit).orderBy(time))
    return df.withColumn(name, flag((before == 0) & (F.col(treatment) == 1)))


def dense_ids(df: DataFrame, key: str, name: str = "unit_id") -> DataFrame:
    """Dense integers 1..n over the sorted distinct keys.

    The keys are numbered range by range, see `number_rows`.
    """
    return number_rows(df.select(key).distinct(), key, name)


def first_address(addresses: DataFrame, crosswalk: DataFrame, first_year: int,
                  last_year: int) -> tuple[DataFrame, DataFrame]:
    """Code of the first address, within the year range; also the unmapped names."""
    keyed = (addresses.where((F.col("addr_no") == 1) & F.col("year").between(first_year, last_year))
             .withColumn("name", country_key("country")))
    return map_codes(keyed, crosswalk, "name", "iso3")


def paper_panel(documents: DataFrame, flags: DataFrame, scores: DataFrame | None, authors: DataFrame,
                context: DataFrame, author: str = "daisng_id") -> DataFrame:
    """Documents with flags, optional scores, known authors and country-year context."""
    papers = documents.join(flags, "ut")
    if scores is not None:
        papers = papers.join(scores, "ut", "left")
    known = authors.where(F.col(author).isNotNull())
    return papers.join(known, "ut").join(context, ["iso3", "year"])


def merge_context(df: DataFrame, context: DataFrame, on, covered: str) -> tuple[DataFrame, DataFrame]:
    """Left merge of country-year context, and a one-row coverage report."""
    merged = df.join(context, on, "left")
    report = merged.agg(F.count(F.lit(1)).alias("rows"), F.count(covered).alias("covered"),
                        F.count_if(F.col(covered).isNull()).alias("missing"))
    return merged, report


def country_year_cells(documents: DataFrame, measure: str, context: DataFrame, min_docs: int = 10,
                       keys=("iso3", "year")) -> DataFrame:
    """Mean and count per cell, thin cells dropped, joined with context."""
    cells = documents.where(F.col(measure).isNotNull()).groupBy(*keys).agg(
        F.avg(measure).alias("value"), F.count(F.lit(1)).alias("n_docs"))
    return cells.where(F.col("n_docs") >= min_docs).join(context, list(keys))


def range_filter(df: DataFrame, unit: str, column: str, at_least: float, min_rows: int = 1) -> DataFrame:
    """Rows of units whose column spans at least a given range."""
    wide = df.groupBy(unit).agg((F.max(column) - F.min(column)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    return df.join(wide.where((F.col("_r") >= at_least) & (F.col("_n") >= min_rows)).select(unit),
                   unit, "left_semi")


def effective_sample(df: DataFrame, unit: str, treatment: str) -> DataFrame:
    """Documents, units, units with repeats, and units with variation inside."""
    per_unit = df.groupBy(unit).agg(F.count(F.lit(1)).alias("n"),
                                    (F.max(treatment) - F.min(treatment)).alias("r"))
    informative = (F.col("n") >= 2) & (F.col("r") > 0)
    return per_unit.agg(
        F.sum("n").alias("documents"), F.count(F.lit(1)).alias("units"),
        F.count_if(F.col("n") >= 2).alias("repeat_units"), F.count_if(informative).alias("informative_units"),
        F.sum(F.when(informative, F.col("n")).otherwise(0)).alias("informative_documents"))


def first_value(df: DataFrame, unit: str, value: str, order) -> DataFrame:
    """Value of the first row per unit; the order columns make ties explicit."""
    return df.groupBy(unit).agg(F.min(F.struct(*order, value))[value].alias(value))


def origins(papers: DataFrame, author: str = "daisng_id") -> DataFrame:
    """Country and year of an author's first paper (ties by document)."""
    first = F.min(F.struct("year", "ut", "iso3"))
    return papers.groupBy(author).agg(first["iso3"].alias("origin_iso3"), first["year"].alias("first_year"))


def with_origin(papers: DataFrame, author: str = "daisng_id") -> DataFrame:
    """Papers with the author's origin and a flag for being away from it."""
    return papers.join(origins(papers, author), author).withColumn(
        "away", flag(F.col("iso3") != F.col("origin_iso3")))


def author_types(papers: DataFrame, author: str = "daisng_id") -> DataFrame:
    """Papers, moves and countries per author, and seen on both sides or not.

    Papers are first counted per author and country: an author has moved, and
    is seen on both sides, exactly when there is more than one country.
    """
    per_country = papers.groupBy(author, "iso3").agg(F.count(F.lit(1)).alias("n"))
    several = flag(F.count("iso3") > 1)
    return per_country.groupBy(author).agg(
        F.sum("n").alias("n_papers"), several.alias("moved"), F.count("iso3").alias("n_countries"),
        several.alias("both_sides"))


def origin_treatment(moved: DataFrame, treatment: str, name: str) -> DataFrame:
    """Treatment of the origin country in the paper's year, from the panel itself."""
    values = (moved.select("iso3", "year", treatment).distinct().groupBy("iso3", "year")
              .agg(F.avg(treatment).alias(name)).withColumnRenamed("iso3", "origin_iso3"))
    return moved.join(values, ["origin_iso3", "year"], "left")


def since_first_event(df: DataFrame, unit: str, time: str, event: Column, name: str) -> DataFrame:
    """1 from the unit's first event on."""
    first = df.where(event).groupBy(unit).agg(F.min(time).alias("_first"))
    return df.join(first, unit, "left").withColumn(name, flag(F.col(time) >= F.col("_first"))).drop("_first")


def risk_set(papers: DataFrame, last_risk_year: int, events: dict[str, str], author: str = "daisng_id",
             min_papers: int = 2) -> DataFrame:
    """Author-years at risk of exit, with status flags that start at a first event.

    An author whose first year is after the last risk year has no row.
    """
    careers = papers.groupBy(author).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("year", "ut", "iso3"))["iso3"].alias("iso3"),
        *[F.min(F.when(F.col(c) == 1, F.col("year"))).alias(f"_{n}") for n, c in events.items()])
    end = F.least("last_year", F.lit(last_risk_year))
    years = careers.where((F.col("_n") >= min_papers) & (F.col("first_year") <= end)).withColumn(
        "year", F.explode(F.sequence("first_year", end)))
    return years.select(
        author, "year", "iso3",
        flag((F.col("year") == F.col("last_year")) & (F.col("last_year") <= last_risk_year)).alias("exit"),
        (F.col("year") - F.col("first_year")).alias("career_age"),
        *[flag(F.col("year") >= F.col(f"_{n}")).alias(n) for n in events])


def regime_age(spells: DataFrame, unit: str = "iso3", time: str = "year",
               duration: str = "cumulative_duration") -> DataFrame:
    """Age of the regime per unit and year, and its log1p."""
    return spells.groupBy(unit, time).agg(F.max(duration).alias("regime_age")).withColumn(
        "log_regime_age", F.log1p("regime_age"))


def consecutive_units(df: DataFrame, unit: str, time: str) -> DataFrame:
    """Rows of units without a gap in time."""
    whole = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_n"), (F.max(time) - F.min(time) + 1).alias("_span"))
    return df.join(whole.where(F.col("_n") == F.col("_span")).select(unit), unit, "left_semi")
