"""Within-document contrasts between two sides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.functions.scalars import guarded_rate


def sides_filled(df: DataFrame, keys, side: str, values, names=("other", "power")) -> DataFrame:
    """Long to wide by a 0/1 side, absent side 0; repeated rows are summed."""
    return df.groupBy(*keys).agg(*[
        F.sum(F.when(F.col(side) == i, F.col(v)).otherwise(0)).alias(f"{v}_{names[i]}")
        for v in values for i in (0, 1)])


def sides_means(df: DataFrame, keys, side: str, values, names=("other", "power"),
                both: bool = True) -> DataFrame:
    """A10: means by side, absent side NULL; `both` keeps rows seen on both sides."""
    wide = df.groupBy(*keys).agg(*[
        F.avg(F.when(F.col(side) == i, F.col(v))).alias(f"{v}_{names[i]}")
        for v in values for i in (0, 1)])
    if both:
        first = values[0]
        wide = wide.where(F.col(f"{first}_{names[0]}").isNotNull()
                          & F.col(f"{first}_{names[1]}").isNotNull())
    return wide


def to_long(df: DataFrame, ids, values, name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(values), name, value)


def _at_least(floor: int, *columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c) >= floor)
    return out


def rate_contrast(count: str, size: str, floor: int = 1, scale: float = 1000.0,
                  names=("other", "power")) -> Column:
    """Scaled rate on the power side minus the other side; NULL below the floor."""
    def rate(side):
        return F.col(f"{count}_{side}") * F.lit(scale) / F.col(f"{size}_{side}")
    sizes = [f"{size}_{s}" for s in names]
    return F.when(_at_least(floor, *sizes), rate(names[1]) - rate(names[0]))


def deletion_contrast(expressed: str, total: str, floor: int = 1, names=("other", "power")) -> Column:
    """D3: share without an expressed actor, power side minus other side."""
    def deleted(side):
        return 1 - guarded_rate(f"{expressed}_{side}", f"{total}_{side}", floor)
    return deleted(names[1]) - deleted(names[0])


def document_measures(contrast: DataFrame, min_words: int = 20) -> DataFrame:
    """D2-D4 on the document contrast table: levels and contrasts per definition."""
    out: dict[str, Column] = {}
    for tag in ("kw", "oa", "pa"):
        for side in ("power", "other"):
            out[f"deletion_{side}_{tag}"] = 1 - guarded_rate(f"n_agent_{side}_{tag}", f"n_passive_{side}_{tag}")
        out[f"deletion_contrast_{tag}"] = deletion_contrast(
            "n_agent", "n_passive", names=(f"other_{tag}", f"power_{tag}"))
    for tag in ("kw", "oa"):
        for side in ("power", "other"):
            out[f"hedge_{side}_{tag}"] = F.lit(1000.0) * guarded_rate(
                f"n_hedge_{side}_{tag}", f"n_words_{side}_{tag}", min_words)
        out[f"hedge_contrast_{tag}"] = out[f"hedge_power_{tag}"] - out[f"hedge_other_{tag}"]
    out["booster_contrast_kw"] = F.lit(1000.0) * (
        guarded_rate("n_booster_power_kw", "n_words_power_kw", min_words)
        - guarded_rate("n_booster_other_kw", "n_words_other_kw", min_words))
    return contrast.withColumns({**out, **document_levels(min_words)})


def document_levels(min_words: int = 20) -> dict[str, Column]:
    """Whole-document agent deletion and hedging."""
    def total(stem):
        return F.col(f"{stem}_power_kw") + F.col(f"{stem}_other_kw")
    return {"deletion_level": 1 - guarded_rate(total("n_agent"), total("n_passive")),
            "hedge_level": F.lit(1000.0) * guarded_rate(total("n_hedge"), "n_words_total", min_words)}


def specificity_shares(documents: DataFrame, min_power: int = 2, min_baseline: int = 1) -> DataFrame:
    """Named shares of power and baseline mentions and their difference."""
    power = guarded_rate("n_power_named", "n_power_mentions", min_power)
    base = guarded_rate("n_baseline_named", "n_baseline_mentions", min_baseline)
    return documents.withColumns({
        "power_named_share": power,
        "power_strict_named_share": guarded_rate("n_power_strict_named", "n_power_strict", min_power),
        "baseline_named_share": base, "specificity_contrast": power - base})


def slot_shares(slots: DataFrame) -> DataFrame:
    """Share of power arguments that are active subjects, and objects."""
    return slots.withColumns({"agency_share": guarded_rate("n_active_subject", "n_power_arguments"),
                              "object_share": guarded_rate("n_object", "n_power_arguments")})


def length_residual(df: DataFrame, score: str, n_tokens: str = "n_tokens",
                    name: str | None = None) -> DataFrame:
    """Residual of a score on log length; the fitted line is a one-row subquery."""
    x = F.ln(F.col(n_tokens))
    line = df.agg(F.struct(F.regr_slope(score, x).alias("b"),
                           F.regr_intercept(score, x).alias("a")).alias("l")).scalar()
    return df.withColumn(name or f"{score}_adjusted", F.col(score) - (line["a"] + line["b"] * x))


def side_contrasts(df: DataFrame, keys, side: str, values, both: bool = True) -> DataFrame:
    """Mean on the power side minus mean on the other side, for many columns."""
    wide = sides_means(df, keys, side, values, both=both)
    return wide.select(*keys, *[(F.col(f"{v}_power") - F.col(f"{v}_other")).alias(f"{v}_contrast")
                                for v in values])


def nominalisation_variants(documents: DataFrame) -> DataFrame:
    """Actor-deletion contrast for keep/exclude gerunds x keep/exclude methods predicates.

    Every row is sent to the variants that keep it, and one aggregation serves
    the whole grid.
    """
    grid = F.array(*[F.struct(F.lit(g).alias("keep_gerunds"), F.lit(m).alias("keep_methods"))
                     for g in (0, 1) for m in (0, 1)])
    rows = documents.withColumn("_v", F.explode(grid)).select("*", "_v.*").where(
        ((F.col("keep_gerunds") == 1) | (F.col("is_gerund") == 0))
        & ((F.col("keep_methods") == 1) | (F.col("is_methods_predicate") == 0)))
    wide = sides_filled(rows, ["ut", "keep_gerunds", "keep_methods"], "in_power_clause",
                        ["n_nominalisations", "n_actor_expressed"])
    return wide.withColumn("actor_deletion_contrast",
                           deletion_contrast("n_actor_expressed", "n_nominalisations"))


def clause_contrasts(variants: DataFrame) -> DataFrame:
    """Agent-deletion contrast for each definition x methods filter."""
    wide = sides_filled(variants, ["ut", "definition", "exclude_methods_predicates"],
                        "is_power_side", ["n_passive", "n_agent_expressed"])
    return wide.withColumn("deletion_contrast", deletion_contrast("n_agent_expressed", "n_passive"))


def paired_difference(df: DataFrame, difference: str, by: Iterable[str] = ()) -> DataFrame:
    """Mean, sd, t and share negative of a within-document difference."""
    d = F.col(difference)
    out = df.where(d.isNotNull()).groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"),
        F.avg(F.when(d < 0, 1.0).otherwise(0.0)).alias("share_negative"))
    return out.withColumn("t", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd")))


