"""Column functions (P operators): pure expressions, nothing leaves codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.functions.numbering import number_rows


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def flag(condition: Column) -> Column:
    """0/1 integer; a NULL condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def ends_with_any(c, suffixes) -> Column:
    """True when the string ends in one of the suffixes."""
    return reduce(lambda a, b: a | b, [_col(c).endswith(s) for s in suffixes])


def is_capitalised(c) -> Column:
    """First character is an ASCII capital."""
    return _col(c).rlike("^[A-Z]")


def first_word(c) -> Column:
    """Text before the first blank."""
    return F.split_part(_col(c), F.lit(" "), F.lit(1))


def joined_span(*parts) -> Column:
    """Blank-joined words; NULL as soon as one word is missing."""
    pieces = []
    for i, part in enumerate(parts):
        pieces += ([F.lit(" ")] if i else []) + [_col(part)]
    return F.concat(*pieces)


def zero_if_missing(c) -> Column:
    """P5: coalesce to zero."""
    return F.coalesce(_col(c), F.lit(0))


def text_mentions(pattern: str, *columns) -> Column:
    """Case-blind regular-expression search over several text columns."""
    return F.lower(F.concat_ws(" ", *[_col(c) for c in columns])).rlike(pattern)


def strip_article(c) -> Column:
    """Drop a leading 'The ' and outer blanks."""
    return F.trim(F.regexp_replace(_col(c), "^[Tt]he ", ""))


def n_name_parts(c) -> Column:
    """Number of parts when split on blanks and hyphens."""
    return F.size(F.split(_col(c), "[ -]+"))


def country_key(c, aliases: dict[str, str] | None = None) -> Column:
    """Upper-case trimmed country name with aliases recoded."""
    aliases = fixed.COUNTRY_ALIASES if aliases is None else aliases
    key = F.upper(F.trim(_col(c)))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def natural_log(c) -> Column:
    """Natural log, NULL outside the domain."""
    return F.when(_col(c) > 0, F.ln(_col(c)))


def log_plus_one(c) -> Column:
    """log(x + 1), NULL outside the domain."""
    return F.when(_col(c) > -1, F.log1p(_col(c)))


def below(c, cut) -> Column:
    """P10: 1 below the cut, 0 at or above it, missing stays missing."""
    return F.when(_col(c) < cut, F.lit(1)).when(_col(c) >= cut, F.lit(0))


def guarded_rate(num, den, floor: int = 1) -> Column:
    """Num / den when the denominator reaches the floor, else NULL."""
    return F.when(_col(den) >= floor, _col(num).cast("double") / _col(den))


def per_thousand(num, den) -> Column:
    """1000 * num / den, NULL on a zero denominator."""
    return F.try_divide(_col(num) * F.lit(1000.0), _col(den))


def clamp(c, low, high) -> Column:
    """Bring into [low, high]; NULL stays NULL."""
    return F.when(_col(c).isNotNull(), F.least(F.greatest(_col(c), F.lit(low)), F.lit(high)))


def labelled(c, labels: dict) -> Column:
    """Code to label."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, _col(c))


def per_token_rates(columns, n_tokens="n_tokens", suffix="_rate") -> list[Column]:
    """One rate column per count column."""
    return [F.try_divide(_col(c), _col(n_tokens)).alias(f"{c}{suffix}") for c in columns]


def significance_stars(p) -> Column:
    """marker for 1, 5 and 10 percent."""
    return (F.when(_col(p) < 0.01, F.lit("**")).when(_col(p) < 0.05, F.lit("*"))
            .when(_col(p) < 0.1, F.lit(".")).when(_col(p).isNotNull(), F.lit("")))


def sample_rows(df: DataFrame, key, n: int, salt: str = "") -> DataFrame:
    """N rows chosen by the hash of their key; a top-n, so no full sort."""
    digest = F.md5(F.concat(F.lit(salt), _col(key).cast("string")))
    return df.orderBy(digest, _col(key)).limit(n)


def random_half(df: DataFrame, group: str, salt: str = "") -> DataFrame:
    """The half of the distinct groups with the smallest hash, rounded down."""
    digest = F.md5(F.concat(F.lit(salt), F.col(group).cast("string")))
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    ranked = number_rows(groups.withColumn("_order", F.struct(digest, F.col(group))), "_order", "_rank")
    total = ranked.agg(F.max("_rank").alias("n")).scalar()
    return ranked.where(F.col("_rank") * 2 <= total).select(group)


def standardise(df: DataFrame, columns, population: DataFrame | None = None,
                suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd with moments of `population` (default: the table).

    The moments are one-row scalar subqueries, so nothing is joined.
    """
    source = df if population is None else population
    out = {}
    for c in columns:
        moments = source.agg(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias("t"))
        moments = moments.scalar()
        out[f"{c}{suffix}"] = F.try_divide(F.col(c) - moments["m"], moments["s"])
    return df.withColumns(out)


def long_enough(sentences: DataFrame, lengths: DataFrame, n_tokens: str = "n_tokens",
                at_least: int = 3, keys=("ut", "sent_id")) -> DataFrame:
    """Sentences of a minimum length, lengths taken from another table."""
    keep = lengths.where(F.col(n_tokens) >= at_least).select(*keys, n_tokens)
    return sentences.join(keep, list(keys))
