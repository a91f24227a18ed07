"""Queries on unit-year panels, events and estimators (A, W, O, E, F, G, H, and the rest of P and D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stancepanel.functions import fixed_values as fixed
from stancepanel.functions import scalars as sc
from stancepanel.operators import contrast as ct
from stancepanel.operators import did
from stancepanel.operators import events as ev
from stancepanel.operators import many_levels as ml
from stancepanel.operators import matching as ma
from stancepanel.operators import panel as pa
from stancepanel.operators import regression as rg
from stancepanel.operators import summary as su
from stancepanel.operators import synth as sy
from stancepanel.plans import standins as st
from stancepanel.plans.registry import R, cte, query, rounded, table

# A panel with absent rows and missing outcomes, and one with a staggered absorbing treatment.
cte("gappy", """SELECT unit, year, CASE WHEN (unit + year) % 6 <> 0 THEN y END AS y, n, autocracy, polyarchy FROM panel
  WHERE (unit * 3 + year) % 5 <> 0""", "panel")
cte("holed", "SELECT unit, year, CASE WHEN (unit + year) % 6 <> 0 THEN y END AS y, n, autocracy, polyarchy FROM panel",
    "panel")
cte("staggered", """SELECT *, CASE WHEN year >= start THEN 1 ELSE 0 END AS d, coalesce(start, 0) AS cohort FROM panel""",
    "panel")


def holed(spark, d):
    """The whole panel, with some outcomes missing."""
    y = F.when((F.col("unit") + F.col("year")) % 6 != 0, F.col("y"))
    return st.panel(spark, d).select("unit", "year", y.alias("y"), "n", "autocracy", "polyarchy")


def gappy(spark, d):
    """The same with absent rows, for operators whose feature is gaps."""
    return holed(spark, d).where((F.col("unit") * 3 + F.col("year")) % 5 != 0)


def staggered(spark, d):
    return st.panel(spark, d).withColumns({"d": sc.flag(F.col("year") >= F.col("start")),
                                           "cohort": F.coalesce("start", F.lit(0))})


# --- P and W ------------------------------------------------------------------------------------

@query("p9_logs_and_bounds", f"""SELECT unit, year, {R('ln(y)')} AS ln_y, {R('ln(n + 1)')} AS ln_n, {R('sqrt(abs(y - gdp))')} AS s,
  least(n, pop) AS lo, greatest(n, pop) AS hi FROM panel""", ("panel",))
def p9(spark, d):
    return rounded(st.panel(spark, d).select(
        "unit", "year", sc.natural_log("y").alias("ln_y"), sc.log_plus_one("n").alias("ln_n"),
        F.sqrt(F.abs(F.col("y") - F.col("gdp"))).alias("s"), F.least("n", "pop").alias("lo"),
        F.greatest("n", "pop").alias("hi")))


@query("p10_p14_p15_codes", """SELECT unit, year, CASE WHEN y < 150 THEN 1 WHEN y >= 150 THEN 0 END AS is_low,
  CASE WHEN y IS NOT NULL THEN least(greatest(year - 1998, -2), 2) END AS rel,
  CASE autocracy * 2 WHEN 0 THEN 'Closed autocracy' ELSE 'Electoral democracy' END AS label FROM holed""", ("holed",))
def p10(spark, d):
    return holed(spark, d).select(
        "unit", "year", sc.below("y", 150).alias("is_low"),
        F.when(F.col("y").isNotNull(), sc.clamp(F.col("year") - 1998, -2, 2)).alias("rel"),
        sc.labelled(F.col("autocracy") * 2, fixed.REGIME_LABELS).alias("label"))


@query("w1_row_lags", "SELECT unit, year, " + ", ".join(
    f"{R(f'lag(y, {k}) OVER w')} AS y_lag{k}, lag(autocracy, {k}) OVER w AS autocracy_lag{k}" for k in (1, 2, 3, 4))
    + " FROM gappy WINDOW w AS (PARTITION BY unit ORDER BY year)", ("gappy",))
def w1(spark, d):
    lags = pa.row_lags(gappy(spark, d), "unit", "year", ["y", "autocracy"], (1, 2, 3, 4))
    return rounded(lags.select("unit", "year", *[f"{c}_lag{k}" for k in (1, 2, 3, 4) for c in ("y", "autocracy")]))


@query("w1_gap_safe_lags", "SELECT g.unit, g.year, " + ", ".join(f"{R(f'l{k}.y')} AS y_lag{k}" for k in (1, 2, 3))
       + " FROM gappy g " + " ".join(f"LEFT JOIN gappy l{k} ON g.unit = l{k}.unit AND g.year = l{k}.year + {k}"
                                     for k in (1, 2, 3)), ("gappy",))
def w1g(spark, d):
    lags = pa.row_lags(gappy(spark, d), "unit", "year", ["y"], (1, 2, 3), gap_safe=True)
    return rounded(lags.select("unit", "year", "y_lag1", "y_lag2", "y_lag3"))


@query("w1_key_shift_lag", f"""SELECT g.unit, g.year, {R('l.polyarchy')} AS polyarchy_lag2 FROM gappy g
  JOIN gappy l ON g.unit = l.unit AND g.year = l.year + 2""", ("gappy",))
def w1k(spark, d):
    g = gappy(spark, d)
    return rounded(pa.key_shift_lag(g.select("unit", "year"), g, ["unit"], "year", "polyarchy", 2))


cte("trans", """SELECT unit, year AS event_year FROM (SELECT unit, year, autocracy,
  lag(autocracy) OVER (PARTITION BY unit ORDER BY year) AS before FROM panel) WHERE before = 0 AND autocracy = 1""",
    "panel")


@query("w2_transitions", "SELECT * FROM trans", ("trans",))
def w2(spark, d):
    return ev.transition_events(st.panel(spark, d), "unit", "year", "autocracy")


@query("w5_largest_residuals", f"""SELECT iso3, {R('y - (a + b * polyarchy)')} AS residual FROM cy,
  (SELECT regr_slope(y, polyarchy) AS b, regr_intercept(y, polyarchy) AS a FROM cy)
  ORDER BY abs(y - (a + b * polyarchy)) DESC, iso3 LIMIT 8""", ("cy",))
def w5(spark, d):
    means = st.panel(spark, d).groupBy("iso3").agg(F.avg("y").alias("y"), F.avg("polyarchy").alias("polyarchy"))
    return rounded(su.largest_residuals(means, "y", "polyarchy", "iso3").select("iso3", "residual"))


cte("cy", "SELECT iso3, avg(y) AS y, avg(polyarchy) AS polyarchy FROM panel GROUP BY 1", "panel")


@query("w8_dense_ids", "SELECT c_name, row_number() OVER (ORDER BY c_name) AS unit_id FROM (SELECT DISTINCT c_name FROM customer)")
def w8(spark, d):
    return pa.dense_ids(table(spark, d, "customer"), "c_name")


@query("o1_ranked_units", f"""SELECT iso3, {R('y')} AS y FROM cy ORDER BY y DESC, iso3 LIMIT 10""", ("cy",))
def o1(spark, d):
    means = st.panel(spark, d).groupBy("iso3").agg(F.avg("y").alias("y"))
    return rounded(means.orderBy(F.desc("y"), "iso3").limit(10))


@query("o3_set_operations", """SELECT 'donors with orders' AS what, count(*) AS n FROM (SELECT c_custkey FROM customer
  INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM
  (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def o3(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return su.row_counts({"donors with orders": customers.intersect(buyers),
                          "without": customers.exceptAll(buyers.distinct())}).withColumnRenamed("table_name", "what")


# --- A ------------------------------------------------------------------------------------------

@query("a5_group_summary", f"""SELECT regime, count(*) AS n, count(DISTINCT unit) AS units, {R('avg(y)')} AS mean,
  {R('stddev_samp(y)')} AS sd, {R('min(y)')} AS min, {R('quantile_cont(y, 0.5)')} AS median, {R('max(y)')} AS max
  FROM panel GROUP BY 1""", ("panel",))
def a5(spark, d):
    return rounded(su.describe_groups(st.panel(spark, d), "regime", "y", "unit"))


@query("a5_order_price_summary", f"""SELECT priority, count(*) AS n, count(DISTINCT author) AS units, {R('avg(price)', 3)} AS mean,
  {R('stddev_samp(price)', 3)} AS sd, {R('min(price)', 3)} AS min, {R('quantile_cont(price, 0.5)', 3)} AS median,
  {R('max(price)', 3)} AS max FROM ord GROUP BY 1""", ("ord",))
def a5o(spark, d):
    return rounded(su.describe_groups(st.order_cells(spark, d), "priority", "price", "author"), 3)


@query("a5_regime_trend", f"""SELECT year, regime, {R('avg(y)')} AS mean, count(*) AS n FROM panel GROUP BY 1, 2""", ("panel",))
def a5t(spark, d):
    return rounded(su.trend(st.panel(spark, d), "year", "regime", "y"))


@query("a6_quartile_summary", f"""SELECT CAST(1 + (gdp > q[1])::INT + (gdp > q[2])::INT + (gdp > q[3])::INT AS INT) AS bin,
  {R('min(gdp)')} AS low, {R('max(gdp)')} AS high, count(*) AS n, count(DISTINCT unit) AS units, {R('avg(y)')} AS mean,
  {R('stddev_samp(y)')} AS sd, {R('avg(gdp)')} AS mean_by, {R('100.0 * avg(autocracy)')} AS pct
  FROM panel, (SELECT quantile_cont(gdp, [0.25, 0.5, 0.75]) AS q FROM panel) GROUP BY 1""", ("panel",))
def a6(spark, d):
    return rounded(su.describe_bins(st.panel(spark, d), "y", "gdp", "unit", "autocracy"))


CORR = ["y", "polyarchy", "gdp", "pop", "autocracy"]


@query("a7_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, {R(f'corr({b}, {a})')} AS r FROM panel"
    for i, a in enumerate(CORR) for b in CORR[i + 1:]), ("panel",))
def a7(spark, d):
    return rounded(su.correlations(st.panel(spark, d), CORR))


@query("a8_weighted_moments", f"""SELECT regime, count(*) AS n, {R('any_value(m)')} AS mean,
  {R('sqrt(sum(n * (y - m) * (y - m)) / (sum(n) - 1))')} AS sd
  FROM (SELECT *, sum(n * y) OVER (PARTITION BY regime) / sum(n) OVER (PARTITION BY regime) AS m FROM panel)
  GROUP BY regime""", ("panel",))
def a8(spark, d):
    return rounded(su.weighted_moments(st.panel(spark, d), "y", "n", ["regime"]))


@query("a11_wide_to_long", f"""SELECT unit, year, 'y' AS measure, {R('y')} AS value FROM panel
  UNION ALL SELECT unit, year, 'gdp', {R('gdp')} FROM panel""", ("panel",))
def a11(spark, d):
    return rounded(ct.to_long(st.panel(spark, d), ["unit", "year"], ["y", "gdp"]))


def _profile(c):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) - count({c}) AS missing, {R(f'min({c})')} AS min, "
            f"{R(f'quantile_cont({c}, 0.25)')} AS q1, {R(f'quantile_cont({c}, 0.5)')} AS median, {R(f'avg({c})')} AS mean, "
            f"{R(f'quantile_cont({c}, 0.75)')} AS q3, {R(f'max({c})')} AS max FROM gappy")


@query("a18_column_profile", " UNION ALL ".join(map(_profile, ["y", "polyarchy"])), ("gappy",))
def a18(spark, d):
    return rounded(su.column_profile(gappy(spark, d), ["y", "polyarchy"]))


@query("d13_context_coverage", """SELECT count(*) AS rows, count(g.y) AS covered, count(*) - count(g.y) AS missing
  FROM panel p LEFT JOIN gappy g ON p.unit = g.unit AND p.year = g.year""", ("panel", "gappy"))
def d13(spark, d):
    base = st.panel(spark, d).select("unit", "year")
    return pa.merge_context(base, gappy(spark, d).select("unit", "year", "y"), ["unit", "year"], "y")[1]


@query("d17_regime_age", f"""SELECT unit, year, max(n % 40) AS regime_age, {R('ln(1 + max(n % 40))')} AS log_regime_age
  FROM (SELECT unit, year, priority, count(*) AS n FROM ord GROUP BY 1, 2, 3) GROUP BY 1, 2""", ("ord",))
def d17(spark, d):
    spells = st.order_cells(spark, d).groupBy("unit", "year", "priority").agg(
        (F.count(F.lit(1)) % 40).alias("cumulative_duration"))
    return rounded(pa.regime_age(spells, "unit", "year"))


# --- E ------------------------------------------------------------------------------------------

cte("windows", """SELECT p.*, t.event_year, CAST(p.year - event_year AS INT) AS rel_year FROM panel p
  JOIN trans t ON p.unit = t.unit AND p.year BETWEEN event_year - 5 AND event_year + 5""", "panel", "trans")
cte("holewin", """SELECT p.*, t.event_year, CAST(p.year - event_year AS INT) AS rel_year FROM holed p
  JOIN trans t ON p.unit = t.unit AND p.year BETWEEN event_year - 5 AND event_year + 5""", "holed", "trans")


def transition_events(spark, d):
    return ev.transition_events(st.panel(spark, d), "unit", "year", "autocracy")


def windows(spark, d, rows=None):
    return ev.event_windows(st.panel(spark, d) if rows is None else rows, transition_events(spark, d),
                            "unit", "year", 5)


@query("e1_event_windows", f"SELECT unit, year, event_year, rel_year, {R('y')} AS y FROM windows", ("windows",))
def e1(spark, d):
    return rounded(windows(spark, d).select("unit", "year", "event_year", "rel_year", "y"))


@query("e2_event_path", f"SELECT rel_year, {R('avg(y)')} AS mean_y, count(*) AS n FROM holewin GROUP BY 1", ("holewin",))
def e2(spark, d):
    return rounded(ev.event_path(windows(spark, d, holed(spark, d)), "y"))


@query("e2_event_path_z", f"""SELECT rel_year, {R('avg((y - my) / sy)')} AS mean_y_z, {R('avg((gdp - mg) / sg)')} AS mean_gdp_z,
  count(*) AS n FROM windows, (SELECT avg(y) AS my, stddev_samp(y) AS sy, avg(gdp) AS mg, stddev_samp(gdp) AS sg
    FROM windows) GROUP BY 1""", ("windows",))
def e2z(spark, d):
    return rounded(ev.event_path_z(windows(spark, d), ["y", "gdp"]))


@query("e3_candidate_events", """SELECT unit, event_year, count(*) FILTER (y IS NOT NULL AND rel_year < 0) AS n_pre,
  count(*) FILTER (y IS NOT NULL AND rel_year > 0) AS n_post FROM holewin GROUP BY 1, 2 HAVING
  count(*) FILTER (y IS NOT NULL AND rel_year < 0) >= 2 AND count(*) FILTER (y IS NOT NULL AND rel_year > 0) >= 2""",
       ("holewin",))
def e3(spark, d):
    return ev.candidate_events(windows(spark, d, holed(spark, d)), "unit", "y", 2)


cte("spellchange", """SELECT a.*, b.polyarchy_change FROM (SELECT unit, event_year, count(*) FILTER (year < event_year) AS n_pre,
  count(*) FILTER (year > event_year) AS n_post, avg(price) FILTER (year < event_year) AS price_pre,
  avg(price) FILTER (year > event_year) AS price_post,
  avg(price) FILTER (year > event_year) - avg(price) FILTER (year < event_year) AS price_change
  FROM ord JOIN trans USING (unit) WHERE abs(year - event_year) BETWEEN 1 AND 3 GROUP BY 1, 2
  HAVING count(*) FILTER (year < event_year) >= 10 AND count(*) FILTER (year > event_year) >= 10) a
  LEFT JOIN (SELECT unit, event_year, avg(polyarchy) FILTER (year > event_year)
    - avg(polyarchy) FILTER (year < event_year) AS polyarchy_change FROM panel JOIN trans USING (unit)
    WHERE abs(year - event_year) BETWEEN 1 AND 3 GROUP BY 1, 2) b ON a.unit = b.unit AND a.event_year = b.event_year""",
    "ord", "trans", "panel")


def spell_changes(spark, d):
    docs = st.order_cells(spark, d).select("unit", "year", "price")
    return ev.spell_changes(docs, transition_events(spark, d), st.panel(spark, d).select("unit", "year", "polyarchy"),
                            "unit", "year", ["price"], "polyarchy")


@query("e4_spell_changes", "SELECT unit, event_year, n_pre, n_post, " + ", ".join(
    f"{R(c, 4)} AS {c}" for c in ("price_pre", "price_post", "price_change", "polyarchy_change"))
    + " FROM spellchange", ("spellchange",))
def e4(spark, d):
    return rounded(spell_changes(spark, d), 4)


def _boundary(source):
    return f"""SELECT unit, event_year, sum(CASE WHEN year > event_year THEN n * y END) / sum(CASE WHEN year > event_year THEN n END)
  - sum(CASE WHEN year < event_year THEN n * y END) / sum(CASE WHEN year < event_year THEN n END) AS change,
  CAST(least(sum(CASE WHEN year < event_year THEN n END), sum(CASE WHEN year > event_year THEN n END)) AS BIGINT) AS n_min
  FROM panel JOIN {source} USING (unit) WHERE abs(year - event_year) BETWEEN 1 AND 3 GROUP BY 1, 2
  HAVING sum(CASE WHEN year < event_year THEN n END) >= 10 AND sum(CASE WHEN year > event_year THEN n END) >= 10"""


cte("bounds", _boundary("trans"), "panel", "trans")
cte("pgrid", """SELECT unit, CAST(y AS INT) AS event_year FROM (SELECT DISTINCT unit FROM bounds),
  (SELECT unnest(generate_series(1996, 2000)) AS y) WHERE (unit, y) NOT IN (SELECT (unit, event_year) FROM trans)""",
    "bounds", "trans")
cte("placebo", _boundary("pgrid"), "panel", "pgrid")


def boundary(spark, d, events):
    cells = st.panel(spark, d).select("unit", "year", "y", "n")
    return ev.boundary_changes(cells, events, "unit", "year", "y", "n")


@query("e5_boundary_changes", f"SELECT unit, event_year, {R('change')} AS change, n_min FROM bounds", ("bounds",))
def e5(spark, d):
    return rounded(boundary(spark, d, transition_events(spark, d)))


def placebo(spark, d):
    real = transition_events(spark, d)
    grid = ev.placebo_boundaries(boundary(spark, d, real), real, "unit", 1996, 2000)
    return boundary(spark, d, grid)


@query("e6_placebo_boundaries", f"SELECT unit, event_year, {R('change')} AS change, n_min FROM placebo", ("placebo",))
def e6(spark, d):
    return rounded(placebo(spark, d))


@query("e7_real_against_placebo", f"""SELECT n_real, n_placebo, {R('ar')} AS abs_real, {R('mr')} AS mean_real, {R('ap')} AS abs_placebo,
  {R('mp')} AS mean_placebo, {R('(ar - ap) / sqrt(a + b)')} AS t,
  {R('(a + b) * (a + b) / (a * a / (n_real - 1) + b * b / (n_placebo - 1))')} AS df FROM (
  SELECT n_real, n_placebo, ar, mr, ap, mp, vr / n_real AS a, vp / n_placebo AS b FROM
  (SELECT count(*) AS n_real, avg(abs(change)) AS ar, avg(change) AS mr, var_samp(abs(change)) AS vr FROM bounds),
  (SELECT count(*) AS n_placebo, avg(abs(change)) AS ap, avg(change) AS mp, var_samp(abs(change)) AS vp FROM placebo))""",
       ("bounds", "placebo"))
def e7(spark, d):
    return rounded(ev.compare_changes(boundary(spark, d, transition_events(spark, d)), placebo(spark, d)))


cte("ends", """SELECT unit, year AS endyear, min(priority) AS note_a, max(segment) AS note_b FROM ord
  GROUP BY unit, year, author % 3""", "ord")


@query("e8_typed_starts", """SELECT t.unit, t.event_year, max(CASE WHEN regexp_matches(lower(note_a || ' ' || note_b),
  'urgent|machinery') THEN 1 ELSE 0 END) AS by_coup FROM trans t JOIN ends e ON t.unit = e.unit
  AND t.event_year = e.endyear + 1 GROUP BY 1, 2""", ("trans", "ends"))
def e8(spark, d):
    ends = st.order_cells(spark, d).groupBy("unit", F.col("year").alias("endyear"), F.expr("author % 3").alias("k")).agg(
        F.min("priority").alias("note_a"), F.max("segment").alias("note_b"))
    return ev.typed_starts(transition_events(spark, d), ends, "unit", ["note_a", "note_b"], "urgent|machinery")


@query("e9_event_regression", f"""SELECT 'polyarchy_change' AS term, {R('b', 4)} AS estimate, n FROM (
  SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS b, count(*) AS n FROM (
    SELECT least(n_pre, n_post) AS w, polyarchy_change AS x, price_change AS y FROM spellchange
    WHERE polyarchy_change IS NOT NULL), (SELECT sum(least(n_pre, n_post) * polyarchy_change) / sum(least(n_pre, n_post)) AS mx,
    sum(least(n_pre, n_post) * price_change) / sum(least(n_pre, n_post)) AS my FROM spellchange
    WHERE polyarchy_change IS NOT NULL))""", ("spellchange",))
def e9(spark, d):
    fit = ev.event_regression(spell_changes(spark, d), "price_change", "polyarchy_change")
    return rounded(fit.select("term", "estimate", "n"), 4)


cte("authorwin", """SELECT o.unit || ' ' || event_year AS model, author, price AS y, CASE WHEN year > event_year THEN 1 ELSE 0 END AS x
  FROM ord o JOIN trans t ON o.unit = t.unit WHERE abs(year - event_year) BETWEEN 1 AND 3""", "ord", "trans")
cte("spanning", """SELECT * FROM authorwin SEMI JOIN (SELECT model, author FROM authorwin GROUP BY 1, 2
  HAVING count(DISTINCT x) = 2) USING (model, author)""", "authorwin")
cte("enough", """SELECT * FROM spanning SEMI JOIN (SELECT model FROM spanning GROUP BY 1
  HAVING count(DISTINCT author) >= 20) USING (model)""", "spanning")


def one_way(source: str, params: int, digits: int = 6) -> str:
    """Closed form of one absorbed effect with clustering on it."""
    return f"""SELECT model, {R('any_value(b)', digits)} AS estimate,
  {R(f'sqrt(sum(s * s) / (any_value(sxx) * any_value(sxx)) * count(*) / (count(*) - 1) * (sum(m) - 1) / (sum(m) - {params}))', digits)} AS se,
  CAST(sum(m) AS BIGINT) AS n FROM (SELECT model, author, any_value(b) AS b, any_value(sxx) AS sxx, count(*) AS m,
    sum(xt * (yt - b * xt)) AS s FROM (SELECT *, sum(xt * yt) OVER (PARTITION BY model) / sum(xt * xt) OVER (PARTITION BY model) AS b,
      sum(xt * xt) OVER (PARTITION BY model) AS sxx FROM (SELECT model, author,
        x - avg(x) OVER (PARTITION BY model, author) AS xt, y - avg(y) OVER (PARTITION BY model, author) AS yt
        FROM {source})) GROUP BY 1, 2) GROUP BY 1"""


@query("e10_same_author_effect", one_way("enough", 2, 3), ("enough",))
def e10(spark, d):
    docs = st.order_cells(spark, d).select("unit", "year", "author", "price")
    fit = ev.same_author_effect(docs, transition_events(spark, d), "unit", "year", "author", "price")
    return rounded(fit.select("model", "estimate", "se", "n"), 3)


# --- F ------------------------------------------------------------------------------------------

def two_way(source: str, vcov: str, effects: str = "both", digits: int = 6) -> str:
    """Closed form of balanced two-way effects with one regressor; `source` has model, unit, year, x, y."""
    parts = "model, unit, year"
    center = {v: f"{v} - avg({v}) OVER (PARTITION BY model, unit) - avg({v}) OVER (PARTITION BY model, year)"
                 f" + avg({v}) OVER (PARTITION BY model)" for v in "xy"}
    base = f"""SELECT *, sum(xt * yt) OVER (PARTITION BY model) / sum(xt * xt) OVER (PARTITION BY model) AS b,
      sum(xt * xt) OVER (PARTITION BY model) AS sxx, count(*) OVER (PARTITION BY model) AS m FROM (SELECT {parts},
      {center['x']} AS xt, {center['y']} AS yt FROM {source})"""
    units, years = "count(DISTINCT unit)", "count(DISTINCT year)"
    if vcov == "hetero":
        v = (f"sum(pow(xt * (yt - b * xt), 2)) / pow(any_value(sxx), 2) * any_value(m)"
             f" / (any_value(m) - (1 + {units} + {years} - 1))")
        return f"""SELECT model, {R('any_value(b)', digits)} AS estimate, {R(f'sqrt({v})', digits)} AS se,
  any_value(m) AS n FROM ({base}) GROUP BY 1"""
    v = "sum(s * s) / pow(any_value(sxx), 2) * count(*) / (count(*) - 1) * (any_value(m) - 1) / (any_value(m) - (1 + max(years)))"
    return f"""SELECT model, {R('any_value(b)', digits)} AS estimate, {R(f'sqrt({v})', digits)} AS se, any_value(m) AS n FROM (
  SELECT model, unit, any_value(b) AS b, any_value(sxx) AS sxx, any_value(m) AS m, count(*) AS years,
    sum(xt * (yt - b * xt)) AS s FROM ({base}) GROUP BY 1, 2) GROUP BY 1"""


SHORT = ("model", "estimate", "se", "n")


def short(fit, digits=6):
    return rounded(fit.select(*SHORT), digits)


@query("f0_least_squares", f"""SELECT 'all' AS model, {R('b')} AS estimate, {R('sqrt((syy - b * sxy) / (n - 2) / sxx)')} AS se, n FROM (
  SELECT regr_slope(y, gdp) AS b, regr_sxx(y, gdp) AS sxx, regr_syy(y, gdp) AS syy, regr_sxy(y, gdp) AS sxy,
  count(*) AS n FROM panel)""", ("panel",))
def f0(spark, d):
    return short(rg.ols(st.panel(spark, d), "y", ["gdp"]))


@query("f1_year_effect_weighted", f"""SELECT 'all' AS model, {R('any_value(b)')} AS estimate,
  {R('sqrt(sum(s * s) / pow(any_value(sxx), 2) * count(*) / (count(*) - 1) * (sum(m) - 1) / (sum(m) - (1 + any_value(ny))))')} AS se,
  CAST(sum(m) AS BIGINT) AS n FROM (SELECT unit, any_value(b) AS b, any_value(sxx) AS sxx, any_value(ny) AS ny, count(*) AS m,
    sum(n * xt * (yt - b * xt)) AS s FROM (SELECT *, sum(n * xt * yt) OVER () / sum(n * xt * xt) OVER () AS b,
      sum(n * xt * xt) OVER () AS sxx, (SELECT count(DISTINCT year) FROM panel) AS ny FROM (SELECT unit, year, n,
        autocracy - sum(n * autocracy) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS xt,
        y - sum(n * y) OVER (PARTITION BY year) / sum(n) OVER (PARTITION BY year) AS yt FROM panel)) GROUP BY 1)""", ("panel",))
def f1(spark, d):
    return short(rg.fixed_effects(st.panel(spark, d), "y", ["autocracy"], None, ["year"], weights="n", cluster="unit"))


cte("author1", "SELECT 'all' AS model, author, CAST(substr(priority, 1, 1) AS INT) AS x, price AS y FROM ord", "ord")


@query("f1_author_effect", one_way("author1", 2, 3), ("author1",))
def f1a(spark, d):
    rows = st.order_cells(spark, d).withColumn("x", F.substring("priority", 1, 1).cast("int"))
    return short(rg.fixed_effects(rows, "price", ["x"], "author", cluster="author"), 3)


@query("f2_author_and_year_effects")
def f2a(spark, d):
    rows = st.order_cells(spark, d).withColumn("x", F.substring("priority", 1, 1).cast("int"))
    return rounded(rg.fixed_effects(rows, "price", ["x"], "author", ["year", "segment"], cluster="unit"))


cte("fe", "SELECT 'all' AS model, unit, year, autocracy AS x, y FROM panel", "panel")


@query("f2_two_way_effects", two_way("fe", "cluster"), ("fe",))
def f2(spark, d):
    return short(rg.fixed_effects(st.panel(spark, d), "y", ["autocracy"], "unit", ["year"], cluster="unit"))


@query("f2_many_level_effects", two_way("fe", "cluster"), ("fe",))
def f2m(spark, d):
    return short(ml.ManyLevelModel(st.panel(spark, d), "y", ["autocracy"], ["unit", "year"], cluster="unit").table())


@query("f3_interaction")
def f3(spark, d):
    return rounded(rg.interaction(st.panel(spark, d), "y", "autocracy", "polyarchy", "unit", ["year"], cluster="unit"))


LAGGED = " UNION ALL ".join(
    f"SELECT '{k}' AS model, unit, year, {'autocracy' if k == 0 else f'lag(autocracy, {k}) OVER (PARTITION BY unit ORDER BY year)'}"
    f" AS x, y FROM panel" for k in (0, 2, 3, 4))
cte("lagged", f"SELECT * FROM ({LAGGED}) WHERE x IS NOT NULL", "panel")


@query("f4_robust_lagged_models", two_way("lagged", "hetero"), ("lagged",))
def f4(spark, d):
    rows = pa.row_lags(st.panel(spark, d), "unit", "year", ["autocracy"], (2, 3, 4))
    return short(rg.lagged_specifications(rows, "y", ["autocracy"], (0, 2, 3, 4), "unit", ["year"], vcov="hetero"))


def splits():
    return {"all": F.lit(True), "early": F.col("year") < 1999, "late": F.col("year") >= 1999,
            "even units": F.col("unit") % 2 == 0, "odd units": F.col("unit") % 2 == 1,
            "without group 0": F.col("unit") % 5 != 0}


cte("splitrows", " UNION ALL ".join(f"SELECT '{n}' AS model, unit, year, autocracy AS x, y FROM panel WHERE {c}" for n, c in {
    "all": "true", "early": "year < 1999", "late": "year >= 1999", "even units": "unit % 2 = 0",
    "odd units": "unit % 2 = 1", "without group 0": "unit % 5 <> 0"}.items()), "panel")


@query("f5_split_battery", two_way("splitrows", "cluster"), ("splitrows",))
def f5(spark, d):
    return short(rg.split_battery(st.panel(spark, d), splits(), "y", ["autocracy"], "unit", ["year"], unit="unit",
                                  min_units=10, cluster="unit", min_rows=30))


@query("f5_many_level_splits", two_way("splitrows", "hetero"), ("splitrows",))
def f5m(spark, d):
    labels = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in splits().items()]))
    rows = st.panel(spark, d).withColumn("split", F.explode(labels))
    return short(ml.ManyLevelModel(rows, "y", ["autocracy"], ["unit", "year"], vcov="hetero", by="split").table())


cte("grid", " UNION ALL ".join(f"SELECT '{y} ~ {x}' AS model, unit, year, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM panel"
                               for y in ("y", "gdp") for x in ("autocracy", "polyarchy", "pop")), "panel")


@query("f6_treatment_grid", two_way("grid", "cluster"), ("grid",))
def f6(spark, d):
    return short(rg.treatment_grid(st.panel(spark, d), ["y", "gdp"], ["autocracy", "polyarchy", "pop"], "unit", ["year"],
                                   cluster="unit"))


cte("scan", " UNION ALL ".join(f"""SELECT '{k}' AS model, p.unit, p.year, l.polyarchy AS x, p.y FROM panel p
  JOIN panel l ON p.unit = l.unit AND p.year = l.year + {k}""" for k in range(6)), "panel")


@query("f7_lag_scan", two_way("scan", "cluster"), ("scan",))
def f7(spark, d):
    p = st.panel(spark, d)
    return short(rg.lag_scan(p.select("unit", "year", "y"), p, ["unit"], "year", "polyarchy", "y", range(6), "unit",
                             ["year"], cluster="unit"))


cte("placeborows", "SELECT 'all' AS model, unit, year, autocracy AS x, pop AS y FROM panel", "panel")


@query("f8_placebo_outcome", two_way("placeborows", "cluster"), ("placeborows",))
def f8(spark, d):
    return short(rg.fixed_effects(st.panel(spark, d), "pop", ["autocracy"], "unit", ["year"], cluster="unit"))


@query("f9_with_and_without_controls")
def f9(spark, d):
    return rounded(rg.with_and_without(st.panel(spark, d), "y", "autocracy", ["gdp", "polyarchy", "pop"], "unit", ["year"],
                                       cluster="unit"))


@query("f10_not_estimable", """SELECT 'fixed' AS term, CAST(NULL AS DOUBLE) AS estimate, count(*) AS n FROM panel
  UNION ALL SELECT 'year', CAST(NULL AS DOUBLE), count(*) FROM panel""", ("panel",))
def f10(spark, d):
    rows = st.panel(spark, d).withColumn("fixed", F.col("unit") % 3)
    return rg.fixed_effects(rows, "y", ["fixed", "year"], "unit", ["year"]).select("term", "estimate", "n")


@query("f11_effect_in_sd", f"""SELECT model, {R('estimate / (SELECT stddev_samp(y) FROM panel)', 4)} AS effect_sd FROM
  ({two_way('fe', 'cluster', digits=12)})""", ("fe", "panel"))
def f11(spark, d):
    fit = rg.fixed_effects(st.panel(spark, d), "y", ["autocracy"], "unit", ["year"], cluster="unit")
    return rounded(rg.with_markers(fit).select("model", "effect_sd"), 4)


@query("d8_standardised_coefficients", f"""SELECT 'gdp' AS term, {R('(r1 - r12 * r2) / (1 - r12 * r12)')} AS standardised FROM c
  UNION ALL SELECT 'pop', {R('(r2 - r12 * r1) / (1 - r12 * r12)')} FROM c""".replace("FROM c", """FROM (SELECT corr(y, gdp) AS r1,
  corr(y, pop) AS r2, corr(gdp, pop) AS r12 FROM panel)"""), ("panel",))
def d8(spark, d):
    return rounded(rg.standardised_coefficients(st.panel(spark, d), "y", ["gdp", "pop"], top=12).select("term", "standardised"))


# --- G ------------------------------------------------------------------------------------------

cte("tcohort", """SELECT p.unit, p.year, coalesce(c, 0) AS cohort FROM panel p LEFT JOIN
  (SELECT unit, min(event_year) AS c FROM trans GROUP BY 1) x ON p.unit = x.unit""", "panel", "trans")


@query("g2_cohorts", "SELECT unit, year, cohort FROM tcohort", ("tcohort",))
def g2(spark, d):
    return did.cohorts(st.panel(spark, d), "unit", "year", "autocracy").select("unit", "year", "cohort")


@query("g2_reversals", """SELECT unit, CAST(sum(CASE WHEN before = 1 AND autocracy = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_reversals
  FROM (SELECT *, lag(autocracy) OVER (PARTITION BY unit ORDER BY year) AS before FROM panel) GROUP BY 1""", ("panel",))
def g2r(spark, d):
    return did.reversals(st.panel(spark, d), "unit", "year", "autocracy")


@query("g1_event_study")
def g1(spark, d):
    return rounded(did.event_study(staggered(spark, d), "y", "unit", "year", x=["gdp"]))


cte("gt", """SELECT g.cohort AS g, t.year AS t, CASE WHEN t.year >= g.cohort THEN g.cohort - 1 ELSE t.year - 1 END AS base
  FROM (SELECT DISTINCT cohort FROM staggered WHERE cohort > 0) g, (SELECT DISTINCT year FROM panel WHERE year > 1995) t""",
    "staggered", "panel")
cte("attgt", """SELECT g, t, base, avg(y) FILTER (cohort = g AND year = t) - avg(y) FILTER (cohort = g AND year = base)
  - avg(y) FILTER (c AND year = t) + avg(y) FILTER (c AND year = base) AS att FROM
  (SELECT gt.*, s.y, s.year, s.cohort, s.cohort <> g AND (s.cohort = 0 OR s.cohort > greatest(t, base)) AS c
   FROM gt, staggered s WHERE s.year IN (t, base)) GROUP BY g, t, base""", "gt", "staggered")


def group_time(spark, d):
    return did.GroupTime(staggered(spark, d), "y", "unit", "year")


@query("g3_group_time_effects", f"SELECT g AS cohort, t AS time, base, {R('att')} AS att FROM attgt", ("attgt",))
def g3(spark, d):
    return rounded(group_time(spark, d).table(errors=False).drop("se"))


cte("csize", "SELECT cohort, count(DISTINCT unit) AS k FROM staggered GROUP BY 1", "staggered")


@query("g3_dynamic_effects", f"""SELECT CAST(t - g AS INT) AS rel_year, {R('sum(k * att) / sum(k)')} AS estimate FROM attgt
  JOIN csize ON g = cohort WHERE t - g BETWEEN -5 AND 5 GROUP BY 1""", ("attgt", "csize"))
def g3d(spark, d):
    return rounded(group_time(spark, d).dynamic(errors=False).select("rel_year", "estimate"))


@query("g4_sun_abraham_path")
def g4(spark, d):
    return rounded(did.sun_abraham(staggered(spark, d), "y", "unit", "year")[0])


@query("g5_imputation_path")
def g5(spark, d):
    return rounded(did.imputation(staggered(spark, d), "y", "unit", "year", draws=20))


@query("g6_comparison")
def g6(spark, d):
    p = staggered(spark, d).persist()
    twfe = rg.FixedEffectsModel(p, "y", ["d"], "unit", ["year"], vcov="hetero").records()[0]
    rows = [("TWFE (contemporaneous)", twfe["estimate"], twfe["se"]),
            ("Sun & Abraham", *did.sun_abraham(p, "y", "unit", "year")[1]),
            ("Callaway & Sant'Anna", *did.GroupTime(p, "y", "unit", "year").simple())]
    bjs = did.mean_of_horizons(did.imputation(p, "y", "unit", "year", pretrends=()), "Borusyak et al.")
    return rounded(did.comparison(rows, spark).unionByName(bjs))


@query("g6_simple_effect", f"""SELECT {R('sum(k * att) / sum(k)')} AS att FROM attgt JOIN csize ON g = cohort WHERE t >= g""",
       ("attgt", "csize"))
def g6s(spark, d):
    att, _ = group_time(spark, d).simple(errors=False)
    return rounded(spark.range(1).select(F.lit(att).alias("att")))


@query("g7_stacked_paths")
def g7(spark, d):
    p = staggered(spark, d)
    return rounded(did.stacked_paths(did.event_study(p, "y", "unit", "year"), group_time(spark, d).dynamic(),
                                     did.sun_abraham(p, "y", "unit", "year")[0]))


cte("mrow", """SELECT p.unit, p.year, p.autocracy, h.autocracy AS hist, h.gdp / sqrt(v.s) AS q, p.y - h.y AS d0, f.y - h.y AS d1,
  f.autocracy AS nxt FROM panel p JOIN panel h ON p.unit = h.unit AND p.year = h.year + 1
  JOIN (SELECT year, var_samp(gdp) AS s FROM panel GROUP BY 1) v ON h.year = v.year
  LEFT JOIN panel f ON p.unit = f.unit AND p.year = f.year - 1""", "panel")
cte("mset", """SELECT * FROM (SELECT t.unit AS tu, t.year, t.d0 AS t0, t.d1 AS t1, c.unit AS cu, c.d0 AS c0, c.d1 AS c1,
  abs(t.q - c.q) AS distance, row_number() OVER (PARTITION BY t.unit, t.year ORDER BY abs(t.q - c.q), c.unit) AS pick FROM mrow t
  JOIN mrow c ON t.year = c.year AND c.hist = t.hist AND c.autocracy = 0
  WHERE t.autocracy = 1 AND t.hist = 0 AND coalesce(t.nxt, 1) = 1) WHERE pick <= 5""", "mrow")


def _att(i):
    return (f"SELECT {i} AS lead, {R('avg(e)')} AS att, count(*) AS n_treated FROM (SELECT tu, year, any_value(t{i}) - avg(c{i}) AS e "
            f"FROM mset WHERE t{i} IS NOT NULL AND c{i} IS NOT NULL GROUP BY 1, 2)")


@query("g8_panel_match", f"{_att(0)} UNION ALL {_att(1)}", ("mset",))
def g8(spark, d):
    return rounded(ma.panel_match(st.panel(spark, d), "unit", "year", "autocracy", "y", ["gdp"], lag=1, leads=[0, 1]))


@query("g8_panel_match_intervals")
def g8i(spark, d):
    return rounded(ma.panel_match(staggered(spark, d), "unit", "year", "d", "y", ["gdp", "polyarchy"], lag=2,
                                  leads=[-2, 0, 1], draws=200))


@query("g9_consecutive_units", """SELECT author, count(*) AS n FROM (SELECT DISTINCT author, year FROM ord) GROUP BY 1
  HAVING count(*) = max(year) - min(year) + 1""", ("ord",))
def g9(spark, d):
    years = st.order_cells(spark, d).select("author", "year").distinct()
    return pa.consecutive_units(years, "author", "year").groupBy("author").agg(F.count(F.lit(1)).alias("n"))


# --- H ------------------------------------------------------------------------------------------

cte("hole", """SELECT unit, year, CASE WHEN unit % 7 = 3 AND year = 1996 OR unit = 10 AND year = 1997 THEN NULL ELSE y END AS y, d
  FROM staggered""", "staggered")
cte("cases", """SELECT unit AS treated, min(year) AS first_year, min(year) FILTER (d = 1) AS treat_year FROM hole
  GROUP BY 1 HAVING max(d) = 1""", "hole")
cte("pool", "SELECT unit FROM hole GROUP BY 1 HAVING max(d) = 0", "hole")
cte("pre", """SELECT first_year, treat_year, h.unit, 'treated' AS role, y FROM cases c JOIN hole h ON h.unit = c.treated
  AND year >= first_year AND year < treat_year UNION ALL SELECT first_year, treat_year, unit, 'donor', y FROM
  (SELECT DISTINCT first_year, treat_year FROM cases) JOIN (SELECT * FROM hole SEMI JOIN pool USING (unit)) h
  ON year >= first_year AND year < treat_year""", "cases", "hole", "pool")
cte("coverage", """SELECT first_year, treat_year, unit, role, treat_year - first_year AS n_pre, count(y) AS n_observed
  FROM pre GROUP BY 1, 2, 3, 4 HAVING count(y) > 0""", "pre")
cte("eligible", "SELECT * FROM coverage WHERE n_pre - n_observed <= CASE WHEN role = 'treated' THEN 2 ELSE 0 END", "coverage")


def holes(spark, d):
    gone = ((F.col("unit") % 7 == 3) & (F.col("year") == 1996)) | ((F.col("unit") == 10) & (F.col("year") == 1997))
    return staggered(spark, d).select("unit", "year", F.when(~gone, F.col("y")).alias("y"), "d")


@query("h1_donor_pool", "SELECT * FROM pool", ("pool",))
def h1(spark, d):
    return sy.donor_pool(holes(spark, d), "unit", "d")


@query("h2_balanced_panel", f"""SELECT u.unit, CAST(t.year AS INT) AS year, {R('g.y')} AS y FROM (SELECT DISTINCT unit FROM gappy) u,
  (SELECT unnest(generate_series((SELECT min(year) FROM gappy), (SELECT max(year) FROM gappy))) AS year) t
  LEFT JOIN gappy g ON u.unit = g.unit AND t.year = g.year""", ("gappy",))
def h2(spark, d):
    return rounded(sy.balanced_panel(gappy(spark, d), "unit", "year").select("unit", "year", "y"))


def coverage(spark, d):
    return sy.pre_period_coverage(holes(spark, d), "unit", "year", "d", "y")


@query("h3_eligible_units", "SELECT * FROM eligible", ("eligible",))
def h3(spark, d):
    return sy.eligible(coverage(spark, d))


@query("h4_pre_period_means", f"""SELECT p.first_year, p.treat_year, p.unit, p.role, {R('avg(y)')} AS pre_mean
  FROM pre p SEMI JOIN eligible e USING (first_year, treat_year, unit, role) GROUP BY 1, 2, 3, 4""", ("eligible", "pre"))
def h4(spark, d):
    return rounded(sy.pre_means(holes(spark, d), sy.eligible(coverage(spark, d)), "unit", "year", "d", "y"))


def weights(spark, d):
    return sy.synthetic_weights(holes(spark, d), "unit", "year", "d", "y")


@query("h5_synthetic_weights")
def h5(spark, d):
    return rounded(weights(spark, d))


@query("h5_synthetic_paths")
def h5p(spark, d):
    return rounded(sy.synthetic_paths(holes(spark, d), weights(spark, d), "unit", "year", "y"))


@query("h6_weights_report")
def h6r(spark, d):
    return rounded(sy.weights_report(weights(spark, d)))


@query("h6_weights_and_window")
def h6(spark, d):
    """The path comes from all weights; only the printed list leaves small ones out."""
    paths = sy.synthetic_paths(holes(spark, d), weights(spark, d), "unit", "year", "y")
    return rounded(sy.report_window(paths, "year"))
