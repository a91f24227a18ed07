"""Readers, writers, staging, scalar functions and exact quantiles."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancepanel.functions import scalars as sc
from stancepanel.functions.numbering import number_rows
from stancepanel.functions.scalars import random_half
from stancepanel.operators import panel as pa
from stancepanel.operators import summary as su
from stancepanel.plans import fixture_parse
from stancepanel.sources import tables
from stancepanel.sources.lexicon import clashing_codes, map_codes, read_lexicon


@pytest.fixture
def tokens(spark, tmp_path):
    rows = [(f"d{i}", 2000, "abstract" if i % 2 else "title", 1, 1, 0, "A", "a", "NOUN", "root", None) for i in range(10)]
    df = spark.createDataFrame(rows, tables.TOKEN_SCHEMA)
    for part in range(3):
        tables.save(df.withColumn("year", F.lit(2000 + part)), f"{tmp_path}/part-0000{part}.parquet")
    return str(tmp_path)


def test_token_scan_pushes_the_filter(spark, tokens):
    df = tables.read_tokens(spark, f"{tokens}/part-0000[0-1]*", columns=["ut", "year"])
    assert df.count() == 10 and set(r["year"] for r in df.collect()) == {2000, 2001}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(field), EqualTo(field,abstract)]" in plan
    assert "lemma" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="nope"):
        tables.read_tokens(spark, tokens + "/*", columns=["nope"])


def test_csv_round_trip_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"T{i % 3}") for i in range(20)], "n int, term string")
    path = f"{tmp_path}/out"
    tables.save_csv(df, path, [F.desc("n")], single_file=True)
    back = tables.read_csv(spark, path, "n int, term string", ["n"]).collect()
    assert [r["n"] for r in back] == list(range(19, -1, -1))
    lex = read_lexicon(spark, path, "n int, term string", dedupe=True)
    assert sorted(r["term"] for r in lex.collect()) == ["t0", "t1", "t2"]


def test_staging_reuses_a_finished_table(spark, tmp_path):
    folder = str(tmp_path)
    a = tables.stage(spark.range(3).toDF("x"), "t", folder, reuse=True)
    b = tables.stage(spark.range(9).toDF("x"), "t", folder, reuse=True)
    assert a.count() == b.count() == 3
    assert tables.stage(spark.range(9).toDF("x"), "t", folder).count() == 9


def test_staging_again_after_a_changed_input(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/staged"

    def staged(version=""):
        table = spark.read.schema("id long").parquet(source)
        return tables.stage(table.groupBy().agg(F.sum("id").alias("s")), "sums", folder, reuse=True, version=version)

    tables.save(spark.range(5), source)
    first = staged()
    marker = Path(first.inputFiles()[0].removeprefix("file://")).parent / "_SUCCESS"
    written = marker.stat().st_mtime_ns
    assert staged().first()["s"] == 10 and marker.stat().st_mtime_ns == written
    tables.save(spark.range(6), source, mode="overwrite")
    assert staged().first()["s"] == 15 and first.first()["s"] == 10
    assert len(list(Path(folder).iterdir())) == 2
    staged(version="2")
    assert len(list(Path(folder).iterdir())) == 3


def test_an_unfinished_stage_is_written_again(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/staged"
    tables.save(spark.range(5), source)
    table = spark.read.parquet(source)
    made = tables.stage(table, "t", folder, reuse=True)
    (Path(made.inputFiles()[0].removeprefix("file://")).parent / "_SUCCESS").unlink()
    assert tables.stage(table, "t", folder, reuse=True).count() == 5
    assert len(list(Path(folder).glob("*/_SUCCESS"))) == 1


def test_staging_needs_a_shared_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.stage(spark.range(1), "t")


def test_scalars(spark):
    df = spark.createDataFrame([("The Usa ", 0, 1.0), ("peoples r china", 5, -1.0), (None, 20, None)],
                               "name string, n int, x double")
    r = df.select(sc.country_key("name"), sc.guarded_rate("n", F.lit(10), 10), sc.natural_log("x"), sc.below("n", 5),
                  sc.per_thousand("n", F.lit(0)), sc.strip_article("name")).collect()
    assert [x[0] for x in r] == ["THE USA", "CHINA", None]
    assert r[2][1] == 2.0 and [x[2] for x in r] == [0.0, None, None]
    assert [x[3] for x in r] == [1, 0, 0] and r[0][4] is None and r[0][5] == "Usa"
    stars = spark.createDataFrame([(0.001,), (0.02,), (0.07,), (0.5,), (None,)], "p double")
    assert [x[0] for x in stars.select(sc.significance_stars("p")).collect()] == ["**", "*", ".", "", None]


def test_crosswalk_report(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "k string")
    walk = spark.createDataFrame([("a", "A")], "k string, code string")
    mapped, unmapped = map_codes(df, walk, "k", "code")
    assert [tuple(r) for r in mapped.collect()] == [("a", "A")] and [r["k"] for r in unmapped.collect()] == ["b"]


def test_clashing_codes_are_reported(spark):
    rows = [("a", "1"), ("a", "1"), ("b", "2"), ("b", "0"), ("c", None), ("c", "5"), (None, "1"), (None, "2")]
    crosswalk = spark.createDataFrame(rows, "name string, code string")
    assert [tuple(r) for r in clashing_codes(crosswalk, "name", "code").collect()] == [("b", 2, "0", "2")]


def test_lags_with_a_gap(spark):
    df = spark.createDataFrame([(1, 2000, 1), (1, 2001, 2), (1, 2003, 3), (1, 2004, 4)], "u int, t int, v int")
    rows = pa.row_lags(df, "u", "t", ["v"], [1]).orderBy("t").collect()
    assert [r["v_lag1"] for r in rows] == [None, 1, 2, 3]
    rows = pa.row_lags(df, "u", "t", ["v"], [1, 2], gap_safe=True).orderBy("t").collect()
    assert [(r["v_lag1"], r["v_lag2"]) for r in rows] == [(None, None), (1, None), (None, 2), (3, None)]


def test_missing_treatment_breaks_a_transition(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, None), (1, 3, 1), (2, 1, 0), (2, 2, 1), (2, 3, 0), (2, 4, 1)],
                               "u int, t int, d int")
    got = pa.transitions(df, "u", "t", "d").where("transition = 1").orderBy("u", "t").collect()
    assert [(r["u"], r["t"]) for r in got] == [(2, 2), (2, 4)]


def test_risk_set_skips_late_starters(spark):
    p = spark.createDataFrame([(1, 10, 2017, "A", 0), (2, 10, 2018, "A", 1), (3, 11, 2014, "B", 0), (4, 11, 2018, "C", 1),
                               (5, 12, 2010, "D", 1), (6, 12, 2011, "D", 0)],
                              "ut int, daisng_id int, year int, iso3 string, flag int")
    got = sorted(tuple(r) for r in pa.risk_set(p, 2016, {"w": "flag"}).collect())
    assert got == [(11, 2014, "B", 0, 0, 0), (11, 2015, "B", 0, 1, 0), (11, 2016, "B", 0, 2, 0),
                   (12, 2010, "D", 0, 0, 1), (12, 2011, "D", 1, 1, 1)]


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "constant"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(0)
    v = {"normal": rng.normal(size=5001), "ties": rng.integers(0, 4, 5000).astype(float),
         "heavy": np.exp(rng.normal(size=4000) * 20), "constant": np.full(100, 2.5)}[kind]
    df = spark.createDataFrame([(int(i % 3), float(x)) for i, x in enumerate(v)], "g int, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in su.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.77, 1.0], "g").collect()}
    for (g, p), q in got.items():
        assert np.isclose(q, np.quantile(v[int(g)::3], p), rtol=1e-12)


def test_registry_is_consistent():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quantiles_of_any_values_end(spark):
    inf = float("inf")
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", inf), ("b", -1.7e308), ("b", 1.7e308), ("b", 0.0), (None, 5.0),
            ("NULL", 6.0), ("c", -0.0), ("c", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in su.exact_quantiles(df, "v", [0.5, 1.0], "g").collect()}
    assert got == {("a", 0.5): 2.5, ("a", 1.0): inf, ("b", 0.5): 0.0, ("b", 1.0): 1.7e308, (None, 0.5): 5.0,
                   (None, 1.0): 5.0, ("NULL", 0.5): 6.0, ("NULL", 1.0): 6.0, ("c", 0.5): 0.0, ("c", 1.0): 0.0}


def test_every_document_with_a_token_is_parsed(spark):
    sf = "/root/testdata/sf0.001"
    tokens = fixture_parse.all_tokens(spark, sf).select("ut").distinct()
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("ut"))
    assert tokens.exceptAll(docs).count() == docs.exceptAll(tokens).count() == 0


def test_parse_follows_the_rules(spark):
    """The short forms that Spark runs against UPOS, HEAD, DEPREL and FEATS, on every closed word, sign and ending."""
    words = " ".join(w for _, w in fixture_parse.CLOSED).split() + (
        "The THAT ly Rely able bled ED 7 70 \u0663 \u00aa \u00b5 \u20ac { ~ ^ a z \u00e9 I \u0130stanbul \u4e2d \u4e2d\u6587").split()
    words += [c * k for c in "xyb" for k in range(1, 12)] + [chr(c) for c in range(33, 127)]
    rows = [(u, s, t, w) for u, s in ((2, 1), (3, 0)) for t in range(1, 34, 3) for w in words]
    df = spark.createDataFrame(rows, "ut long, sent_id int, tok_id int, text string")
    by_rule = df.withColumn("w", F.lower("text")).withColumn("n", F.length("w")).withColumn("upos", F.expr(fixture_parse.UPOS))
    names = ("year", "field", "head", "upos", "deprel", "feats")
    want = by_rule.select("ut", "sent_id", "tok_id", "text", *[F.expr(getattr(fixture_parse, c.upper())).alias(c)
                                                               if c != "upos" else F.col(c) for c in names])
    got = fixture_parse.parsed(df).select(want.columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == len(rows)


def test_rows_are_numbered_in_order(spark):
    rows = [(k, f"x{k}") for k in random.Random(3).sample(range(5000), 5000)] + [(None, "none")]
    got = number_rows(spark.createDataFrame(rows, "k int, v string"), "k", "n").orderBy("n").collect()
    assert [(r["k"], r["v"], r["n"]) for r in got] == [(None, "none", 1)] + [(k, f"x{k}", k + 2) for k in range(5000)]
    assert number_rows(spark.createDataFrame([], "k int"), "k", "n").count() == 0


@pytest.mark.parametrize("groups", [0, 1, 2, 7])
def test_random_half_rounds_down(spark, groups):
    df = spark.createDataFrame([(str(g),) for g in range(groups)] * 3 + [(None,)], "g string")
    got = {r["g"] for r in random_half(df, "g", "s").collect()}
    order = sorted((hashlib.md5(f"s{g}".encode()).hexdigest(), str(g)) for g in range(groups))
    assert got == {g for _, g in order[:groups // 2]}


def test_quantiles_of_many_groups_and_of_one_frequent_value(spark):
    """Thousands of groups in one pass; a value that half of the rows share is one row of the ranking."""
    rng = np.random.default_rng(3)
    g, v = rng.integers(0, 5000, 60_000), rng.normal(size=60_000).round(2)
    g[:30_000], v[:30_000] = 7, 1.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    got = {(int(r["g"]), r["prob"]): r["quantile"] for r in su.exact_quantiles(df, "v", [0.25, 0.9], "g").collect()}
    for group in [7, *rng.choice(np.unique(g), 200)]:
        for p in (0.25, 0.9):
            assert np.isclose(got[int(group), p], np.quantile(v[g == group], p), rtol=1e-12)
    assert len(got) == 2 * len(np.unique(g))
    assert su.ranked_values(df, "v", "g").where("name = '7' and v = 1.5").count() == 1


def test_weighted_spread_survives_a_large_offset(spark):
    rows = [("a", 1e9 + v, w) for v, w in ((0.0, 1.0), (1.0, 2.0), (2.0, 3.0))] + [(None, 5.0, 1.0), (None, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: (r["n"], r["mean"], r["sd"]) for r in su.weighted_moments(df, "v", "w", ["g"]).collect()}
    v, w = np.array([0.0, 1.0, 2.0]), np.array([1.0, 2.0, 3.0])
    mean = (v * w).sum() / w.sum()
    assert got["a"][0] == 3 and np.isclose(got["a"][2], np.sqrt((w * (v - mean) ** 2).sum() / (w.sum() - 1)), rtol=1e-6)
    assert got[None] == (2, 6.0, np.sqrt(2.0))
    (r,) = su.weighted_moments(df.where("g is null"), "v", "w").collect()
    assert (r["n"], r["mean"], r["sd"]) == (2, 6.0, np.sqrt(2.0))
