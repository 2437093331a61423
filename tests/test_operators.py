"""Small fixtures for what the driver's tables don't hold: nulls, NaN, bad dates, ties, streams, runs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqspark.functions import expr
from dqspark.functions.expr import Contract
from dqspark.operators import anomaly, cleaning, contract, drift, features, profile, rules
from dqspark.plans import pipeline
from dqspark.sources import tables
from dqspark.streaming import rules as stream_rules

SCHEMA = "row_id long, InvoiceNo string, StockCode string, Description string, Quantity double, InvoiceDate timestamp_ntz, UnitPrice double, CustomerID long, Country string"
DAY = dt.datetime(2010, 5, 1, 9, 30)


def lines(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


PERFECT = [("489434", "79323P", "PINK CHERRY LIGHTS", 12.0, DAY, 6.75, 13085, "United Kingdom"), ("C489449", "22087", "PAPER BUNTING", -2.0, DAY, 2.95, 16321, "Australia"), ("489435", "22195", "LARGE HEART", 24.0, DAY, 1.65, None, "France")]


def test_quality_of_perfect_rows_is_100(spark):
    assert features.quality(lines(spark, *PERFECT)).head().total == 100.0


def test_quality_refuses_no_rows(spark):
    with pytest.raises(ValueError):
        features.quality(lines(spark, *PERFECT).limit(0))


def test_normalise_and_impute(spark):
    df = lines(spark, ("489434", " 72349b ", "  white  cherry   lights ", 1.0, DAY, 1.0, None, "EIRE"), ("489435", "72349B", None, 1.0, DAY, 1.0, None, "U.S.A."), ("489436", "ZZZ", None, None, DAY, 3.0, None, "o'neil st-james"))
    out = {r.row_id: r for r in cleaning.impute(cleaning.normalise(df)).collect()}
    assert (out[0].StockCode, out[0].Description, out[0].Country) == ("72349B", "WHITE CHERRY LIGHTS", "Ireland")
    assert (out[1].Description, out[1].description_source, out[1].Country) == ("WHITE CHERRY LIGHTS", "lookup", "United States")
    assert (out[2].description_source, out[2].Quantity, out[2].Country) == ("mode", 1.0, "O'Neil St-James")


def test_nulls_and_nan_in_rules(spark):
    df = lines(spark, (None, None, " \t", float("nan"), None, None, None, None))
    hit = {r.rule_id for r in rules.violations(df).collect()}
    assert hit == {"invoiceno_format", "stockcode_format", "description_missing_or_blank", "invoicedate_out_of_window"}


def test_exact_dedup_keeps_first_and_equates_nulls(spark):
    row = ("489434", "A1", None, 1.0, DAY, 1.0, None, "France")
    assert [r.row_id for r in cleaning.exact_dedup(lines(spark, row, row, PERFECT[0])).orderBy("row_id").collect()] == [0, 2]


def test_near_duplicates(spark):
    df = lines(spark, ("1", "A", "RED SPONGE CAKE", 1.0, DAY, 1.0, None, "France"), ("2", "A", "RED SPUNGE CAKE", 1.0, DAY, 1.0, None, "France"), ("3", "B", "BLUE LAMP", 1.0, DAY, 1.0, None, "France"))
    groups = cleaning.near_groups(df).collect()
    assert len(groups) == 1 and groups[0].descriptions == ["RED SPONGE CAKE", "RED SPUNGE CAKE"] and groups[0].n_rows == 2


def test_scaling_and_skew_of_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = features.scale(df, ["a", "b"]).agg(F.var_pop("a_scaled").alias("v"), F.sum("b_scaled").alias("s")).head()
    assert abs(got.v - 1) < 1e-9 and got.s == 0
    assert df.agg(expr.adjusted_skew("b").alias("x"), expr.correlation("a", "b").alias("r")).head() == (0.0, 0.0)


def test_knn_fills_from_equal_prices(spark):
    df = spark.createDataFrame([(0, 4.0, 1.0), (1, 8.0, 2.0), (2, None, 1.0), (3, 8.0, None)], "row_id long, Quantity double, UnitPrice double")
    out = {r.row_id: r for r in anomaly.knn_impute(df, k=2).collect()}
    assert out[2].Quantity == 4.0 and out[3].UnitPrice == 2.0


def test_isolation_forest_finds_extremes(spark):
    df = spark.createDataFrame([(i, float(1 + i % 12), float(1 + i % 10)) for i in range(300)] + [(1000, 50000.0, 5.0), (1001, 5.0, 40000.0)], "row_id long, Quantity double, UnitPrice double")
    top = anomaly.isolation_forest(df, ["Quantity", "UnitPrice"], trees=50).orderBy(F.desc("score")).limit(2).collect()
    assert {(r.Quantity, r.UnitPrice) for r in top} == {(50000.0, 5.0), (5.0, 40000.0)}
    with pytest.raises(ValueError):
        anomaly.points(df, ["nothing"])


def test_drift_from_zero_is_infinite_and_left_out(spark):
    df = lines(spark, *[("1", "A", "X", 1.0, dt.datetime(2009, 1, 2), 1.0, 13000, "France"), ("2", "A", "X", -1.0, dt.datetime(2010, 1, 2), 1.0, 13000, "France")])
    shares = {r.metric: r for r in drift.shares(df, (2009, 2010)).collect()}
    assert shares["return"].band == "alert" and shares["return"].rel_change == float("inf")
    assert drift.verdict(df, (2009, 2010)).head().max_rel_change < float("inf")


def test_contract_inference():
    got = contract.infer({"Quantity": {"q1": 1, "q3": 8, "low": -10000, "high": 10000}, "UnitPrice": {"q1": 1.65, "q3": 4.95, "low": 0, "high": 20000}, "InvoiceDate": {"min": "2009-12-01", "max": "2011-06-01"}})
    assert got["Quantity"]["typical"] == (-9.5, 18.5) and got["Quantity"]["plausible"] == (-20, 29) and got["UnitPrice"]["typical"][0] == 0
    assert got["InvoiceDate"]["window"] == ("2009-01-01 00:00:00", "2011-12-31 23:59:59")


def test_all_ones_are_boolean_and_dates_in_text(spark):
    df = spark.createDataFrame([("1", "2010-01-02", "12", "1.5"), ("1", "2010-01-03", "13", "2")], "a string, b string, c string, d string")
    assert {r.column: r.dtype for r in profile.infer_dtype(df).collect()} == {"a": "boolean", "b": "date", "c": "int", "d": "float"}


def test_sources(spark, tmp_path):
    spark.createDataFrame([("489434", "A1", "3", "2010-01-02 00:00:00", "x")], "Invoice string, StockCode string, Quantity string, InvoiceDate string, Price string").write.csv(str(tmp_path / "a.csv"), header=True)
    got = tables.load(spark, str(tmp_path / "a.csv")).head()
    assert got.InvoiceNo == "489434" and got.Quantity == 3.0 and got.UnitPrice is None and got.row_id == 0
    with pytest.raises(ValueError):
        tables.load(spark, "x.xlsx")
    ids = tables.with_row_id(spark.range(100).repartition(3)).select("row_id").collect()
    assert sorted(r.row_id for r in ids) == list(range(100))


def test_config_says_all_that_is_wrong():
    with pytest.raises(ValueError, match="fuzzy.*contamination"):
        pipeline.validate_config({k: dict(v) for k, v in pipeline.DEFAULTS.items()} | {"paths": {"input": "a", "output": "b"}, "cleaning": {"fuzzy_threshold": 2}, "validation": {"contamination": True}})


def test_pipeline_end_to_end(spark, tmp_path):
    df = lines(spark, *PERFECT * 20).drop("row_id")
    df.write.parquet(str(tmp_path / "in.parquet"))
    config = {k: dict(v) for k, v in pipeline.DEFAULTS.items()} | {"paths": {"input": str(tmp_path / "in.parquet"), "output": str(tmp_path / "out")}}
    assert pipeline.run(spark, config, dry=True) == {"dry_run": True}
    summary = pipeline.run(spark, config)
    assert {k: v["status"] for k, v in summary.items()} == {"profiling": "ok", "cleaning": "ok", "validation": "ok"}
    report = tables.load_json(str(tmp_path / "out" / "validation_report.json"))
    assert report["severity"]["n_rows"] == 3 and report["health"]["grade"] in ("Healthy", "Watch", "Review")
    with pytest.raises(FileNotFoundError):
        pipeline.run(spark, config | {"paths": {"input": str(tmp_path / "none.csv"), "output": "x"}})


def test_rules_on_a_stream(spark, tmp_path):
    lines(spark, *PERFECT).write.parquet(str(tmp_path / "s"))
    flagged = stream_rules.flag(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "s")), Contract())
    run = flagged.writeStream.format("memory").queryName("flagged").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("flagged").count() == 3 and "unitprice_negative" in flagged.columns


def test_nearest_neighbours_with_ties_match_a_stable_sort():
    rng = np.random.default_rng(3)
    ref, x = rng.integers(0, 6, (80, 2)).astype(float), rng.integers(0, 6, (30, 2)).astype(float)
    d = ((x[:, None, :] - ref[None, :, :]) ** 2).sum(axis=2)
    d[(x[:, None, :] == ref[None, :, :]).all(axis=2)] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :7]
    got_d, got = anomaly.neighbours(x, ref, 7)
    assert (got == want).all() and (got_d == np.take_along_axis(d, want, axis=1)).all()


def test_health_weighs_distinct_rows():
    got = features.health(200, 20, 10, 2, 0.25)
    assert got["score"] == round(0.4 * 90 + 0.25 * 99 + 0.2 * 95 + 0.15 * 50, 2) and got["grade"] == "Watch"
    assert features.health(10, 0, 0, 0, None)["grade"] == "Healthy"
    with pytest.raises(ValueError):
        features.health(0, 0, 0, 0, None)


def test_evaluation_ranks_injected_rows_high(spark):
    rows = spark.range(400).selectExpr("id as row_id", "cast(id % 17 + 1 as double) as Quantity", "cast(id % 13 + 1 as double) as UnitPrice")
    got = {r.model: r for r in anomaly.evaluate(rows, ["Quantity", "UnitPrice"], trees=50).collect()}
    assert set(got) == {"isolation_forest", "lof", "either", "both"}
    assert all(r.tp + r.fn == 100 and r.fp + r.tn == 400 for r in got.values())
    assert got["isolation_forest"].auc > 0.9 and got["isolation_forest"].precision_at_k > 0.7
    assert got["either"].tp >= got["both"].tp
    one = anomaly.severity(rows, ["Quantity", "UnitPrice"], trees=50).first()
    assert one.n_rows == 400 and one.n_both <= min(one.n_if, one.n_lof)


def test_lof_where_leaves_have_no_guests(spark, monkeypatch):
    monkeypatch.setattr(anomaly, "LEAF", 40)  # a leaf for each cluster
    rng = np.random.default_rng(1)
    x = np.concatenate([np.stack(np.divmod(rng.permutation(81)[:n], 9), 1) + c for n, c in ((40, [0, 0]), (40, [9_000, 0]), (40, [0, 70_000]), (40, [8_000, 50_000]))]).astype(float)
    x = x[np.lexsort(x.T[::-1])]
    got = {(r.a, r.b): r.lof for r in anomaly.lof(spark.createDataFrame(x.tolist(), "a double, b double"), ["a", "b"], k=5).collect()}
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    own = np.take_along_axis(d, near, axis=1)
    density = 1 / np.maximum(1e-10, np.maximum(own, own[:, -1][near]).mean(axis=1))
    assert len(got) == len(x) and np.allclose([got[tuple(p)] for p in x.tolist()], density[near].mean(axis=1) / density)


def test_evaluation_keeps_its_plan_small(spark):
    rows = spark.range(300).selectExpr("id as row_id", "cast(id % 17 + 1 as double) as Quantity", "cast(id % 13 + 1 as double) as UnitPrice")
    for f in (anomaly.evaluate, anomaly.recall_by_model, anomaly.severity):
        df = f(rows, ["Quantity", "UnitPrice"], trees=20)
        assert len(df._jdf.queryExecution().toString()) < 60_000 and df.count(), f.__name__


def test_numbers_are_no_phones(spark):
    df = spark.createDataFrame([(123456.78 + i, 1234567 + i, "555-123-45%02d" % i) for i in range(20)], "order_total double, order_key_no_ long, contact string")
    assert {r["column"]: r.semantic for r in profile.infer_semantic(df).collect()} == {"order_total": "price/amount", "order_key_no_": "numeric_measure", "contact": "phone"}
