import math

import pytest
from pyspark.sql import functions as F

from fixtures import preview_frame
from riskframe.operators import profile, project


def test_nulls_and_nan_count_as_missing(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, None), (3, float("nan"), ""), (4, 2.0, "b")],
        "id long, x double, s string",
    )
    counts = {r.column_name: r.n_missing for r in profile.null_counts(df).collect()}
    assert counts == {"id": 0, "x": 2, "s": 1}
    total = profile.null_total(df).first()
    assert total.n_missing == 3 and total.status == "alert"
    assert profile.null_total(df.na.drop()).first().status == "ok"


def test_duplicate_count_null_equals_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",), ("a",)], "k string")
    assert profile.duplicate_count(df, ["k"]).first().n_duplicates == 3


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (1.5,), (2.0,), (-1.0,), (0.0,)], "x double")
    rows = {r.bin: r["count"] for r in profile.histogram(df, "x", [-0.5, 0.5, 1.5, 2.5]).collect()}
    # [-0.5,0.5): -0.5, 0.0 ; [0.5,1.5): 0.5 ; [1.5,2.5]: 1.5, 2.0
    assert rows == {0: 2, 1: 1, 2: 2}
    empty = {r.bin: r["count"] for r in profile.histogram(df, "x", [10.0, 11.0, 12.0]).collect()}
    assert empty == {0: 0, 1: 0}


def test_describe_numeric_quartiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    r = profile.describe_numeric(df).first()
    assert (r.p25, r.p50, r.p75) == (1.75, 2.5, 3.25)
    assert r["count"] == 4 and r.mean == 2.5 and math.isclose(r.std, 1.2909944487358056)


def test_describe_mixed_top_tie_is_smallest(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("a", 4), (None, 5)], "s string, n int")
    rows = {r.column_name: r for r in profile.describe_mixed(df).collect()}
    assert rows["s"].top == "a" and rows["s"].freq == 2 and rows["s"].unique == 2 and rows["s"]["count"] == 4
    assert rows["n"].mean == 3.0 and rows["n"].top is None


def test_value_counts_and_shares(spark):
    df = preview_frame(spark)
    vc = [(r.Contract, r["count"]) for r in profile.value_counts(df, "Contract").collect()]
    assert vc == [("One year", 4), ("Two year", 4), ("Month-to-month", 2)]
    shares = {r.Contract: r.share_pct for r in profile.value_shares(df, "Contract").collect()}
    assert shares["Month-to-month"] == 20.0


def test_schema_report_and_shape(spark):
    df = preview_frame(spark)
    rep = profile.schema_report(df).collect()
    assert len(rep) == 20 and rep[0].column_name == "customerID" and rep[0].non_null == 10
    shape = profile.table_shape(df).first()
    assert (shape.n_rows, shape.n_cols) == (10, 20)


def test_describe_text_is_lexical_for_strings(spark):
    d = {r.summary: r for r in profile.describe_text(preview_frame(spark), ["customerID"]).collect()}
    assert d["max"].customerID == "customer_9" and d["mean"].customerID is None


def test_labels(spark):
    df = spark.createDataFrame([("Yes",), ("No",), ("maybe",), (None,)], "Churn string")
    strict = [r.y for r in project.map_label(df, "Churn", {"Yes": 1, "No": 0}, "y").collect()]
    assert strict == [1, 0, None, None]
    binary = [r.label for r in project.binary_label(df, "Churn").collect()]
    assert binary == [1.0, 0.0, 0.0, 0.0]


def test_projection_helpers(spark):
    df = preview_frame(spark)
    xy = project.features_and_target(df, "Churn", drop=["customerID"])
    assert xy.columns[-1] == "target" and "customerID" not in xy.columns and len(xy.columns) == 19
    prof = project.select_existing(df, ["Contract", "InternetService", "tenure", "MonthlyCharges", "nope"])
    assert prof.columns == ["Contract", "InternetService", "tenure", "MonthlyCharges"]
    top = project.top_k(df, "MonthlyCharges", 2, tie_break=["customerID"]).collect()
    assert [r.customerID for r in top] == ["customer_10", "customer_7"]
    assert project.filter_at_least(df, "tenure", 51).count() == 4
    assert df.where(F.col("Churn") == "Yes").count() == 1


def _quartiles(values):
    """pandas' rule; equal neighbours (infinite ones too) are the answer."""
    v, out = sorted(values), []
    for p in (0.25, 0.5, 0.75):
        h = (len(v) - 1) * p
        lo, hi = v[math.floor(h)], v[math.ceil(h)]
        out.append(lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
    return out


def test_exact_quartiles_in_few_and_many_rounds(spark, monkeypatch):
    inf, nan = math.inf, math.nan
    n = 30_000
    cols = {
        "hot": [7.0 if i % 3 == 0 else (i * 37 % 1001) / 10.0 - 20.0 for i in range(n)],
        "distinct": [math.sin(i) * 1e6 for i in range(n)],
        "gaps": [None if i % 5 == 0 else nan if i % 7 == 0 else float(i % 17) for i in range(n)],
        "infinite": [inf if i % 2 else -inf if i % 3 == 0 else float(i) for i in range(n)],
        "constant": [3.0] * n,
        "edge": [1.0 if i < n // 4 else 2.0 + i for i in range(n)],
        "empty": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(4)
    seen = []
    for limit, accuracy in ((100_000, 10_000), (50, 20), (1, 10)):
        monkeypatch.setattr(profile, "BRACKET_ROWS", limit)
        monkeypatch.setattr(profile, "ACCURACY", accuracy)
        got = {r.column_name: r for r in profile.describe_numeric(df).collect()}
        for c, values in cols.items():
            here = [v for v in values if v is not None and v == v]
            assert got[c]["count"] == len(here)
            want = _quartiles(here) if here else [None] * 3
            assert [got[c].p25, got[c].p50, got[c].p75] == want, (c, limit)
        seen.append(got["distinct"].asDict())
    assert seen[0] == seen[1] == seen[2]
    approx = {r.column_name: r for r in profile.describe_numeric(df, method="approx").collect()}
    assert approx["gaps"]["count"] == got["gaps"]["count"]
    with pytest.raises(ValueError):
        profile.describe_numeric(df, method="percentile")


def test_three_scans_at_most(spark, monkeypatch):
    """The first aggregate, ``_rows_by_segment`` and ``_counted`` scan the input."""
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009 / 7).alias("x"), (F.col("id") % 3).alias("y"))
    want = [(r.p25, r.p50, r.p75) for r in profile.describe_numeric(df).collect()]
    scans = []
    for name in ("_rows_by_segment", "_counted"):
        real = getattr(profile, name)
        monkeypatch.setattr(profile, name, lambda *a, real=real, name=name: scans.append(name) or real(*a))
    for limit in (10_000, 500, 1):
        monkeypatch.setattr(profile, "BRACKET_ROWS", limit)
        scans.clear()
        assert [(r.p25, r.p50, r.p75) for r in profile.describe_numeric(df).collect()] == want
        assert scans == ["_rows_by_segment", "_counted"]
    scans.clear()
    profile.describe_numeric(df.select("y")).collect()  # brackets of one value
    assert scans == ["_rows_by_segment"]
    # a sketch that misses: the values between the brackets are counted too
    monkeypatch.setattr(profile, "_sketch", lambda x, probs: F.array(*[F.min(x) + k for k in range(2 * len(probs))]))
    scans.clear()
    assert [(r.p25, r.p50, r.p75) for r in profile.describe_numeric(df).collect()] == want
    assert scans == ["_rows_by_segment", "_counted"]


def test_more_than_a_million_distinct_values(spark):
    df = spark.range(1_300_001).select((F.col("id") * 7919 % 1_300_001).alias("x"))
    r = profile.describe_numeric(df).first()
    assert (r.p25, r.p50, r.p75) == (325_000.0, 650_000.0, 975_000.0)


def test_missing_values_are_no_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (math.nan,), (None,), (math.inf,)], "x double")
    assert [(r.x, r["count"]) for r in profile.value_counts(df, "x").collect()] == [(1.0, 2), (math.inf, 1)]
    assert round(sum(r.share_pct for r in profile.value_shares(df, "x").collect()), 9) == 100.0
    assert [r["count"] for r in profile.histogram(df, "x", [0.0, 1.0, math.inf]).collect()] == [0, 3]


def test_describe_mixed_covers_every_type(spark):
    df = spark.sql(
        "select 1 as i, 'a' as s, true as b, date'2024-01-02' as d, timestamp'2024-01-02 03:04:05' as t, "
        "array(1, 2) as a, cast(1.5 as decimal(5,2)) as n"
    )
    got = {r.column_name: r for r in profile.describe_mixed(df).collect()}
    assert set(got) == set("isbdtan")
    assert (got["b"].top, got["d"].top, got["t"].top) == ("true", "2024-01-02", "2024-01-02 03:04:05")
    assert got["n"].p50 == 1.5 and got["a"].unique == 1
    assert profile.describe_mixed(df, ["b"]).count() == 1
    none = profile.describe_mixed(df, [])
    assert none.count() == 0 and none.columns[:2] == ["column_name", "count"]


def test_describe_text_matches_spark_describe(spark):
    df = preview_frame(spark)
    ours = {r.summary: r.asDict() for r in profile.describe_text(df).collect()}
    theirs = {r.summary: r.asDict() for r in df.describe().collect()}
    for stat in ("count", "min", "max"):
        assert ours[stat] == theirs[stat]
    for stat in ("mean", "stddev"):
        for c, v in theirs[stat].items():
            if c == "summary":
                continue
            if v is None:
                assert ours[stat][c] is None
            else:
                assert math.isclose(float(ours[stat][c]), float(v), rel_tol=1e-12)


def test_histogram_with_few_many_and_infinite_edges(spark):
    xs = [(i * 7919 % 1000) / 10.0 - 5.0 for i in range(2000)] + [-math.inf, math.inf, math.nan]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for edges in (
        [0.0, 50.0],
        [float(e) for e in range(0, 101, 5)],
        [-math.inf, *map(float, range(10)), math.inf],
        [-math.inf, *map(float, range(500)), math.inf],
    ):
        want = [
            sum(a <= x < b or (k == len(edges) - 2 and x == b) for x in xs)
            for k, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
        got = sorted(profile.histogram(df, "x", edges).collect(), key=lambda r: r.bin)
        assert [r["count"] for r in got] == want
        assert [(r.lower, r.upper) for r in got] == list(zip(edges, edges[1:]))
    with pytest.raises(ValueError):
        profile.histogram(df, "x", [0.0, math.nan])


def test_empty_inputs(spark):
    from riskframe.operators import act, evaluate

    df = spark.createDataFrame([], "k string, x double, label double, prediction double, churn_proba double")
    num = {r.column_name: r for r in profile.describe_numeric(df, ["x"]).collect()}
    assert num["x"]["count"] == 0 and num["x"].p50 is None
    mixed = {r.column_name: r for r in profile.describe_mixed(df, ["k", "x"]).collect()}
    assert mixed["k"]["count"] == 0 and mixed["k"].unique == 0 and mixed["k"].top is None
    assert profile.value_shares(df, "k").count() == 0
    assert [r["count"] for r in profile.histogram(df, "x", [0.0, 1.0]).collect()] == [0]
    assert profile.duplicate_count(df, ["k"]).first().n_duplicates == 0
    assert profile.null_total(df).first().status == "ok"
    assert act.retention_roi(act.at_risk(df)).first().roi_pct is None
    assert evaluate.summary(df).first().accuracy == 0.0
