from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID
from riskframe.functions.columns import stable_hash
from riskframe.operators import split
from riskframe.sources.activity import load_activity


def _frame(spark, n=2000):
    # label with a 1-in-5 positive rate, string key
    return spark.range(n).select(
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("label"),
    )


def test_stratified_split_keeps_class_shares(spark):
    df = _frame(spark)
    out = split.stratified_split(df, "label", "key", 0.3, seed=42)
    counts = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert counts[(1.0, "test")] == 120 and counts[(1.0, "train")] == 280
    assert counts[(0.0, "test")] == 480 and counts[(0.0, "train")] == 1120


def test_split_is_partition_independent(spark):
    df = _frame(spark)
    answers = []
    for parts in (1, 4, 7):
        out = split.stratified_split(df.repartition(parts), "label", "key", 0.3, seed=42)
        answers.append(sorted(r.key for r in out.where("split = 'test'").select("key").collect()))
    assert answers[0] == answers[1] == answers[2]


def test_train_test_partition_the_input(spark):
    df = _frame(spark, 500)
    train, test = split.train_test(df, "label", "key", 0.3, seed=1)
    a = {r.key for r in train.select("key").collect()}
    b = {r.key for r in test.select("key").collect()}
    assert not (a & b) and len(a | b) == 500


def test_bucketed_rank_equals_plain_window(spark):
    df = _frame(spark, 3000)
    ours = split.stratified_rank(df, "label", "key", seed=42, digits=2)
    w = Window.partitionBy("label").orderBy(stable_hash(["key"], 42), "key")
    plain = df.withColumn("rk", F.row_number().over(w))
    joined = ours.join(plain, ["key", "label"])
    assert joined.where(F.col("_rank") != F.col("rk")).count() == 0
    assert joined.count() == 3000


def test_folds_sizes_differ_by_at_most_one(spark):
    df = _frame(spark, 1003)
    out = split.stratified_folds(df, "label", "key", k=5, seed=42)
    sizes = out.groupBy("label", "fold").count().collect()
    for lab in (0.0, 1.0):
        s = [r["count"] for r in sizes if r.label == lab]
        assert len(s) == 5 and max(s) - min(s) <= 1


def test_null_label_is_its_own_class(spark):
    df = _frame(spark, 100).withColumn("label", F.when(F.col("key") == "k3", None).otherwise(F.col("label")))
    out = split.stratified_split(df, "label", "key", 0.3)
    assert out.count() == 100


def test_hash_split_weights(spark):
    df = _frame(spark, 5000)
    out = split.assign_split(df, "key", (0.7, 0.3), ("train", "test"), seed=42)
    share = out.where("split = 'test'").count() / 5000
    assert 0.27 < share < 0.33
    parts = split.random_split(df, (0.5, 0.5), seed=3, by="key")
    assert parts[0].count() + parts[1].count() == 5000


def test_activity_positive_counts(spark):
    a = load_activity(spark, SF_MID)
    assert a.count() == 1496
    assert a.where("churned = 'Yes'").count() == 322


def test_activity_with_a_hot_customer_matches_brute_force(spark):
    """One customer holds a third of all orders; the Spark plan (partial
    aggregation, joins) must agree with a plain pandas computation."""
    import datetime as dt

    import pandas as pd

    from riskframe.sources.activity import activity_frame

    n = 3000
    orders = spark.range(n).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 97).cast("long").alias("o_custkey"),
        F.lit("O").alias("o_orderstatus"),
        (F.col("id") % 1000 + 0.25).cast("double").alias("o_totalprice"),
        F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(id * 7 % 2400 AS INT), 0, 0, 0)").alias(
            "o_orderdate"
        ),
        F.when(F.col("id") % 5 == 0, "1-URGENT").otherwise("3-MEDIUM").alias("o_orderpriority"),
    )
    customer = spark.range(100).select(
        F.col("id").alias("c_custkey"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name"),
        (F.col("id") % 5).cast("int").alias("c_nationkey"),
        (F.col("id") * 10.5).alias("c_acctbal"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("c_mktsegment"),
    )
    nation = spark.range(5).select(
        F.col("id").cast("int").alias("n_nationkey"),
        F.concat(F.lit("N"), F.col("id").cast("string")).alias("n_name"),
        (F.col("id") % 2).cast("int").alias("n_regionkey"),
    )
    region = spark.range(2).select(
        F.col("id").cast("int").alias("r_regionkey"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("r_name")
    )

    got = activity_frame(customer, orders, nation, region).toPandas().set_index("c_custkey").sort_index()

    o, c = orders.toPandas(), customer.toPandas()
    cutoff = o.o_orderdate.max() - dt.timedelta(days=365)
    before, after = o[o.o_orderdate <= cutoff], o[o.o_orderdate > cutoff]
    g = before.groupby("o_custkey")
    exp = pd.DataFrame({
        "n_orders": g.size(),
        "total_spend": g.o_totalprice.sum(),
        "first": g.o_orderdate.min(),
        "urgent": g.o_orderpriority.apply(lambda s: (s == "1-URGENT").sum()),
    })
    exp["churned"] = ["No" if k in set(after.o_custkey) else "Yes" for k in exp.index]
    exp["tenure_days"] = [(cutoff.normalize() - f.normalize()).days for f in exp["first"]]
    exp = exp.join(c.set_index("c_custkey"), how="inner").sort_index()

    assert list(got.index) == list(exp.index)
    assert got.loc[7, "n_orders"] == exp.loc[7, "n_orders"] > n // 4  # the hot customer
    assert (got.n_orders == exp.n_orders).all()
    assert ((got.total_spend - exp.total_spend).abs() < 1e-6).all()
    assert (got.avg_spend.round(9) == (exp.total_spend / exp.n_orders).round(9)).all()
    assert (got.urgent_share.round(12) == (exp.urgent / exp.n_orders).round(12)).all()
    assert (got.tenure_days == exp.tenure_days).all()
    assert (got.churned == exp.churned).all()


def test_right_sized_cuts_lineage(spark):
    from riskframe.functions.frames import right_sized

    deep = split.stratified_folds(_frame(spark, 3000), "label", "key", k=3)
    deep = split.stratified_split(deep, "label", "key", 0.3)
    before = len(deep._jdf.queryExecution().toString())
    cut = right_sized(deep, rows_per_partition=1000)
    after = len(cut._jdf.queryExecution().toString())
    assert cut.rdd.getNumPartitions() == 3 and cut.count() == 3000
    assert after < before / 5, (before, after)


def test_hash_split_three_parts_is_a_partition(spark):
    df = _frame(spark, 3000)
    out = split.assign_split(df, "key", (0.5, 0.3, 0.2), ("a", "b", "c"), seed=1)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and set(counts) == {"a", "b", "c"}
    assert 1350 < counts["a"] < 1650 and 750 < counts["b"] < 1050


def test_split_keys_do_not_collide(spark):
    rows = [("a", None), (None, "a"), ("a#b", "c"), ("a", "b#c"), ("1:a", ""), ("", "1:a"), (None, None), ("-", "-")]
    df = spark.createDataFrame(rows, "p string, q string")
    h = {r[0] for r in df.select(stable_hash(["p", "q"], 1)).collect()}
    assert len(h) == len(rows)


def test_null_keys_spread_over_buckets(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("key"), (F.col("id") % 2).cast("double").alias("label"), "id"
    )
    ranked = split.stratified_rank(df, "label", "key", digits=2)
    w = split._draw(df, ["key"], 42)
    sizes = df.where("key is null").groupBy(F.substring(w, 1, 2)).count().agg(F.max("count")).first()[0]
    assert sizes < 50
    ranks = sorted(r._rank for r in ranked.where("label = 1").collect())
    assert ranks == list(range(1, 2001))
    a = {r.id for r in split.stratified_split(df, "label", "key").where("split = 'test'").collect()}
    b = {r.id for r in split.stratified_split(df.repartition(7), "label", "key").where("split = 'test'").collect()}
    assert a == b and len(a) == 1200


def test_right_sized_layout_depends_on_the_rows_alone(spark):
    from riskframe.functions.frames import right_sized

    df = _frame(spark, 3000)
    layouts = []
    for parts in (1, 3, 9):
        cut = right_sized(df.repartition(parts), rows_per_partition=1000)
        layouts.append(cut.withColumn("p", F.spark_partition_id()).collect())
    assert layouts[0] == layouts[1] == layouts[2]


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest

    from riskframe.functions.frames import checkpoint_root

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())
