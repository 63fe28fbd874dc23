"""Fitted pipelines and thresholds apply to a stream as they do to a table."""

from conftest import SF_SMALL
from riskframe.operators import act, models, project, split
from riskframe.sources import activity


def test_scores_of_a_stream_equal_the_batch(spark, tmp_path):
    table = project.binary_label(activity.load_activity(spark, SF_SMALL), activity.TARGET, "Yes", "label")
    train, _ = split.train_test(table, "label", activity.KEY)
    model, _ = models.fit_logistic(train, list(activity.CATEGORICAL), list(activity.NUMERIC))
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    keep = [activity.KEY, "n_orders"]
    rules = {"intercept": 1.0, "n_orders": -0.1}
    for scorer in (model, rules):
        batch = act.at_risk(models.score(scorer, table, keep=keep), threshold=0.2)
        out = f"{tmp_path}/{type(scorer).__name__}"
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = (
            act.at_risk(models.score(scorer, stream, keep=keep), threshold=0.2)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{out}-state")
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination(120)
        got = sorted(spark.read.parquet(out).collect())
        assert got == sorted(batch.collect()) and got
