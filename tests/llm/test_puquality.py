"""Positive-unlabelled quality scores: held-out accuracy and edge rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import puquality, queries

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = queries.op5_pu_quality(spark, MID).collect()
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([s for s, q in held if q == 1])
    bad = np.array([s for s, q in held if q == 0])
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert auc > 0.97
    assert np.mean([(s >= 0.5) == bool(q) for s, q in held]) > 0.93


def test_scores_depend_on_the_text_alone(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "text")
    a = {r.doc_id: r.score for r in queries.op5_pu_quality(spark, MID).collect()}
    labels = spark.read.parquet(f"{MID}/labels.parquet").where("quality = 1")
    keep = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    # extra held-out rows and labels change nothing
    extra = docs.where(~keep).withColumn("doc_id", F.col("doc_id") + 0)
    again = puquality.pu_scores(docs.union(extra), labels.where(keep).select("doc_id"), keep).collect()
    assert all(abs(r.score - a[r.doc_id]) < 1e-12 for r in again)


def test_prior_from_known_mixtures():
    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.9):
        pos = rng.beta(8, 2, 20_000)
        unl = np.concatenate([rng.beta(8, 2, int(40_000 * prior)), rng.beta(1, 12, int(40_000 * (1 - prior)))])
        got = puquality.estimate_prior(*(np.histogram(x, 1000, (0, 1))[0] for x in (pos, unl)))
        assert abs(got - prior) < 0.04


def test_features_of_odd_texts():
    assert not puquality.features(None).any() and not puquality.features(" \n\t").any()
    for text in ("x", "\x00", "é" * 200_000, "a " * 200_000, "\n" * 50 + "w"):
        f = puquality.features(text)
        assert f.shape == (puquality.WIDTH,) and np.isfinite(f).all()


def test_edge_rows(spark):
    rows = [(i, "plain words of a good text number %d and more of it" % i, 1, "x") for i in range(60)]
    rows += [(i, "$$$ !!! BUY### NOW%%% $$$ ***", 1, "x") for i in range(60, 80)]
    rows += [(80, None, 1, None), (81, "", None, None), (None, "no id", 1, None), (3, rows[3][1], 1, "x"), (82, "w " * 100_000, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int, score string")
    trusted = spark.createDataFrame([(i,) for i in range(30)] + [(None,), (3,)], "doc_id long")
    out = puquality.pu_scores(docs, trusted, F.col("doc_id") % 3 != 1).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (80, 81)}) == 1
    none = puquality.pu_scores(docs, trusted.where("false"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert puquality.pu_scores(docs.where("false"), trusted, F.lit(True)).count() == 0


def test_sample_bounds_are_arguments(spark, monkeypatch):
    sizes = []
    fit = puquality._fit
    monkeypatch.setattr(puquality, "_fit", lambda p, u, *a: (sizes.append((len(p), len(u))), fit(p, u, None, 1))[1])
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9 + 1)) for i in range(600)], "doc_id long, text string")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    for most, least in (((1000, 1000), (300, 600)), ((30, 60), None)):
        sizes.clear()
        puquality.pu_scores(docs, trusted, F.lit(True), max_positive=most[0], max_unlabelled=most[1])
        if least:
            assert sizes[-1] == least
        else:
            assert all(0 < p < 90 and 0 < u < 150 for p, u in sizes)
