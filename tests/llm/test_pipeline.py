"""The pipeline stage by stage against brute force, and on odd tables."""

from collections import Counter

import corpus_pipeline
from test_decontaminate import brute as leak
from test_secrets import brute as secrets_in
from test_simhash import brute_components, brute_fingerprint

from riskframe.llm import quality, secrets

SF = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frames, now = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now = spark.createDataFrame(now.collect(), now.schema)
        frames.append(now)
    rows = [{r.doc_id: r for r in f.collect()} for f in frames]
    assert all(f.columns == docs.columns for f in frames[:-1])
    start, good, unique, clean, masked, mixed = rows
    verdict = {r.row.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert set(good) == {d for d, k in verdict.items() if k}
    fp = {d: brute_fingerprint(r.text) for d, r in good.items()}
    comp = brute_components(fp.values(), 4)
    least = {}
    for d in good:
        least[comp[fp[d]]] = min(least.get(comp[fp[d]], d), d)
    assert set(unique) == set(least.values()) and all(unique[d] == start[d] for d in unique)
    assert set(clean) == {d for d, r in unique.items() if all(leak(r.text, i) < 0.8 for i in items)}
    assert set(masked) == set(clean)
    for d, r in masked.items():
        found = secrets_in(clean[d].text)
        assert (r.text != clean[d].text) == bool(found)
        assert r.n_chars == len(r.text) and not secrets.find_secrets(r.text)
        assert (r.lang, r.source) == (clean[d].lang, clean[d].source)
    assert set(mixed) <= set(masked) and all(mixed[d][:5] == masked[d][:5] for d in mixed)
    size = {d: len((r.text or "").split()) for d, r in masked.items()}
    total = Counter()
    for d, r in mixed.items():
        assert 1 <= r.copies <= 2
        total[r.source] += r.copies * size[d]
    assert sum(total.values()) <= 2 * sum(size.values())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(whole.collect()) == sorted(mixed.values())


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, votes string"
    clean = "The quick reading of a long text is that it has many words in it, and of those the most are short. "
    rows = [
        (1, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 1, "v"),
        (3, clean + "It ends here with number three and nothing else to say about that.", "en", "a", 9, 1, "v"),
        (3, clean + "It ends here with number three and nothing else to say about that.", "en", "a", 9, 1, "v"),
        (None, "Another fine text in which nobody has an id at all. It is still good to read, and it is kept for the mix.", None, None, None, None, None),
        (5, clean * 1 + "The token = abcdefghijklmnop0123 is in it, as the fifth of these texts. So it goes on for a while.", "en", "b", 0, None, "v"),
    ]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {3, None, 5} and len(got) <= 3
    assert all("abcdefghijklmnop" not in r.text for r in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
