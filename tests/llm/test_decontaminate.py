"""Decontamination against brute force over all windows."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, item):
    a, b = grams(text), grams(item)
    if not a or not b or not set(a) & set(b):
        return 0.0
    size, want = min(len(a), len(b)), Counter(b)
    best = 0.0
    for i in range(len(a) - size + 1):
        common = (Counter(a[i : i + size]) & want).total()
        best = max(best, common / (size + len(b) - common))
    return best


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {}
    for d in docs:
        for i in items:
            s = brute(d.text, i.text)
            if s >= 0.8:
                want[d.doc_id, i.item_id] = s
    got = {(r.doc_id, r.item_id): r.similarity for r in queries.op7_decontaminate(spark, SF).collect()}
    assert set(got) == set(want) and want
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_multi_index_finds_all_in_the_radius():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 500, dtype=np.uint64)
    index = decontaminate.MultiIndex(fps)
    probes = []
    for i in range(300):
        fp = fps[i]
        for b in rng.choice(64, rng.integers(0, 24), replace=False).tolist():
            fp = fp ^ np.uint64(1 << b)
        probes.append(fp)
    probes = np.array(probes)
    want = np.nonzero(np.bitwise_count(probes[:, None] ^ fps[None, :]) <= decontaminate.RADIUS)
    got = index.near(probes)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_edited_copies_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 120)))) for i in range(60)]
    found = missed = 0
    docs, want = [], set()
    for d in range(400):
        item_id, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            edit = rng.choice(("swap", "drop", "add", "case"))
            if edit == "drop":
                del w[k]
            elif edit == "add":
                w.insert(k, rng.choice(vocabulary))
            else:
                w[k] = w[k].upper() if edit == "case" else rng.choice(vocabulary)
        whole = " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)) + w + rng.choices(vocabulary, k=rng.randint(0, 80)))
        docs.append((d, whole))
        if brute(whole, text) >= 0.8:
            want.add((d, item_id))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench).collect()}
    assert got == want and len(want) > 100
    # in several blocks the same
    found = frame.select("doc_id", F.explode(decontaminate.leaks_of(F.col("text"), bench, block_chars=5000)).alias("x"))
    assert {(r.doc_id, r.x.item_id) for r in found.collect()} == want


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame(
        [(1, item, "x"), (1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "too short", "x"), (None, "a b c d e f g h i j k", "x")],
        "item_id long, text string, leaks string",
    )
    rows = [
        (1, None, "l"), (2, "", "l"), (3, item, "l"), (3, item, "l"), (4, "too short", "l"),
        (5, "w " * 120_000 + item + " w" * 120_000, "l"), (None, "A B C D E F G H I J K", "l"), (6, item[:-7], "l"),
        (7, "w " * 50, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    got = sorted(((r.doc_id or 0), (r.item_id or 0), round(r.similarity, 3)) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(0, 0, 1.0), (3, 1, 1.0), (3, 1, 1.0), (5, 1, 1.0), (6, 1, 0.875)]
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 4, 7]
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == len(rows)


def test_word_hashes_by_pieces(monkeypatch):
    rng = random.Random(6)
    words = ["w" * rng.randint(1, 12) + str(i % 50) for i in range(3000)] + ["x" * 500, "y" * 70]
    rng.shuffle(words)
    for glue in (" ", "\n\t ", "\x0b"):
        raw = (glue + glue.join(words) + rng.choice(["", glue])).encode()
        whole = decontaminate.word_hashes(raw)
        assert len(whole) == len(words)
        assert len(set(whole.tolist())) == len(set(words))
        by = dict(zip(words, whole.tolist()))
        for size in (64, 7, 1):
            monkeypatch.setattr(decontaminate, "PIECE", size)
            again = decontaminate.word_hashes(raw)
            assert again.tolist() == [by[w] for w in words]
        monkeypatch.undo()
    for raw in (b"", b" ", b" \n"):
        assert len(decontaminate.word_hashes(raw)) == 0
    assert len(decontaminate.word_hashes(b"z" * 300_000)) == 1
    assert len(decontaminate.word_hashes(b"z" * 300_000 + b" y")) == 2


def test_repeated_shingles_are_not_lost():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(5000)]
    far = 0
    for n in range(12):
        item = rng.choices(vocabulary, k=404)
        at = rng.randrange(100, 300)
        text = item[:at] + ["x"] * 36 + item[at:]
        if n % 3 == 1:  # the item holds the run
            item, text = text, item
        if n % 3 == 2:  # both do, and differ in all else but a little
            item = ["x"] * 360 + rng.choices(vocabulary, k=40)
            text = ["x"] * 360 + rng.choices(vocabulary, k=30)
        other = " ".join(rng.choices(vocabulary, k=404))
        whole = " ".join(rng.choices(vocabulary, k=30) + text + rng.choices(vocabulary, k=30))
        want = brute(whole, " ".join(item))
        assert want >= 0.8
        got = decontaminate.LeakIndex([(1, " ".join(item)), (2, other)]).leaks(whole)
        assert [(x[0], round(x[1], 9)) for x in got] == [(1, round(want, 9))]
        w, size = decontaminate.shingle_hashes(whole)[0], len(item) - 4
        fp = decontaminate.sign_windows(w, np.array([got[0][2]]), min(size, len(w)))
        own = decontaminate.sign_windows(decontaminate.shingle_hashes(" ".join(item))[0], np.zeros(1, np.int64), size)
        far += int(np.bitwise_count(fp ^ own)[0]) > decontaminate.RADIUS
    assert far


def test_repeats_and_sliding_counts():
    rng = np.random.default_rng(9)
    for n, size in ((40, 7), (40, 40), (200, 30), (5, 1)):
        hashes = rng.integers(0, 12, n, dtype=np.uint64)
        windows = [hashes[i : i + size].tolist() for i in range(n - size + 1)]
        got = decontaminate._repeats(decontaminate._pairs(hashes), len(windows), size)
        assert got.tolist() == [size - len(set(w)) for w in windows]
        want = Counter(rng.integers(0, 12, size).tolist())
        starts = sorted(rng.choice(len(windows), max(1, len(windows) // 3), replace=False).tolist())
        slid = list(decontaminate._slide(hashes.tolist(), starts, size, want))
        assert slid == [(i, (Counter(windows[i]) & want).total()) for i in starts]


def test_short_items_are_found(spark, tmp_path):
    items = [(1, "Too short"), (2, "one"), (3, "a b c d"), (4, " "), (5, None), (6, "too SHORT"), (7, "a b c d e f g")]
    docs = [
        (1, "too short"), (2, "far too short, one too short ONE one"), (3, "a b c"), (4, "x a b c d"), (5, None), (6, ""),
        (7, "too, short"), (8, "short too"), (9, "a b c d e f g"),
    ]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op7_decontaminate(spark, str(tmp_path)).collect())
    assert got == [
        (1, 1, 1.0, 0, 2), (1, 6, 1.0, 0, 2), (2, 1, 1.0, 4, 2), (2, 2, 1.0, 3, 1), (2, 6, 1.0, 4, 2),
        (4, 3, 1.0, 1, 4), (9, 3, 1.0, 0, 4), (9, 7, 1.0, 0, 7),
    ]
    kept = corpus_pipeline.benchmark_free(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8]


def test_lists_select():
    rng = np.random.default_rng(11)
    items, windows = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (2000, 300))
    i, j = decontaminate.MultiIndex(items).candidates(windows)
    # 2,517 of 65,536 block values in each of four blocks
    assert 0.13 < len(i) / (2000 * 300) < 0.17
    # and hold all whose nearest block is near enough, whatever the rest
    least = np.min([np.bitwise_count(decontaminate.MultiIndex.block(items, b)[None, :] ^ decontaminate.MultiIndex.block(windows, b)[:, None]) for b in range(4)], axis=0)
    assert list(zip(i.tolist(), j.tolist())) == [tuple(x) for x in np.argwhere(least <= 4).tolist()]
    assert all(len(x) == 0 for x in decontaminate.MultiIndex(items[:0]).near(windows))
    assert all(len(x) == 0 for x in decontaminate.MultiIndex(items).near(windows[:0]))


def test_radius_loses_little():
    """Of pairs at similarity 0.8 to 0.82 nearly all are in the radius."""
    rng = np.random.default_rng(12)
    far = 0
    for _ in range(3000):
        size = int(rng.integers(20, 300))
        common = -int(-0.8 * 2 * size // 1.8)
        both, own, other = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (common, size - common, size - common))
        a, b = (decontaminate.sign_windows(np.concatenate([both, x]), np.zeros(1, np.int64), size) for x in (own, other))
        far += int(np.bitwise_count(a ^ b)[0]) > decontaminate.RADIUS
    assert far <= 15, far


def test_index_is_built_once_a_worker(spark):
    built = spark.sparkContext.accumulator(0)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i} zeta{i}") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "x " + items[i % 20][1]) for i in range(200)], "doc_id long, text string").repartition(40)

    class Told:
        def __init__(self, value):
            self.inner = value

        @property
        def value(self):  # read when an index is built only
            built.add(1)
            return self.inner

    look = decontaminate._lookup(Told(items), 0.8, False)
    assert docs.select(F.size(look("text")).alias("n")).where("n = 1").count() == 200
    assert 1 <= built.value <= 16
    # one block and several give the same rows, and a block a pass
    read = lambda df: sorted(map(tuple, df.collect()))
    whole = read(decontaminate.find_leaks(docs, bench))
    assert len(whole) == 200 and read(decontaminate.find_leaks(docs, bench, block_chars=300)) == whole
    some = bench.where("item_id < 15")
    kept = read(decontaminate.decontaminate(docs, some))
    assert len(kept) == 50 and read(decontaminate.decontaminate(docs, some, block_chars=200)) == kept
