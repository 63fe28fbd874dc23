"""SimHash near-dedup against brute force."""

import random

import numpy as np
import pytest
import xxhash

from riskframe.llm import queries, simhash
from riskframe.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = [w for w in _words(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_components(fps, max_bits):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    comp = brute_components(fp.values(), 4)
    low = {}
    for d, f in fp.items():
        low[comp[f]] = min(low.get(comp[f], d), d)
    got = {r.doc_id: r for r in queries.op1_simhash_dedup(spark, SF).collect()}
    assert set(got) == set(fp)
    for d, f in fp.items():
        assert got[d].fingerprint == f"{f:016x}"
        assert got[d].component_id == low[comp[f]]


def test_every_pair_in_the_radius_meets():
    rng = random.Random(1)
    masks = simhash.covering_masks(list(range(64)), 4)
    assert len(masks) == 31 and min(m.bit_count() for m in masks) >= 32
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & diff == 0 for m in masks)


def test_second_covering_bounds_the_bucket():
    for m in simhash.covering_masks(list(range(64)), 4):
        free = [i for i in range(64) if not m >> i & 1]
        for s in simhash.covering_masks(free, 4):
            assert 64 - (m | s).bit_count() <= 16


def test_cube_forest_links_as_the_pairs_do():
    rng = np.random.default_rng(2)
    free = sorted(rng.choice(64, 12, replace=False).tolist())
    for n in (2, 20, 200):
        cells = rng.integers(0, 1 << 12, n)
        fps = np.array([sum(1 << p for i, p in enumerate(free) if c >> i & 1) for c in cells.tolist()], np.uint64)
        a, b = simhash.cube_forest(fps, free, 2)
        x, y = simhash.forest(fps, 2)
        want = brute_components(fps.tolist(), 2)
        for left, right in ((a, b), (x, y)):
            pairs = list(zip(left.tolist(), right.tolist()))
            root = _roots(set(fps.tolist()), pairs)
            assert {f: root[f] for f in want} == want


def _roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_hot_bucket_goes_through_the_second_covering(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", 5)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        f = base
        for b in rng.sample(range(64), rng.choice([2, 3, 6, 9])):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(20)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.simhash_links(df, 4).collect()]
    assert _roots(fps, links) == brute_components(fps, 4)


def test_buckets_and_salted_copies_are_not_broadcast(spark, monkeypatch):
    """Spark sizes exploded frames as before the explode: small tables by its
    count, far too many rows for a driver."""
    plans = {}
    real = simhash.written

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(simhash, "written", seen)
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(400)]
    fps += [f ^ 3 for f in fps[:100]]
    simhash.simhash_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")).count()
    assert "SortMergeJoin" in plans["buckets"] and "Broadcast" not in plans["buckets"]
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i % 50, f"text number {i % 50} of {i % 50 + 7} in two equal rows") for i in range(100)], "doc_id long, text string")
    kept = simhash.simhash_dedup(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan and "SortMergeJoin" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "salt" in line]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(None, 3), (7, 7), (200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


DOCS = "doc_id long, text string, fp string, low int, key string, n int"


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, None, "x", 1, "k", 1),
        (2, "", None, None, None, None),
        (3, "only three words", "x", 1, "k", 1),
        (4, "only THREE  words\n", "x", 1, "k", 1),
        (4, "only THREE  words\n", "x", 1, "k", 1),
        (None, "a text without an id at all", "x", 1, "k", 1),
        (None, "a text without an id at all", "x", 2, "k", 1),
        (None, long, None, 1, "k", 1),
        (9, long + " ", None, 1, "k", 1),
        (4, "same id but another text than above here", "y", 1, "k", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    out = simhash.simhash_groups(docs).collect()
    assert len(out) == len(rows)
    comp = sorted((r.doc_id, r.component_id) for r in out if r.doc_id is not None)
    assert comp == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (4, 4), (9, 9)]
    assert {r.component_id for r in out if r.doc_id is None} == {None, 9}
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or -1, (r.text or "")[:9]) for r in kept.collect())
    assert left == [(-1, "a text wi"), (1, ""), (3, "only thre"), (4, "same id b"), (9, "w0 w1 w2 ")]
    empty = docs.where("false")
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("most", [None, 0])
def test_dedup_of_clashing_and_equal_rows_reruns_alike(spark, monkeypatch, most):
    if most is not None:  # too many hashes to be broadcast
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    text = "one text that many rows have and that is long enough"
    schema = "doc_id long, text string, row_hash_a string, tags map<string,int>, source string"
    rows = [(1, text, "x", {"k": i % 7}, f"s{i % 5}") for i in range(350)]
    rows += [(1, text, None, None, "x"), (1, text, "x", None, None)]
    rows += [(2, "another text of its own, in two equal rows", "x", None, "s")] * 2 + [(None, None, None, None, None)] * 3
    want = None
    for parts in (1, 3, 16):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        kept = simhash.simhash_dedup(docs)
        assert kept.schema == docs.schema
        got = sorted(map(str, kept.collect()))
        assert len(got) == 3 and len([r for r in got if "one text" in r]) == 1
        assert want in (None, got)
        want = got


def test_dedup_signs_each_text_once(spark, monkeypatch):
    calls = []
    real = simhash.with_fingerprint
    monkeypatch.setattr(simhash, "with_fingerprint", lambda *a: calls.append(1) or real(*a))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = simhash.simhash_dedup(docs)
    assert calls == [1]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("n", [1, 3, 4, 5, 70_000])
def test_fingerprint_of_long_and_short_texts(n):
    text = " ".join(f"Word{i % 977}" for i in range(n))
    assert simhash.fingerprint(text) == brute_fingerprint(text)
