"""Mixing against the SQL oracle's rule and a sort-based brute force."""

import hashlib

from oracle_check import compare

from riskframe.llm import mixing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size int, target string, h string, copies int"


def test_query_equals_sql(spark):
    res = compare(spark, SF, names=["op10_mix"], verbose=False)
    assert res["op10_mix"][0] == "ok", res


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    open_, rest = set(names), share * sum(sizes.values())
    while open_ and rest > 1e-9:
        all_w, left = sum(w[s] for s in open_), rest
        rest = 0.0
        for s in sorted(open_, key=str):
            target[s] += left * w[s] / all_w
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


def _h(i):
    return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)


def test_edge_rows_and_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 7}" if i % 7 else None, 1, "t", "h", 3) for i in range(600)]
    rows += [(i, "word " * 30, "hot", 1, None, None, None) for i in range(600, 900)]
    rows += [(5, None, "s5", 1, None, None, None), (None, "a b c", "s5", 1, None, None, None)]
    rows += [(901, "   \n", "void", 1, None, None, None), (902, None, "void", 1, None, None, None)]
    rows += [(700, "word " * 30, "hot", 1, None, None, None)] * 3
    rows += [(903, "x " * 40_000, "s1", 1, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    sizes, taken = {}, {}
    for r in plan:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        assert 0 <= r.copies <= 2
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES)
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
    largest = {s: max(r.size for r in plan if r.source == s) for s in sizes}
    for s, t in want.items():
        # nearest prefix in hash order; repeated ids enter together
        slack = largest[s] * (4 if s == "hot" else 1)
        assert abs(taken[s] - t) <= slack
    by_id = {}
    for r in plan:
        by_id.setdefault((r.source, r.id), set()).add(r.copies)
    assert all(len(c) == 1 for c in by_id.values())
    # within a source more copies go to the smaller hashes
    for s in sizes:
        hs = sorted((_h(r.id), r.copies) for r in plan if r.source == s and r.size)
        assert [c for _, c in hs] == sorted((c for _, c in hs), reverse=True)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copies_1"]
    got = sorted((r.doc_id or -1, r.source or "", r.copies_1) for r in mixed.collect())
    assert got == sorted((r.id or -1, r.source or "", r.copies) for r in plan if r.copies)
    assert mixing.mix_plan(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_one_source_is_capped_at_twice_its_size(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a", "x")], "doc_id long, text string, source string")
    got = {r.id: (r.target, r.copies) for r in mixing.mix_plan(docs).collect()}
    assert {t for t, _ in got.values()} == {6.0}
    assert sorted(3 * got[1][1] + got[2][1] for _ in [0])[0] in (5, 7)
