"""Line dedup against the SQL and a plain Python version."""

import random
from collections import defaultdict

from oracle_check import compare

from riskframe.llm.linededup import line_dedup

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs=3, min_chars=20):
    order = lambda i: (i is not None, i if i is not None else 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[low(line.strip(SPACE))].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = low(line.strip(SPACE))
            many = len(key) >= min_chars and len(held[key]) >= min_docs
            if not many or i == max(held[key], key=order):
                kept.append(line)
        put = None if text is None else "\n".join(kept)
        out.append((i, put, len(lines), len(lines) - len(kept)))
    return out


def test_query_equals_sql(spark):
    res = compare(spark, SF, names=["op11_line_dedup"], verbose=False)
    assert res["op11_line_dedup"][0] == "ok", res


def check(spark, rows, **kw):
    docs = spark.createDataFrame(
        [(i, t, "x", 5, 6) for i, t in rows], "doc_id long, TEXT string, r1 string, n_lines int, n_dropped int"
    ).repartition(4)
    got = line_dedup(docs, text_col="text", **kw)
    assert got.columns == ["doc_id", "TEXT", "r1", "n_lines", "n_dropped", "n_lines_1", "n_dropped_1"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2], r[3])
    got = sorted(((r[0], r[1], r[5], r[6]) for r in got.collect()), key=key)
    assert got == sorted(brute(rows, **kw), key=key)


def test_hostile_rows(spark):
    shared = "this line is found in many documents"
    rows = [(i, f"own {i}\n  {shared.upper()}\t\nend {i}\r\n{shared}") for i in range(6)]
    rows += [(None, shared), (None, f"{shared}\nnull two"), (2, shared), (2, shared), (9, shared[:19]), (10, shared[:19]), (11, shared[:19])]
    rows += [(12, None), (13, ""), (14, "\n\n"), (15, "\n"), (None, None)]
    # exactly 20 code points that are not 20 bytes; two documents only; accents keep their case
    rows += [(i, "é" * 20 + "\n") for i in range(20, 23)] + [(i, "É" * 20) for i in range(23, 25)]
    rows += [(30, "twenty-one characters\n" * 40_000), (31, "twenty-one characters"), (32, "TWENTY-ONE characters \x0b")]
    rows += [(33, "no-break space stays here "), (34, "no-break space stays here"), (35, "no-break space stays here")]
    check(spark, rows)
    check(spark, rows, min_docs=2, min_chars=1)


def test_random_lines(spark):
    rng = random.Random(7)
    lines = [f"line number {i} with some text" for i in range(40)] + ["short", ""]
    rows = [(rng.randrange(60), "\n".join(rng.choice(lines) for _ in range(rng.randrange(30)))) for _ in range(150)]
    check(spark, rows)


def test_one_line_in_every_document(spark):
    rows = [(i, "a passage that all documents have") for i in range(3000)]
    check(spark, rows)


def test_empty_table_and_text_ids(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id string, text string")).count() == 0
    rows = [(c, "the same line in all of them") for c in ("a", "b", "z", "Z")]
    got = {r.doc_id: r.n_dropped for r in line_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": 1, "b": 1, "Z": 1, "z": 0}
