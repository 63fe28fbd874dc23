"""Alignment against the definition, written out token by token, with the
vocabulary files' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskframe.llm import alignment, queries
from riskframe.llm.tokenizers import ByteLevelBpe, PieceBpe, byte_alphabet

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, bytes) of both sides, or two empty lists."""
    a, b = libraries
    if not text:
        return [], []
    byte = byte_alphabet()
    raw = (" " + text).encode()
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
    right = []
    for i in b.encode(text):
        name = b.id_to_piece(i)
        if len(name) == 6 and name.startswith("<0x"):
            right.append((i, bytes([int(name[3:5], 16)])))
        else:
            right.append((i, name.replace("▁", " ").encode()))
    if any(b"".join(x for _, x in side) != raw for side in (left, right)):
        return [], []
    return left, right


def groups_of(left, right):
    ends = []
    for side in (left, right):
        at, out = 0, []
        for _, x in side:
            at += len(x)
            out.append(at)
        ends.append(out)
    both = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in both]
    for s, side in enumerate((left, right)):
        g = 0
        for (i, _), end in zip(side, ends[s]):
            while end > both[g]:
                g += 1
            out[g][s].append(i)
    return out


def brute(libraries, rows):
    per, held = [], defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        left, right = tokens(libraries, text)
        groups = groups_of(left, right)
        links = Counter((a, b) for x, y in groups for a in x for b in y)
        for pair in links:
            held[pair].add(n)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        per.append((doc_id, len(left), len(right), len(groups), links, shown))
    count = {p: len(d) for p, d in held.items()}
    most = defaultdict(int)
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    out = []
    for doc_id, n_a, n_b, n_g, links, shown in per:
        best = sum(m for (a, b), m in links.items() if count[a, b] == most[a])
        total = sum(m * count[p] for p, m in links.items())
        out.append((doc_id, n_a, n_b, n_g, sum(links.values()), best, total, shown))
    return out, count, most


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r))


def test_query_equals_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = [
        (*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "")
        for r in brute(libraries, [tuple(r) for r in docs.collect()])[0]
    ]
    got = queries.op13_token_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert ordered(got.collect()) == ordered(want)


HOSTILE = [
    None,
    "",
    " ",
    "   lead and trail  ",
    "two  spaces\t\n\n tabs \x00\x01",
    "a▁b has the sign",
    "<|endoftext|> </s> <s> <unk> <0x41> [INST]",
    "日本語のテキスト、한국어 그리고 العربية",
    "👩‍👩‍👧‍👦 🇫🇷 naïve café é",
    "-" * 3000 + "=" * 777,
    "x" * 5000,
    "\n" * 400,
    " " * 300 + "end",
    "long run" + " " * 200_000 + "\n" * 3000 + "end",
    "don't won't I'll we've 12345678901234567890",
    "lorem ipsum " * 2000,
    "  ​﻿\u0085",
]


def test_hostile_rows_in_small_runs(spark, libraries):
    """Runs of a few records, merges of three runs, groups of some bytes."""
    rows = list(enumerate(HOSTILE)) + [(None, "the cat the dog"), (3, "the cat the dog"), (3, "the cat the dog")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, groups string, run int")
    want, count, most = brute(libraries, rows)
    got = alignment.align_tokenizers(docs.repartition(5), run_records=40, merge_runs=3, group_bytes=2000)
    assert ordered(got.collect()) == ordered(want)
    pairs = alignment.pair_counts(docs.repartition(3), run_records=40, merge_runs=2).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs} == count
    assert all(r.best == (r.n_docs == most[r.a_id]) for r in pairs)


def test_empty_and_tokenless_tables(spark):
    schema = "doc_id string, text string"
    empty = alignment.align_tokenizers(spark.createDataFrame([], schema))
    assert empty.count() == 0
    none = alignment.align_tokenizers(spark.createDataFrame([("a", None), (None, "")], schema)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in none) == [("None", 0, 0, 0, 0, 0, 0, ""), ("a", 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \t\nab'.1é▁"), st.characters(codec="utf-8"))), max_size=4))
def test_encoders_equal_their_libraries(libraries, texts):
    a, b = libraries
    texts = [t for t in texts if t]
    assert ByteLevelBpe.from_file(A).encode(texts) == [a.encode(t, add_special_tokens=False).ids for t in texts]
    assert PieceBpe.from_file(B).encode(texts) == [b.encode(t) for t in texts]


def test_large_cells_count_as_small_ones(monkeypatch):
    aligner = alignment.Aligner(ByteLevelBpe.from_file(A), PieceBpe.from_file(B))
    texts = ["日本語 text 한국어 and more", "ààà ééé 日本日本日本"]
    small = aligner.align(texts)
    monkeypatch.setattr(alignment, "LARGE_CELL", 1)
    large = aligner.align(texts)
    assert (small["keys"] == large["keys"]).all() and (small["times"] == large["times"]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300), min_size=1), max_size=9), st.integers(1, 7))
def test_merge_of_runs(sets, block):
    rng = random.Random(0)
    runs = [(np.array(sorted(s)), np.array([rng.randrange(9) for _ in s])) for s in sets]
    want = Counter()
    for p, c in runs:
        for x, y in zip(p.tolist(), c.tolist()):
            want[x] += y
    out = [(x, y) for p, c in alignment.merge_runs(runs, block) for x, y in zip(p.tolist(), c.tolist())]
    assert out == sorted((p, want[p]) for p in {x for p, _ in runs for x in p.tolist()})


def test_pack_round_trip():
    for dtype in ("<u4", "<i8"):
        values = np.array([0, 1, 255, 256, 1 << 30, 7], dtype)
        assert (alignment.unpack(alignment.pack(values), len(values), dtype) == values).all()
        assert len(alignment.unpack(alignment.pack(values[:0]), 0, dtype)) == 0
