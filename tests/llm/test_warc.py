"""WARC archives: exact round trips, pushed filters, odd archives."""

import gzip
import hashlib

import pytest
from oracle_check import compare
from pyspark.sql import functions as F

from riskframe.llm import archive, warc

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    res = compare(spark, SF, names=["op4_warc"], verbose=False)
    assert res["op4_warc"][0] == "ok", res


BIG = "é" * 60
ROWS = [
    (5, "http://a/1", BIG, "x"), (3, "http://a/2 b\r\nX: y", BIG, "x"), (3, None, BIG, "x"), (None, "u", BIG, "x"),
    (7, "http://a/3", "small", "x"), (8, "http://a/4", "small", "x"), (9, None, None, "x"), (10, "", "", "x"),
    (11, "http://a/5", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "x"), (12, "http://a/6", "long \U0001f600 " * 400_000, "x"),
    (None, "u", "null ids only " * 10, "x"), (None, "u", "null ids only " * 10, "x"),
]


def test_round_trip_of_edge_rows(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/a"
    archive.write_archives(archive.page_records(pages), path, max_file_bytes="2000", split_bytes="100")
    back = archive.read_archives(spark, path)
    got = back.withColumn("page", archive.page_of(F.col("record_id"))).collect()
    assert len(got) == len(ROWS)
    left = [(i, (h or "").encode()) for i, _, h, _ in ROWS]
    for r in got:
        body = next(b for i, b in left if i == r.page and "sha256:" + hashlib.sha256(b).hexdigest() == r.payload_digest)
        left.remove((r.page, body))
        assert r.payload_bytes == len(body)
        if body == BIG.encode() and r.page != 3:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "<urn:page:3>", None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, body)
    assert not left
    # a pushed type and header filter: the same rows, and no payload where none is wanted
    seen = back.where("record_type = 'revisit' and target_uri is not null").collect()
    assert len(seen) == 2 and all(r.record_type == "revisit" for r in seen)
    plan = back.where("record_type = 'revisit'")._jdf.queryExecution().toString()
    assert "Filter (record_type" not in plan.split("== Physical Plan ==")[1]
    bare = archive.read_archives(spark, path, payload="false").collect()
    assert sorted(r.payload_bytes for r in bare) == sorted(r.payload_bytes for r in got)
    assert all(r.payload is None for r in bare)
    # appended archives are read too; an empty table writes none
    archive.write_archives(archive.page_records(pages.where("page_id = 7")), path)
    archive.write_archives(archive.page_records(pages.where("false")), path)
    assert archive.read_archives(spark, path).count() == len(ROWS) + 1
    archive.write_archives(archive.page_records(pages.where("false")), f"{tmp_path}/empty")
    assert archive.read_archives(spark, f"{tmp_path}/empty").count() == 0


def test_files_of_a_failed_task_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string, x string")
    archive.write_archives(archive.page_records(pages), f"{tmp_path}/a")
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert archive.read_archives(spark, f"{tmp_path}/a").count() == 2


@pytest.mark.parametrize("packed", [True, False])
def test_foreign_archives(spark, tmp_path, packed):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n"
    page = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://h/\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\nHTTP/1.0 200 OK\r\nServer: x\r\n\r\n" % (30 + 2_500_000) + b"y" * 2_500_000 + b"\r\n\r\n"
    name = tmp_path / ("b.warc.gz" if packed else "b.warc")
    name.write_bytes(gzip.compress(info) + gzip.compress(page) if packed else info + page)
    got = archive.read_archives(spark, str(tmp_path)).collect()
    assert [r.record_type for r in got] == ["warcinfo", "response"]
    assert bytes(got[0].payload) == b"software:" and bytes(got[1].payload) == b"y" * 2_500_000
    only = archive.read_archives(spark, str(name)).where("record_type in ('response', 'resource')").collect()
    assert [r.target_uri for r in only] == ["http://h/"] and only[0].payload_bytes == 2_500_000


def test_pushed_filters_follow_null_rules():
    from pyspark.sql.datasource import EqualTo, IsNull, Not

    row = dict.fromkeys(warc.HEADERS)
    assert not warc._fits(EqualTo(("refers_to",), "x"), row)
    assert not warc._fits(Not(EqualTo(("refers_to",), "x")), row)
    assert warc._fits(IsNull(("refers_to",)), row) and not warc._fits(Not(IsNull(("refers_to",))), row)


def _reader(path, *tests, **options):
    reader = warc.WarcReader({"path": str(path), **options})
    reader.tests = list(tests)
    return reader


def test_unwanted_payloads_are_not_unpacked(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo

    pages = spark.range(2_000).selectExpr(
        "id as page_id", "concat('http://h/', id) as url",
        "if(id % 10 = 0, repeat('the same page ', 1500), concat(repeat(concat('page ', id, ' '), 1700), id)) as html",
    )
    archive.write_archives(archive.page_records(pages.repartition(2)), str(tmp_path / "a"), split_bytes="200000")
    seen = []
    real = warc._Members.__init__
    monkeypatch.setattr(warc._Members, "__init__", lambda self, *a: (real(self, *a), seen.append(self))[0])
    whole = _reader(tmp_path / "a", split_bytes="100000")
    spans = whole.partitions()
    assert len(spans) > 4
    rows = [r for s in spans for r in whole.read(s)]
    unpacked = sum(m.unpacked for m in seen)
    assert len(rows) == 2_000 and unpacked > 25_000_000
    seen.clear()
    some = _reader(tmp_path / "a", EqualTo(("record_type",), "revisit"))
    assert sorted(r for s in spans for r in some.read(s)) == sorted(r for r in rows if r[1] == "revisit")
    assert len({r[0] for r in rows if r[1] == "revisit"}) == 199
    assert sum(m.unpacked for m in seen) < 0.05 * unpacked
    # other split sizes than the writer's read every record once
    for size in ("1000", "700000", "100000000"):
        other = _reader(tmp_path / "a", split_bytes=size)
        assert sorted(r for s in other.partitions() for r in other.read(s)) == sorted(rows)


def test_members_of_any_kind(tmp_path):
    from pyspark.sql.datasource import EqualTo

    def record(kind, block, type_="application/http; msgtype=response"):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Type: {type_}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    long = bytes(range(256)) * 4_000
    parts = [record("response", http + long), record("request", http + long), record("response", b"no head at all" * 400), record("request", b""),
             record("response", http + b"last")]
    payloads = [long, b"no head at all" * 400, b"last"]
    packed = warc.pack_member(parts[0] + parts[1]) + gzip.compress(parts[2] + parts[3]) + warc.pack_member(parts[4])
    cut = len(parts[0]) + 100  # a record that starts in one member and ends in the next
    plain = b"".join(parts)
    split = warc.pack_member(plain[:cut]) + warc.pack_member(plain[cut:])
    assert gzip.decompress(packed) == plain == gzip.decompress(split)
    for i, data in enumerate((packed, split, plain, gzip.compress(plain))):
        file = tmp_path / f"{i}.warc.gz"
        file.write_bytes(data)
        reader = _reader(file, EqualTo(("record_type",), "response"))
        assert [r[-1] for r in reader.read(reader.partitions()[0])] == payloads
        reader = _reader(file, EqualTo(("record_type",), "request"))
        assert [r[-1] for r in reader.read(reader.partitions()[0])] == [long, b""]


def test_commits_side_by_side_and_overwriting(spark, tmp_path):
    path = str(tmp_path / "a")
    one, two = ({"path": path}, {"path": path})
    rows = [dict.fromkeys([*warc.HEADERS, "payload_bytes", "payload"]) | {"record_type": "response", "target_uri": u} for u in "ab"]
    first, second = warc.WarcWriter(one, False), warc.WarcWriter(two, False)
    told = [w.write(iter([r])) for w, r in zip((first, second), rows)]
    second.commit([told[1], None])
    assert archive.read_archives(spark, path).count() == 1
    first.commit([told[0]])
    assert sorted(r.target_uri for r in archive.read_archives(spark, path).collect()) == ["a", "b"]
    pages = spark.createDataFrame([(1, "c", "")], "page_id long, url string, html string")
    archive.page_records(pages).write.format("warc").mode("overwrite").save(path)
    assert [r.target_uri for r in archive.read_archives(spark, path).collect()] == ["c"]
    lost = warc.WarcWriter(one, False)
    lost.abort([lost.write(iter(rows))])
    assert archive.read_archives(spark, path).count() == 1 and not list((tmp_path / "a").glob("*.tmp"))


def test_paths(spark, tmp_path):
    assert archive.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    with pytest.raises(ValueError, match="no file system"):
        warc._system("dbfs:/x/y")


def test_repeats_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")
    read = lambda: sorted(map(str, archive.page_records(pages).collect()))
    want = read()
    monkeypatch.setattr(archive, "BROADCAST_DIGESTS", 0)
    assert read() == want
