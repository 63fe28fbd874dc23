"""WARC archives as a Python data source.

``df.write.format("warc")`` writes one record per row; files roll at
``max_file_bytes`` and each record is a gzip member of its own, whose header
tells its packed and plain length (extra field ``sl``). Beside each file lie
its split marks, the offsets of members about ``split_bytes`` apart. A task
writes under a name no other attempt has; only files of committed tasks enter a
manifest, one for each commit, put in place by a rename. So a lost executor or
a repeated task leaves nothing a reader sees, and appends that run side by side
keep each other's files.

``spark.read.format("warc")`` plans a partition for every ``split_bytes`` of a
file; the task finds its members by the marks (archives without a manifest: a
partition a file). Filters on record type and on header columns are pushed
down: a few hundred bytes of a member are unpacked until its header ends, and
what is left of an unwanted record is passed over by seeking to the next
member. Archives of other writers lack the lengths; their unwanted blocks have
to be unpacked to find their end, and are dropped piece by piece. Option
``payload=false`` leaves out all payloads.

Paths are local ones, ``file:`` or any scheme Arrow's file systems know
(``s3a:`` is read as ``s3:``). A path without a scheme is each machine's own;
``archive.write_archives`` and ``read_archives`` qualify it by the cluster's
default file system first, as Spark's own sources do.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)

MANIFEST = "_manifest-"
MARKS = ".marks"
#: Columns read from headers, and the headers they come from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    except Exception as e:
        raise ValueError(f"no file system for {path}: use file:, s3a:, hdfs:, gs: or abfss:") from e


def _value(text: str) -> str:
    """Without characters that end a header."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(row) -> bytes:
    """A response or revisit record; its block is the HTTP head, and the
    payload for a response. The head's length is the whole payload's, also in
    a revisit, which has none."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else bytes(row["payload"] or b"")
    length = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
    block = http.encode() + payload
    head = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row[column]
        if column == "date" and value is None:
            value = DATE
        if value is not None:
            head.append(f"{name}: {_value(value)}")
    if revisit:
        head.append(f"WARC-Profile: {PROFILE}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack_member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with both its lengths in the extra field ``sl`` (two
    little-endian 32-bit numbers); without it where they do not fit."""
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(record) + pack.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = 10 + 2 + 12 + len(body) + len(tail)
    if max(whole, len(record)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _put(system: pafs.FileSystem, path: str, value) -> None:
    """JSON under a name of its own first, then renamed: never seen half."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside, compression=None) as out:
        out.write(json.dumps(value).encode())
    system.move(aside, path)


def _get(system: pafs.FileSystem, path: str):
    with system.open_input_stream(path, compression=None) as f:
        return json.loads(f.read())


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.max_bytes = int(options.get("max_file_bytes", 256 << 20))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.level = int(options.get("level", 1))
        self.overwrite = overwrite

    def write(self, rows: Iterator) -> _Written:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, name, size, marks = None, "", 0, [0]

        def closed() -> None:
            out.close()
            _put(system, f"{root}/{name}{MARKS}", marks)
            files.append((name, size))

        try:
            for row in rows:
                if out is None or size >= self.max_bytes:
                    if out is not None:
                        closed()
                    name, size, marks = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                if size - marks[-1] >= self.split:
                    marks.append(size)
                member = pack_member(encode_record(row), self.level)
                out.write(member)
                size += len(member)
            if out is not None:
                closed()
        finally:
            if out is not None and not out.closed:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        older = _manifests(system, root) if self.overwrite else []
        _put(system, f"{root}/{MANIFEST}{uuid.uuid4().hex}.json", {"replaces": older, "files": files})

    def abort(self, messages: list[_Written | None]) -> None:
        system, root = _system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                for path in (f"{root}/{name}", f"{root}/{name}{MARKS}"):
                    if system.get_file_info(path).type == pafs.FileType.File:
                        system.delete_file(path)


def _manifests(system: pafs.FileSystem, root: str) -> list[str]:
    found = system.get_file_info(pafs.FileSelector(root))
    return sorted(x.base_name for x in found if re.fullmatch(MANIFEST + r"[0-9a-f]+\.json", x.base_name))


def _committed(system: pafs.FileSystem, root: str) -> list[tuple[str, int]] | None:
    """Names and sizes of the committed files, without those of commits that
    a later one replaced; None where nothing was committed."""
    names = _manifests(system, root)
    if not names:
        return None
    read = {n: _get(system, f"{root}/{n}") for n in names}
    gone = {n for m in read.values() for n in m["replaces"]}
    return [tuple(f) for n in names if n not in gone for f in read[n]["files"]]


@dataclass
class Span(InputPartition):
    """The members of a file that start from one byte up to another (``end``
    -1: the whole file, which may lack marks)."""

    file: str
    start: int
    end: int


#: Bytes read at once, and bytes of a packed member unpacked first to see its
#: header.
CHUNK = 1 << 18
PEEK = 512
#: Bytes of a partition, as far as the marks allow.
SPLIT_BYTES = 8 << 20


class _Members:
    """The plain bytes of a run of gzip members (or of an archive that is not
    packed), read as far as asked for. ``unpacked`` counts them."""

    def __init__(self, file, start: int, end: int):
        self.file, self.at = file, start
        self.end = end if end >= 0 else file.size()
        file.seek(start)
        self.ready = self.raw = b""
        self.unpack = None
        self.member: tuple[int, int] | None = None  # its end in the file, bytes it has left to give
        self.unpacked = 0
        self._fill(2)
        self.packed = self.raw[:2] == b"\x1f\x8b"

    def _fill(self, n: int) -> bool:
        """At least ``n`` raw bytes at hand, if there are as many."""
        while len(self.raw) < n and self.at < self.end:
            data = self.file.read(min(CHUNK, self.end - self.at))
            if not data:
                self.at = self.end
                break
            self.at += len(data)
            self.raw += data
        return len(self.raw) >= n

    def _open(self) -> bool:
        """The next member, with its lengths if it tells them."""
        if not self._fill(1):
            return False
        self.unpack, self.member = zlib.decompressobj(31), None
        begin = self.at - len(self.raw)
        if self._fill(24) and self.raw[3] & 4 and self.raw[12:16] == b"sl\x08\0":
            packed, plain = struct.unpack_from("<II", self.raw, 16)
            self.member = (begin + packed, plain)
        return True

    def _more(self, most: int) -> bool:
        if not self.packed:
            if not self._fill(1):
                return False
            self.ready, self.raw = self.ready + self.raw, b""
            return True
        while True:
            if (self.unpack is None or self.unpack.eof) and not self._open():
                return False
            if not self._fill(1):
                return False
            data = self.unpack.decompress(self.raw, most)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if data:
                self.unpacked += len(data)
                if self.member:
                    self.member = (self.member[0], self.member[1] - len(data))
                self.ready += data
                return True

    def until(self, mark: bytes, limit: int | None = None) -> bytes | None:
        """All up to and with ``mark``; None at the end, or where the next
        ``limit`` bytes do not hold it (then nothing is taken)."""
        step = PEEK
        while (at := self.ready.find(mark)) < 0 or (limit is not None and at + len(mark) > limit):
            if limit is not None and len(self.ready) >= limit or not self._more(step):
                return None
            step *= 2
        out, self.ready = self.ready[: at + len(mark)], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have + len(self.ready) < n:
            parts.append(self.ready)
            have += len(self.ready)
            self.ready = b""
            if not self._more(CHUNK):
                break
        parts.append(self.ready[: n - have])
        self.ready = self.ready[n - have :]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n > len(self.ready):
            n -= len(self.ready)
            self.ready = b""
            if not self.packed:
                ahead = self.at - len(self.raw) + n
                self._jump(min(ahead, self.end))
                return
            if self.member and n >= self.member[1] and not self.unpack.eof:
                end, left = self.member
                n -= left
                self._jump(end)
                self.unpack = self.member = None
            elif not self._more(CHUNK):
                return
        self.ready = self.ready[n:]

    def _jump(self, to: int) -> None:
        """Raw bytes go on at a place of the file."""
        have = to - (self.at - len(self.raw))
        if have <= len(self.raw):
            self.raw = self.raw[have:]
        else:
            self.raw, self.at = b"", to
            self.file.seek(to)


def _fits(test, row: dict) -> bool:
    """A pushed filter over header columns; null rows fail, as in SQL."""
    if isinstance(test, Not):
        inner = test.child
        if isinstance(inner, EqualNullSafe | IsNull | IsNotNull):
            return not _fits(inner, row)
        return row[inner.attribute[0]] is not None and not _fits(inner, row)
    value = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None:
        return False
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    return value.startswith(test.value)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tests: list = []

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        """Keeps what the headers decide; Spark gets the rest back."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            known = isinstance(inner, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith)
            if known and len(inner.attribute) == 1 and inner.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Span]:
        system, root = _system(self.path)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Span(root, 0, -1)]
        files = _committed(system, root)
        if files is not None:
            return [
                Span(f"{root}/{name}", a, min(a + self.split, size))
                for name, size in files
                for a in range(0, size, self.split)
            ]
        found = system.get_file_info(pafs.FileSelector(root, recursive=True))
        return [Span(x.path, 0, -1) for x in found if re.search(r"\.warc(\.gz)?$", x.path)]

    def read(self, span: Span) -> Iterator[tuple]:
        if span is None:
            return
        system, _ = _system(self.path)
        start, end = span.start, span.end
        if end >= 0:
            marks = _get(system, f"{span.file}{MARKS}")
            first, last = bisect_left(marks, start), bisect_left(marks, end)
            if first == last:
                return
            start, end = marks[first], marks[last] if last < len(marks) else -1
        with system.open_input_file(span.file) as f:
            members = _Members(f, start, end)
            while (head := members.until(b"\r\n\r\n")) is not None:
                lines = head.decode("utf-8", "replace").strip().split("\r\n")
                fields = {}
                for line in lines[1:]:
                    name, _, value = line.partition(":")
                    fields.setdefault(name.strip().lower(), value.strip())
                length = int(fields.get("content-length", 0))
                row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                if not all(_fits(t, row) for t in self.tests):
                    members.skip(length + 4)
                    continue
                size, payload = self._block(members, length, fields)
                members.skip(4)
                yield (*row.values(), size, payload)

    def _block(self, members: _Members, length: int, fields: dict[str, str]) -> tuple[int, bytes | None]:
        """Length of the whole payload, and the payload if it is wanted and
        there (a revisit has none)."""
        if not fields.get("content-type", "").startswith("application/http"):
            if self.payload:
                return length, members.take(length)
            members.skip(length)
            return length, None
        http = members.until(b"\r\n\r\n", length) or b""
        left = length - len(http)
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        revisit = fields.get("warc-type") == "revisit"
        size = int(told[1]) if told and (revisit or not left) else left
        if revisit or not self.payload:
            members.skip(left)
            return size, None
        return size, members.take(left)


class WarcSource(DataSource):
    """See the module's docstring. Columns: ``SCHEMA``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)
