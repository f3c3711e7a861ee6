import hashlib
import io
import zipfile

import pyarrow.fs as pafs
import pytest

from dosefold.llm import archives
from dosefold.session import scratch_folder

SCHEMA = "page_id long, url string, html string, digest string, refers_to int"
BIG = "<p>" + "x" * 1200


def rows():
    out = [(1, "http://a/", BIG, "", 1), (2, "http://b/", BIG, "", 1), (3, None, None, None, None), (4, "u v\r\nX: y", "short", "", 0)]
    out += [(5, "c", "short", "", 1), (6, "d", BIG + "é", "", 1), (7, "d", BIG + "é", "", 1), (7, "d", BIG + "é", "", 1), (None, "n", BIG, "", 1)]
    return out + [(100 + i, "hot", BIG * 3, "", 1) for i in range(200)] + [(None, "only", BIG * 2, "", 0), (None, "only", BIG * 2, "", 0)]


def brute(given):
    top = {}
    for page_id, _, html, *_ in given:
        top[html or ""] = max(top.get(html or "") or -1, -1 if page_id is None else page_id)
    out = []
    for page_id, _, html, *_ in given:
        data, first = (html or "").encode(), top[html or ""]
        revisit = len(data) >= 1000 and first >= 0 and page_id != first
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = archives.archive_round_trip(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows())


def test_empty_table(spark):
    assert archives.archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_packages_are_plain_zip_and_gzip(spark):
    import gzip

    folder = scratch_folder(spark, "archives-test")
    packages = archives.write_archives(spark.createDataFrame(rows(), SCHEMA), folder, limit=300)
    names = packages.collect()
    assert len(names) > 10 and sum(r.records for r in names) == len(rows())
    with zipfile.ZipFile(f"{folder}/{names[0].name}") as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
        assert gzip.decompress(z.read(archives.DATA)).startswith(b"WARC/1.1\r\n")


class Sparse:
    """A package of which only some ranges exist."""

    def __init__(self, parts, size):
        self.parts, self.size = parts, size

    def read(self, offset, length):
        for at, data in self.parts:
            if at <= offset < at + len(data):
                return data[offset - at : offset - at + length]
        return b"\0" * length


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 inside"])
def test_directory_matches_zipfile(comment):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/é.txt", b"one")
        z.writestr(zipfile.ZipInfo("b"), b"two" * 9)
        z.comment = comment
    data = out.getvalue()
    read = lambda o, n: data[o : o + n]
    found = archives.directory(read, len(data))
    assert list(found) == ["a/é.txt", "b"]
    at, n = archives.stored_range(read, found["b"])
    assert data[at : at + n] == b"two" * 9


def test_zip64_fields():
    import struct

    far = 5 << 32
    extra = struct.pack("<HHQQQ", 1, 24, far, far, far + 7)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"z" + extra
    base = 20 << 32
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), base)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, base + len(entry), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    tail = entry + end64 + locator + end
    size = base + len(tail)
    window = 65535 + 22 + 20
    source = Sparse([(base, tail), (size - window, b"\0" * (window - len(tail)) + tail)], size)
    assert archives.directory(source.read, size) == {"z": (0, far + 7, far, far)}


def test_compressed_member_is_refused():
    with pytest.raises(ValueError):
        archives.stored_range(lambda o, n: b"", (8, 0, 1, 1))


def test_broken_record_is_refused():
    good = archives.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert archives.parse_record(good)[:2] == (1, 3)
    with pytest.raises(ValueError):
        archives.parse_record(good.replace(b"abc", b"abd"))
