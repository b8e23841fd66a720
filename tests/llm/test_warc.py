import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from vexel.llm import warc
from vexel.llm import zip_archive as za


def brute(rows):
    groups = {}
    for k, _, h in rows:
        groups.setdefault(h or "", []).append(k)
    out = []
    for k, _, h in rows:
        g = groups[h or ""]
        first = min((x for x in g if x is not None), default=None)
        revisit = len(g) > 1 and first is not None and k != first
        p = (h or "").encode()
        out.append((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://x/{i}", f"<p>{i % 7}é</p>" * (i % 7)) for i in range(60)]
ROWS += [(100, None, None), (101, "http://y z/\n", ""), (None, "u", "<p>1é</p>"), (7, "again", ROWS[7][2]), (7, "again", ROWS[7][2]), (102, "big", "x\r\n\r\n" * 400_000), (None, "v", "only"), (None, "w", "only")]


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(spark, tmp_path, zip64):
    df = spark.createDataFrame([(*r, "p", 1) for r in ROWS], "page_id long, url string, html string, payload_digest string, refers_to int").repartition(3)
    path = f"file://{tmp_path}/w"
    got = sorted((tuple(r) for r in warc.round_trip(df, path, zip64).collect()), key=str)
    assert got == brute(ROWS)
    payloads = {r.page_id: r.payload for r in warc.read(spark, path).where("record_type = 'response' and page_id is not null").collect()}
    assert payloads[102] == ("x\r\n\r\n" * 400_000).encode() and payloads[0] == b""
    for f in (tmp_path / "w").glob("*.zip"):  # another library reads them too
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None and set(z.namelist()) == {warc.DATA, warc.INDEX}
            whole = gzip.decompress(z.read(warc.DATA))
            assert whole.count(b"WARC/1.1\r\n") == len(z.read(warc.INDEX).splitlines())
    assert warc.round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_small_packages_and_least_bytes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    made = warc.write(df, path, package_bytes=600, least=10**9).collect()
    assert len(made) > 3 and sum(r.records for r in made) == len(ROWS)
    got = warc.read(spark, path).collect()
    assert len(got) == len(ROWS) and {r.record_type for r in got} == {"response"}


def test_directories():
    for zip64 in (False, True):
        data = b"".join(za.build([("a", b"123"), ("ü/b", b""), ("c", b"x" * 999)], zip64))
        f = io.BytesIO(data)
        found = za.directory(f, len(data))
        assert list(found) == ["a", "ü/b", "c"] and zipfile.ZipFile(f).read("c") == b"x" * 999
        assert za.read_range(f, za.data_start(f, found["a"]), 1, 2) == b"23"
    many = b"".join(za.build([(str(i), b"") for i in range(66_000)]))  # more entries than 16 bits count
    assert len(za.directory(io.BytesIO(many), len(many))) == 66_000
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:  # written by another library, with a comment that holds the signature
        z.writestr("m", b"stored")
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"xxPK\x05\x06" + b"y" * 40
    raw = other.getvalue()
    f = io.BytesIO(raw)
    found = za.directory(f, len(raw))
    assert za.read_range(f, za.data_start(f, found["m"]), 0, 6) == b"stored"
    with pytest.raises(ValueError):
        za.data_start(f, found["d"])
    with pytest.raises(ValueError):
        za.directory(io.BytesIO(b"no archive" * 9), 90)
