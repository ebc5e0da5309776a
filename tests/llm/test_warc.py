from __future__ import annotations

import hashlib
import io
import zipfile

import pytest

from corpuslens.llm import warc

PAGES = "page_id long, url string, html string, payload string"


class Sink(io.BytesIO):
    pass


@pytest.mark.parametrize("zip64", [False, True])
def test_package_is_a_zip_file(zip64):
    out = Sink()
    writer = warc.PackageWriter(out, zip64=zip64)
    writer.member("a/b.bin", iter([b"abc", b"defg"]))
    writer.member("c", iter([]))
    writer.close()
    raw = out.getvalue()
    reader = warc.PackageReader(io.BytesIO(raw), len(raw))
    assert reader.range("a/b.bin", 2, 3) == b"cde" and reader.members["c"][1] == 0
    with pytest.raises(ValueError):
        reader.range("a/b.bin", 5, 3)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.read("a/b.bin") == b"abcdefg" and z.testzip() is None


def test_reads_foreign_zip_with_comment_and_deflated_member():
    out = Sink()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored")
        z.writestr("d", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a note"[4:]
    raw = out.getvalue()
    reader = warc.PackageReader(io.BytesIO(raw), len(raw))
    assert set(reader.members) == {"s"} and reader.range("s", 0, 6) == b"stored"
    with pytest.raises(ValueError):
        warc.PackageReader(io.BytesIO(b"not a zip"), 9)


def test_round_trip_equals_brute_force(spark):
    long_ = "é" * 600
    pages = [(1, "http://a/\r\nx", long_, "k"), (5, None, long_, "k"), (3, "u", long_, None), (5, None, long_, "k")]
    pages += [(6, "u", "x" * 999, ""), (7, "u", "x" * 999, ""), (8, "u", None, ""), (9, "u", "", ""), (None, "u", long_, "")]
    pages += [(20 + k, "u", "y" * 300_000 + str(k % 2), "") for k in range(6)] + [(40, "u", "a\r\n\r\nb\0", "")]
    manifest = warc.write_packages(spark.createDataFrame(pages, PAGES), package_bytes=400_000)
    got = warc.read_packages(manifest, range_bytes=1000).collect()
    want = []
    for page, _, html, _ in pages:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in pages if p is not None and (h or "").encode() == payload]
        last = max(same, default=None)
        again = page is not None and len(payload) >= 1000 and page < last
        want.append((str(page) if page is not None else None, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", str(last) if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {bytes(r.payload) for r in got if r.page_id == "40"} == {b"a\r\n\r\nb\0"}


def test_empty_table(spark):
    assert warc.read_packages(warc.write_packages(spark.createDataFrame([], PAGES))).count() == 0
