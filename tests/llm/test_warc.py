import hashlib
import io

import pytest

from slidegrid.llm import warc


def test_round_trip_with_odd_rows(spark):
    long, other = "<p>" + "é" * 200, "z" * 99
    rows = [(3, "u", long, 1), (1, "v w", long, 1), (2, None, long, 1), (1, "v w", long, 1), (4, "", other, 1), (5, "", other, 1), (6, "x", None, 1), (7, "x", "", 1), (None, "n", long, 1), (8, "big", "ab" * 400_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    out = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    payload = lambda h: (h or "").encode()
    want = []
    for i, _, h, _ in rows:
        kind, to = ("revisit", 1) if h == long and i != 1 else ("response", None)
        want.append((i, len(payload(h)), hashlib.sha256(payload(h)).hexdigest(), kind, to))
    assert out == sorted(want, key=str)


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reader_is_sequential_and_verifies():
    data = b"".join(warc.record_bytes("response", i, f"u{i}", bytes([i]) * 70_000 * i) for i in range(4))
    assert [(h["X-Page-ID"], len(b)) for h, b in warc.read_records(io.BytesIO(data))] == [(str(i), 70_000 * i) for i in range(4)]
    import gzip

    plain = gzip.decompress(warc.record_bytes("response", 1, "u", b"abc"))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(gzip.compress(plain.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(data[:-20])))


def test_missing_archive_raises(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 40) for i in range(300)], "page_id long, url string, html string").repartition(3)
    manifest = warc.write(pages, str(tmp_path / "a"))
    assert warc.read(manifest, str(tmp_path / "a")).count() == 300
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) == 3
    files[1].unlink()
    with pytest.raises(FileNotFoundError, match=f"missing archive {files[1].name}"):
        warc.read(manifest, str(tmp_path / "a")).count()


def test_folder_without_scheme_is_resolved(spark, tmp_path):
    assert warc.whole_uri(spark, str(tmp_path)) == f"file://{tmp_path}" == warc.whole_uri(spark, f"file://{tmp_path}") == warc.whole_uri(spark, f"file:{tmp_path}")
