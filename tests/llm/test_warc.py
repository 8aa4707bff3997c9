import gzip
import hashlib
import io
import struct
import zipfile

import pytest

from bowline.llm import warc
from bowline.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, record_type string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def expected(rows):
    kept = {}
    copies = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            copies[raw] = copies.get(raw, 0) + 1
            if i is not None:
                kept[raw] = max(kept.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = kept.get(raw) if copies.get(raw, 0) > 1 and kept.get(raw) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return out


ROWS = [(1, "http://a/", "x" * 1000), (5, "http://b/é", "x" * 1000), (3, None, "x" * 1000), (4, "u\r\nv", "x" * 999),
        (6, "http://c/", "x" * 999), (7, "http://d/", None), (8, "http://e/", ""), (9, "", "é" * 700),
        (10, "http://f/", "é" * 700), (None, "http://g/", "é" * 700), (11, "http://h/", "line\r\n\r\nWARC/1.1\r\n" * 90),
        (12, "http://i/", "y" * 300_000), (5, "http://b/é", "x" * 1000)]


def key(r):
    return tuple((x is None, x) for x in r)


def test_round_trip(spark, table_dir):
    got = QUERIES["op1_warc"](spark, table_dir(pages=pages(spark, ROWS))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(ROWS), key=key)


def test_all_ids_null_and_empty_table(spark, table_dir):
    rows = [(None, "u", "z" * 2000)] * 3
    got = QUERIES["op1_warc"](spark, table_dir(pages=pages(spark, rows))).collect()
    assert sorted(map(tuple, got), key=key) == sorted(expected(rows), key=key)
    assert QUERIES["op1_warc"](spark, table_dir(pages=pages(spark, []))).count() == 0


def test_packages_hold_standard_records(spark, tmp_path):
    manifest = warc.write_packages(warc.revisits(pages(spark, ROWS).select("page_id", "url", "html")),
                                   f"file://{tmp_path}/w", max_records=4)
    seen = 0
    for r in manifest.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None
            assert {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            whole = gzip.decompress(z.read("archive/data.warc.gz"))
            assert whole.count(b"WARC-Record-ID:") >= r["records"] and r["records"] <= 4
            assert len(z.read("indexes/index.cdxj").decode().splitlines()) == r["records"]
        seen += r["records"]
    assert seen == len(ROWS)
    payloads = {r["record_id"]: bytes(r["payload"]) for r in warc.read_packages(manifest).collect()
                if r["record_type"] == "response"}
    assert payloads["<urn:x-page:12>"] == b"y" * 300_000
    assert payloads["<urn:x-page:11>"] == ROWS[10][2].encode()


def reader(raw):
    return lambda at, n: raw[at:at + n]


def package(members, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


RECORDS = [warc.warc_record(i, f"http://x/{i}", b"p" * i, "0" * 40, None) for i in (1, 50, 0)]


@pytest.mark.parametrize("gz", [True, False])
def test_members_without_an_index_are_scanned(gz):
    parts = [gzip.compress(r) if gz else r for r in RECORDS]
    raw = package([("archive/a.warc" + ".gz" * gz, b"".join(parts)), ("other.txt", b"n")], comment=b"PK\x05\x06 odd")
    got = list(warc.list_records(reader(raw), len(raw)))
    assert [raw[at:at + n] for _, at, n in got] == parts


def test_zip64_and_prefix(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = package([("archive/a.warc", b"".join(RECORDS)), ("b.bin", b"12345678901234")])
    assert b"PK\x06\x07" in raw
    for prefix in (b"", b"some bytes in front"):
        whole = prefix + raw
        got = list(warc.list_records(reader(whole), len(whole)))
        assert [whole[at:at + n] for _, at, n in got] == RECORDS


def test_zip64_marks_are_followed():
    extra = struct.pack("<HHH", 7, 2, 0) + struct.pack("<HHQQ", 1, 16, 1 << 33, 1 << 34)
    assert warc._zip64(extra, [warc.MAX32, 9, warc.MAX32]) == [1 << 33, 9, 1 << 34]


def test_unreadable_packages():
    raw = package([("archive/a.warc", b"".join(RECORDS))], zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(warc.list_records(reader(raw), len(raw)))
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.zip_members(reader(b"nothing here"), 12)


def written(spark, tmp_path, raw):
    (tmp_path / "p.wacz").write_bytes(raw)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/p.wacz", len(raw))], "path string, bytes long")
    return sorted(bytes(r["payload"]) for r in warc.read_packages(manifest).collect())


PAYLOADS = sorted(b"p" * i for i in (1, 50, 0))


@pytest.mark.parametrize("cut", [[0, 3], [0, 1, 3], [0, 2, 3]])
def test_gzip_streams_of_many_records_lose_none(spark, tmp_path, cut):
    streams = [gzip.compress(b"".join(RECORDS[a:b])) for a, b in zip(cut, cut[1:])]
    assert written(spark, tmp_path, package([("archive/a.warc.gz", b"".join(streams))])) == PAYLOADS


def test_a_last_record_without_line_ends(spark, tmp_path):
    whole = gzip.compress(b"".join(RECORDS)[:-4])
    assert written(spark, tmp_path, package([("archive/a.warc.gz", whole)])) == PAYLOADS


@pytest.mark.parametrize("named", [[], [0], [1], [2], [0, 2], [1, 1], [0, 1, 2]])
@pytest.mark.parametrize("gz", [True, False])
def test_what_an_index_leaves_out_is_scanned(spark, tmp_path, named, gz):
    import json
    parts = [gzip.compress(r) if gz else r for r in RECORDS]
    at = [sum(map(len, parts[:i])) for i in range(3)]
    name = "a.warc" + ".gz" * gz
    index = "".join("k 2020 " + json.dumps({"filename": name, "offset": str(at[i]), "length": str(len(parts[i]))}) + "\n" for i in named)
    assert written(spark, tmp_path, package([("archive/" + name, b"".join(parts)), ("indexes/index.cdxj", index)])) == PAYLOADS


def test_records_of_a_stream_come_one_at_a_time():
    big = [warc.warc_record(i, "http://x/", bytes([i % 251]) * (i * 7000), "0" * 40, None) for i in range(40)]
    assert list(warc.unpacked(gzip.compress(b"".join(big[:25])) + gzip.compress(b"".join(big[25:])), True, 1000)) == big
