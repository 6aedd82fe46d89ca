import hashlib
import random
import struct

import pytest
import zstandard

from docpairs.llm import warc as W


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")
    return make


def brute(rows):
    out = {}
    for i, _, h in rows:
        body = (h or "").encode()
        group = [j for j, _, k in rows if (k or "").encode() == body]
        revisit = len(body) >= 1000 and i != max(group)
        out[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(group) if revisit else None)
    return out


def test_round_trip_against_brute_force(spark, pages):
    rnd = random.Random(0)
    bodies = ["short", None, "", "é" * 500, "x" * 999, "y" * 1000, "é\r\n\r\nWARC/1.1 " * 100, "z" * 400000]
    rows = [(i, None if i % 5 == 0 else f"http://h/{i}\r\n", rnd.choice(bodies)) for i in range(1, 120)]
    got = {r.page_id: tuple(r)[1:] for r in W.round_trip(spark, pages(rows)).collect()}
    assert got == brute(rows)


def test_payloads_come_back_and_archives_roll(spark, pages, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i}</p>" * 300) for i in range(50)]
    made = W.write_pages(pages(rows), f"file://{tmp_path}/a", roll_bytes=20000).collect()
    assert sum(r.records for r in made) == 50 and len(made) > 5
    back = W.read_pages(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in back) == rows and not any(r.error for r in back)


def test_repeated_rows_null_ids_and_empty_table(spark, pages):
    body = "b" * 2000
    got = W.round_trip(spark, pages([(3, "u", body), (3, "u", body), (1, "u", body), (None, "u", body)])).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "response", None), (1, "revisit", 3), (3, "response", None), (3, "response", None)]
    assert W.round_trip(spark, pages([(1, "u", "b")]).limit(0)).count() == 0


RECORD = W.page_record(7, "http://x", b"payload", None)


@pytest.mark.parametrize("change, error", [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/0.9"), "version line"),
    (lambda r: r.replace(b"WARC-Date", b"X-Date"), "no warc-date"),
    (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response"), "header line"),
    (lambda r: r.replace(b"\r\n\r\n", b"\r\n", 1).replace(b"\r\n\r\n", b"", 9), "no end of headers"),
    (lambda r: r[:-5], "block length"),
    (lambda r: r[:-4] + b"abcd", "record trailer"),
    (lambda r: r.replace(b"payload\r\n\r\n", b"paylaod\r\n\r\n"), "block digest"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Type: response\r\nWARC-Date"), "repeated header WARC-Type"),
])
def test_bad_records_are_told_apart(change, error):
    assert W.http_payload(W.parse_record(RECORD)[1]) == b"payload"
    with pytest.raises(W.BadRecord, match=error):
        W.parse_record(change(RECORD))


def test_archive_layout_and_damage():
    records = [W.page_record(i, f"http://x/{i}", b"body %d " % i * 50, None) for i in range(30)]
    data = W.write_archive(records, records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == W.DICTIONARY_MAGIC
    assert [r for _, r, e in W.read_archive(data) if e is None] == records
    # One frame per record: each decodes alone with the dictionary of the leading frame.
    offsets = [at for at, _, _ in W.read_archive(data)]
    assert len(offsets) == 30 and offsets[0] == 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    assert reader.decompress(data[offsets[7]:offsets[8]]) == records[7]
    cut = list(W.read_archive(data[:-10]))
    assert [r for _, r, e in cut if e is None] == records[:-1] and cut[-1][2] == "frame cut short"
    bad = bytearray(data)
    bad[offsets[3] + 12] ^= 0xFF
    got = list(W.read_archive(bytes(bad)))
    assert any(e for _, _, e in got) and [r for _, r, e in got if e is None][-1] == records[-1]
    assert list(W.read_archive(b"junk"))[0][2] == "no dictionary frame"
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])  # a compressed dictionary
    again = struct.pack("<II", magic, len(packed)) + packed + data[8 + size:]
    assert [r for _, r, _ in W.read_archive(again)] == records


def test_errors_become_rows(spark, tmp_path):
    good = W.page_record(1, "u", b"x" * 50, None)
    W.save_file(f"file://{tmp_path}/b", "a.warc.zst", W.write_archive([good, good.replace(b"WARC/1.1", b"HARC/1.1"), good], [good]))
    got = W.read_pages(spark, f"file://{tmp_path}/b").orderBy("frame_at").collect()
    assert [r.error for r in got] == [None, "version line", None]
