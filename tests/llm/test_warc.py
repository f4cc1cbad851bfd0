import hashlib
import io
import struct

import pytest
import zstandard

from tallyglass.llm import warc

PAGES = "page_id long, url string, html string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], PAGES)


def plain(rows):
    least = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= 100 and i is not None:
            least[body] = min(least.get(body, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        to = least.get(body)
        revisit = to is not None and i != to
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def corpus():
    page = lambda k: f"<html><head><title>{k}</title></head><body>{'<p>some text é 北 ' * (k % 40 + 5)}</body></html>"
    rows = [(k, f"https://a.example/{k}", page(k)) for k in range(300)]
    rows += [(1000 + k, f"https://b.example/{k}\r\nX-Evil: 1", page(7)) for k in range(150)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "u", "x" * 99), (2003, "u", "x" * 99), (2004, "u", "y" * 100), (2005, "u", "y" * 100)]
    rows += [(2006, "u", "\r\n\r\nWARC/1.1\r\n" * 40), (2007, "u", "z" * 3_000_000), (None, "u", page(7)), (5, "u", page(5))]
    return rows


def test_round_trip(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages(spark, rows)).collect()), key=str)
    assert got == plain(rows)


def test_archives_roll_over_and_empty_table(spark, monkeypatch, tmp_path):
    assert warc.round_trip(spark, pages(spark, corpus()).limit(0)).count() == 0
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    rows = [(k, "u", f"{k}" * 300) for k in range(200)]
    archives = warc.write_archives(pages(spark, rows).coalesce(1), f"file://{tmp_path}")
    assert archives.count() > 2
    assert sorted((tuple(r) for r in warc.read_archives(archives).collect()), key=str) == plain(rows)


def archive(tmp_path, records, dictionary):
    made = warc.Archive(str(tmp_path), dictionary)
    for r in records:
        made.add(r)
    return open(made.close()[0], "rb").read()


def test_format_of_an_archive(tmp_path):
    records = [warc.record(k, "u", f"<p>{k} words and more words</p>".encode() * 9, hashlib.sha256(f"<p>{k} words and more words</p>".encode() * 9).hexdigest()) for k in range(80)]
    known = warc.train_dictionary(records)
    assert known
    raw = archive(tmp_path, records, known)
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D and raw[8 : 8 + size] == known
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)).decompressobj()
    assert first.decompress(raw[8 + size :]) == records[0]
    assert list(warc.frames(io.BytesIO(raw).read)) == records
    assert list(warc.frames(lambda n, b=io.BytesIO(raw): b.read(7))) == records
    assert list(warc.frames(io.BytesIO(archive(tmp_path, records[:3], b"")).read)) == records[:3]
    packed = zstandard.ZstdCompressor().compress(known)
    assert list(warc.frames(io.BytesIO(struct.pack("<II", magic, len(packed)) + packed + raw[8 + size :]).read)) == records
    for end in (3, 20, size, len(raw) - 3):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(raw[:end]).read))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(raw[8 + size :]).read))


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"WARC/9.1"),
        (b"WARC-Date: ", b"WARC-Dote: "),
        (b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: 1"),
        (b"Content-Length: 5", b"Content-Length: 6"),
        (b"hello", b"jello"),
        (b"WARC-Type: response", b"WARC-Type response"),
        (b"hello\r\n\r\n", b"hello\r\n"),
    ],
)
def test_broken_records_are_refused(old, new):
    good = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest())
    assert warc.parse(good)["payload"] == b"hello"
    assert old in good
    with pytest.raises(warc.WarcError):
        warc.parse(good.replace(old, new, 1))
