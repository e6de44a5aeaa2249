import gzip
import hashlib
import zlib

import pytest

from fourfold.llm.warc import normalise, parse, read_archives, record, records_of, round_trip, typed, write_monolithic


def test_records_of_any_piece_size():
    raws = [record(i, "http://x/ä", ("é" * i * 37).encode(), "response", None, hashlib.sha1(b"").digest()) for i in range(20)]
    mono, members = gzip.compress(b"".join(raws)), b"".join(gzip.compress(r) for r in raws)
    for blob in (mono, members):
        for step in (1, 7, 1000, len(blob)):
            assert list(records_of(blob[i : i + step] for i in range(0, len(blob), step))) == raws
    with pytest.raises(ValueError):
        list(records_of([gzip.compress(raws[0][:-3])]))


def test_round_trip(spark):
    big, other = "é" * 600, "y" * 1000
    rows = [(1, "u", big), (2, "u", big), (7, None, big), (3, "u", other), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "a\r\nb", None), (None, "u", other), (8, "u", ""), (7, "u", big), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]
    df = spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in rows], "page_id long, url string, html string, d string, of int").repartition(3)
    got = round_trip(spark, df, archive_bytes=1500).collect()
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        twins = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        again = len(raw) >= 1000 and p != max(twins, default=None)
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(twins) if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert round_trip(spark, df.limit(0)).count() == 0


def test_members_stand_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(30)], "page_id long, url string, html string").coalesce(2)
    manifest = normalise(write_monolithic(typed(df), f"file://{tmp_path}/a"), f"file://{tmp_path}/b")
    assert sum(r.records for r in manifest.collect()) == 30
    for r in manifest.collect():
        blob = open(r.path, "rb").read()
        for line in open(r["index"]):
            offset, length, kind, _ = __import__("json").loads(line)
            one = zlib.decompressobj(31)
            parsed = parse(one.decompress(blob[offset : offset + length]))
            assert one.eof and not one.unused_data and parsed["WARC-Type"] == kind
    assert read_archives(manifest, f"file://{tmp_path}/b").count() == 30


def test_a_stream_packed_very_well_is_inflated_in_pieces():
    """Payloads near and beyond the size of a piece, a gigabyte's worth of zeros scaled down, several streams one after another."""
    import zlib

    from fourfold.llm import warc

    record = lambda n, c: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + c * n + b"\r\n\r\n"
    sizes = [0, 1, warc._PIECE - 40, warc._PIECE, warc._PIECE + 1, 40 << 20, 7]
    whole = [record(n, b"\0") for n in sizes]
    pack = lambda x: (lambda z: z.compress(x) + z.flush())(zlib.compressobj(9, zlib.DEFLATED, 31))
    for stream in (pack(b"".join(whole)), pack(b"".join(whole[:3])) + pack(b"".join(whole[3:]))):
        pieces = (stream[i : i + 1000] for i in range(0, len(stream), 1000))
        assert [len(x) for x in warc.records_of(pieces)] == [len(x) for x in whole]
