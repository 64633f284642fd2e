"""op6's reader against a plain walk over a file's bytes: records inside records, split files, empty files, gzip members."""

import gzip
import random

import pytest

from ladderwork.llm import warc


def made(n, seed):
    """WARC bytes whose bodies hold archived records, and their records by a plain reader's account."""
    rng, data, want = random.Random(seed), b"", []
    for i in range(n):
        inner = b"".join(b"WARC/1.0\r\nWARC-Type: fake\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (rng.randint(0, 90), b"x" * rng.randint(0, 40)) for _ in range(rng.randint(0, 4)))
        body = rng.choice([b"plain text %d" % i, b"", b"a\r\n\r\n" + inner + b"tail", inner, b"\r\n\r\nWARC/1.1\r\nno head", b"y" * 3000])
        head = b"WARC/1.%d\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d:%d>\r\nContent-Length: %d\r\n\r\n" % (i % 2, seed, i, len(body))
        data += head + body + b"\r\n\r\n"
        want.append(("<urn:%d:%d>" % (seed, i), "response", body, True))
    return data, want


def shown(df):
    return sorted((r.record_id, r.warc_type, bytes(r.block), r.whole) for r in df.collect())


@pytest.mark.parametrize("split", [300, 4000, 128 << 20])
def test_reader_against_a_plain_walk(spark, tmp_path, split):
    want = []
    for k in range(3):
        data, records = made(60, k)
        (tmp_path / f"{k}.warc").write_bytes(data)
        want += records
    (tmp_path / "empty.warc").write_bytes(b"")
    data, records = made(20, 9)
    cut = len(data) // 2
    (tmp_path / "z.warc.gz").write_bytes(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    want += records
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        assert shown(warc.read_records(spark, str(tmp_path))) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reader_of_faulty_records(spark, tmp_path):
    head = "WARC/1.0\r\nWARC-Type: {}\r\nContent-Length: {}\r\n\r\n"
    data = "garbage\r\n\r\n" + head.format("long", 2) + "four\r\n\r\n" + head.format("good", 3) + "abc\r\n\r\n" + head.format("odd", "x") + "\r\n\r\n" + head.format("short", 50) + "cut"
    (tmp_path / "a.warc").write_bytes(data.encode())
    got = {r.warc_type: (bytes(r.block), r.whole) for r in warc.read_records(spark, str(tmp_path)).collect()}
    assert got == {"long": (b"fo", False), "good": (b"abc", True), "odd": (b"", False), "short": (b"cut", False)}


def test_reader_of_empty_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"")
    assert warc.read_records(spark, str(tmp_path)).count() == 0
