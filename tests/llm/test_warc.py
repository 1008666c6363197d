import gzip
import hashlib
from pathlib import Path

import pytest

from planloom.llm import common, warc
from planloom.llm.common import scratch
from planloom.llm.queries import ORACLES

SCHEMA = "page_id bigint, url string, html string, digest string, bytes string"
BIG = "<p>" + "payload é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n" * 20
ROWS = [
    (5, "http://a/1", BIG),
    (3, "http://a/2 with space", BIG),
    (9, "http://b/", BIG),
    (1, "http://c/", "short"),
    (2, "http://c/", "short"),
    (4, None, None),
    (6, "http://e/\r\nX-Injected: 1", "x" * 99),
    (7, "http://f/", "x" * 100),
    (8, "http://f/", "x" * 100),
    (10, "http://é/ü?q=日本", "<html>" + "long body " * 50000),
    (11, "", ""),
    (3, "http://a/2 with space", BIG),
    (None, "http://n/", BIG),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "b") for r in rows], SCHEMA)


def brute(rows):
    data = [(d, (h or "").encode()) for d, _, h in rows]
    out = []
    for d, b in data:
        same = [x for x, y in data if y == b and x is not None]
        first = min(same, default=None) if len(b) >= 100 else None
        again = first is not None and (d is None or first < d)
        out.append((d, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip_against_brute_force(spark):
    got = warc.round_trip(pages(spark, ROWS)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(ROWS)
    assert {r.page_id: r.url for r in got}[10] == "http://é/ü?q=日本"


def test_archives_are_warc_files(spark):
    path = scratch(spark, "test-warc")
    warc.write_archives(pages(spark, ROWS), path)
    data = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part-*.gz")))
    assert gzip.decompress(data)
    records = list(warc._blocks(data))
    kinds = [h["warc-type"] for h, _ in records]
    assert kinds.count("request") == kinds.count("metadata") == kinds.count("response") + kinds.count("revisit") == len(ROWS)
    ids = {h["warc-record-id"] for h, _ in records if h["warc-type"] in ("response", "revisit")}
    assert all(h["warc-concurrent-to"] in ids for h, _ in records if h["warc-type"] in ("request", "metadata"))
    assert not any("x-injected" in h for h, _ in records)
    assert any(b.endswith(BIG.encode()) for _, b in records)
    nested = warc.assemble(warc.read_records(spark, path))
    assert nested.count() == len(ROWS)
    assert nested.where("request is null or metadata is null or response.bad").count() == 0


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_against_sql(spark, data, duck):
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    got = sorted(map(str, (tuple(r) for r in warc.round_trip(spark.read.parquet(f"{data}/pages.parquet")).selectExpr(*names.split(", ")).collect())))
    assert got == sorted(map(str, duck.execute(f"select {names} from ({ORACLES['op7_transactions']})").fetchall()))


def test_archives_of_bounded_size(spark, monkeypatch):
    """Several archives of a task, records longer than what is inflated at a time, and damage that is not passed over."""
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 7)
    monkeypatch.setattr(warc, "INFLATED", 1000)
    path = scratch(spark, "test-warc")
    warc.write_archives(pages(spark, ROWS).coalesce(1), path)
    files = sorted(Path(path).glob("part-*.gz"))
    records = [r for f in files for r in warc._blocks(f.read_bytes())]
    assert len(files) > 3
    assert len(records) == 3 * len(ROWS)
    whole = max((f.read_bytes() for f in files), key=len)
    for bad in (whole[: len(whole) // 2], gzip.compress(gzip.decompress(whole)[:-9]), gzip.compress(b"x" + gzip.decompress(whole))):
        with pytest.raises(ValueError):
            list(warc._blocks(bad))


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    """However many payloads the bitmaps take for copied ones, joins decide."""
    monkeypatch.setattr(common.sieve, "__defaults__", (True, 2))
    got = warc.round_trip(pages(spark, ROWS)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(ROWS)
