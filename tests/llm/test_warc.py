import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tickloom.llm import warc as R

SCHEMA = "page_id long, url string, html string, key string, offset long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data, f = (h or "").encode(), first.get(h or "")
        again = i != f and len(data) >= least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h{i % 7}.ex.com/p{i % 50}?q#f", f"payload é {i % 30}\r\n\r\n") for i in range(2500)] + [
    (9001, None, None), (9002, "not a url", "x"), (None, "http://a/", "x"), (None, "http://a/", "only null"),
    (9003, "HTTP://U@A.b.C:80\n/x", "x\r\n\r\ny"), (9004, "http://b", ""), (9004, "http://b", ""), (9005, "http://c", "long " * 300_000),
]


@pytest.mark.parametrize("least", [0, 2])
@pytest.mark.parametrize("block_lines", [1000, 3])
def test_round_trip(spark, monkeypatch, least, block_lines):
    monkeypatch.setattr(R.write_index, "__defaults__", (block_lines,))
    got = R.archive_round_trip(frame(spark, ROWS).repartition(5), least)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS, least)


def test_look_up_reads_only_what_is_asked(spark):
    root = R.archive_root(spark)
    df = frame(spark, ROWS)
    captures = R.write_archives(df, root)
    shards = R.write_index(captures, root, 7)
    keys = spark.createDataFrame([("com,ex,h3)/p10?q",), ("com,ex,h3)/p10",), ("zz",), ("a",)], "key string")
    found = R.look_up(keys, shards, root)
    want = sorted(i for i, u, _ in ROWS if u == "http://h3.ex.com/p10?q#f")
    assert want and sorted(r["page_id"] for r in found.collect()) == want
    records = R.read_records(found.where(f"page_id = {want[0]}"), root).collect()
    assert len(records) == 1 and records[0]["page_id"] == want[0]
    one = captures.first()
    path = f"{root.removeprefix('file://').removeprefix('file:')}/{one['file']}"
    with open(path, "rb") as f:
        f.seek(one["offset"])
        assert gzip.decompress(f.read(one["length"])).startswith(b"WARC/1.1\r\nWARC-Type: ")
    with gzip.open(path) as f:  # members one after the other are one stream
        assert f.read(8) == b"WARC/1.1"


def test_empty(spark):
    assert R.archive_round_trip(frame(spark, [])).count() == 0


def test_stretches_of_one_archive_go_to_several_tasks(spark, monkeypatch):
    rows = [(i, f"http://a.ex/{i}", f"{i} " * 400) for i in range(3000)]
    df = spark.createDataFrame([(*r, "s", "f", 1) for r in rows], "page_id long, url string, html string, sha string, first string, id int")
    root = R.archive_root(spark)
    captures = R.write_archives(df.coalesce(1), root)
    monkeypatch.setattr(R, "STRETCH_BYTES", 50_000)
    read = R.read_records(captures, root)
    held = read.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in held) == 3000 and len(held) > 4
