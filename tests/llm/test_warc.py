import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest

from conftest import SMALL
from evertally.llm import warc
from evertally.llm.queries import QUERIES

PAGES = "page_id BIGINT, url STRING, html STRING"


def brute_force(pages, min_bytes=0):
    groups = defaultdict(list)
    for page_id, html in pages:
        if len((html or "").encode()) >= min_bytes:
            groups[html or ""].append(page_id)
    rows = []
    for page_id, html in pages:
        payload = (html or "").encode()
        ids = [i for i in groups.get(html or "", []) if i is not None]
        first = min(ids, default=None)
        revisit = len(payload) >= min_bytes and page_id != first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        rows.append((page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(rows, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_registered_query_equals_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html").collect()]
    assert found(QUERIES["op9_warc"](spark, SMALL)) == brute_force(pages)


ODD = [
    (1, "http://a.example.com/x", "same"), (2, "https://www.A.example.com:443/x#f", "same"), (3, None, None),
    (4, "", ""), (5, "http://b.org/é ü\r\nX: y?q=1", "ü" * 70_000), (None, "http://b.org/", "same"),
    (7, "http://a.example.com/x", "other"), (7, "http://a.example.com/x", "other"), (8, "ftp://u@host:21/%41", "é"),
    (None, "z", "only here"), (None, "z", "only here"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip_and_lookup(spark, folder, monkeypatch, min_bytes):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = spark.createDataFrame([(*r, "x", 1) for r in ODD], PAGES + ", digest STRING, file BIGINT").repartition(3)
    archive = warc.Archive.write(pages, folder, min_bytes)
    keys = warc.with_keys(pages.select("url").distinct())
    back = archive.records(archive.found(keys)).drop("url")
    expected = brute_force([(i, h) for i, _, h in ODD], min_bytes)
    assert found(back) == expected
    urls = sorted({u or "" for _, u, _ in ODD}) + ["http://nowhere.net/", "http://a.example.com/", "http://zzz/"]
    places = defaultdict(list)
    for r in archive.lookup(spark.createDataFrame([(u,) for u in urls], "url STRING")).collect():
        places[r["url"]].append(tuple(r)[1:])
    for url in urls:
        same = [i for i, u, _ in ODD if warc.url_key(u) == warc.url_key(url)]
        records = [warc.Record.parse(warc.unpacked(warc.Store(folder).read(*place))) for place in places[url]]
        assert sorted(str(i) for i in same) == sorted(r.headers.get("X-Page-ID", "None") for r in records)
    files = [p for p in Path(folder.removeprefix("file:")).iterdir() if p.name.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert whole.count(b"WARC/1.1\r\n") == len(ODD)


def test_keys():
    assert warc.url_key("https://user@www.Example.com:443/A?b#c") == "com,example)/a?b"
    assert warc.url_key("http://x.y.z") == "z,y,x)/" and warc.url_key(None) == ")/"
    assert " " not in warc.url_key("http://é.fr/a b\n")


def test_empty_table(spark):
    assert warc.archive_report(spark.createDataFrame([], PAGES)).count() == 0


def test_blocks_of_a_hot_key_are_read_by_many_tasks(spark, folder, monkeypatch):
    """Every block is read once, with its keys; a key with a third of all captures is spread over its blocks."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 10)
    monkeypatch.setattr(warc, "TASK_BYTES", 2000)
    rows = [(i, "http://hot.org/" if i % 3 == 0 else f"http://h{i % 50}.org/{i}", f"page {i}") for i in range(900)]
    archive = warc.Archive.write(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"), folder)
    keys = warc.with_keys(spark.createDataFrame([(u,) for _, u, _ in rows], "url STRING").distinct())
    blocks = archive.blocks_of(keys)
    hot = blocks.filter("key = 'org,hot)/'")
    assert 30 <= hot.count() <= 33 and hot.repartition(archive._tasks(), "file", "offset").selectExpr("spark_partition_id() p").distinct().count() > 5
    assert blocks.select("file", "offset").distinct().count() == archive.directory.count()
    found = archive.found(keys)
    assert found.count() == found.select("file", "offset").distinct().count() == 900
    assert sorted(r["page_id"] for r in archive.records(found).collect()) == list(range(900))
