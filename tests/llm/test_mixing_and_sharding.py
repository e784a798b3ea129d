import hashlib
from collections import Counter

import numpy as np
import pytest

from conftest import SMALL
from evertally.llm import mixing, sharding
from evertally.llm.queries import ORACLES, QUERIES
from oracle import spark_rows, sql_rows

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
ODD = [
    (1, "a b c", "x", "s1", 1), (1, "a b c", "x", "s1", 1), (None, "d e", None, None, None), (2, None, "x", "s2", 2),
    (3, "", "x", "s2", 2), (4, "w " * 50_000, "y", "s3", 3), (None, None, None, "s1", 0), (5, "one", "x", "", 1),
    (6, "é ü", None, "é", 1), (None, "d e", None, None, None), (7, "q r s t", "z", None, 1),
]


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_mix_equals_its_sql(spark, folder, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    name = "op2_weighted_mixing"
    assert spark_rows(QUERIES[name](spark, folder)) == sql_rows(folder, ORACLES[name])


def level(sizes, weights, share=1.5):
    """Targets by bisection of the water level."""
    budget = share * sum(sizes)
    low, high = 0.0, 2.0 * max(sizes) + 1
    for _ in range(200):
        middle = (low + high) / 2
        if sum(min(2 * s, w * middle) for s, w in zip(sizes, weights, strict=True)) < budget:
            low = middle
        else:
            high = middle
    return [min(2 * s, w * high) for s, w in zip(sizes, weights, strict=True)]


def test_targets_by_bisection(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 11):
        sizes = [int(x) for x in rng.integers(0, 1000, n)] if n > 1 else [10]
        rows = spark.createDataFrame([(f"s{i:02d}" if i < n - 1 else None, s) for i, s in enumerate(sizes)], "source STRING, size BIGINT")
        found = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
        expected = level(sizes, [(5, 2, 1)[i % 3] for i in range(n)])
        for i, target in enumerate(expected):
            assert found[f"s{i:02d}" if i < n - 1 else None] == pytest.approx(target, abs=1e-3)


def test_sources_come_near_their_targets(spark):
    rows = QUERIES["op2_weighted_mixing"](spark, SMALL).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert sum(taken.values()) <= 1.5 * sum(r["size"] for r in rows)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(*row, "c") for row in ODD], DOCS + ", key STRING")
    report = mixing.mix_report(docs)
    assert report.count() == len(ODD)
    assert spark_rows(report) == spark_rows(mixing.mix_report(docs.repartition(5)))
    sizes = sorted(r["size"] for r in report.collect())
    assert sizes == sorted(len((row[1] or "").split()) for row in ODD)
    copies = mixing.mixed(docs)
    assert copies.columns == docs.columns
    assert sum(len(r["text"].split()) for r in copies.collect()) == sum(r["taken"] for r in report.collect())
    assert mixing.mix_report(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_lookup_table():
    names = sharding.shard_names(10)
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table, minlength=10)
    assert counts.max() - counts.min() <= 1 and counts.sum() == 1009
    fewer = sharding.lookup_table(names[:-1], 1009)
    stayed = (table != 9) & (table == fewer)
    assert stayed.sum() > 0.75 * (table != 9).sum()
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(wrong, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def brute_force_table(names, size):
    """Each shard's whole permutation, claimed in turns."""
    digests = [hashlib.sha256(n.encode()).digest() for n in names]
    orders = [
        [(int.from_bytes(d[:8], "big") + (int.from_bytes(d[8:16], "big") % (size - 1) + 1) * j) % size for j in range(size)]
        for d in digests
    ]
    owner, turn = {}, 0
    while len(owner) < size:
        slot = next(s for s in orders[turn % len(names)] if s not in owner)
        owner[slot] = turn % len(names)
        turn += 1
    return [owner[s] for s in range(size)]


def test_registered_sharding_equals_brute_force(spark):
    assert sharding.lookup_table(sharding.shard_names(7), 101).tolist() == brute_force_table(sharding.shard_names(7), 101)
    rows = QUERIES["op8_sharding"](spark, SMALL).collect()
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    names, table = sharding.shard_names(64), sharding.lookup_table(sharding.shard_names(64))
    hashed = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    for r in rows:
        assert r["slot"] == hashed[r["doc_id"]] % 65_537 and r["shard"] == names[table[r["slot"]]]


def test_sharding_of_odd_rows(spark, folder):
    docs = spark.createDataFrame([(*row, "c", 1) for row in ODD], DOCS + ", slot STRING, shard INT")
    placed = sharding.sharded(docs)
    assert placed.columns == [*docs.columns, "_slot", "_shard"]
    rows = placed.collect()
    assert len(rows) == len(ODD)
    assert len({r["_shard"] for r in rows if r["doc_id"] == 1}) == 1
    assert sharding.sharded(docs.limit(0)).count() == 0
    sharding.write_shards(placed, folder, "_shard")
    assert spark.read.parquet(folder).count() == len(ODD)
