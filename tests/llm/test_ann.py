import math

import numpy as np
import pytest

from evertally.llm import ann, shard_graph
from evertally.llm.queries import QUERIES

VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def brute_force(rows, every=20, wanted=20):
    """Per query id, (vec_id, score) nearest first; rows are (id, float32 vector)."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for at, i in enumerate(ids):
        if i % every == 0:
            scores = vectors @ vectors[at]
            order = sorted((j for j in range(len(ids)) if j != at), key=lambda j: (-round(scores[j], 12), ids[j]))
            out[int(i)] = [(int(ids[j]), scores[j]) for j in order[:wanted]]
    return out


def check(found, rows, recall, every=20):
    expected = brute_force(rows, every)
    by_query = {}
    vectors = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-9)
    assert set(by_query) == {q for q, e in expected.items() if e}
    hits = total = 0
    for query, own in by_query.items():
        assert [r["rank"] for r in own] == list(range(1, len(expected[query]) + 1))
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"])) or len({r["vec_id"] for r in own}) == len(own)
        hits += len({r["vec_id"] for r in own} & {j for j, _ in expected[query]})
        total += len(own)
    assert hits >= recall * total


def test_registered_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op7_nearest_neighbours"](spark, sf), rows, 0.97)


def test_copies_scales_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 200)  # several batches of queries
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(8) * rng.random() * 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]  # copies of one vector
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [None]), (2060, [math.nan] * 8), (2080, [math.inf] * 8), (2100, []), (None, [1.0] * 8), (2120, [1.0] * 3)]
    docs = spark.createDataFrame([(i, v, None, "x") for i, v in rows + rows[:3] + odd], VECTORS + ", node STRING")
    check(ann.nearest(docs), rows, 0.97)


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (40, [1.0, 0.0])]
    check(ann.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)), rows, 1.0)
    assert ann.nearest(spark.createDataFrame([], VECTORS)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1), (5, [0.0], 1)], VECTORS)
    assert ann.nearest(alone).count() == 0


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(150)]
    graph = ann.Graph(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    found = {}
    for r in graph.exact(graph.nodes.filter("node % 20 = 0").selectExpr("node AS query")).collect():
        found.setdefault(r["query"], []).append((r["distance"], r["other"]))
    assert {q: [i for _, i in sorted(e)] for q, e in found.items()} == {q: [i for i, _ in e] for q, e in brute_force(rows).items()}


def test_beam_grows_until_the_recall_is_reached(spark, monkeypatch):
    for name, value in {"BEAM": 20, "DEGREE": 8, "MEETING": 4, "BLOCK": 32}.items():  # as small for these vectors as the usual ones for a large table
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((1500, 64)))]
    check(ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)), rows, 0.93)


def test_no_pair_is_scored_twice(spark, monkeypatch):
    """A hop asks only for nodes that its query has not met; a node is one row, whatever the number of queries."""
    rng = np.random.default_rng(7)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((600, 16)))]
    graph = ann.Graph(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    kept = []
    monkeypatch.setattr(ann, "written", lambda rows, name, f=ann.written: kept.append((name, f(rows, name))) or kept[-1][1])
    graph.search(graph.nodes.filter("node % 20 = 0").selectExpr("node AS query"), size=64).collect()
    asked = [(r["query"], other) for name, table in kept if name == "asks" for r in table.collect() for other in r["asks"]]
    assert len(asked) == len(set(asked)) and not any(q == o for q, o in asked)
    last = [table for name, table in kept if name == "beam"][-1].collect()
    assert sum(len(r["met"]) - 1 for r in last) == len(asked) and all(len(r["met"]) == len(set(r["met"])) for r in last)


def test_vectors_of_doubles_are_scored_as_they_are(spark):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((60, 4))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    for r in ann.nearest(docs).collect():
        assert r["score"] == pytest.approx(vectors[r["query_id"]] @ vectors[r["vec_id"]], rel=1e-14)


def test_descent_and_hops_write_no_table_each(spark, monkeypatch):
    """The work of rounds and hops stays in the tasks that hold a shard: the tables written do not grow with their number."""
    rng = np.random.default_rng(9)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((600, 16)))]
    kept = []
    monkeypatch.setattr(ann, "written", lambda rows, name, f=ann.written: kept.append(name) or f(rows, name))
    check(ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)), rows, 0.97)
    assert kept.count("lists") == 1
    assert kept.count("beam") == kept.count("queries") - 1 and "asks" not in kept  # the comparison with all ships queries too


def test_queries_are_searched_in_every_shard(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 250)
    monkeypatch.setattr(ann, "QUERY_BYTES", 4000)  # several batches of queries
    rng = np.random.default_rng(10)
    vectors = rng.standard_normal((1500, 32))
    # tight groups, scattered over the shards, and one large group of near copies
    vectors[:600] = np.repeat(rng.standard_normal((60, 32)), 10, axis=0) + rng.standard_normal((600, 32)) * 0.05
    vectors[600:900] = vectors[600] + rng.standard_normal((300, 32)) * 1e-4
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    graph = ann.Graph(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS))
    assert graph.shards.count() == graph.shard_count == 6
    check(graph.neighbours(graph.rows.filter("id % 20 = 0").selectExpr("id AS query_id")), rows, 0.95)


def test_scattered_groups_are_reached_in_every_shard(spark, monkeypatch):
    """Lists that stay within a group, and groups that no other node lists."""
    for name, value in {"SHARD": 250, "DEGREE": 8, "MEETING": 4, "BLOCK": 32, "BEAM": 24}.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(11)
    vectors = np.repeat(rng.standard_normal((20, 32)), 60, axis=0) + rng.standard_normal((1200, 32)) * 0.05
    vectors = np.concatenate([vectors, np.repeat(rng.standard_normal((30, 32)) * 2, 10, axis=0) + rng.standard_normal((300, 32)) * 0.05])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1)[:, None])]
    check(ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)), rows, 0.95)


def test_entries_and_links():
    rng = np.random.default_rng(12)
    vectors = np.repeat(rng.standard_normal((30, 8)), 10, axis=0) + rng.standard_normal((300, 8)) * 0.01
    lists = shard_graph.neighbour_lists(vectors, degree=6, meeting=4, changed=0.05, tables=9, block=32)
    entries = shard_graph.entries(lists)
    assert len(entries) < 150 and all(node in entries or set(lists[node]) & set(entries.tolist()) for node in range(300))
    links = shard_graph.linked(lists, 3)
    assert (links[:, :6] == lists).all()
    for node in range(300):
        single = [other for other in range(300) if node in lists[other] and other not in lists[node]]
        single.sort(key=lambda other: (lists[other].tolist().index(node), other))
        assert [other for other in links[node, 6:] if other >= 0] == single[:3]


def test_equally_near_vectors_and_extreme_sizes(spark):
    """Ties go to the smaller id whatever their number, and products beyond a float are compared."""
    for size in (1e-30, 1.0, 1e30):
        rows = [(i, [size, 0.0, 0.0] if not i else [0.0, size, size * (i % 7)]) for i in range(200)]
        found = ann.nearest(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), every=1000).collect()
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 21))
