import hashlib
import re

import pytest

from conftest import SMALL
from evertally.llm import decontamination as d
from evertally.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, window=10):
    pieces = {}
    for item, text in items:
        found = words(text)
        width = min(window, len(found))
        for i in range(len(found) - width + 1 if width else 0):
            pieces.setdefault(tuple(found[i : i + width]), set()).add(item)
    lengths = {len(p) for p in pieces}
    out = {}
    for doc_id, text in docs:
        found = words(text)
        hit, named = set(), set()
        for width in lengths:
            for i in range(len(found) - width + 1):
                owners = pieces.get(tuple(found[i : i + width]))
                if owners is not None:
                    hit.update(range(i, i + width))
                    named |= {str(o) for o in owners if o is not None}
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[doc_id] = (len(found), len(hit), len(named), digest, bool(hit))
    return out


def found(frame):
    return {r[0]: tuple(r[1:6]) for r in frame.collect()}


@pytest.mark.parametrize("table", [SMALL])
def test_registered_query_equals_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{table}/benchmark.parquet").select("item_id", "text").collect()
    result = found(QUERIES["op10_benchmark_decontamination"](spark, table))
    assert result == brute_force(docs, items)
    assert any(row[4] for row in result.values())


CASES = [
    (1, "x a b c d e f g h i j y"),
    (2, "A b, C-d e f g h i\tj"),
    (3, "q r s"),
    (4, "q r"),
    (5, None),
    (6, ""),
    (7, " .,;!"),
    (8, "a b c d e f g h i " * 3 + "élan vital q r s q r s"),
    (9, "Élan vital"),
    (10, "z" * 100_000 + " q r s " + "word " * 60_000 + "a b c d e f g h i j k"),
    (11, "b c d e f g h i j k l m"),
    (12, "b c d e f g h i j k l m"),
]
ITEMS = [
    (1, "a b c d e f g h i j k l"), (2, "Q r S"), (3, None), (4, ""), (5, "..."), (2, "Q r S"),
    (10, "c d e f g h i j k l m n"), (None, "élan vital"), (9, "élan vital"), (9, "s q"),
]


@pytest.mark.parametrize("shard_bytes", [20, 10**6])
@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_edge_cases_and_shards(spark, monkeypatch, window, shard_bytes):
    monkeypatch.setattr(d, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(d, "SHARDS_PER_PASS", 2)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in CASES], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    assert found(d.benchmark_hits(docs, items, window=window)) == brute_force(CASES, ITEMS, window)


def test_spans_go_and_mostly_hit_documents_go(spark):
    docs = spark.createDataFrame([(i, t, "l", i, "clash") for i, t in CASES], "doc_id BIGINT, text STRING, spans STRING, items BIGINT, n_words STRING")
    items = spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")
    cleaned = d.decontaminated(docs, items)
    assert cleaned.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert set(texts) == {4, 5, 6, 7, 8, 9, 10}
    assert texts[8] == "a b c d e f g h i " * 3 and texts[5] is None
    assert texts[10].endswith("word ") and " q" not in texts[10]
    assert not any(r["contaminated"] for r in d.benchmark_hits(cleaned, items).collect())


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id BIGINT, text STRING")
    some = spark.createDataFrame([(i, t, None, None, None) for i, t in CASES], DOCS)
    assert d.benchmark_hits(docs, items).count() == 0
    assert not any(r["n_hit"] for r in d.benchmark_hits(some, items).collect())
    assert d.decontaminated(some, items).count() == len(CASES)


def test_indexes_are_built_in_tasks_and_held_a_pass_at_a_time(spark, monkeypatch):
    """A benchmark of many shards: no item is collected, and no broadcast holds more than a pass."""
    monkeypatch.setattr(d, "SHARD_BYTES", 400)
    monkeypatch.setattr(d, "SHARDS_PER_PASS", 3)
    items = [(f"i{n}", " ".join(f"w{n}x{k}" for k in range(14))) for n in range(60)]
    benchmark = spark.createDataFrame(items, "item_id STRING, text STRING")
    table, count = d.item_shards(benchmark, "item_id", "text", 10)
    assert count > 9 and table.count() <= count and table.columns == ["shard", "index"]
    sizes = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sizes.append(len(value)) or broadcast(self, value))
    docs = [(n, f"before {text} after" if n % 2 else text.replace("x3", "y3"), "x", "s", 1) for n, (_, text) in enumerate(items)]
    found = d.benchmark_hits(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"), benchmark)
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in found.collect()} == {n: (14, 1) if n % 2 else (10, 1) for n in range(60)}
    assert max(sizes) <= 3 and len(sizes) == -(-count // 3)
