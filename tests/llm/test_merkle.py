import hashlib
import zlib

import pytest

from conftest import SMALL
from evertally.llm import merkle
from evertally.llm.queries import ORACLES, QUERIES
from oracle import spark_rows, sql_rows

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
NAME = "op11_merkle_manifest"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def paths(nodes):
    """(root, the siblings left and right of each node's way up) of one tree, level by level."""
    found = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place // 8 * 8
            found[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
        nodes = [sha("".join(nodes[run : run + 8])) for run in range(0, len(nodes), 8)]
        at = [place // 8 for place in at]
    return nodes[0], found


def brute(rows):
    """Rows of the query, by building every tree in memory."""
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        digest = other = leaf((doc_id, source, lang, n_chars, text))
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            other = leaf((doc_id, source, lang, n_chars, lower))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id, digest, other))
    langs = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for tree in trees.values():
        tree.sort(key=lambda node: (node[0], node[1] or 0, node[2]))
    built = {lang: paths([node[2] for node in trees[lang]]) for lang in langs}
    root, last = paths([built[lang][0] for lang in langs])
    result = []
    for lang, above in zip(langs, last, strict=True):
        subroot, own = built[lang]
        for (_, doc_id, digest, other), path in zip(trees[lang], own, strict=True):
            at = other
            for left, right in path + above:
                at = sha(left + at + right)
            proof = sha("".join(left + right for left, right in path + above))
            result.append((doc_id, digest, subroot, root, proof, at, at == root))
    return sorted(result, key=repr)


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_equals_its_sql(spark, folder):
    assert spark_rows(QUERIES[NAME](spark, folder)) == sql_rows(folder, ORACLES[NAME])


ODD = [
    (None, "No id", "x", "s", 1), (None, None, None, None, None), (None, "No id", "x", "s", 1), (1, "", "x", "s", 0),
    (1, "Same id", "x", "s", 7), (2, "Älter Ä", None, "s", 7), (2, "W " * 60_000, "é", "s", 120_000), (0, "A", "", "", -5),
    (9, None, "z", "s", None),
]


@pytest.mark.parametrize("copies", [0, 1, 8, 9, 64, 65])
def test_equals_brute_force(spark, copies):
    rows = ODD + [(1000 + i, f"Text {i}", "many", "s", i) for i in range(copies)] + [(5, "Again", "many", "s", 5)] * copies
    found = merkle.verified_manifest(spark.createDataFrame(rows, DOCS))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("rows", [65, 513, 4097])
def test_blocks_and_storeys(spark, monkeypatch, rows):
    """Small blocks: several storeys, with the last run of a level short."""
    monkeypatch.setattr(merkle, "LEVELS", 1 if rows < 4097 else 2)
    monkeypatch.setattr(merkle, "BLOCK", 8 if rows < 4097 else 64)
    docs = [(i, f"Text {i}", "many" if i % 3 else f"l{i % 60}", "s", i) for i in range(rows)]
    found = merkle.verified_manifest(spark.createDataFrame(docs, DOCS))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs)


def test_empty_single_and_clashing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.verified_manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "A", None, None, 1, 5, "t", "d", 3)], DOCS + ", place INT, tree STRING, digest STRING, _row INT")
    row = merkle.verified_manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    assert row["verified"] == (zlib.crc32(b"1") % 3 != 0)
