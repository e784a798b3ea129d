import zlib

import numpy as np
import pyarrow as pa

from evertally.llm import language_id as li
from evertally.llm.queries import QUERIES

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    assert np.mean([r["accepted"] for r in held]) > 0.9


def test_buckets_equal_brute_force():
    texts = ["Ab c", "", None, "é, x" * 3, "12 34"]
    block = np.concatenate(list(li.counts(pa.array(texts))))
    for text, row in zip(texts, block, strict=True):
        data = li.LETTERS[np.frombuffer((text or "").encode(), dtype=np.uint8)].tolist()
        expected = np.zeros(li.BUCKETS, dtype=int)
        for length in (1, 2, 3):
            for at in range(len(data) - length + 1):
                gram = 0
                for byte in data[at : at + length]:
                    gram = (gram << 8) | byte
                expected[((gram + length * 0x51ED270B) % 2**32 * 0x9E3779B1 % 2**32) >> 20] += 1
        assert (row == expected).all()


def test_nearest_centroid_equals_brute_force():
    rng = np.random.default_rng(2)
    points = rng.random((60, li.BUCKETS)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids, radius = li.cluster(points, 3)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1, atol=1e-4) and len(radius) == 3
    model = li.LanguageModel(np.ones(li.BUCKETS, dtype=np.float32), ["a", "b", "c"], centroids, radius)
    block = rng.integers(0, 3, (5, li.BUCKETS))
    names, cosine, _ = model.predict(block)
    for row, name, score in zip(np.log1p(block), names, cosine, strict=True):
        all_cosines = [float(row @ c / np.linalg.norm(row)) for c in centroids]
        assert name == "abc"[int(np.argmax(all_cosines))] and abs(score - max(all_cosines)) < 1e-4


def test_odd_rows(spark):
    rows = [(i, f"the cat and the dog number {i} went home", "en", None, 1) for i in range(40)]
    rows += [(100 + i, f"der Hund und die Katze {i} gingen nach Hause", "de", None, 1) for i in range(40)]
    odd = [(1, "the dog", "en", "s", 1), (1, "the dog", None, "s", 1), (None, "die Katze", None, None, None), (300, None, "de", "", 1),
           (301, "", None, "", 1), (302, "12 34 !?", "en", "", 1), (303, "привет 世界", None, "", 1), (304, "und die " * 50_000, None, "", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], DOCS + ", lang_pred STRING")
    model = li.learned(docs)
    found = [tuple(r) for r in li.identified(docs, model).collect()]
    assert len(found) == len(rows) + len(odd)
    by_id = {r[0]: r[1:] for r in found}
    assert by_id[300] == by_id[301] == by_id[302] == ("und", 0.0, False)
    assert by_id[304][0] == by_id[None][0] == "de" and by_id[1][0] == "en" and not by_id[303][2]
    nothing = spark.createDataFrame([], DOCS)
    assert li.learned(nothing) is None and li.identified(nothing, model).count() == 0
    assert {r["lang_pred"] for r in li.identified(docs, None).collect()} == {"und"}


def test_a_language_of_copies_is_learned(spark):
    copies = spark.range(20_000).selectExpr("id AS doc_id", "concat('der Hund und die Katze gingen nach Hause', if(id % 2 = 0, '', ' zusammen')) AS text", "'de' AS lang")
    others = spark.range(50_000, 50_040).selectExpr("id AS doc_id", "concat('the cat and the dog number ', id, ' went home') AS text", "'en' AS lang")
    docs = copies.union(others)
    model = li.learned(docs)
    assert set(model.languages) == {"de", "en"}
    found = li.identified(docs, model).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in found} == {"de": 20_000, "en": 40}


def test_every_language_of_many_is_learned(spark):
    rng = np.random.default_rng(7)
    names = [f"l{i:03}" for i in range(310)]
    words = {name: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4)] for name in names}
    rows = [(8 * i + j, " ".join(rng.permutation(words[name] * 3)), name, None, 1) for i, name in enumerate(names) for j in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    model = li.learned(docs)
    assert set(model.languages) == set(names)
    found = li.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.99
