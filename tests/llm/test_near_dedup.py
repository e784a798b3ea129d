import random
import re

import pytest

from conftest import SMALL
from evertally.llm import near_dedup as nd
from evertally.llm.components import components
from evertally.llm.queries import QUERIES

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, length):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + length]) for i in range(max(1, len(words) - length + 1)))


def brute_force(docs, length, percent):
    """component of each row, by comparing all sets"""
    sets = [shingles(text, length) for _, text in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    rows = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        rows.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(rows, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_registered_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    result = found(QUERIES["op5_near_duplicates"](spark, SMALL))
    assert result == brute_force(docs, 3, 85)
    assert not all(r[3] for r in result)


def variants(seed):
    """Groups around the threshold: copies, edits, chains, a shared passage, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one two", "a b c", "a b c d", "é É", None]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.randint(5, 60)))}" for _ in range(25)]
    for length in (8, 10, 20, 40, 100, 400):
        base = rng.choices(vocabulary, k=length)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        for _ in range(6):  # a chain
            base = base[: -max(1, length // 15)] + rng.choices(vocabulary, k=max(1, length // 15))
            texts.append(" ".join(base))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows + [rows[20], rows[30], (None, texts[40]), (None, texts[40]), (None, "only here with no id at all"), (rows[3][0], "other text")]


@pytest.mark.parametrize(("length", "percent", "k"), [(3, 85, 64), (5, 80, 64), (1, 85, 64)])
def test_groups_equal_brute_force(spark, length, percent, k):
    rows = variants(length)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    result = found(nd.near_duplicates(docs, shingle_words=length, percent=percent, k=k))
    assert result == brute_force(rows, length, percent)


def test_one_of_each_group_stays(spark):
    rows = variants(7)[:-1]
    docs = spark.createDataFrame([(i, t, "x", i, "y", "z") for i, t in rows], "doc_id BIGINT, text STRING, cls STRING, keeper BIGINT, sketch STRING, component_id STRING")
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    rows_kept = [(r["doc_id"], r["text"]) for r in kept.collect()]
    groups = {r[2] for r in brute_force(rows, 5, 80) if r[1]}
    empty = sum(1 for _, t in rows if not (t or "").strip())
    assert sum(1 for _, t in rows_kept if not (t or "").strip()) == empty
    assert sorted(repr(i) for i, t in rows_kept if (t or "").strip()) == sorted(map(repr, groups))


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert nd.near_duplicates(none).count() == 0 and nd.deduplicated(none).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (None, " ", None, None, None)], DOCS)
    assert found(nd.near_duplicates(blank)) == [(1, 0, 1, True), (None, 0, None, True)]


def test_shared_values_needed():
    assert nd.least_shared(7, 85, 64) == 6 and nd.least_shared(1, 85, 64) == 1
    assert all(nd.least_shared(n, 85, 64) <= -(-n * 85 // 100) for n in range(1, 3000))


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = [(ids[i], ids[i + 1]) for i in range(len(ids) - 1) if i != 120] + [(500, 500)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    for part in (ids[:121], ids[121:]):
        assert {labels[i] for i in part} == {min(part)}
    assert labels[500] == 500


@pytest.mark.parametrize("doc_id", [None, 5, "own"])
def test_one_text_is_fetched_for_each_class(spark, doc_id):
    """However many documents lack an id or share one; a very long text and repeated rows are among them."""
    base = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(40)] + ["long " * 3 + " ".join(map(str, range(30_000)))]
    texts = [t for text in base for t in (text, text + " end")] + base[:10]
    rows = [(i if doc_id == "own" else doc_id, text, "x", "s", 1) for i, text in enumerate(texts)]
    duplicates = nd.NearDuplicates(spark.createDataFrame(rows, DOCS))
    wanted = duplicates.classes.select("cls")
    assert duplicates._texts(wanted).count() == wanted.count() == 82
    assert duplicates._sets(wanted).select("cls").distinct().count() == 82
    if doc_id is None:
        assert duplicates.links.count() == 41
