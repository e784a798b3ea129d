import hashlib
import random
import re

import pytest

from conftest import SMALL
from evertally.llm import substring_dedup as sd
from evertally.llm.queries import QUERIES
from evertally.llm.suffix_automaton import SuffixAutomaton

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(docs, window):
    """Rows with ids only; (id, n_words, n_removed, digest)."""
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in docs]
    for i, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            first[key] = min(first.get(key, i), i)
    rows = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = " ".join(word for at, word in enumerate(words) if at not in gone)
        rows.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(rows, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_registered_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    result = found(QUERIES["op6_substring_dedup"](spark, SMALL))
    assert result == [row[:4] for row in brute_force(docs, 13)]
    assert any(row[2] for row in result)


def variants(seed):
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(12)] + ["é", "ñandú", "x.", "--"]
    passages = [rng.choices(letters, k=rng.randint(5, 40)) for _ in range(6)]
    texts = [None, "", "  \n", "one", " ".join(passages[0]) + "\n" * 3]
    for _ in range(40):
        words = rng.choices(letters, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            at, passage = rng.randint(0, len(words)), rng.choice(passages)
            a = rng.randint(0, len(passage) // 2)
            words[at:at] = passage[a : a + rng.randint(3, 40)]
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words) + rng.choice(["", " ", "\n"]))
    texts += [texts[10], texts[11], texts[12] + " ", "a " * 5000, "a " * 300]
    ids = rng.sample(range(-5, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    return rows + [rows[12], (rows[13][0], texts[14]), (rows[15][0], texts[16])]


@pytest.mark.parametrize("window", [1, 3, 6, 13])
def test_removals_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(sd, "SHARD_PIECES", 50)
    monkeypatch.setattr("evertally.llm.tables.BROADCAST_ROWS", 0 if window == 6 else 10**6)
    rows = variants(window)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    assert found(sd.repeat_report(docs, window=window)) == [row[:4] for row in brute_force(rows, window)]


def test_texts_without_repeats(spark):
    rows = variants(2)
    docs = spark.createDataFrame([(i, t, "x", "y", i) for i, t in rows], "doc_id BIGINT, text STRING, row STRING, starts STRING, copy BIGINT")
    kept = sd.without_repeats(docs, window=5)
    assert kept.columns == docs.columns
    texts = dict(rows)
    expected = sorted((i, k if n else None) for i, _, n, _, k in brute_force(rows, 5) if n)
    changed = sorted((r["doc_id"], r["text"]) for r in kept.collect() if (r["doc_id"], r["text"]) not in rows)
    assert [row for row in expected if row not in rows] == changed
    assert kept.count() == len(rows) and None in texts.values()


def test_null_ids_come_last(spark):
    text = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (7, text), (None, "q " + text), (9, None)], "doc_id BIGINT, text STRING")
    rows = {(r[0], r[1]): r[2] for r in sd.repeat_report(docs).collect()}
    assert rows == {(None, 20): 20, (7, 20): 0, (None, 21): 20, (9, 0): 0}
    assert sd.repeat_report(docs.limit(0)).count() == 0 and sd.without_repeats(docs.limit(0)).count() == 0


def test_automaton_against_all_pieces():
    rng = random.Random(3)
    for _ in range(60):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(1, 4))]
        automaton = SuffixAutomaton()
        for s in sequences:
            automaton.add(s)
        pieces = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a, len(s) + 1)} | {()}
        stream = [rng.randrange(4) for _ in range(30)]
        at_two = automaton.at_length(2)
        states = {}
        for end, (state, matched) in enumerate(automaton.stream(stream), start=1):
            assert matched == max(n for n in range(end + 1) if tuple(stream[end - n : end]) in pieces)
            if matched >= 2:
                states.setdefault(at_two[state], set()).add(tuple(stream[end - 2 : end]))
        assert all(len(v) <= 1 or len({_ends(sequences, p) for p in v}) == 1 for v in states.values())


def _ends(sequences, piece):
    return tuple((n, e) for n, s in enumerate(sequences) for e in range(len(piece), len(s) + 1) if tuple(s[e - len(piece) : e]) == piece)
