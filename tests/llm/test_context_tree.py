import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from conftest import SMALL
from evertally.llm import context_tree, words
from evertally.llm.queries import QUERIES
from pyspark.sql import functions as F

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
NAME = "op12_lm_scoring"


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def decisions(text, depth):
    """(context, node of the binary tree, bit) for every bit of the text and its end."""
    data = b"\xff" * depth + lower(text) + b"\xff"
    for at in range(depth, len(data)):
        context = data[at - depth : at][::-1]
        for bit in range(8):
            yield context, (1 << bit) | (data[at] >> (8 - bit)), (data[at] >> (7 - bit)) & 1


class Tree:
    """Context-tree weighting as the books have it: recursive, over dictionaries."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, node, bit in decisions(text, depth):
                for d in range(depth + 1):
                    self.counts[context[:d], node][bit] += 1
                    if d < depth:
                        self.children[context[:d], node].add(context[: d + 1])
        self.memo = {}

    def estimate(self, at):
        a, b = self.counts[at]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, context, node):
        return sum(self.weighted(child, node) for child in self.children[context, node])

    def weighted(self, context, node):
        at = context, node
        if at not in self.memo:
            own = self.estimate(at)
            if len(context) == self.depth:
                self.memo[at] = own
            else:
                other = self.below(context, node)
                top = max(own, other)
                self.memo[at] = top + math.log(math.exp(own - top) + math.exp(other - top)) - math.log(2)
        return self.memo[at]

    def one(self, context, node, d=0):
        """Probability of a one; None where the context was never seen."""
        at = context[:d], node
        a, b = self.counts.get(at, (0, 0))
        if a + b == 0:
            return 0.5 if d == 0 else None
        own = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        deeper = self.one(context, node, d + 1)
        if deeper is None:
            return own
        stop = 1 / (1 + math.exp(min(700, self.below(*at) - self.estimate(at))))
        return stop * own + (1 - stop) * deeper

    def score(self, text):
        total = 0.0
        for context, node, bit in decisions(text, self.depth):
            p = self.one(context, node)
            total += math.log10(p if bit else 1 - p)
        return total


def brute(rows):
    """{row number: (held_out, n_tokens, n_known, train_tokens, base_score, score)}"""
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2 for r in rows]
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", lower(r[1])), None] for r in rows]
    counts = Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(counts.values()), len(counts)
    tree = Tree([r[1] for r, h in zip(rows, held, strict=True) if not h], context_tree.DEPTH)
    return [
        (r[0], h, len(ts), sum(t in counts for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), tree.score(r[1]))
        for r, h, ts in zip(rows, held, tokens, strict=True)
    ]


def found(spark, rows, schema=DOCS):
    scores = context_tree.lm_scores(spark.createDataFrame(rows, schema), ~context_tree_fold())
    return [
        (r["doc_id"], not r["learned"], *(r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")))
        for r in scores.collect()
    ]


def context_tree_fold():
    from evertally.llm.tables import held_out

    return held_out(parts=7)


def assert_same(got, expected):
    got, expected = (sorted(x, key=lambda r: (str(r[0]), r[2], r[6])) for x in (got, expected))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


ODD = [
    (None, "no id", "x", "s", 1), (None, None, None, None, None), (1, "", "x", "s", 0), (1, "Same ID same", "x", "s", 7),
    (1, "Same ID same", "x", "s", 7), (2, "Älter ÄLTER \t\n\x0b x", None, "s", 7), (3, " ", "x", "s", 1),
]


@pytest.mark.parametrize("frequent", [0, 20, 1 << 20])
def test_equals_brute_force(spark, monkeypatch, frequent):
    """Whatever part of the table is broadcast, the rest is joined."""
    monkeypatch.setattr(context_tree, "FREQUENT", frequent)
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(30).collect()
    rows = ODD + [(10 + i, r["text"][:700], r["lang"], r["source"], 0) for i, r in enumerate(texts)]
    assert_same(found(spark, rows), brute(rows))


def test_pieces_and_chunks(spark, monkeypatch):
    """Small slices, merges and chunks give the same."""
    from evertally.llm import words

    rows = [(i, f"word{i % 3} and Some more text {i * 7 % 5} " * (1 + i % 4), "x", "s", 1) for i in range(40)] + ODD
    rows.append((77, "one long text of repeated words " * 300, "x", "s", 1))
    data, offsets = words_of([lower(r[1]) for r in rows])
    whole = [tuple(map(list, pair)) for pair in context_tree.byte_strings(data, offsets)]
    monkeypatch.setattr(context_tree, "SLICE_BYTES", 64)
    pieces = [tuple(map(list, pair)) for pair in context_tree.byte_strings(data, offsets)]
    assert len(pieces) > 100 and [sum((p[i] for p in pieces), []) for i in (0, 1)] == [sum((p[i] for p in whole), []) for i in (0, 1)]
    monkeypatch.undo()
    assert words.SLICE_BYTES == context_tree.SLICE_BYTES
    assert_same(found(spark, rows), brute(rows))


def words_of(texts):
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def test_no_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id INT, text STRING")
    rows = {r["doc_id"]: r for r in context_tree.lm_scores(docs, F.lit(False)).collect()}
    assert rows[1]["score"] == pytest.approx(24 * math.log10(0.5)) and rows[2]["bits_per_byte"] == pytest.approx(8)
    assert rows[1]["n_known"] == rows[1]["train_tokens"] == 0 and rows[1]["base_score"] == 0
    assert context_tree.lm_scores(docs.filter("doc_id > 5"), F.lit(True)).count() == 0


def test_clashing_columns(spark):
    names = "row, rare, learned, training, key, kind, string, head, n_bytes".split(", ")
    docs = spark.createDataFrame([(1, "text", *range(len(names)))], "doc_id INT, text STRING, " + ", ".join(f"{n} INT" for n in names))
    assert context_tree.lm_scores(docs, F.lit(True)).first()["n_known"] == 2


def test_held_out_texts_cost_little(spark):
    """A byte of a held-out text costs far less than by its own frequency (about 4 bits); its words are rarely known."""
    rows = QUERIES[NAME](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and 0 < len(held) < 250
    n_bytes = sum(-r["score"] * math.log2(10) / r["bits_per_byte"] for r in held)
    assert 1 < sum(-r["score"] for r in held) * math.log2(10) / n_bytes < 2.3


def text_batch(texts):
    columns = [pa.array(range(len(texts))), pa.array(texts, type=pa.string()), pa.array([True] * len(texts))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "training"])


def test_a_task_scores_bounded_pieces(monkeypatch):
    """Every row once and in order, whatever the size of Spark's batches; only a longer text is a larger piece."""
    monkeypatch.setattr(context_tree, "PIECE_BYTES", 100)
    given = [text_batch(["a" * 30] * 50 + [None, "", "b" * 1000, "c"]), text_batch([]), text_batch([None, "d"])]
    pieces = list(context_tree._pieces(iter(given)))
    assert [v for p in pieces for v in p.column("text").to_pylist()] == [v for b in given for v in b.column("text").to_pylist()]
    sizes = [[len(v or "") for v in p.column("text").to_pylist()] for p in pieces]
    assert all(sum(s) <= 100 + max(s, default=0) for s in sizes)


def test_tasks_give_their_memory_back(monkeypatch):
    """Workers are kept for later stages: what a task has freed must not stay with them."""
    returned = []
    monkeypatch.setattr(words, "give_back", lambda: returned.append(True))
    counted = pa.Table.from_batches(context_tree._count_batches(iter([text_batch(["a b", None])])))
    assert returned == [True] and counted.num_rows == 8  # two words and the end; "a", " ", "b", the end, and that of no text
