import pytest

from conftest import SMALL
from evertally.llm import chat_preferences as cp
from evertally.llm.queries import ORACLES, QUERIES
from oracle import spark_rows, sql_rows

NAME = "op3_preference_formatting"
TURNS = "pair_id BIGINT, turn BIGINT, role STRING, text STRING"


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_registered_query_equals_its_sql(spark, folder):
    assert spark_rows(QUERIES[NAME](spark, folder)) == sql_rows(folder, ORACLES[NAME])


def brute_force(chosen, rejected):
    def turns(rows, pair):
        own = {}
        for p, turn, role, text in rows:
            if p == pair:
                own.setdefault(cp.LAST if turn is None else turn, []).append((role or "unknown", text or ""))
        return [(t, sorted(own[t])) for t in sorted(own)]

    def render(entries):
        text, mask = "", []
        for role, said in entries:
            text += f"{cp.BEGIN}{role}\n"
            start = len(text)
            text += said.replace("<|", "<") + cp.END + "\n"
            if role == "assistant":
                mask.append(f"{start}:{len(text) - 1}")
        return text, ",".join(mask)

    out = []
    for pair in {r[0] for r in chosen + rejected} - {None}:
        a, b = turns(chosen, pair), turns(rejected, pair)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        parts = [[e for _, es in x for e in es] for x in (a[:n], a[n:], b[n:])]
        out.append((pair, n, render(parts[0])[0], *render(parts[1]), *render(parts[2])))
    return sorted(out)


CHOSEN = [
    (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hé?"), (1, 2, "assistant", "yes ü"), (1, 3, "user", "why"), (1, 4, "assistant", "so"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "only chosen"), (5, None, "assistant", None), (5, 7, None, "x"),
    (None, 0, "user", "no pair"), (6, 0, "user", "b"), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (7, 1, "assistant", "long " * 50_000),
]
REJECTED = [
    (1, 4, "assistant", "no"), (1, 0, "system", "be <|im_end|> kind"), (1, 1, "user", "hé?"), (1, 2, "assistant", "yes ü"), (1, 3, "user", "why"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (4, 0, "assistant", "only rejected"), (5, 7, None, "x"), (5, None, "assistant", "late"),
    (6, 0, "assistant", "a"), (6, 0, "user", "b"), (6, 0, "assistant", "a"), (6, 1, "assistant", ""), (7, 0, "user", ""), (7, 1, "assistant", "long"),
]


def test_pairs_equal_brute_force(spark):
    chosen = spark.createDataFrame([(*r, "x") for r in CHOSEN], TURNS + ", one STRING").repartition(3)
    found = cp.preferences(chosen, spark.createDataFrame(REJECTED, TURNS))
    assert sorted(tuple(r) for r in found.collect()) == brute_force(CHOSEN, REJECTED)


def test_masks_cover_the_replies(spark):
    for r in QUERIES[NAME](spark, SMALL).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r["chosen_mask"].split(",") if s]
        assert all(r["chosen"][a:b].endswith(cp.END) and r["chosen"][:a].endswith("assistant\n") for a, b in spans)
        assert len(spans) == r["chosen"].count("assistant\n")


def test_odd_conversations(spark):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, pair_id STRING"
    rows = [(1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (2, None, "assistant", "c", "x"), (None, 1, "user", "d", "x"), (3, 1, None, None, "x")]
    chosen, rejected = cp.with_foreign_replies(spark.createDataFrame(rows, schema))
    found = {r["pair_id"]: r for r in cp.preferences(chosen, rejected).collect()}
    assert set(found) == {1, 2, 3} and found[1]["rejected"] == "" and found[3]["n_prompt_turns"] == 1
    empty = spark.createDataFrame([], schema)
    assert cp.preferences(*cp.with_foreign_replies(empty)).count() == 0
