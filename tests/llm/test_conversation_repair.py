import hashlib
import random
import re
import zlib

import pytest

from conftest import SMALL
from evertally.llm import conversation_repair as repair
from evertally.llm.queries import ORACLES, QUERIES
from oracle import spark_rows, sql_rows

TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
NAME = "op13_conversation_repair"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        way = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(way, text)
        yield from [(conv, turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)


def content(row):
    return hashlib.md5(f"{len(row[2])}:{row[2]}:{row[3]}".encode()).hexdigest()


def all_ways(rows, faults):
    """(cost, audit, lines) of the best way, over a table of whole prefixes; insertions are steps of their own."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    state_of = {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "", ())}

    def with_insertions(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                to = state_of[after[state]]
                way = (cost + 2, audit + "I", (*lines, {2: "user:", 3: "assistant:"}[to]))
                table[to] = min(table.get(to, way), way)
        return table

    # the least prefix need not be part of the least whole, so every prefix of least cost is kept
    tables = [{(s, a): (c, ls) for s, (c, a, ls) in best.items()}]
    for row, fault in zip(rows, faults, strict=True):
        found = {}
        queue = [(s, a, c, ls) for (s, a), (c, ls) in tables[-1].items()]
        for _ in range(3):
            queue += [(state_of[after[s]], a + "I", c + 2, (*ls, {"u": "user:", "a": "assistant:"}[after[s]])) for s, a, c, ls in queue]
        for state, audit, cost, lines in queue:
            ways = [(state, "D", 3, lines)]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                to = state_of[after[state]]
                ways.append((to, "R", 2 + extra, (*lines, f"{ {2: 'user', 3: 'assistant'}[to]}:{row[3]}")))
                initial = row[2][:1]
                if initial == after[state] or (initial == "s" and state == 0):
                    ways.append((state_of[initial], "K", extra, (*lines, f"{row[2]}:{row[3]}")))
            for to, edit, price, text in ways:
                key = to, audit + edit
                if key not in found or cost + price < found[key][0]:
                    found[key] = cost + price, text
        least = {s: min(c for (t, _), (c, _) in found.items() if t == s) for s in {s for s, _ in found}}
        tables.append({k: v for k, v in found.items() if v[0] == least[k[0]]})
    ends = []
    for (state, audit), (cost, lines) in tables[-1].items():
        tail = {0: (), 1: ("user:", "assistant:"), 2: ("assistant:",), 3: ()}[state]
        ends.append((cost + 2 * len(tail), audit + "I" * len(tail), (*lines, *tail)))
    return min(ends)


def brute(rows, damages=True):
    result = {}
    conversations = {r[0]: [] for r in rows}
    for row in damage(rows) if damages else rows:
        conversations[row[0]].append(row)
    for conv, turns in conversations.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, content(r)))
        seen, faults = set(), []
        for row in turns:
            letters = WORD.findall(row[3])
            fault = "blank" if not letters else "duplicate" if row[2:] in seen else "" if letters[-1] in ".!?" else "truncated"
            seen.add(row[2:])
            faults.append(fault)
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = all_ways(turns, faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return result


def found(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_equals_its_sql(spark, folder):
    assert spark_rows(QUERIES[NAME](spark, folder)) == sql_rows(folder, ORACLES[NAME])


def conversations(seed, count, longest):
    rng = random.Random(seed)
    texts = ["", " \t", "yes.", "no", "Why?", "x \n", "end!\x0b", "é。", "a b. c"]
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice([*texts, f"t{turn}.", f"t{turn}", None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3]), role, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = conversations(seed, 60, 9)
    frame = spark.createDataFrame(rows, TURNS)
    assert found(repair.repair_report(repair.damaged(frame))) == brute(rows)


def test_best_way_of_codes():
    """All edit sequences of short rows, without Spark."""
    rng = random.Random(3)
    names = {0: "tool", 1: "system", 2: "user", 3: "assistant"}
    faults = ["", "blank", "duplicate", "truncated"]
    for _ in range(400):
        codes = bytes(rng.choice(range(16)) for _ in range(rng.randint(0, 7)))
        expected = all_ways([(0, i, names[c % 4], "x") for i, c in enumerate(codes)], [faults[c // 4] for c in codes])
        exit = repair.best_exit(codes)
        audit = "".join(repair._solved(codes, 0, exit) if codes else []) + "I" * (repair.ENDING[exit] // 2)
        assert audit == expected[1]


def test_long_conversations_over_segments(spark, monkeypatch):
    """Cut into small segments, joined in several levels, the result is that of one piece."""
    rng = random.Random(4)
    rows = conversations(5, 8, 6)
    for conv in (100, 101):
        for turn in range(300):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{turn}.", f"t{turn}", "", "again."])))
    frame = spark.createDataFrame(rows, TURNS)
    whole = found(repair.repair_report(repair.as_turns(frame)))
    monkeypatch.setattr(repair, "SEGMENT", 5)
    monkeypatch.setattr(repair, "FAN", 4)
    assert found(repair.repair_report(repair.as_turns(frame))) == whole
    short = [r for r in rows if r[0] not in (100, 101)]
    expected = brute([(r[0], r[1], *(" " if v is None else v for v in r[2:])) for r in short], damages=False)
    assert {k: v for k, v in whole.items() if k in expected} == expected


def test_repaired_lines_give_the_digest(spark):
    rows = conversations(6, 30, 8)
    turns = repair.damaged(spark.createDataFrame(rows, TURNS))
    lines = {}
    for r in repair.repaired(turns).collect():
        lines.setdefault(r["conv_id"], []).append((r["turn"], f"{r['role']}:{r['text']}"))
    for conv, report in found(repair.repair_report(turns)).items():
        text = "\n".join(line for _, line in sorted(lines.get(conv, [])))
        assert hashlib.sha256(text.encode()).hexdigest() == report[-1]


def test_long_text_dropped_rows_empty_and_clashing(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, dropped, "user", "gone", 1), (8, 0, "user", "w " * 500_000, 2)]
    frame = spark.createDataFrame(rows, TURNS + ", copies INT")
    report = found(repair.repair_report(repair.damaged(frame)))
    assert report[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report == brute([r[:4] for r in rows])
    assert repair.repair_report(repair.damaged(frame.filter("conv_id > 9"))).count() == 0
