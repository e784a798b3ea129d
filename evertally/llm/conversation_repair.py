"""Repair of conversations by the cheapest edits, found by Hirschberg's divide and conquer.

Rows of a conversation are read by turn, nulls first. A row is blank (no character but ASCII white space), a duplicate
(its role and text were seen earlier) or truncated (its last such character is none of `.!?`); the first that holds
counts. The repaired conversation's roles must spell `(s?(ua)+)?` in their initials. Edits are Keep (0), Rerole to user
or assistant (2), Delete (3, required for blank rows and duplicates) and Insert of an empty user or assistant turn (2);
a truncated row that stays costs 1 more. Of the cheapest edit sequences the one whose initials are least in ASCII is taken.

The pattern has four states: at the start, after the system turn, after a user turn, after an assistant turn. Insertions
are taken to come before the next row of the input, so what precedes a row boundary is never a prefix of another
way to reach it, and ways of equal cost can be ranked by four small numbers instead of their texts. Forward vectors (cost
and rank of each state) and backward vectors (cost to the end) meet in the middle; the least cost, then the least rank,
fixes the state there, and both halves are solved alone. That needs memory for the rows of a part, not for a table of costs.

How it runs: only codes are sorted and cut, texts stay behind. The global order is cut into segments of `SEGMENT` rows,
whatever conversations they hold. Segments at whose border a conversation goes on are summarised by their 4 x 4 costs and
ranks; `FAN` summaries at a time are joined into one until a conversation is one summary, and the states at the
borders are chosen on the way back. So a conversation of any length is solved by many tasks. Equal rows of one turn are
counted before they are sorted. At last the chosen edits meet the texts, sorted by Spark; the digest of the repaired
text is made row by row. That one step reads a conversation in one task, as SHA-256 is sequential, and keeps only its
edits' initials, which are part of the result.

Defined results: null ids are one conversation; a null role or text is one space, so it is blank or fits nowhere; rows of
one turn are ordered by the MD5 of role and text; repeated rows are duplicates; very long texts are streamed; a
conversation without rows has zeros, no edits and the digest of the empty text; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evertally.llm.ordering import numbered
from evertally.llm.tables import written

SEGMENT, FAN = 2048, 512

# Fixed values of the edit model
WHITE_SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or reroled turn leads
ROLES = {USER: "user", ASSISTANT: "assistant"}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = ("", "s", "u", "a")  # by code; 0 is any other
LEGAL = {(1, 2), (2, 3), (3, 2)}

INFINITE = 1 << 50


# The edits of one row


def _kept(state: int, initial: int) -> int | None:
    """The state after a kept row."""
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial in (USER, ASSISTANT) and NEXT[state] == initial else None


def _row_edits(initial: int, fault: int) -> list[dict[int, tuple[int, str]]]:
    """Per state before a row: the states after it, each with the cheapest (cost, edits)."""
    found: list[dict[int, tuple[int, str]]] = []
    for start in STATES:
        ways: dict[int, tuple[int, str]] = {}
        state, inserted = start, ""
        for _ in range(3):  # a third insertion comes back to a state had before
            after = [(DELETE, state, 0)]
            if fault not in (BLANK, DUPLICATE):
                extra = int(fault == TRUNCATED)
                after += [(REROLE, NEXT[state], extra)]
                if _kept(state, initial) is not None:
                    after += [(KEEP, _kept(state, initial), extra)]
            for edit, to, extra in after:
                way = (COST[edit] + extra + COST[INSERT] * len(inserted), inserted + edit)
                ways[to] = min(ways.get(to, way), way)
            state, inserted = NEXT[state], inserted + INSERT
        found.append(ways)
    return found


#: By row code: initial + 4 * fault
EDITS = [_row_edits(code % 4, code // 4) for code in range(16)]
#: Cost of what must be inserted after the last row
ENDING = {START: 0, SYSTEM: 4, USER: 2, ASSISTANT: 0}

Vector = tuple[tuple[int, ...], tuple[int, ...]]  # cost and rank per state


def forward(codes: bytes, entry: int) -> Vector:
    """Cost of reaching each state after the rows, and the order of the edits that do, least first."""
    cost = [INFINITE] * 4
    rank = [0] * 4
    cost[entry] = 0
    for code in codes:
        best: list[tuple | None] = [None] * 4
        edits = EDITS[code]
        for state in STATES:
            if cost[state] < INFINITE:
                for to, (price, text) in edits[state].items():
                    way = (cost[state] + price, rank[state], text)
                    if best[to] is None or way < best[to]:
                        best[to] = way
        order = sorted((way[1:], to) for to, way in enumerate(best) if way is not None)
        cost = [INFINITE if way is None else way[0] for way in best]
        rank = [0] * 4
        for place, (_, to) in enumerate(order):
            rank[to] = place
    return tuple(cost), tuple(rank)


def backward(codes: bytes, exit: int) -> list[int]:
    """Cost of getting from each state before the rows to `exit` after them."""
    cost = [INFINITE] * 4
    cost[exit] = 0
    for code in reversed(codes):
        edits = EDITS[code]
        cost = [min((price + cost[to] for to, (price, _) in edits[state].items()), default=INFINITE) for state in STATES]
    return cost


def crossing(left: Vector, right: list[int] | dict[int, int]) -> int:
    """The state at which both halves meet: least cost, then least edits."""
    return min(STATES, key=lambda state: (min(left[0][state] + right[state], INFINITE), left[1][state]))


def solved(codes: bytes, entry: int, exit: int) -> list[str]:
    """The edits of each row on the best way from `entry` to `exit`."""
    return list(_solved_short(codes, entry, exit)) if len(codes) <= 16 else _solved(codes, entry, exit)


def _solved(codes: bytes, entry: int, exit: int) -> list[str]:
    if len(codes) == 1:
        return [EDITS[codes[0]][entry][exit][1]]
    middle = len(codes) // 2
    state = crossing(forward(codes[:middle], entry), backward(codes[middle:], exit))
    return solved(codes[:middle], entry, state) + solved(codes[middle:], state, exit)


@lru_cache(maxsize=1 << 16)
def _solved_short(codes: bytes, entry: int, exit: int) -> tuple[str, ...]:
    """Short runs repeat all over a corpus."""
    return tuple(_solved(codes, entry, exit)) if codes else ()


def best_exit(codes: bytes, entry: int = START) -> int:
    return crossing(forward(codes, entry), ENDING)


# Summaries of segments

Summary = list[Vector]  # per entry state


def joined(left: Summary, right: Summary) -> Summary:
    """The summary of two runs of rows in a row."""
    result = []
    for cost, rank in left:
        ways = []
        for to in STATES:
            way = min((cost[m] + right[m][0][to], rank[m], right[m][1][to]) for m in STATES)
            ways.append((min(way[0], INFINITE), *way[1:]))
        order = sorted((way[1:], to) for to, way in enumerate(ways) if way[0] < INFINITE)
        ranks = [0] * 4
        for place, (_, to) in enumerate(order):
            ranks[to] = place
        result.append((tuple(way[0] for way in ways), tuple(ranks)))
    return result


def _listed(summary: Summary) -> list[int]:
    return [value for cost, rank in summary for value in (*cost, *rank)]


def _summary(values: list[int]) -> Summary:
    return [(tuple(values[at : at + 4]), tuple(values[at + 4 : at + 8])) for at in range(0, 32, 8)]


def border_states(summaries: list[Summary], entry: int, exit: int | None) -> list[tuple[int, int]]:
    """(entry, exit) of each summary on the best way; an unknown last exit is chosen by what must follow it."""
    costs: list = [ENDING if exit is None else [0 if s == exit else INFINITE for s in STATES]]
    for summary in reversed(summaries):
        after = costs[-1]
        costs.append([min(min(summary[s][0][m] + after[m] for m in STATES), INFINITE) for s in STATES])
    states = [entry]
    for summary, after in zip(summaries, costs[-2::-1], strict=True):
        states.append(crossing(summary[states[-1]], after))
    return list(zip(states[:-1], states[1:], strict=True))


def _pieces(table: pa.Table) -> list[tuple[object, int, int, bytes]]:
    """(conversation, first row, end, codes) of the runs of rows of one conversation."""
    found, start = [], 0
    codes = bytes(table.column("code").to_pylist())
    for conversation, rows in groupby(table.column("conv_id").to_pylist()):
        end = start + sum(1 for _ in rows)
        found.append((conversation, start, end, codes[start:end]))
        start = end
    return found


def _segment_summaries(table: pa.Table) -> pa.Table:
    """Summaries of the first and the last piece of a segment; only these can go on beyond it."""
    table = table.sort_by("at")
    pieces = _pieces(table)
    outer = pieces[:1] + pieces[1:][-1:]
    segment = table.column("segment")[0].as_py()
    rows = {
        "conv_id": pa.array([p[0] for p in outer], table.schema.field("conv_id").type),
        "block": pa.array([segment] * len(outer), pa.int64()),
        "summary": pa.array([_listed([forward(p[3], s) for s in STATES]) for p in outer], pa.list_(pa.int64())),
    }
    return pa.table(rows)


def _joined_summaries(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    summaries = [_summary(values) for values in table.column("summary").to_pylist()]
    whole = summaries[0]
    for summary in summaries[1:]:
        whole = joined(whole, summary)
    first = table.slice(0, 1)
    return pa.table(
        {"conv_id": first.column("conv_id"), "block": first.column("parent"), "summary": pa.array([_listed(whole)], pa.list_(pa.int64()))}
    )


def _with_states(table: pa.Table) -> pa.Table:
    """(conv_id, block, entry, exit) of summaries whose row says where their group starts and ends."""
    table = table.sort_by("block")
    summaries = [_summary(values) for values in table.column("summary").to_pylist()]
    states = border_states(summaries, table.column("entry")[0].as_py(), table.column("exit")[0].as_py())
    ends = [pa.array([pair[i] for pair in states], pa.int32()) for i in (0, 1)]
    return pa.table([table.column("conv_id"), table.column("block"), *ends], ["conv_id", "block", "entry", "exit"])


def borders(summaries: DataFrame, conversation: str) -> DataFrame:
    """(conv_id, block, entry, exit) for the written summaries (conv_id, block, summary) of conversations."""
    states = f"conv_id {conversation}, block bigint, entry int, exit int"
    most = summaries.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    if most <= FAN:
        ends = summaries.withColumn("entry", F.lit(START)).withColumn("exit", F.lit(None).cast("int"))
        return ends.groupBy("conv_id").applyInArrow(_with_states, states)
    children = summaries.withColumn("parent", F.expr(f"block div {FAN}"))
    schema = f"conv_id {conversation}, block bigint, summary array<bigint>"
    parents = written(children.groupBy("conv_id", "parent").applyInArrow(_joined_summaries, schema), "summaries")
    ends = borders(parents, conversation).withColumnsRenamed({"conv_id": "_conv", "block": "_parent"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("parent") == F.col("_parent"))
    children = children.join(ends, same).drop("_conv", "_parent")
    return children.groupBy("conv_id", "parent").applyInArrow(_with_states, states)


def _segment_edits(table: pa.Table, ends: pa.Table) -> pa.Table:
    """Adds the edits of each row of a segment; `ends` has the states of pieces that go on beyond it."""
    table = table.sort_by("at")
    known = {r["conv_id"]: (r["entry"], r["exit"]) for r in ends.to_pylist()}
    edits: list[str] = []
    for conversation, _, _, codes in _pieces(table):
        entry, exit = known.get(conversation) or (START, best_exit(codes))
        edits += solved(codes, entry, exit)
    return table.drop_columns(["at", "segment"]).append_column("edits", pa.array(edits, pa.string()))


# Tables


def rows_with_codes(turns: DataFrame) -> DataFrame:
    """Codes of the rows of (conv_id, turn, role, text, copies): one row per conversation, turn and content.

    Columns: conv_id, turn, content, copies, code of the first copy.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    initial = F.substring("role", 1, 1)
    coded = turns.filter("copies > 0").select(
        "conv_id", "turn", "content", "copies",
        F.coalesce(*[F.when(initial == letter, code) for code, letter in enumerate(INITIALS) if letter], F.lit(0)).alias("initial"),
        F.when(trimmed == "", BLANK).when(F.substring(trimmed, -1, 1).isin(*".!?"), NO_FAULT).otherwise(TRUNCATED).alias("fault"),
    )
    rows = coded.groupBy("conv_id", "turn", "content").agg(
        F.sum("copies").cast("bigint").alias("copies"), F.first("initial").alias("initial"), F.first("fault").alias("fault")
    )
    rows = written(rows.withColumn("turn_order", F.struct(F.col("turn").isNotNull().alias("known"), "turn")), "turns")
    firsts = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("content").alias("_content"))
    firsts = firsts.agg(F.min("turn_order").alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("content") == F.col("_content"))
    again = (F.col("fault") != BLANK) & ~F.col("turn_order").eqNullSafe(F.col("_first"))
    fault = F.when(again, DUPLICATE).otherwise(F.col("fault"))
    code = (F.col("initial") + len(INITIALS) * fault).alias("code")
    return rows.join(firsts, same).select("conv_id", "turn", "content", "copies", code)


def edited(rows: DataFrame) -> DataFrame:
    """Adds `edits`, the initials of the edits up to and including each row's first copy, to rows with codes."""
    conversation = rows.schema["conv_id"].dataType.simpleString()
    placed = numbered(written(rows, "codes"), [F.col("conv_id"), F.col("turn"), F.col("content")], "sorted_codes", "at")
    placed = placed.withColumn("segment", F.expr(f"at div {SEGMENT}"))
    schema = f"conv_id {conversation}, block bigint, summary array<bigint>"
    outer = written(placed.groupBy("segment").applyInArrow(_segment_summaries, schema), "outer_pieces")
    going_on = outer.groupBy(F.col("conv_id").alias("_conv")).count().filter("count > 1")
    outer = outer.join(going_on, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    ends = borders(written(outer, "summaries"), conversation).withColumnRenamed("block", "segment")
    ends = written(ends, "border_states")
    given = f"conv_id {conversation}, turn {rows.schema['turn'].dataType.simpleString()}, content binary, copies bigint, code int, edits string"
    return placed.groupBy("segment").cogroup(ends.groupBy("segment")).applyInArrow(_segment_edits, given)


class _Report:
    """What is known of a conversation after some of its rows."""

    def __init__(self):
        self.state, self.before = START, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.least = self.most = None
        self.turns = 0
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.waiting = None  # role under which the next text goes

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.lines == 0 else chr(10)}{role}:{text}".encode())
        self.lines += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.cost += COST[INSERT]
        self.line(ROLES[self.state], "")

    def row(self, turn: int | None, copies: int, code: int, edits: str) -> None:
        initial, fault = code % 4, code // 4
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        if self.before is not None and (self.before, initial) not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.illegal += copies - 1
        self.blank += copies if fault == BLANK else 0
        self.duplicate += copies if fault == DUPLICATE else copies - 1 if fault != BLANK else 0
        self.truncated += fault == TRUNCATED
        for _ in edits[:-1]:
            self.insert()
        edit = edits[-1]
        self.cost += COST[edit] + (fault == TRUNCATED and edit != DELETE) + COST[DELETE] * (copies - 1)
        self.waiting = None
        if edit == REROLE:
            self.state = NEXT[self.state]
            self.waiting = ROLES[self.state]
        elif edit == KEEP:
            self.state = initial
            self.waiting = ""
        self.audit.append(edits + DELETE * (copies - 1))

    def text(self, role: str, text: str) -> None:
        if self.waiting is not None:
            self.line(self.waiting or role, text)
            self.waiting = None

    def result(self) -> tuple:
        for _ in range(ENDING[self.state] // COST[INSERT]):
            self.insert()
            self.audit.append(INSERT)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        counts = gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost
        return *counts, "".join(self.audit), self.digest.hexdigest()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _conversations(batches: Iterator[pa.RecordBatch], kind: type[_Report]) -> Iterator[tuple[object, _Report, bool]]:
    """(conversation, what is known of it, whether it has ended) after each row and at the end of each conversation.

    Rows of a conversation come together, in order, each with edits before its texts.
    """
    report, current = None, None
    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "turn", "copies", "code", "edits", "role", "text")]
        for at in range(batch.num_rows):
            conversation, turn, copies, code, edits, role, text = (c[at].as_py() for c in columns)
            if report is None or conversation != current:
                if report is not None:
                    yield current, report, True
                report, current = kind(), conversation
            if edits is not None:
                report.row(turn, copies, code, edits)
            elif text is not None:
                report.text(role, text)
            yield current, report, False
    if report is not None:
        yield current, report, True


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, size)):
        columns = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _reporter(schema: pa.Schema):
    def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = ((conversation, *report.result()) for conversation, report, end in _conversations(batches, _Report) if end)
        return _batches(ended, schema)

    return reports


class _Lines(_Report):
    """Keeps the lines that no one has taken yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[tuple[int, str, str]] = []

    def line(self, role: str, text: str) -> None:
        self.fresh.append((self.lines, role, text))
        self.lines += 1

    def taken(self) -> list[tuple[int, str, str]]:
        fresh, self.fresh = self.fresh, []
        return fresh


def _line_writer(schema: pa.Schema):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conversation, report, end in _conversations(batches, _Lines):
                if end:
                    report.result()
                for line in report.taken():
                    yield conversation, *line

        return _batches(rows(), schema, 100)

    return lines


def as_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with one space for null roles and texts."""
    space = F.lit(" ")
    return conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).alias("copies")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns as `as_turns` gives them, some of them damaged by the crc32 of `conv_id:turn` modulo 20."""
    turns = as_turns(conversations)
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    way = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(way == 4, "user").otherwise(F.col("role"))
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _content() -> Column:
    """Stands for role and text, which need not be moved then."""
    return F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))).alias("content")


def with_edits(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, content, role, text), and before the first turn of each content a row with its copies,
    code and edits, each conversation in one partition, in order. Conversations whose turns all have no copies stay."""
    turns = turns.withColumn("content", _content())
    edits = edited(rows_with_codes(turns))
    here = F.col("copies") > 0
    texts = turns.select(
        "conv_id", F.when(here, F.col("turn")).alias("turn"), F.when(here, F.col("content")).alias("content"),
        F.when(here, F.col("role")).alias("role"), F.when(here, F.col("text")).alias("text"),
    )
    rows = edits.unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "content", F.col("edits").isNull())


def repair_report(turns: DataFrame) -> DataFrame:
    """Per conversation of `turns` (conv_id, turn, role, text, copies): its faults, the cost and initials of the best
    edits, and the digest of the repaired lines."""
    counts = ", ".join(f"{name} bigint" for name in COUNTS)
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {counts}, audit string, repaired_sha256 string"
    return with_edits(turns).mapInArrow(_reporter(_arrow_schema(schema)), schema)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0), role, text."""
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turn bigint, role string, text string"
    return with_edits(turns).mapInArrow(_line_writer(_arrow_schema(schema)), schema)
