"""Preference formatting: one prompt and two masked completions per pair of conversations.

The prompt is the longest common prefix of turns of the chosen and the rejected conversation, rendered once; what follows
is rendered for each side, and the mask lists the character spans of the completion that count for the loss: the
assistant's texts with their end marks. Where the sides part is found by a join of single turns and a minimum, so nothing is
gathered but the turns of a record itself.

Defined results: a null turn number comes last; rows of one conversation with the same turn number form one turn, by
role and text; a null role is `unknown`, a null text is empty; marks inside texts lose their bar; a pair missing on one side
has no prompt and an empty completion there; equal conversations have empty completions; rows without a pair id are left
out; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn (fixed values).
BEGIN, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
LAST = (1 << 63) - 1


def harmless(text: Column) -> Column:
    """Text that cannot be taken for a mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<"))


def _turns(rows: DataFrame, side: str) -> DataFrame:
    """(pair_id, turn, side): each turn as a list of (role, text), in order."""
    entry = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter("pair_id is not null")
    turns = rows.groupBy("pair_id", F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("turn"))
    return turns.agg(F.sort_array(F.collect_list(entry)).alias(side))


def _rendered(entries: str) -> Column:
    """(text, where its loss starts or null) of every entry of a turn."""

    def render(entry: Column) -> Column:
        head = F.concat(F.lit(BEGIN), harmless(entry["role"]), F.lit("\n"))
        whole = F.concat(head, harmless(entry["text"]), F.lit(END + "\n"))
        return F.struct(whole.alias("text"), F.when(entry["role"] == ASSISTANT, F.length(head)).alias("from"))

    return F.transform(entries, render)


def _text(parts: str) -> Column:
    return F.array_join(F.transform(parts, lambda part: part["text"]), "")


def _mask(parts: str) -> Column:
    """start:end of each span, in characters of the joined text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        # the line break behind the end mark does not count
        end = state["at"] + F.length(part["text"])
        span = F.concat_ws(":", (state["at"] + part["from"]).cast("string"), (end - 1).cast("string"))
        spans = F.when(part["from"].isNull(), state["spans"]).otherwise(F.array_append(state["spans"], span))
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(parts, start, step)["spans"], ",")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask of (pair_id, turn, role, text) rows."""
    both = _turns(chosen, "one").join(_turns(rejected, "two"), ["pair_id", "turn"], "full")
    parts = both.filter(~F.col("one").eqNullSafe(F.col("two"))).groupBy("pair_id").agg(F.min("turn").alias("parting"))
    both = both.join(parts, "pair_id", "left")
    # with no parting, all turns are common
    common = F.coalesce(F.col("turn") < F.col("parting"), F.lit(True))
    turns = both.select(
        "pair_id", "turn", common.alias("common"), _rendered("one").alias("one"), _rendered("two").alias("two")
    )

    def collected(condition: Column, side: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.when(condition, F.struct("turn", F.col(side).alias("parts")))))
        return F.flatten(F.transform(ordered, lambda turn: turn["parts"]))

    rows = turns.groupBy("pair_id").agg(
        F.count(F.when(F.col("common"), 1)).alias("n_prompt_turns"),
        collected(F.col("common"), "one").alias("shared"),
        collected(~F.col("common") & F.col("one").isNotNull(), "one").alias("one"),
        collected(~F.col("common") & F.col("two").isNotNull(), "two").alias("two"),
    )
    return rows.select(
        "pair_id", "n_prompt_turns", _text("shared").alias("prompt"), _text("one").alias("chosen"),
        _mask("one").alias("chosen_mask"), _text("two").alias("rejected"), _mask("two").alias("rejected_mask"),
    )


def with_foreign_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: as they are, and with the last assistant turn of the conversation with the next id.

    Without such a conversation or reply, the rejected side lacks its last assistant turn.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )
    said = turns.filter((F.col("role") == ASSISTANT) & F.col("turn").isNotNull())
    last = said.groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("reply"))).alias("last"))
    reply = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.reply").alias("reply"))
    places = last.select("pair_id", F.col("last.turn").alias("place")).join(reply, "pair_id", "left")
    rows = turns.join(places, "pair_id", "left")
    replaced = F.coalesce((F.col("turn") == F.col("place")) & (F.col("role") == ASSISTANT), F.lit(False))
    text = F.when(replaced, F.col("reply")).otherwise(F.col("text"))
    rejected = rows.filter(~replaced | F.col("reply").isNotNull()).select("pair_id", "turn", "role", text.alias("text"))
    return turns, rejected
