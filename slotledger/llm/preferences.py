"""Preference pairs from conversations, with DataFrame functions only.

A pair holds a chosen and a rejected conversation. The longest run of leading turns that are equal
in role and text is rendered once, as the prompt; what follows in either conversation is its
completion. A completion's mask lists the spans to train on: the texts of assistant turns with the
marker that ends them, as ``(start, end)`` in characters of the completion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class ChatTemplate:
    """A turn is ``before + role + between + text + after``; ``after`` is trained with the text."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    trained_role: str = "assistant"

    def render(self, turn: Column) -> Column:
        return F.concat(F.lit(self.before), turn["role"], F.lit(self.between), turn["text"], F.lit(self.after))


def _rendered(turns: Column, template: ChatTemplate) -> Column:
    return F.array_join(F.transform(turns, template.render), "")


def _mask(turns: Column, template: ChatTemplate) -> Column:
    """Spans of the trained turns, by a running length over the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(F.concat(F.lit(template.before), turn["role"], F.lit(template.between)))
        end = done["at"] + F.length(template.render(turn))
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        trained = turn["role"] == template.trained_role
        spans = F.when(trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda done: done["spans"])


def preference_pairs(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row for each pair_id of ``turns(pair_id, side, turn, role, text)``; side 0 is chosen, 1 rejected.

    Returns ``pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``. Turns
    are in the order of turn, role and text; a null turn comes first, and repeated turns stay. A
    null role or text is rendered as empty. A pair that lacks a side has no common turns: its
    prompt is empty, and that side's completion and mask are null. If one conversation begins the
    other, its completion is empty. Rows with a null pair_id or another side are in no pair. Other
    columns are not read. An empty table gives no pairs.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where("pair_id is not null and side in (0, 1)").groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, turn))).alias(name) for side, name in enumerate("cr")]
    )
    at = F.sequence(F.lit(1), F.least(F.size("c"), F.size("r")))
    unequal = F.filter(at, lambda k: (F.element_at("c", k)["role"] != F.element_at("r", k)["role"]) | (F.element_at("c", k)["text"] != F.element_at("r", k)["text"]))
    least = F.least(F.size("c"), F.size("r"))
    common = F.when(least == 0, 0).otherwise(F.coalesce(F.try_element_at(unequal, F.lit(1)) - 1, least))
    cut = grouped.withColumn("prompt_turns", common)
    rest = {name: F.slice(name, F.col("prompt_turns") + 1, F.size(name)) for name in "cr"}
    present = {name: F.size(name) > 0 for name in "cr"}
    columns = []
    for name, label in (("c", "chosen"), ("r", "rejected")):
        columns.append(F.when(present[name], _rendered(rest[name], template)).alias(label))
        columns.append(F.when(present[name], _mask(rest[name], template)).alias(f"{label}_mask"))
    prompt = _rendered(F.slice("c", F.lit(1), F.col("prompt_turns")), template)
    return cut.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), prompt.alias("prompt"), *columns)
