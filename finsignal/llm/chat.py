"""Chat formatting from event logs: fold deltas, edits and regenerations into messages, then render with a loss mask.

An event log has one row per event: conv_id, slot (place of the message in its conversation), seq (order of events in
the conversation), kind, role, text. Kinds:

* start       opens message `slot` with `role` and a first piece of text
* delta       appends text to the current version of message `slot`
* edit        replaces message `slot` by text; messages after it that were made before the edit go
* regenerate  as edit, for a model's answer: starts a new version, later deltas append to it

Everything is windows and aggregates partitioned by conversation, so one shuffle by conv_id serves the whole job.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESETS = ("edit", "regenerate")


@dataclass(frozen=True)
class Template:
    """Turn markers, and the control strings that never appear inside a rendered text."""

    turn: str = "<|turn|>"
    end: str = "<|end|>"
    masked_role: str = "assistant"
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def codes(self) -> list[tuple[str, str]]:
        """(plain, escaped), in the order of escaping; every backslash in an escaped text begins exactly one code."""
        return [("\\", "\\b"), *((c, f"\\{chr(ord('A') + i)}") for i, c in enumerate(self.controls))]

    def escape(self, text: Column) -> Column:
        return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), self.codes(), text)

    def unescape(self, text: Column) -> Column:
        return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(self.codes()), text)

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def events_from_turns(turns: DataFrame, delta_chars: int = 256, max_deltas: int = 64) -> DataFrame:
    """The event log of finished turns (conv_id, turn, role, text): each text arrives in pieces of delta_chars, or of
    a 1/max_deltas part of a longer text. Rows of one conversation are ordered by (turn, role, text); equal rows each
    count. Null role or text: empty."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.greatest(F.lit(delta_chars), F.ceil(F.char_length("text") / max_deltas)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("text") / F.col("_fs_size")).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("text"), i * F.col("_fs_size") + 1, F.col("_fs_size")))
    cut = rows.withColumns({"slot": F.row_number().over(order).cast("long") - 1, "_fs_size": size})
    each = cut.select("conv_id", "slot", "role", F.posexplode(pieces).alias("_fs_at", "text"))
    return each.select(
        "conv_id", "slot", (F.col("slot") * F.lit(1 << 20) + F.col("_fs_at")).alias("seq"),
        F.when(F.col("_fs_at") == 0, "start").otherwise("delta").alias("kind"), F.when(F.col("_fs_at") == 0, F.col("role")).alias("role"), "text",
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, slot, role, text) of an event log.

    An event survives if no later edit or regeneration hit its own or an earlier message. A message's role is the last
    one given to it (of several at one seq the largest). Null text adds nothing; repeated equal events count once;
    messages without a surviving event go. Events with a null conv_id are one conversation; an empty log gives no rows.
    """
    upto = Window.partitionBy("conv_id").orderBy("slot").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reset = F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(upto)
    alive = F.col("_fs_reset").isNull() | (F.col("seq") >= F.col("_fs_reset"))
    piece = F.when(alive, F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))
    messages = events.withColumn("_fs_reset", reset).groupBy("conv_id", "slot").agg(F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"), F.collect_list(piece).alias("_fs_pieces"))
    text = F.array_join(F.transform(F.array_sort(F.array_distinct("_fs_pieces")), lambda p: p["text"]), "")
    return messages.where(F.size("_fs_pieces") > 0).select("conv_id", "slot", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_spans array<struct<start, loss_start, loss_end>>.

    Spans are code points in `formatted`; [loss_start, loss_end) is the text of a masked (assistant) turn and empty for
    other turns. Messages with a null conv_id are one conversation; no messages, no rows; other columns are ignored.
    """
    head = F.concat(F.lit(template.turn), template.escape_role(F.col("role")), F.lit("\n"))
    body = messages.withColumns({"_fs_head": head, "_fs_body": template.escape(F.col("text"))})
    sized = body.select("conv_id", "slot", "role", F.concat("_fs_head", "_fs_body", F.lit(template.end)).alias("_fs_part"), F.char_length("_fs_head").alias("_fs_skip"), F.char_length("_fs_body").alias("_fs_len"))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("_fs_part")).over(before), F.lit(0))
    first = F.col("_fs_start") + F.col("_fs_skip")
    span = F.struct(F.col("_fs_start").alias("start"), first.alias("loss_start"), (first + F.when(F.col("role") == template.masked_role, F.col("_fs_len")).otherwise(0)).alias("loss_end"))
    whole = sized.withColumn("_fs_start", start).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("slot", F.col("_fs_part").alias("part"), span.alias("span")))).alias("_fs_turns"))
    return whole.select("conv_id", F.array_join(F.transform("_fs_turns", lambda t: t["part"]), "").alias("formatted"), F.transform("_fs_turns", lambda t: t["span"]).alias("turn_spans"))


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse rendered conversations: adds turns array<struct<role, text>> and loss_texts array<string>, unescaped. Masked
    turns without text add nothing to loss_texts; an empty table gives no rows."""
    parts = F.slice(F.split("formatted", f"\\Q{template.turn}\\E", -1), F.lit(2), F.greatest(F.size("turn_spans"), F.lit(0)))

    def turn(part: Column) -> Column:
        cut = F.locate("\n", part)
        role = F.substring(part, F.lit(1), cut - 1)
        text = F.substring(part, cut + 1, F.char_length(part) - cut - F.lit(len(template.end)))
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(text).alias("text"))

    def under_mask(part: Column, span: Column) -> Column:
        return F.substring(part, span["loss_start"] - span["start"] - len(template.turn) + 1, span["loss_end"] - span["loss_start"])

    masked = F.filter(F.arrays_zip(F.col("_fs_parts").alias("part"), F.col("turn_spans").alias("span")), lambda z: z["span"]["loss_end"] > z["span"]["loss_start"])
    return rendered.withColumn("_fs_parts", parts).withColumns({
        "turns": F.transform("_fs_parts", turn),
        "loss_texts": F.transform(masked, lambda z: template.unescape(under_mask(z["part"], z["span"]))),
    }).drop("_fs_parts")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Finished turns to rendered conversations, through the event log. Null roles and texts count as empty, equal turns
    each, turns without conv_id as one conversation; an empty table gives no rows; other columns are ignored."""
    return render(fold(events_from_turns(turns)), template)
