"""Multi-party perspective rotation of dialogues.

For every participant of a dialogue there is one row: the whole dialogue with that speaker as the assistant, every other speaker as a
user with a name, and the spans of the assistant's words, which are the ones to learn from.

Where a span lies for each speaker follows from two running figures of a turn, made in windows of the dialogue: the length of all turns before it, and how many of
them were by the same speaker, whose header is another one in that speaker's view. Windows and grouping share one shuffle by dialogue, there is no join, and the work
grows with the number of turns. A dialogue is one row for each participant, and so must fit a task.

Format: `<|system|>\\ntext<|end|>\\n`, `<|user name=NAME|>\\ntext<|end|>\\n`, `<|assistant|>\\ntext<|end|>\\n`. A span covers an assistant's text and its
`<|end|>`, counted in code points from 0, end exclusive, as `start:end` joined by commas.

Defined results: system turns belong to no participant and are rendered for everyone; a dialogue with system turns alone has no rows. A
null role is 'unknown', a null text is '', a null dialogue id is a dialogue of its own. Turns are in order of turn (null first), then role, then text; repeated rows are
repeated turns. `|` and line ends in a name become `_`, so that no name can end its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "<|assistant|>\n"


def _cleaned(name: Column) -> Column:
    return F.regexp_replace(name, r"[|\r\n]", "_")


def rotate(turns: DataFrame, dialogue: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """dialogue, speaker, rendered, n_turns, n_own, mask_spans, mask_chars: a row for every dialogue and participant."""
    own = turns.select(
        F.col(dialogue).alias("dialogue"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    name = F.when(F.col("role") == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _cleaned(F.col("role")), F.lit("|>\n")))
    shown = own.withColumns({"head": name, "body": F.concat("text", F.lit("<|end|>"))})
    whole = (F.length("head") + F.length("body") + 1).cast("long")
    before = Window.partitionBy("dialogue").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("dialogue", "role").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("at", F.coalesce(F.sum(whole).over(before), F.lit(0))).withColumn("nth", F.count(F.lit(1)).over(same))
    first = F.col("at") + F.col("nth") * (len(ASSISTANT) - F.length("head")) + len(ASSISTANT)
    placed = placed.withColumn("first", first).withColumn("last", F.col("first") + F.length("body"))
    turn_of = F.struct("turn", "role", "text", "at", "head", "body", "first", "last")  # equal turns are told apart by their places
    grouped = placed.groupBy("dialogue").agg(F.array_sort(F.collect_list(turn_of)).alias("turns"))
    each = grouped.select("dialogue", "turns", F.explode(F.array_distinct(F.filter(F.col("turns.role"), lambda r: r != system))).alias("speaker"))
    each = each.withColumn("own", F.filter("turns", lambda t: t["role"] == F.col("speaker")))
    return each.select(
        F.col("dialogue").alias(dialogue),
        "speaker",
        F.array_join(F.transform("turns", lambda t: F.concat(F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(t["head"]), t["body"], F.lit("\n"))), "").alias("rendered"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size("own").cast("long").alias("n_own"),
        F.array_join(F.transform("own", lambda t: F.concat_ws(":", t["first"], t["last"])), ",").alias("mask_spans"),
        F.aggregate("own", F.lit(0).cast("long"), lambda n, t: n + t["last"] - t["first"]).alias("mask_chars"),
    )
