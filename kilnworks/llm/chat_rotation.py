"""Multi-party perspective rotation: every participant of a dialogue in turn becomes the assistant.

For each conversation and participant the dialogue is rendered with that participant's turns as assistant turns and
all others as users under their names; system turns stay system turns and take no perspective. Masks are the spans
that a model should learn: the assistant's words and the mark that ends its turn.

A dialogue is rendered in parts of PART_TURNS turn numbers, so that a conversation with a very large share of the rows
is spread over many tasks; `start` is where a part begins in the whole rendering, and parts joined in order are the
whole. Masks count from the start of the whole.

No text or name can forge a turn: "<|" and "|>" inside of them become "< |" and "| >" before anything is rendered.

Edge cases: repeated rows (same conversation, turn, role and text) are one message; messages that share a turn number
stand in order of role, then text; a null text is empty, a null role is "unknown", a null turn comes first, null
conversations are one conversation; a conversation of system turns alone gives no rows; other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM = ("system",)
END = "<|end|>\n"
FIRST_TURN = -(1 << 62)


def _plain(words: Column) -> Column:
    """Words without the marks of turns."""
    return F.replace(F.replace(words, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, start, n_turns, text and masks (array of start and end) of each part of each perspective."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST_TURN)).alias("turn"),
        _plain(F.coalesce(role, F.lit("unknown"))).alias("role"),
        _plain(F.coalesce(text, F.lit(""))).alias("text"),
    ).distinct()
    rows = rows.withColumn("part", F.floor(F.col("turn") / part_turns).cast("long"))
    speakers = rows.filter(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    @F.pandas_udf("text string, masks array<struct<start:long,end:long>>")
    def render(lists: pd.Series, names: pd.Series) -> pd.DataFrame:
        texts, masks = [], []
        for said, speaker in zip(lists, names, strict=True):
            out, spans, at = [], [], 0
            for t in said:
                own, system = t["role"] == speaker, t["role"] in SYSTEM
                head = "<|assistant|>\n" if own else "<|system|>\n" if system else f"<|user name={t['role']}|>\n"
                piece = head + t["text"] + END
                if own:
                    spans.append({"start": at + len(head), "end": at + len(piece)})
                out.append(piece)
                at += len(piece)
            texts.append("".join(out))
            masks.append(spans)
        return pd.DataFrame({"text": texts, "masks": masks})

    made = seen.withColumn("_made", render("turns", "speaker")).select("conv_id", "speaker", "part", F.size("turns").alias("n_turns"), "_made.text", "_made.masks")
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("start", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)))
    moved = F.transform("masks", lambda m: F.struct((m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end")))
    return made.select("conv_id", "speaker", "part", "start", "n_turns", "text", moved.alias("masks"))
