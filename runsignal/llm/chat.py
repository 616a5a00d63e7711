"""Dialogues rendered once from every participant's view, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``open + role [+ name] + newline + text + close``.  Roles in ``context`` keep their role in every
    view and take no view of their own.  ``block`` turn numbers are added up at a time."""

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    context: tuple[str, ...] = ("system",)
    block: int = 1024


def perspectives(turns: DataFrame, cfg: Template = Template()) -> DataFrame:
    """One row for every turn of every view: ``conv_id, perspective, pos, turn, role, name, segment, start, end,
    loss_start, loss_end``.

    In a view its speaker is ``assistant``, all others are ``user`` with their name.  Segments in the order of ``pos``
    are the rendered dialogue; start and end are its character offsets.  Loss is on the view's own
    texts with their closing tag, else null.  Turns go by number, then speaker and text; a null number comes last, a
    null text is empty, a null speaker is named ``unknown``.  Rows with a null conv_id are one dialogue.
    A dialogue with context turns only has no view.

    A dialogue is never gathered: offsets are running sums inside blocks of turn numbers plus the sums of
    the blocks before, so a dialogue with many turns is spread over tasks.
    """
    speaker = F.coalesce(F.col("role"), F.lit("unknown"))
    rows = turns.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    views = rows.where(~F.col("speaker").isin(*cfg.context)).select(F.col("conv_id").alias("v_conv"), F.col("speaker").alias("perspective")).distinct()
    rows = rows.join(views, F.col("conv_id").eqNullSafe(F.col("v_conv"))).drop("v_conv")
    own, context = F.col("speaker") == F.col("perspective"), F.col("speaker").isin(*cfg.context)
    role = F.when(own, "assistant").when(context, F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(cfg.open), F.col("v_role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), "name")).otherwise(""), F.lit("\n"))
    rows = rows.withColumns({"v_own": own, "v_role": role, "name": F.when(~own & ~context, F.col("speaker"))}).withColumn("v_head", head)
    rows = rows.withColumns({"v_size": F.length("v_head") + F.length("text") + len(cfg.close), "v_block": F.floor(F.col("turn") / cfg.block)})
    key = ["conv_id", "perspective"]
    sums = rows.groupBy(*key, "v_block").agg(F.sum("v_size").alias("v_sum"), F.count("*").alias("v_n"))
    before = Window.partitionBy(*key).orderBy(F.asc_nulls_last("v_block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(c).alias(f"b_{c}") for c in [*key, "v_block"]), _sum("v_sum", before).alias("b_chars"), _sum("v_n", before).alias("b_pos"))
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in [*key, "v_block"]]
    inside = Window.partitionBy(*key, "v_block").orderBy(F.asc_nulls_last("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"i_chars": _sum("v_size", inside), "i_pos": F.count("*").over(inside)}).join(sums, same[0] & same[1] & same[2])
    start = F.col("i_chars") + F.col("b_chars")
    loss = start + F.length("v_head")
    return rows.select(
        *key,
        (F.col("i_pos") + F.col("b_pos")).alias("pos"),
        "turn",
        F.col("v_role").alias("role"),
        "name",
        F.concat("v_head", "text", F.lit(cfg.close)).alias("segment"),
        start.alias("start"),
        (start + F.col("v_size")).alias("end"),
        F.when(F.col("v_own"), loss).alias("loss_start"),
        F.when(F.col("v_own"), start + F.col("v_size")).alias("loss_end"),
    )


def _sum(column: str, window: Window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0)).cast("long")
