"""Walking an entity's track in pieces: the row before, running sums and sessions without one entity's whole track in a task.

A track is cut into time blocks. Inside a block a window does the work; what a block needs from the blocks before it comes
from one row per block, so an entity with a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_S = 86_400.0
ORDER = ("ts", "event_id")


def block(seconds: float = BLOCK_S) -> Column:
    return F.floor(F.col("ts") / seconds).cast("long")


def with_previous(log: DataFrame, fields: list[str], out: str = "b", seconds: float = BLOCK_S) -> DataFrame:
    """Adds `out`, a struct of the fields of the entity's row before in the order of (ts, event_id); null at the first."""
    log = log.withColumn("_block", block(seconds))
    last = log.groupBy("entity_id", "_block").agg(F.max_by(F.struct(*fields), F.struct(*ORDER)).alias("_last"))
    carried = last.select("entity_id", "_block", F.lag("_last").over(Window.partitionBy("entity_id").orderBy("_block")).alias("_carried"))
    inside = F.lag(F.struct(*fields)).over(Window.partitionBy("entity_id", "_block").orderBy(*ORDER))
    joined = log.withColumn("_inside", inside).join(carried, ["entity_id", "_block"])
    return joined.select(*[c for c in log.columns if c != "_block"], F.coalesce("_inside", "_carried").alias(out))


def running_sum(log: DataFrame, value: Column, out: str, seconds: float = BLOCK_S) -> DataFrame:
    """Adds the sum of a whole-number value over the entity's rows up to this one, in the order of (ts, event_id)."""
    log = log.withColumn("_block", block(seconds)).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    sums = log.groupBy("entity_id", "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy("entity_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("entity_id", "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    inside = F.sum("_value").over(Window.partitionBy("entity_id", "_block").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    joined = log.withColumn("_inside", inside).join(carried, ["entity_id", "_block"])
    return joined.select(*[c for c in log.columns if c not in ("_block", "_value", out)], (F.col("_inside") + F.col("_carried")).alias(out))
