"""Joins whose hot keys don't meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than this and than its share of all rows; so there are at most HOT_KEYS hot ones to broadcast.
HOT_ROWS, HOT_KEYS = 256, 4096


def hot_least(rows: int) -> int:
    """Rows beyond which a key is hot, in a table of `rows` rows."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str | list[str], least: int, count: str = "n") -> DataFrame:
    """Inner join of rows with one row per key. `count` holds the key's number of rows; hot keys are broadcast, others shuffled."""
    hot, cold = keyed.where(F.col(count) > least).drop(count), keyed.where(F.col(count) <= least).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def lone_key(key: Column, matchable: Column, *columns: str) -> Column:
    """The key as text, or one that matches nothing: rows that can't match are spread by the hash of their columns.

    The hash depends on the row alone, so a task that is run again sends it to the same place; equal rows stay together.
    """
    return F.when(matchable & key.isNotNull(), F.concat(F.lit("k"), key.cast("string"))).otherwise(F.concat(F.lit("~"), F.xxhash64(*columns).cast("string")))


def attach(rows: DataFrame, keyed: DataFrame, key: str, least: int, matchable: Column | None = None, count: str = "n") -> DataFrame:
    """Left join of rows with one row per key; hot keys are broadcast, and rows that can't match (or have no key) are spread.

    The columns of `keyed` but key and count must be named unlike those of rows.
    """
    new = [c for c in keyed.columns if c not in (key, count)]
    taken = {c.lower() for c in (*rows.columns, *keyed.columns)}
    pre = "_hot"
    while any(c.startswith(pre) for c in taken):
        pre = "_" + pre
    hot = keyed.where(F.col(count) > least).select(F.col(key).alias(f"{pre}0"), *[F.col(c).alias(f"{pre}_{c}") for c in new])
    cold = keyed.where(F.col(count) <= least).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias(f"{pre}1"), *new)
    ok = F.lit(True) if matchable is None else F.coalesce(matchable, F.lit(False))
    met = rows.join(F.broadcast(hot), (F.col(key) == F.col(f"{pre}0")) & ok, "left")
    met = met.withColumn(f"{pre}2", lone_key(F.col(key), ok & F.col(f"{pre}0").isNull(), *[c for c, t in rows.dtypes if "map<" not in t and t != "variant"]))
    out = met.join(cold, F.col(f"{pre}2") == F.col(f"{pre}1"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"{pre}_{c}", c).alias(c) for c in new])
