"""Helpers that keep one heavy key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT_SPREAD = 1024


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: list[str],
    size_column: str,
    row_id: str,
    hot_share: int = 1000,
    keep_unmatched: bool = False,
) -> DataFrame:
    """Join one-row-per-key facts back to the rows they came from.

    A key holding more than ``1/hot_share`` of all rows is hot. There can be at most ``hot_share``
    such keys whatever the data size, so that slice of ``per_key`` is safe to broadcast. Rows of hot keys
    are then spread by ``row_id`` for the shuffle join that serves every other key.
    """
    # At most hot_share - 1 keys can each exceed that share of the total, so this side has a fixed bound.
    limit = per_key.agg((F.sum(size_column) / hot_share).alias("limit")).scalar()
    facts = [c for c in per_key.columns if c not in key]
    hot = per_key.where(F.col(size_column) > limit).select(*key, F.struct(*facts).alias("_hot"))
    # Always 0, but no constant: the optimizer would fold a constant into the join condition and deal rows by the key alone.
    zero = F.least(F.col(size_column), F.lit(0)).cast("int")
    cold = per_key.where(F.col(size_column) <= limit).select(*key, zero.alias("_spread"), F.struct(*facts).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_spread",
        F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(row_id), F.lit(HOT_SPREAD)).cast("int") + 1),
    )
    joined = marked.join(cold, [*key, "_spread"], "left").withColumn("_facts", F.coalesce("_hot", "_cold"))
    if not keep_unmatched:
        joined = joined.where(F.col("_facts").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_facts.{c}").alias(c) for c in facts])


def running_number(df: DataFrame, key: list[str], block: Column, order: list[Column], output: str) -> DataFrame:
    """``row_number`` inside each key, computed in two levels.

    Rows are numbered inside (key, block) and shifted by the sizes of the earlier blocks, so a key
    with a third of all rows is sorted by many tasks. ``block`` must grow with ``order``.
    """
    tagged = df.withColumn("_block", block)
    sizes = tagged.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy(*key, "_block").orderBy(*order)
    numbered = tagged.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*key, "_block"])
        .withColumn(output, (F.col("_local") + F.col("_before")).cast("int"))
        .drop("_block", "_local", "_before")
    )


def previous_value(df: DataFrame, key: list[str], order: str, block: Column, values: list[str], prefix: str = "prev_") -> DataFrame:
    """Backward as-of lookup on ``order`` inside each key, in blocks so a heavy key stays parallel."""
    tagged = df.withColumn("_block", block)
    payload = F.struct(order, *values)
    last = tagged.groupBy(*key, "_block").agg(F.max_by(payload, F.col(order)).alias("_last"))
    carry = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carry", F.last("_last", ignorenulls=True).over(carry)).drop("_last")
    local = Window.partitionBy(*key, "_block").orderBy(order)
    looked = tagged.withColumn("_local", F.lag(payload).over(local)).join(carried, [*key, "_block"])
    found = F.coalesce("_local", "_carry")
    return looked.select(*df.columns, *[found[c].alias(prefix + c) for c in [order, *values]])


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Top ``k`` rows of each key; the rank filter prunes inside every map task before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)
