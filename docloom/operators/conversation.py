"""Chat history made ready for an answering model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.skew import top_per_key
from docloom.functions.text import strip
from docloom.settings import DEFAULTS, Settings


def last_turns(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The last ``2 x history_turns`` turns with any text, per conversation."""
    spoken = turns.where(strip(F.col("text")) != "")
    return top_per_key(spoken, ["conv_id"], [F.col("turn").desc()], 2 * settings.history_turns, "_n").drop("_n")


def history(turns: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``(conv_id, position, role, text)``: neighbours of one role merged, starting with the user, ending with the assistant.

    Works on the last turns only, so a window over one conversation sees a dozen rows at most.
    """
    recent = last_turns(turns, settings)
    by_turn = Window.partitionBy("conv_id").orderBy("turn")
    changed = F.coalesce(F.col("role") != F.lag("role").over(by_turn), F.lit(True)).cast("int")
    runs = recent.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(by_turn))
    merged = runs.groupBy("conv_id", "run").agg(
        F.first("role").alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n").alias("text"),
    )
    bounds = merged.groupBy("conv_id").agg(
        F.min(F.when(F.col("role") == "user", F.col("run"))).alias("low"), F.max(F.when(F.col("role") == "assistant", F.col("run"))).alias("high")
    )
    kept = merged.join(bounds, "conv_id").where(F.col("run").between(F.col("low"), F.col("high")))
    return kept.select("conv_id", (F.col("run") - F.col("low") + 1).cast("int").alias("position"), "role", "text")
