"""Conversations and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summaries(messages: DataFrame) -> DataFrame:
    """conv_id, messages, title (the first user message, 60 signs at most), last_turn."""
    title = F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 60)), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), title.alias("title"), F.max("turn").alias("last_turn"))


def last_turns(messages: DataFrame, n: int = 6, chars: int = 700) -> DataFrame:
    """The last n turns of each conversation, oldest first, texts cut to `chars`."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), "text")
    rows = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return rows.select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("text"))


def nested(messages: DataFrame) -> DataFrame:
    """conv_id, messages: the ordered turns as an array of structs (a conversation is the unit that is asked for)."""
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def tool_status(events: DataFrame) -> DataFrame:
    """event_type, one count a status, mean value; status by the sign of the value."""
    status = F.when(F.col("value").isNull(), "unknown").when(F.col("value") >= 50, "ok").otherwise("error")
    counts = events.withColumn("status", status).groupBy("event_type").pivot("status", ["ok", "error", "unknown"]).count().na.fill(0)
    return counts.join(events.groupBy("event_type").agg(F.avg("value").alias("mean_value")), "event_type")


def since(events: DataFrame, as_of: Column, seconds: int, n: int) -> DataFrame:
    """The newest n events within the last seconds."""
    return events.where((F.col("ts") <= as_of) & (F.col("ts") > as_of - F.make_dt_interval(secs=F.lit(seconds)))).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def parse_since(text: str) -> int:
    """Seconds of a span such as 30m, 2h or 7d."""
    return int(text[:-1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[text[-1]]


def all_any(events: DataFrame) -> DataFrame:
    """user_id, every_positive, some_large."""
    return events.groupBy("user_id").agg(F.every(F.col("value") > 0).alias("every_positive"), F.some(F.col("value") > 90).alias("some_large"))
