"""Source and topic summaries with anchored windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, ratio, rnd


def source_summary(rows: DataFrame, by: list[str], negative: Column, weight: Column, when: str) -> DataFrame:
    """Records, first and last time (epoch microseconds), negative share, engagement by source."""
    us = F.unix_micros(F.col(when))
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), ratio(F.sum(F.when(negative, 1).otherwise(0)), F.count("*")).alias("negative_share"), F.sum(weight).alias("engagement"))


def period_label(rows: DataFrame, when: str, days: int = 30) -> DataFrame:
    """Adds period: recent, prior or older than the windows before the latest time of the data (W6, T-27)."""
    end = rows.agg(F.max(when).alias("anchor"))
    w = F.expr(f"INTERVAL '{days}' DAY")
    t = F.col(when)
    label = F.when(t >= F.col("anchor") - w, "recent").when(t >= F.col("anchor") - w - w, "prior").otherwise("older")
    return rows.join(F.broadcast(end), how="cross").withColumn("period", label).drop("anchor")  # one row


def topic_priority(rows: DataFrame, topic: str, source: str, when: str, negative: Column, days: int = 30, other: str = "Other") -> DataFrame:
    """Priority table by topic (A12, W6, W9, F-19): volume, negative share, momentum of shares, breadth, total and label.

    One aggregate over the rows; totals and the largest topic come from windows over its few result rows.
    """
    p = period_label(rows, when, days)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = p.groupBy(F.col(topic).alias("topic")).agg(
        F.count("*").alias("records"), one(negative).alias("negatives"), F.countDistinct(source).alias("sources"), one(F.col("period") == "recent").alias("recent"), one(F.col("period") == "prior").alias("prior")
    )
    every = Window.partitionBy(F.lit(1))
    total, top = F.sum("records").over(every), F.max("records").over(every)
    share = lambda c: F.col(c).cast("double") / F.greatest(F.lit(1), F.sum(c).over(every))
    g = g.select(
        "*",
        ratio(F.col("records"), total).alias("share"),
        ratio(F.col("negatives"), F.col("records")).alias("negative_share"),
        rnd((share("recent") + 0.005) / (share("prior") + 0.005), 4).alias("momentum"),
        bucket(F.col("records").cast("double") / F.greatest(F.lit(1), top), 0.15, 0.35, 0.65).alias("volume_score"),
    )
    g = g.withColumn("negative_score", bucket(F.col("negative_share"), 0.2, 0.4, 0.6)).withColumn("momentum_score", F.when(F.col("recent") + F.col("prior") >= 5, bucket(F.col("momentum"), 1.05, 1.3, 1.75)).otherwise(0))
    g = g.withColumn("breadth_score", F.least(F.lit(3), F.col("sources")).cast("int"))
    score = F.when(F.col("topic") == other, 0).otherwise(F.col("volume_score") + F.col("negative_score") + F.col("momentum_score") + F.col("breadth_score"))
    g = g.withColumn("priority_score", score.cast("int"))
    label = F.when(F.col("topic") == other, "N/A").when(F.col("priority_score") >= 10, "P0").when(F.col("priority_score") >= 7, "P1").when(F.col("priority_score") >= 4, "P2").otherwise("P3")
    return g.withColumn("priority", label)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; rank is row_number over a full order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the last by order (W1, U2, U4, U7): an aggregate with map-side combine, no window sort of hot keys."""
    rest = [c for c in rows.columns if c not in key]
    got = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return got.select(*key, "r.*").select(*rows.columns)


def anchored_momentum(rows: DataFrame, by: str, when: str, days: int = 30) -> DataFrame:
    """Recent and prior counts against each group's own latest time; undated rows count in volume only (A15, W7, T-28)."""
    last = rows.groupBy(by).agg(F.max(when).alias("anchor"))
    w = F.expr(f"INTERVAL '{days}' DAY")
    t = F.col(when)
    g = rows.join(last, by).groupBy(by).agg(
        F.count("*").alias("items"),
        F.sum(F.when(t >= F.col("anchor") - w, 1).otherwise(0)).alias("recent"),
        F.sum(F.when((t >= F.col("anchor") - w - w) & (t < F.col("anchor") - w), 1).otherwise(0)).alias("prior"),
    )
    ratio_ = rnd((F.col("recent") + 0.5) / (F.col("prior") + 0.5), 3)
    return g.withColumn("momentum", F.when(F.col("recent") + F.col("prior") >= 3, ratio_)).withColumn("volume_score", F.least(F.lit(3), F.ceil(F.log2(F.col("items") + 1))).cast("int"))
