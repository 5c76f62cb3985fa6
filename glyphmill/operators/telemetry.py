"""Cohort and product telemetry aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio, rnd


def mature(users: DataFrame, signup: str, end: DataFrame, days: int) -> DataFrame:
    """Users whose whole window of days lies before the end of the data (V14); end(end) is one row."""
    return users.join(F.broadcast(end), F.col(signup) <= F.date_sub(F.col("end"), days)).drop("end")


def retention(users: DataFrame, activity: DataFrame, days: tuple[int, ...] = (1, 7, 30), by: list[str] = ()) -> DataFrame:
    """users(user, signup, ...), activity(user, day): share of users active exactly n days after signup (A1, J6, T-25).

    One join and conditional flags instead of one self join for each day; users without activity stay in the denominator.
    """
    n = F.datediff("day", "signup")
    flags = [F.max(F.when(n == d, 1).otherwise(0)).alias(f"d{d}") for d in days]
    near = activity.select("user", "day").distinct()
    per = users.join(near, "user", "left").groupBy("user", *by).agg(*flags)
    out = per.groupBy(*by).agg(F.count("*").alias("eligible"), *[F.sum(f"d{d}").alias(f"d{d}_users") for d in days])
    return out.select(*by, "eligible", *[c for d in days for c in (F.col(f"d{d}_users"), ratio(F.col(f"d{d}_users"), F.col("eligible")).alias(f"d{d}_rate"))])


def monetisation(users: DataFrame, payments: DataFrame, by: list[str]) -> DataFrame:
    """users(user, ...), payments(user, amount): payers, revenue, conversion, ARPU, ARPPU (null without payer) by cohort."""
    eligible = users.groupBy(*by).agg(F.count("*").alias("eligible"))
    paid = payments.join(users, "user").groupBy(*by).agg(F.countDistinct("user").alias("payers"), F.count("*").alias("transactions"), F.sum("amount").alias("revenue"))
    j = eligible.join(paid, by, "left")
    payers, revenue = F.coalesce("payers", F.lit(0)), F.coalesce("revenue", F.lit(0.0))
    return j.select(
        *by,
        "eligible",
        payers.alias("payers"),
        F.coalesce("transactions", F.lit(0)).alias("transactions"),
        rnd(revenue, 2).alias("revenue"),
        ratio(payers, F.col("eligible")).alias("conversion"),
        ratio(revenue, F.col("eligible"), 2).alias("arpu"),
        F.when(payers > 0, rnd(revenue / payers, 2)).alias("arppu"),
    )


def engagement(events: DataFrame, user: str, flags: dict[str, Column], outcome: Column) -> DataFrame:
    """Two-level aggregate: flags of each user, then users and outcome share of each flag combination."""
    per = events.groupBy(user).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(k) for k, c in flags.items()], F.max(F.when(outcome, 1).otherwise(0)).alias("outcome"))
    return per.groupBy(*flags).agg(F.count("*").alias("users"), F.sum("outcome").alias("with_outcome"), ratio(F.sum("outcome"), F.count("*")).alias("outcome_rate"))


def segmentation(events: DataFrame, by: list[Column], failed: Column, value: str, user: str) -> DataFrame:
    """Sessions, failures, failure rate, mean value and users by segment (A4)."""
    f = F.sum(F.when(failed, 1).otherwise(0))
    return events.groupBy(*by).agg(F.count("*").alias("sessions"), f.alias("failures"), ratio(f, F.count("*")).alias("failure_rate"), rnd(F.avg(value), 2).alias("mean_value"), F.countDistinct(user).alias("users"))


def funnel(events: DataFrame, user: str, first: Column, then: Column) -> DataFrame:
    """Users of the first step, those who took the next, conversion with a zero guard (A5, J8): one pass of flags, no join."""
    per = events.groupBy(user).agg(F.max(F.when(first, 1).otherwise(0)).alias("a"), F.max(F.when(then, 1).otherwise(0)).alias("b")).filter("a = 1")
    return per.agg(F.count("*").alias("participants"), F.coalesce(F.sum("b"), F.lit(0)).alias("buyers"), ratio(F.coalesce(F.sum("b"), F.lit(0)), F.count("*"), 5).alias("conversion"))


def subset_share(rows: DataFrame, by: list[str], within: Column, subset: Column) -> DataFrame:
    """By group the rows within a condition, those of them in a subset, and their share, 0 where there are none."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = rows.groupBy(*by).agg(n(within).alias("rows"), n(within & subset).alias("matching"))
    return g.withColumn("share", ratio(F.col("matching"), F.col("rows")))


def roll_up(aggregate: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """An aggregate of sums added up over the keys that are left out (A9); it reads the aggregate, not the rows again."""
    return aggregate.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts])
