"""Sourced facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id


def unpivot(rows: DataFrame, entity: str, columns: dict[str, str]) -> DataFrame:
    """One fact row for each non-empty value of the named columns, with a stable id (S22, D18, T-23: absent values make no fact)."""
    parts = ", ".join(f"'{t}', cast(`{c}` as string)" for t, c in columns.items())
    f = rows.select(F.col(entity).cast("string").alias("entity"), F.expr(f"stack({len(columns)}, {parts}) AS (fact_type, value)"))
    f = f.filter(F.col("value").isNotNull() & (F.trim("value") != ""))
    return f.withColumn("fact_id", stable_id("fact_", F.col("entity"), F.col("fact_type"), F.col("value")))


def conflicts(facts: DataFrame, by: list[str], multi: list[str] = ()) -> DataFrame:
    """Groups with more than one distinct value of a single-valued fact."""
    g = facts.filter(~F.col("fact_type").isin(list(multi)) if multi else F.lit(True)).groupBy(*by)
    return g.agg(F.count("*").alias("facts"), F.countDistinct("value").alias("values")).filter("values > 1")


def in_scope(scope: Column, wanted: list[str]) -> Column:
    """A null scope matches any request, others case-insensitively (V8, T-22)."""
    return scope.isNull() | F.lower(scope).isin([w.lower() for w in wanted])


def readiness(facts: DataFrame, wanted: list[str]) -> DataFrame:
    """By entity the wanted fact types that are there and those that are missing."""
    g = facts.filter(F.col("fact_type").isin(wanted)).groupBy("entity").agg(F.collect_set("fact_type").alias("have"))
    return g.select("entity", F.array_join(F.array_sort("have"), ",").alias("available"), F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), "have")), ",").alias("missing"))
