"""Audience views: comparison, preference fit, findings, controversies, run status."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rnd
from .summaries import top_per_group


def compare_grid(items: DataFrame) -> DataFrame:
    """items(subject, dimension, source) to a complete grid with counts, share of the subject in percent and a confidence class.

    The grid is the product of two small aggregates (subjects and dimensions), never of the items.
    """
    cells = items.groupBy("subject", "dimension").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    totals = cells.groupBy("subject").agg(F.sum("n").alias("total"))
    grid = totals.join(cells.select("dimension").distinct(), how="cross")
    n = F.coalesce("n", F.lit(0))
    level = F.when(n == 0, "insufficient").when(n < 3, "low").when((n >= 5) & (F.col("sources") >= 2), "higher").otherwise("medium")
    g = grid.join(cells, ["subject", "dimension"], "left")
    return g.select("subject", "dimension", n.alias("n"), rnd(100.0 * n.cast("double") / F.col("total"), 1).alias("share"), level.alias("confidence"))


def preference_fit(positions: DataFrame, wanted: list[str], avoided: list[str]) -> DataFrame:
    """Fit of each topic to a profile: avoided and met is friction, wanted and praised at all a match, wanted and only complained of friction."""
    n = lambda v: F.sum(F.when(F.col("position") == v, 1).otherwise(0))
    g = positions.groupBy("topic").agg(n("positive").alias("praise"), n("negative").alias("complaints"), F.countDistinct("source").alias("sources"))
    p, c, t = F.col("praise"), F.col("complaints"), F.col("topic")
    fit = F.when(t.isin(avoided) & (p + c > 0), "possible_friction").when(t.isin(wanted) & (p > 0), "likely_match").when(t.isin(wanted) & (c > 0), "possible_friction").otherwise("uncertain")
    return g.withColumn("fit", fit)


def findings(annotated: DataFrame, n: int) -> DataFrame:
    """Negative and mixed rows with the weight of their topic's complaints, the first n of each topic."""
    bad = annotated.filter(F.col("sentiment").isin("negative", "mixed")).select("ingest_seq", F.col("primary").alias("topic"), "hits")
    weight = bad.groupBy("topic").agg(F.count("*").alias("weight"))
    r = top_per_group(bad, ["topic"], [F.desc("hits"), F.col("ingest_seq")], n).join(weight, "topic", "left")
    return r.select("ingest_seq", "topic", F.coalesce("weight", F.lit(-1)).alias("weight"), "rank")


def controversies(positions: DataFrame, least: int = 2) -> DataFrame:
    """Topics with at least so many distinct pieces of evidence on each side, none of which is on both.

    Evidence that states both positions is counted as shared and makes its topic not distinguishable; each piece is reduced to one row
    per topic before topics are counted, so the sides never meet as lists.
    """
    has = lambda v: F.max((F.col("position") == v).cast("int"))
    each = positions.filter("topic != 'unknown'").groupBy("topic", "evidence_id").agg(has("positive").alias("p"), has("negative").alias("n"))
    g = each.groupBy("topic").agg(F.sum("p").alias("pro"), F.sum("n").alias("con"), F.sum(F.col("p") * F.col("n")).alias("shared"))
    return g.filter((F.col("pro") >= least) & (F.col("con") >= least)).withColumn("distinguishable", F.col("shared") == 0)


def source_states(runs: DataFrame) -> DataFrame:
    """run_id, source, status, items_retrieved from the JSON status maps of runs."""
    m = F.from_json("source_status", "map<string,struct<status:string,items_retrieved:long>>")
    return runs.select("run_id", F.explode(m).alias("source", "s")).select("run_id", "source", "s.*")


def status_rollup(runs: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """State of each source over all runs from the JSON status maps (A20); sources without any result are disabled.

    Items beside a failure are partial; else all collected, any partial, all unavailable, in that order; else failed.
    """
    x, st = source_states(runs), F.col("status")
    g = x.groupBy("source").agg(F.count("*").alias("runs"), F.sum("items_retrieved").alias("items"), F.bool_and(st == "collected").alias("all_ok"), F.bool_or(st == "partial").alias("part"), F.bool_or(st == "failed").alias("fail"), F.bool_and(st == "unavailable").alias("gone"))
    state = F.when((F.col("items") > 0) & F.col("fail"), "partial").when(F.col("all_ok"), "collected").when(F.col("part"), "partial").when(F.col("gone"), "unavailable").otherwise("failed")
    g = g.select("source", "runs", "items", state.alias("state"))
    if sources:
        want = runs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
        g = want.join(g, "source", "full").select("source", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("state", F.lit("disabled")).alias("state"))
    return g


def usable_difference(gaps: DataFrame, per_source: DataFrame, least: int = 2) -> DataFrame:
    """Differences between sources that rest on at least so many items of each of their two sources (V13). per_source(topic, source, n)."""
    n = lambda side: per_source.select("topic", F.col("source").alias(side), F.col("n").alias(f"{side}_n"))
    j = gaps.join(n("highest"), ["topic", "highest"]).join(n("lowest"), ["topic", "lowest"])
    return j.filter((F.col("highest_n") >= least) & (F.col("lowest_n") >= least))


def parse_preferences(text: str, topics: dict[str, list[str]], against: list[str], reach: int = 24) -> dict[str, list[str]]:
    """One person's wish as wanted and avoided topics (D24): a topic is avoided where a word of against stands in the same clause, up to reach
    characters before one of its terms, else wanted; avoided wins. A driver-side function for a single text."""
    low, found = " ".join(unicodedata.normalize("NFKC", text or "").casefold().split()), {"wanted": set(), "avoided": set()}
    for topic, terms in topics.items():
        for term in terms:
            for m in re.finditer(re.escape(term), low):
                clause = re.split(r"[,.;!?，。；！？]|\bbut\b|但", low[max(0, m.start() - reach) : m.start()])[-1]
                found["avoided" if any(w in clause for w in against) else "wanted"].add(topic)
    return {"wanted": sorted(found["wanted"] - found["avoided"]), "avoided": sorted(found["avoided"])}
