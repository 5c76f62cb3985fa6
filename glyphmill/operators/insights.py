"""Coverage and evidence-linked insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bucket, ratio, rnd


def coverage(evidence: DataFrame, status: DataFrame) -> DataFrame:
    """evidence(source, label), status(source, status, retrieved): status wins, observed counts fall back."""
    one = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0)).alias(v)
    seen = evidence.groupBy("source").agg(F.count("*").alias("observed"), one("relevant"), one("ambiguous"), one("irrelevant"))
    j = seen.join(status, "source", "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("source", F.coalesce("status", F.lit("collected")).alias("status"), F.coalesce("retrieved", "observed").alias("retrieved"), zero("observed"), zero("relevant"), zero("ambiguous"), zero("irrelevant"))


# Kinds of evidence that count as community voices.
COMMUNITY_KINDS = ["review", "post", "comment", "video", "survey_response", "support_record"]


def corpus(rows: DataFrame) -> DataFrame:
    """The default gate of every insight: public, relevant community evidence (V5)."""
    return rows.filter((F.col("access_scope") == "public") & (F.col("relevance_label") == "relevant") & F.col("evidence_kind").isin(COMMUNITY_KINDS))


def positioned(annotated: DataFrame) -> DataFrame:
    """Adds position and method: the source's own recommendation wins over the lexicon."""
    own = F.when(F.col("recommended"), "positive").when(~F.col("recommended"), "negative")
    method = F.when(F.col("recommended").isNotNull(), "source_native_recommendation").otherwise("inferred_bilingual_lexicon")
    return annotated.withColumn("position", F.coalesce(own, F.col("sentiment"))).withColumn("method", method)


def memberships(annotated: DataFrame) -> DataFrame:
    """One row per (row, topic): primary and secondary topics alike."""
    return annotated.withColumn("topic", F.explode(F.array_distinct(F.concat(F.array("primary"), "secondary"))))


def priorities(member: DataFrame, by: list[str], eligible: DataFrame, days: int = 30) -> DataFrame:
    """member(*by, source, position, published_at) to the four priority components, their total of 0 to 12 and its label.

    eligible(source) are the collected sources; the windows end at each group's own latest dated row. One aggregate over the rows for the
    anchors and one for the counts, joined on the group.
    """
    w, t, a = F.expr(f"INTERVAL '{days}' DAY"), F.col("published_at"), F.col("anchor")
    anchor = member.groupBy(*by).agg(F.max("published_at").alias("anchor"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = member.join(F.broadcast(eligible.select("source").distinct().withColumn("ok", F.lit(True))), "source", "left").join(anchor, by)  # a few sources
    g = g.groupBy(*by).agg(
        F.count("*").alias("items"), one(F.col("position") == "negative").alias("negatives"), one(t >= a - w).alias("recent"),
        one((t >= a - w - w) & (t < a - w)).alias("prior"), F.countDistinct(F.when(F.col("ok"), F.col("source"))).alias("breadth"),
    )
    g = g.withColumn("negative_share", ratio(F.col("negatives"), F.col("items")))
    g = g.withColumn("momentum", F.when(F.col("recent") + F.col("prior") >= 3, rnd((F.col("recent") + 0.5) / (F.col("prior") + 0.5), 3)))
    share = F.col("negatives").cast("double") / F.col("items")
    g = g.withColumn("volume_score", F.least(F.lit(3), F.ceil(F.log2(F.col("items") + 1))).cast("int")).withColumn("negative_score", bucket(share, 0.2, 0.4, 0.6))
    g = g.withColumn("momentum_score", F.coalesce(bucket(F.col("momentum"), 1.05, 1.3, 2.0), F.lit(0))).withColumn("breadth_score", F.least(F.lit(3), F.col("breadth")).cast("int"))
    total = sum(F.col(f"{c}_score") for c in ("volume", "negative", "momentum", "breadth")).cast("int")
    return g.withColumn("total", total).withColumn("label", F.when(total >= 9, "high").when(total >= 5, "medium").otherwise("low"))


def confidence_of(items: Column, sources: Column) -> Column:
    return rnd(F.least(F.lit(0.95), 0.45 + 0.08 * F.least(F.lit(5), items) + 0.05 * F.least(F.lit(2), sources)), 3)


def insights(member: DataFrame, max_topics: int = 12, cap: int = 12, least: int = 1) -> DataFrame:
    """member(game_id, topic, source, position) to one row per insight: kind, supporting and challenging counts, confidence (A17, D16, T-20, T-21).

    Topics of a game rank by (-items, name); the first max_topics give praise, complaint, controversy, difference (negative shares of two
    sources .30 apart, A19) and research_gap rows; of each kind but the last the first cap topics count. All windows run over aggregates.
    """
    n = lambda v: F.sum(F.when(F.col("position") == v, 1).otherwise(0)).alias(v)
    per = member.groupBy("game_id", "topic", "source").agg(F.count("*").alias("items"), n("positive"), n("negative"), n("mixed"))
    share = F.col("negative").cast("double") / F.col("items")
    side = lambda x: F.struct(x.alias("x"), "source", "items", share.alias("share"))
    total = lambda c: F.sum(c).alias(c)
    by = lambda v: F.count(F.when(F.col(v) > 0, 1)).alias(f"{v}_sources")
    both_ = F.count(F.when(F.col("positive") + F.col("negative") > 0, 1)).alias("polar_sources")
    g = per.groupBy("game_id", "topic").agg(
        total("items"), F.count("*").alias("sources"), total("positive"), total("negative"), total("mixed"), both_, by("mixed"), F.min(side(-share)).alias("hi"), F.min(side(share)).alias("lo")
    )
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("items"), "topic"))).filter((F.col("rank") <= max_topics) & (F.col("items") >= least))
    known, pos, neg, mixed, none = F.col("topic") != "unknown", F.col("positive"), F.col("negative"), F.col("mixed"), F.lit(0).cast("bigint")
    row = lambda kind, pro, con, sources: F.struct(F.lit(kind).alias("kind"), pro.alias("supports"), con.alias("challenges"), sources.alias("kind_sources"))
    gap = (F.col("sources") >= 2) & (F.col("hi.share") - F.col("lo.share") >= 0.3)
    kinds = F.array_compact(
        F.array(
            F.when(~known, row("research_gap", F.col("items"), none, F.col("sources"))),
            F.when(known & (pos > 0), row("praise", pos, neg, F.col("polar_sources"))),
            F.when(known & (neg > 0), row("complaint", neg, pos, F.col("polar_sources"))),
            F.when(known & (pos > 0) & (neg > 0), row("controversy", pos, neg, F.col("polar_sources"))),
            F.when(known & (mixed > 0) & ~((pos > 0) & (neg > 0)), row("research_gap", mixed, none, F.col("mixed_sources"))),
            F.when(known & gap, row("difference", F.col("hi.items"), F.col("lo.items"), F.lit(2).cast("bigint"))),
        )
    )
    r = g.select("game_id", "topic", "rank", F.explode(kinds).alias("k")).select("game_id", "topic", "rank", "k.*")
    slot = F.row_number().over(Window.partitionBy("game_id", "kind").orderBy("rank"))
    r = r.withColumn("slot", slot).filter((F.col("slot") <= cap) | (F.col("kind") == "research_gap"))
    return r.select("game_id", "topic", "rank", "kind", "supports", "challenges", confidence_of(F.col("supports") + F.col("challenges"), F.col("kind_sources")).alias("confidence"))


def source_gap(member: DataFrame, least: float = 0.3) -> DataFrame:
    """Topics whose negative share differs by least or more between sources, with the two sources (A19; ties by source)."""
    g = member.groupBy("topic", "source").agg(F.count("*").alias("n"), ratio(F.sum(F.when(F.col("position") == "negative", 1).otherwise(0)), F.count("*")).alias("share"))
    s = g.groupBy("topic").agg(
        F.count("*").alias("sources"), F.min(F.struct((-F.col("share")).alias("x"), "source")).alias("hi"), F.min(F.struct(F.col("share").alias("x"), "source")).alias("lo")
    )
    gap = rnd(-F.col("hi.x") - F.col("lo.x"), 4)
    return s.select("topic", "sources", F.col("hi.source").alias("highest"), F.col("lo.source").alias("lowest"), gap.alias("gap")).filter((F.col("sources") >= 2) & (F.col("gap") >= least))


def opportunities(annotated: DataFrame, groups: str, origin: str, cap: int = 12) -> DataFrame:
    """annotated(game_id, source, evidence_id, *groups array) to the first cap groups of each game by (-items, name), with their origin."""
    x = annotated.select("game_id", "source", "evidence_id", F.explode(groups).alias("name"))
    g = x.groupBy("game_id", "name").agg(F.count("*").alias("mentions"), F.countDistinct("evidence_id").alias("items"), F.countDistinct("source").alias("sources"))
    g = g.withColumn("rank", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("mentions"), "name"))).filter(F.col("rank") <= cap)
    return g.select("game_id", F.lit(origin).alias("origin"), "name", "mentions", "items", "rank", confidence_of(F.col("items"), F.col("sources")).alias("confidence"))
