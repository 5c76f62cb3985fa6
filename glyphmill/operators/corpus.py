"""Corpus counts, guards and lookups, and the comparison of games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .insights import COMMUNITY_KINDS


def gate(evidence: DataFrame, game_id: str | None = None, label: str | None = None, community: bool = False, scope: str | None = None) -> DataFrame:
    """The filter of the store's reader, each condition only where it is asked for (V6)."""
    for column, value in (("game_id", game_id), ("relevance_label", label), ("access_scope", scope)):
        if value is not None:
            evidence = evidence.filter(F.col(column) == value)
    return evidence.filter(F.col("evidence_kind").isin(COMMUNITY_KINDS)) if community else evidence


def source_counts(evidence: DataFrame) -> DataFrame:
    """Items by source with their labels and duplicates: rows less distinct (source, content id) (A21). Fact sources count as official."""
    one = lambda v: F.sum(F.when(F.col("relevance_label") == v, 1).otherwise(0)).alias(v)
    e = evidence.withColumn("bucket", F.when(F.col("evidence_kind") == "fact_source", "official").otherwise(F.col("source")))
    g = e.groupBy("bucket").agg(F.count("*").alias("items"), one("relevant"), one("ambiguous"), one("irrelevant"), F.countDistinct("source", "source_content_id").alias("n"))
    return g.select(F.col("bucket").alias("source"), "items", "relevant", "ambiguous", "irrelevant", (F.col("items") - F.col("n")).alias("duplicates"))


def label_counts(evidence: DataFrame) -> DataFrame:
    """Community items by scope and label."""
    return gate(evidence, community=True).groupBy("access_scope", "relevance_label").agg(F.count("*").alias("items"))


def missing_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Keys of left without a row in right, with their rows: the guard before a join that must be complete (J9, J12). Null keys are missing."""
    return left.join(right.select(*on).distinct(), on, "left_anti").groupBy(*on).agg(F.count("*").alias("rows"))


def require_all(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left joined to right one to one; raises where a key of left has none."""
    lost = missing_from(left, right, on).limit(5).collect()
    if lost:
        raise ValueError(f"without a match: {[tuple(r)[:-1] for r in lost]}")
    return left.join(right, on)


def with_query(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Each item with the intent and text of its query, or with its retrieval method where the link is unknown (J18); one row an item."""
    q = links.groupBy("evidence_id", "query_id").agg(F.min("intent").alias("intent"), F.min("query_text").alias("query_text"))
    j = evidence.join(q, ["evidence_id", "query_id"], "left")
    return j.withColumn("provenance", F.coalesce("intent", F.concat(F.lit("unlinked:"), "retrieval_method"), F.lit("unlinked")))


def layers(ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """ids(id) with layer: community where the id is evidence, else fact."""
    known = evidence.select(F.col("evidence_id").alias("id")).distinct().withColumn("layer", F.lit("community"))
    return ids.join(known, "id", "left").withColumn("layer", F.coalesce("layer", F.lit("fact")))


def game_coverage(members: DataFrame) -> DataFrame:
    """Corpus size, sources, languages, first and last day and extension topics (those with a dot) of each game."""
    return members.groupBy("game_id").agg(
        F.countDistinct("evidence_id").alias("items"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.array_join(F.array_sort(F.collect_set(F.coalesce("language", F.lit("unknown")))), ",").alias("languages"),
        F.to_date(F.min("published_at")).alias("first_day"), F.to_date(F.max("published_at")).alias("last_day"), F.countDistinct(F.when(F.contains("topic", F.lit(".")), F.col("topic"))).alias("extension_topics"),
    )


def comparison_status(members: DataFrame, games: list[str], days: int = 180, ratio: float = 4.0, floor: int = 3) -> DataFrame:
    """Whether games can be compared on each topic, and why not.

    Fewer than floor items for any of the games: insufficient; unlike source mixes, last days more than days apart, or counts over ratio
    to one: with caution. The last days count only if every game has one.
    """
    m = members.filter(F.col("game_id").isin(games))
    per = m.groupBy("topic", "game_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("mix"), F.max("published_at").alias("end"))
    g = per.groupBy("topic").agg(F.count("*").alias("games"), F.min("n").alias("least"), F.max("n").alias("most"), F.countDistinct("mix").alias("mixes"), F.count("end").alias("dated"), F.unix_micros(F.max("end")).alias("z"), F.unix_micros(F.min("end")).alias("a"))
    gap = F.floor((F.col("z") - F.col("a")) / 86_400_000_000)
    reasons = F.concat_ws("; ", F.when(F.col("mixes") > 1, "source mix"), F.when((F.col("dated") == F.col("games")) & (gap > days), "dates"), F.when(F.col("most") / F.col("least") > ratio, "sample sizes"))
    least = F.when(F.col("games") < len(games), 0).otherwise(F.col("least"))
    g = g.withColumn("status", F.when(least < floor, "insufficient_evidence").when(reasons != "", "comparable_with_caution").otherwise("comparable"))
    return g.select("topic", "games", least.cast("long").alias("least"), "most", "status", F.when(F.col("status") == "comparable_with_caution", reasons).otherwise("").alias("reasons"))


def fact_status(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """facts(entity, fact_type, value), entities(entity): how many entities have each fact, and whether all, some or none can be compared."""
    n = entities.agg(F.countDistinct("entity").alias("entities"))
    g = facts.join(entities, "entity", "left_semi").groupBy("fact_type").agg(F.countDistinct("entity").alias("available"), F.count("*").alias("values"))
    g = g.join(F.broadcast(n), how="cross")  # one row
    status = F.when(F.col("available") == F.col("entities"), "comparable").when(F.col("available") > 0, "partial").otherwise("insufficient_evidence")
    return g.withColumn("status", status)


def result_ranks(results: DataFrame, query: str, item: Column, order: list[Column], own: Column, key_length: Column, top: int = 10, near: int = 5) -> DataFrame:
    """Where a query's own item ranks among its first results, and how ambiguous the query is by the others near the top.

    Of a query only the first top results are kept (a group limit, no full sort); queries whose own item is not among them give no row.
    """
    r = results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1).filter(F.col("rank") < top)
    g = r.groupBy(query).agg(F.min(F.when(own, F.col("rank"))).alias("rank"), F.sum(F.when(~own & (F.col("rank") < near), 1).otherwise(0)).alias("competitors"), F.max(key_length).alias("length"), F.min(F.when(own, item)).alias("item"))
    ambiguity = F.when(F.col("competitors") == 0, "none").when(F.col("length") <= 3, "high").otherwise("medium")
    return g.filter("rank is not null").select(query, "item", "rank", "competitors", ambiguity.alias("ambiguity"))


def first_values(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """By key the first non-null value of each column in the given order (W3, W8): an aggregate, no sort."""
    return rows.groupBy(*key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
