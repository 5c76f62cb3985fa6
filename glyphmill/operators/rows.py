"""Conversions between evidence and the flat voice row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pseudonym, slug, stable_id


def evidence_kind(content_type: Column, source_type: Column) -> Column:
    """review, comment, post or video, whichever the first of the two types names, in that order; else post (P5)."""
    of = lambda c: F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(k)), k) for k in ("review", "comment", "post", "video")])
    return F.coalesce(of(content_type), of(source_type), F.lit("post"))


def stable_game_id(title: Column) -> Column:
    """game_, the title as a slug of up to 48 characters, and eight digits of its hash."""
    name = slug(title)
    return F.concat_ws("_", F.lit("game"), F.when(name == "", "unknown").otherwise(name), F.substring(F.sha2(F.lower(title), 256), 1, 8))


def to_voice_rows(evidence: DataFrame, game: Column) -> DataFrame:
    """Evidence items as the 20 columns of the voice row (P1, P3); engagement falls back from votes to likes to 0, times to the retrieval."""
    fields = evidence.schema["engagement"].dataType.fieldNames()
    votes = F.coalesce(*[F.col(f"engagement.{c}").cast("double") for c in ("helpful_votes", "likes") if c in fields], F.lit(0.0))
    meta = evidence.schema["source_metadata"].dataType.fieldNames()
    channel = F.coalesce(*[F.col(f"source_metadata.{c}").cast("string") for c in ("app_id", "bvid") if c in meta], F.col("source"))
    return evidence.select(
        F.substring(F.sha2(F.concat_ws(":", "source", "source_content_id"), 256), 1, 20).alias("record_id"), "source", F.when(F.col("source") == "steam", "store_review").otherwise("video_comment").alias("source_type"),
        game.alias("game"), channel.alias("channel"), F.col("evidence_kind").alias("content_type"), "source_content_id", F.regexp_replace("parent_evidence_id", "^ev_", "").alias("parent_id"), "title",
        F.col("source_url").alias("url"), "language", F.coalesce("published_at", "retrieved_at").alias("created_at"), F.col("retrieved_at").alias("collected_at"), F.col("original_text").alias("text"), "recommended",
        "rating", votes.alias("engagement_score"), "reply_count", "playtime_hours", F.to_json("source_metadata").alias("metadata_json"),
    )


def to_evidence(voices: DataFrame, run_id: str) -> DataFrame:
    """Voice rows as evidence that awaits its relevance (P4): ids, kind and game id derived, null text dropped by the caller."""
    reference = F.when(F.col("url").isNull(), F.concat("source", F.lit(":"), F.coalesce("channel", "source_content_id")))
    return voices.select(
        F.concat(F.lit("ev_"), "record_id").alias("evidence_id"), stable_game_id(F.col("game")).alias("game_id"), evidence_kind(F.col("content_type"), F.col("source_type")).alias("evidence_kind"),
        F.lit("public").alias("access_scope"), "source", "source_content_id", F.concat(F.lit("ev_"), "parent_id").alias("parent_evidence_id"), F.col("url").alias("source_url"), reference.alias("source_reference"),
        "title", F.col("text").alias("original_text"), "language", F.lit(run_id).alias("run_id"), F.when(F.col("source_type") == "licensed_provider", "licensed_provider").otherwise("public_endpoint").alias("retrieval_method"),
        F.lit("pending").alias("relevance_label"), F.when(F.col("source") == "steam", "platform_store").otherwise("public_community").alias("source_class"), F.sha2(F.encode("text", "utf-8"), 256).alias("content_checksum"),
    )


def review_queue(evidence: DataFrame) -> DataFrame:
    """The 13 columns of ambiguous items that a reviewer sees."""
    provenance = F.struct("query_id", F.size(F.coalesce("matched_alias_ids", F.array().cast("array<string>"))).alias("aliases"))
    return evidence.filter("relevance_label = 'ambiguous'").select(
        "evidence_id", "game_id", "source", "source_content_id", "title", "original_text", "source_url", "query_id", "relevance_score", "relevance_label", "relevance_reasons", "relevance_method_version", provenance.alias("query_provenance")
    )


def authors(evidence: DataFrame, author: Column) -> DataFrame:
    """Adds author_key: 16 digits of the hash of source and author, null for a blank one (P9), and a stable id of the item."""
    return evidence.withColumn("author_key", pseudonym(F.col("source"), author)).withColumn("stable", stable_id("ev_", F.col("source"), F.col("source_content_id")))
