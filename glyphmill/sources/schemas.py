"""Schemas of the domain's records and checks of their contracts."""

from __future__ import annotations

VOICE_ROW = """record_id string, source string, source_type string, game string, channel string, content_type string, source_content_id string,
parent_id string, title string, url string, language string, created_at timestamp, collected_at timestamp, text string, recommended boolean,
rating double, engagement_score double, reply_count long, playtime_hours double, metadata_json string"""

ANNOTATION = """evidence_id string, primary_topic string, secondary_topics array<string>, sentiment string, sentiment_score double,
requests array<string>, behaviours array<string>, pains array<string>, needs array<string>, confidence double, needs_review boolean"""

LINK = "evidence_id string, query_id string, run_id string, source string, language string, intent string, query_text string, alias_ids array<string>"

# Rules by record: SQL predicates that must not be false.
RULES = {
    "voice": {
        "required": "source IS NOT NULL AND game IS NOT NULL AND source_content_id IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL",
        "id matches": "record_id = substring(sha2(concat_ws(':', source, source_content_id), 256), 1, 20)",
        "counts are not negative": "coalesce(reply_count, 0) >= 0 AND coalesce(playtime_hours, 0) >= 0",
    },
    "annotation": {"score in range": "sentiment_score IS NULL OR abs(sentiment_score) <= 1", "confidence in range": "confidence BETWEEN 0 AND 1"},
    "evidence": {"scope": "(access_scope = 'private') = (coalesce(dataset_id, '') <> '')", "score in range": "relevance_score IS NULL OR relevance_score BETWEEN 0 AND 1"},
}
