"""Queries of the training-data operators, pN_... by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .encoding import p7_ids
from .history import p3_found
from .language import p5_found, p5_languages, p5_segments
from .leakage import p8_found
from .lookalike import p6_forms, p6_found
from .moderation import p1_found, p1_rates, p1_scores
from .near_copies import p4_found, p4_groups
from .personal import p2_found, p2_redacted
from .sentences import p9_found

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p1_scores": p1_scores,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_languages": p5_languages,
    "p5_segments": p5_segments,
    "p6_found": p6_found,
    "p6_forms": p6_forms,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p9_found": p9_found,
}
ORACLE: dict[str, str] = {}
