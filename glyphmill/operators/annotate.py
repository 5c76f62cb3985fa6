"""Rule annotation: topics, sentiment, requests, behaviours, pains, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import first_position, has_term, normalise, rnd, sentences, substring_count, term_count, term_hits


def annotate(rows: DataFrame, text: str = "text", topics: dict[str, list[str]] = L.TOPICS) -> DataFrame:
    """Adds norm, tokens, hits by topic, ranked topics, primary, secondary (up to four with half the hits), sentiment and its label.

    Text is normalised and cut into tokens once; every count is an expression over these, so the plan has one projection whatever the
    number of terms. Topics rank by hits, then by where their first term stands, then by name. Null text counts as no token.
    """
    r = rows.withColumn("norm", normalise(F.col(text)))
    r = r.withColumn("tokens", F.split("norm", "[^a-z0-9]+"))
    x, t = F.col("norm"), F.col("tokens")
    hits = [F.struct((-term_count(x, t, terms)).alias("neg"), first_position(x, t, terms).alias("at"), F.lit(k).alias("topic")) for k, terms in sorted(topics.items())]
    r = r.withColumn("ranked", F.array_sort(F.filter(F.array(*hits), lambda h: h["neg"] < 0)))
    first = F.get("ranked", F.lit(0))
    r = r.withColumn("primary", F.coalesce(first["topic"], F.lit("unknown"))).withColumn("hits", F.coalesce(-first["neg"], F.lit(0)))
    least = F.greatest(F.lit(1), F.floor(F.col("hits") / 2))
    rest = F.transform(F.filter(F.slice("ranked", 2, 99), lambda h: -h["neg"] >= least), lambda h: h["topic"])
    r = r.withColumn("secondary", F.slice(rest, 1, 4))
    distinct = lambda terms: sum(F.when(has_term(x, t, w), 1).otherwise(0) for w in terms)
    r = r.withColumn("pos", distinct(L.POSITIVE)).withColumn("neg", distinct(L.NEGATIVE)).withColumn("neu", distinct(L.NEUTRAL))
    p, n = F.col("pos"), F.col("neg")
    label = F.when((p > 0) & (n > 0), "mixed").when(p > 0, "positive").when(n > 0, "negative").when(F.col("neu") > 0, "neutral").otherwise("unknown")
    score = F.when((p > 0) & (n > 0), 0.0).when(p > 0, F.least(F.lit(1.0), 0.5 + 0.1 * p)).when(n > 0, F.greatest(F.lit(-1.0), -0.5 - 0.1 * n)).when(F.col("neu") > 0, 0.0)
    return r.withColumn("sentiment", label).withColumn("sentiment_score", rnd(score, 2))


def lexical_sentiment(rows: DataFrame, text: str) -> DataFrame:
    """Adds lex_pos, lex_neg and (pos - neg) / (pos + neg) from raw substring counts (F-10, F-23, T-9)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    pos = sum(substring_count(low, w) for w in L.POSITIVE)
    neg = sum(substring_count(low, w) for w in L.NEGATIVE)
    r = rows.withColumn("lex_pos", pos).withColumn("lex_neg", neg)
    both = F.col("lex_pos") + F.col("lex_neg")
    return r.withColumn("lex_score", F.when(both > 0, rnd((F.col("lex_pos") - F.col("lex_neg")).cast("double") / both, 4)).otherwise(0.0))


def confidence(annotated: DataFrame) -> DataFrame:
    """Adds confidence and needs_review."""
    c = F.when(F.col("primary") == "unknown", 0.35).otherwise(F.least(F.lit(0.95), 0.55 + 0.08 * F.col("hits")))
    return annotated.withColumn("confidence", rnd(c, 2)).withColumn("needs_review", (F.col("primary") == "unknown") | (F.col("sentiment") == "unknown"))


def requests(rows: DataFrame, text: str) -> DataFrame:
    """Adds requests: the first three sentences that match a request pattern, cut to 300 characters (D12, F-14)."""
    rx = "|".join(L.REQUESTS)
    hit = F.filter(sentences(F.coalesce(F.col(text), F.lit(""))), lambda s: F.lower(s).rlike(rx))
    return rows.withColumn("requests", F.transform(F.slice(hit, 1, 3), lambda s: F.substring(s, 1, 300)))


def behaviours(rows: DataFrame) -> DataFrame:
    """Adds behaviours, sorted, from tokens."""
    flags = [F.when(term_hits(F.col("tokens"), terms) > 0, F.lit(k)) for k, terms in sorted(L.BEHAVIOURS.items())]
    return rows.withColumn("behaviours", F.array_compact(F.array(*flags)))


def pains(annotated: DataFrame) -> DataFrame:
    """Adds pains and needs of negative and mixed rows."""
    bad = F.col("sentiment").isin("negative", "mixed")
    flags = F.array_compact(F.array(*[F.when(term_hits(F.col("tokens"), terms) > 0, F.lit(k)) for k, terms in sorted(L.PAINS.items())]))
    need = F.create_map(*[F.lit(x) for kv in L.NEEDS.items() for x in kv])
    return annotated.withColumn("pains", F.when(bad, flags).otherwise(F.array().cast("array<string>"))).withColumn("need", F.when(bad, need[F.col("primary")]))
