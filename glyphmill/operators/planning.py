"""Query plans, aliases and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_key


def query_matrix(a: DataFrame, b: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """Small configuration tables combined, the first cap rows of each group (J17, W4). Both sides are configuration, not data."""
    return a.join(b, how="cross").withColumn("slot", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("slot") <= cap)


def select_plans(plans: DataFrame, group: str, variant: str, seq: str, cap: int) -> DataFrame:
    """By group: one plan of each variant in order, then the others, up to cap."""
    first = F.row_number().over(Window.partitionBy(group, variant).orderBy(seq))
    p = plans.withColumn("again", F.when(first > 1, 1).otherwise(0))
    return p.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy("again", seq))).filter(F.col("slot") <= cap)


def merge_observations(obs: DataFrame, key: str, seq: str) -> DataFrame:
    """Observations of one key: first text by seq, smallest type rank, largest ambiguity, sorted values, any flag (A29, T-29)."""
    return obs.groupBy(key).agg(
        F.count("*").alias("observations"),
        F.min_by("text", seq).alias("text"),
        F.min("type_rank").alias("type_rank"),
        F.max("ambiguity_rank").alias("ambiguity_rank"),
        F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"),
        F.max("confidence").alias("confidence"),
        F.bool_or("flag").alias("any_flag"),
    )


def validate_aliases(merged: DataFrame) -> DataFrame:
    """Adds status by an ordered rule ladder."""
    c, n = F.col("confidence"), F.col("observations")
    status = (
        F.when(n < 1, "rejected")
        .when(F.col("ambiguity_rank") >= 3, F.when(c >= 0.6, "scoped").otherwise("rejected"))
        .when(F.col("ambiguity_rank") == 2, "scoped")
        .when((F.col("type_rank") >= 3) & (n < 2), "pending")
        .when(c < 0.5, "pending")
        .otherwise("validated")
    )
    return merged.withColumn("status", status)


def closest_margin(rows: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """By group the best candidate by (-score, name) and its margin to the runner-up, 0 being the score of none.

    Names are distinct within a group. Two aggregates with map-side combine, so no group is sorted in one task.
    """
    best = rows.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(name).alias("n"))).alias("b"))
    best = best.select(group, F.col("b.n").alias("best"), (-F.col("b.s")).alias("score"))
    rest = rows.join(best.select(group, F.col("best").alias("first")), group).filter(F.col(name) != F.col("first")).groupBy(group).agg(F.max(score).alias("runner_up"))
    j = best.join(rest, group, "left")
    return j.select(group, "best", "score", (F.col("score") - F.coalesce("runner_up", F.lit(0.0))).alias("margin"), F.col("runner_up").isNotNull().alias("contested"))


def resolution(margins: DataFrame, least: float = 0.7, choice: float = 0.45, safe: float = 0.12) -> DataFrame:
    """Adds status to rows of closest_margin: resolved with a high score and a safe margin, needs_choice where two are close, else unresolved."""
    close = F.col("contested") & (F.col("margin") < safe)
    status = F.when((F.col("score") >= least) & ~close, "resolved").when((F.col("score") >= choice) & close, "needs_choice").otherwise("unresolved")
    return margins.withColumn("status", status)


# The order of alias types.
ALIAS_TYPES = ["official_title", "localized_title", "abbreviation", "transliteration", "community_nickname", "common_misspelling"]


def language_family(x: Column) -> Column:
    return F.when(F.lower(x).startswith("zh"), "zh").otherwise("en")


def usable_aliases(aliases: DataFrame, languages: DataFrame) -> DataFrame:
    """aliases(game_id, alias_id, key, text, language, alias_type, status, search_enabled, safe, confidence) by languages(language): those that
    may be searched in it, each key once, in order of safety, type, confidence, key and id, with their slot (V9, O6, W3).

    An alias fits a language of its own family, any if it has none. Both sides are configuration, so the product and the windows are small.
    """
    fits = F.col("language").isNull() | (language_family(F.col("language")) == language_family(F.col("for_language")))
    a = aliases.filter(F.col("search_enabled") & F.col("status").isin("validated", "scoped_only")).join(languages.select(F.col("language").alias("for_language")), how="cross").filter(fits)
    order = [F.when(F.col("safe"), 0).otherwise(1), F.array_position(F.array(*map(F.lit, ALIAS_TYPES)), F.col("alias_type")), F.desc("confidence"), F.col("key"), F.col("alias_id")]
    a = a.withColumn("again", F.row_number().over(Window.partitionBy("game_id", "for_language", "key").orderBy(*order))).filter("again = 1").drop("again")
    return a.withColumn("slot", F.row_number().over(Window.partitionBy("game_id", "for_language").orderBy(*order)))


def render_queries(aliases: DataFrame, templates: DataFrame, run_id: str) -> DataFrame:
    """usable aliases by templates(source, intent, language_family, template with {alias}): the query texts and their ids.

    The id hashes run, source, language, intent and the text in lower case with collapsed blanks, so equal queries get one id.
    """
    q = aliases.join(templates, language_family(F.col("for_language")) == F.col("language_family"))
    q = q.withColumn("query_text", F.trim(F.replace(F.col("template"), F.lit("{alias}"), F.col("text"))))
    meaning = F.trim(F.regexp_replace(F.lower("query_text"), r"(?U)\s+", " "))
    key = F.concat_ws("|", F.lit(run_id), "source", "for_language", "intent", meaning)
    return q.select("game_id", "alias_id", "source", F.col("for_language").alias("language"), "intent", "query_text", F.concat(F.lit("query_"), F.substring(F.sha2(key, 256), 1, 20)).alias("query_id"))


def entity_links(candidates: DataFrame, entity: str, ids: str) -> DataFrame:
    """Pairs of entities that share an external id value, through its smallest holder: n sharers give n - 1 links."""
    e = candidates.select(F.col(entity).alias("e"), F.explode(F.map_entries(ids)).alias("x")).select("e", F.concat_ws(":", "x.key", "x.value").alias("k")).distinct()
    head = e.groupBy("k").agg(F.min("e").alias("head"))
    return e.join(head, "k").filter("e != head").select(F.col("head").alias("a"), F.col("e").alias("b")).distinct()


def active_topics(entities: DataFrame, triggers: DataFrame) -> DataFrame:
    """entities(game_id, tags array), triggers(topic, tags array): the extension topics that a shared tag switches on.

    Tags meet in tag_key form. Both sides are exploded and joined on the tag, so nothing is compared pairwise.
    """
    tag = lambda df, key: df.select(key, F.explode("tags").alias("t")).select(key, tag_key(F.col("t")).alias("t")).filter("t != ''").distinct()
    return tag(entities, "game_id").join(tag(triggers, "topic"), "t").select("game_id", "topic").distinct()
