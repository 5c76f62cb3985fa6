"""Rule-based relevance (D8, J15, F-11, P7, A28)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import GAME_TERMS
from ..functions.text import ascii_tokens, contains_phrase, phrase_in, ratio, rnd, word_form


@dataclass(frozen=True)
class Settings:
    title: float = 0.78
    safe_alias: float = 0.55
    scoped_alias: float = 0.20
    company: float = 0.30
    term: float = 0.45
    term_cap: float = 0.675
    context: float = 0.15
    provenance: float = 0.05
    competitor: float = 0.85
    relevant: float = 0.70
    ambiguous: float = 0.25


def relevance(rows: DataFrame, text: str, titles: list[str], safe: list[str], scoped: list[str], competitors: list[str], provenance: Column | None = None, s: Settings = Settings()) -> DataFrame:
    """Adds score and label of each text for one entity given as small lists of phrases (broadcast as literals).

    Null texts score as empty ones. Label ladder: a competitor without enough score is irrelevant; matched unsafe aliases alone never
    make a text relevant.
    """
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"(?U)[^\w]+", " "))
    r = rows.withColumn("norm", t)
    hit = lambda phrases: F.greatest(*[contains_phrase(F.col("norm"), p).cast("int") for p in phrases], F.lit(0)) > 0
    r = r.withColumn("title_hit", hit(titles)).withColumn("safe_hit", hit(safe)).withColumn("scoped_hit", hit(scoped)).withColumn("rival_hit", hit(competitors))
    r = r.withColumn("terms", F.size(F.array_intersect(ascii_tokens(F.col("norm")), F.array(*map(F.lit, GAME_TERMS)))))
    alias = F.col("safe_hit") | F.col("scoped_hit")
    v = lambda c, w: F.when(c, w).otherwise(0.0)
    score = (
        v(F.col("title_hit"), s.title)
        + F.when(F.col("safe_hit"), s.safe_alias).when(F.col("scoped_hit"), s.scoped_alias).otherwise(0.0)
        + F.least(F.col("terms") * s.term, F.lit(s.term_cap))
        + v(alias & (F.col("terms") >= 2), s.context)
        + v(F.lit(False) if provenance is None else provenance, s.provenance)
        - v(F.col("rival_hit"), s.competitor)
    )
    r = r.withColumn("score", rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    unsafe = F.col("scoped_hit") & ~F.col("safe_hit") & ~F.col("title_hit") & (F.col("terms") == 0)
    label = (
        F.when(F.col("rival_hit") & (F.col("score") < s.relevant), "irrelevant")
        .when((F.col("score") >= s.relevant) & ~unsafe, "relevant")
        .when((F.col("score") >= s.ambiguous) | alias | F.col("title_hit"), "ambiguous")
        .otherwise("irrelevant")
    )
    return r.withColumn("label", label)


# Words that show the context of a game.
CONTEXT_CUES = ["update", "patch", "fps", "stutter", "server", "ranked", "matchmaking", "更新", "补丁", "帧", "卡顿", "服务器"]


def entity_table(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each entity: its titles, companies and usable aliases in word form, and external_ids.

    entities(game_id, titles, companies array<string>, external_ids map); aliases(alias_id, game_id, text, ambiguity, status,
    search_enabled, standalone_safe). Only enabled aliases that are validated or scoped count, and none that is a title.
    """
    e = entities.select("game_id", "external_ids", *[F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("titles", "companies")])
    for c in ("titles", "companies"):  # small configuration; one Python pass over its names
        words = e.select("game_id", F.explode(c).alias("w")).withColumn("w", word_form("w")).filter("w != ''")
        e = e.drop(c).join(words.groupBy("game_id").agg(F.array_sort(F.collect_set("w")).alias(c)), "game_id", "left")
    a = aliases.filter(F.col("search_enabled") & F.col("status").isin("validated", "scoped_only")).withColumn("w", word_form("text")).filter("w != ''")
    side = F.struct("alias_id", "w", F.col("standalone_safe").alias("safe"), (F.col("ambiguity").isin("medium", "high") | ~F.col("standalone_safe")).alias("unsafe"))
    e = e.join(a.groupBy("game_id").agg(F.array_sort(F.collect_list(side)).alias("aliases")), "game_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = e.select("game_id", "external_ids", none("titles"), none("companies"), "aliases")
    return out.withColumn("aliases", F.coalesce(F.filter("aliases", lambda x: ~F.array_contains("titles", x["w"])), F.filter("aliases", lambda _: F.lit(False)), F.array().cast("array<struct<alias_id:string,w:string,safe:boolean,unsafe:boolean>>")))


def method_version(terms: list[str], competitors: list[str], s: Settings = Settings(), name: str = "relevance-1") -> str:
    """Name and twelve digits of the settings, terms and competitors that a decision was made with."""
    payload = json.dumps({"settings": s.__dict__, "terms": sorted(set(terms)), "competitors": sorted(set(competitors))}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return f"{name}+{hashlib.sha256(payload.encode()).hexdigest()[:12]}"


def relevance_to_entity(rows: DataFrame, entities: DataFrame, terms: list[str], competitors: list[str], s: Settings = Settings()) -> DataFrame:
    """rows(id, game_id, source, title, text, native map<string,string>, query_game_id) with score, label, signals and method_version.

    Each row is held against its own entity of entity_table(): a native id of its source decides alone (0.99 or irrelevant); else titles,
    aliases, companies, terms, context and the query's entity add up and a competitor takes away. Matched unsafe aliases alone never make
    a row relevant. Rows of an unknown or null entity are irrelevant; null texts match nothing. The entity side is left to the join's size check.
    """
    r = rows.join(entities.withColumn("known", F.lit(True)), "game_id", "left")
    r = r.withColumn("norm", word_form(F.concat_ws(" ", "title", "text")))
    x = F.col("norm")
    any_of = lambda c: F.coalesce(F.exists(c, lambda p: phrase_in(x, p)), F.lit(False))
    literals = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    found = lambda words: F.size(F.filter(literals(words), lambda p: phrase_in(x, p)))
    steam = (F.col("source") == "steam") & F.col("external_ids")["steam_app_id"].isNotNull()
    own = F.concat("source", F.lit("_id"))
    expected = F.when(steam, F.col("external_ids")["steam_app_id"]).otherwise(F.element_at("external_ids", own))
    actual = F.when(steam, F.element_at("native", F.lit("app_id"))).otherwise(F.element_at("native", own))
    r = r.withColumn("native_match", F.when(expected.isNotNull() & (expected != ""), expected == actual))
    r = r.withColumn("title_hit", any_of("titles")).withColumn("hit", F.filter("aliases", lambda a: phrase_in(x, a["w"])))
    r = r.withColumn("alias_ids", F.coalesce(F.transform("hit", lambda a: a["alias_id"]), F.array().cast("array<string>")))
    r = r.withColumn("alias_hit", F.size("alias_ids") > 0).withColumn("safe_hit", F.coalesce(F.exists("hit", lambda a: a["safe"]), F.lit(False)))
    r = r.withColumn("company_hit", any_of("companies")).withColumn("terms", found(terms)).withColumn("cues", found(CONTEXT_CUES)).withColumn("rivals", found(competitors))
    v = lambda c, w: F.when(c, w).otherwise(0.0)
    alias, native = F.col("alias_hit"), F.coalesce("native_match", F.lit(False))
    score = (
        v(native, 0.99) + v(F.col("title_hit"), s.title) + F.when(F.col("safe_hit"), s.safe_alias).when(alias, s.scoped_alias).otherwise(0.0) + v(F.col("company_hit"), s.company)
        + F.least(F.col("terms") * s.term, F.lit(s.term_cap)) + v(alias & (F.col("cues") >= 2), s.context) + v(F.coalesce(F.col("query_game_id") == F.col("game_id"), F.lit(False)), s.provenance)
        - v(F.col("rivals") > 0, s.competitor)
    )
    out = F.col("known").isNull() | (F.col("native_match") == F.lit(False))
    out = F.coalesce(out, F.lit(False))
    r = r.withColumn("score", F.when(out, 0.0).otherwise(rnd(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)))
    unsafe = alias & F.coalesce(F.forall("hit", lambda a: a["unsafe"]), F.lit(True)) & ~(F.col("title_hit") | F.col("company_hit") | (F.col("terms") > 0) | native)
    label = (
        F.when(out | ((F.col("rivals") > 0) & ~native & (F.col("score") < s.relevant)), "irrelevant")
        .when((F.col("score") >= s.relevant) & ~unsafe, "relevant")
        .when((F.col("score") >= s.ambiguous) | alias | F.col("title_hit"), "ambiguous")
        .otherwise("irrelevant")
    )
    signal = lambda c, name: F.when(c, F.lit(name))
    signals = F.array_compact(F.array(
        signal(native, "source_native_id_match"), signal(F.col("native_match") == F.lit(False), "source_native_id_mismatch"), signal(F.col("title_hit"), "official_title_match"),
        signal(F.col("safe_hit"), "safe_alias_match"), signal(alias & ~F.col("safe_hit"), "scoped_alias_match"), signal(F.col("company_hit"), "developer_publisher_match"),
        signal(F.col("terms") > 0, "game_term_match"), signal(F.col("rivals") > 0, "competing_entity_match"), signal(unsafe, "ambiguous_alias_only"),
    ))
    r = r.withColumn("label", label).withColumn("signals", F.when(out & F.col("known").isNull(), F.array(F.lit("game_id_mismatch"))).otherwise(signals))
    return r.select("id", "game_id", "score", "label", "signals", "alias_ids", F.lit(method_version(terms, competitors, s)).alias("method_version"))


def precision_recall(rows: DataFrame, predicted: str, truth: str, positive: str = "relevant") -> DataFrame:
    """tp, fp, fn, precision and recall with zero guards."""
    p, t = F.col(predicted) == positive, F.col(truth) == positive
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    g = rows.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"))
    return g.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
