"""Which entity a name means: assessment of merged candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, rnd, similarity


def assess(candidates: DataFrame, query: str, locale: str = "en", external_ids: dict[str, str] | None = None, developer: str | None = None, publisher: str | None = None, platform: str | None = None) -> DataFrame:
    """candidates(game_id, provider, titles, locales, developers, publishers, platforms arrays, external_ids map) to one scored row an entity.

    Rows of one game_id are merged. An exact title (in name_key form) counts .50, else a quarter of the best similarity; a title in the
    locale .06, each provider .06 up to .12, an external id .06, the requested one .14, the developer .08, the publisher .06, the platform
    .04 or any listing .02. Ordered by (-score, title, id) through the rank column of the caller. Null arrays count as empty.
    """
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(none(c))))).alias(c)
    m = candidates.groupBy("game_id").agg(
        *[gather(c) for c in ("titles", "locales", "developers", "publishers", "platforms")], F.countDistinct("provider").alias("providers"),
        F.flatten(F.collect_list(F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))))).alias("ids"),
    )
    keyed = lambda c: F.transform(c, name_key)
    own = name_key(F.lit(query))
    best = m.select("game_id", F.explode_outer(keyed("titles")).alias("t")).withColumn("s", similarity(own, F.col("t"))).groupBy("game_id").agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("similarity"))
    m = m.join(best, "game_id")
    exact = F.array_contains(keyed("titles"), own)
    met = lambda c, v: F.lit(False) if v is None else F.array_contains(keyed(c), name_key(F.lit(v)))
    wanted = F.lit(False)
    for pair in (external_ids or {}).items():
        wanted = wanted | F.array_contains(F.transform("ids", lambda x: F.concat_ws("=", x["key"], x["value"])), "=".join(pair))
    prefix = locale.lower().split("-")[0]
    local = F.exists("locales", lambda x: F.split(F.lower(x), "-")[0] == prefix)
    v = lambda c, w: F.when(c, w).otherwise(0.0)
    score = (
        F.when(exact, 0.5).otherwise(0.25 * F.col("similarity")) + v(local, 0.06) + F.least(F.lit(0.12), 0.06 * F.col("providers")) + v(F.size("ids") > 0, 0.06) + v(wanted, 0.14) + v(met("developers", developer), 0.08)
        + v(met("publishers", publisher), 0.06) + F.when(met("platforms", platform), 0.04).when(F.size("platforms") > 0, 0.02).otherwise(0.0)
    )
    m = m.withColumn("exact", exact).withColumn("score", rnd(F.least(F.lit(1.0), score), 4))
    return m.select("game_id", F.get("titles", F.lit(0)).alias("title"), "exact", rnd(F.col("similarity"), 4).alias("similarity"), "providers", "score")
