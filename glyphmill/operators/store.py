"""Evidence store: identity, upsert, links, duplicates and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summaries import keep_last

REFRESHED = ["evidence_id", "relevance_label", "run_id", "query_id", "content_fingerprint", "payload_json", "updated_at"]


def identity_key(scope="access_scope", dataset="dataset_id", source="source", content="source_content_id"):
    """SHA-256 of scope|dataset or public|source|content id."""
    d = F.when(F.coalesce(F.col(dataset), F.lit("")) == "", "public").otherwise(F.col(dataset))
    return F.sha2(F.concat_ws("|", F.col(scope), d, F.col(source), F.col(content)), 256)


def upsert(base: DataFrame, incoming: DataFrame, order: str = "ingest_seq", key: str = "identity_key") -> DataFrame:
    """Base with incoming merged by key: the last incoming row refreshes REFRESHED columns, the first evidence_id stays (U1, T-13)."""
    new = keep_last(incoming, [key], order)
    j = base.alias("b").join(new.alias("n"), key, "full")
    cols = []
    for c in base.columns:
        if c == key:
            cols.append(F.col(key))
        elif c == "evidence_id":
            cols.append(F.coalesce(F.col("b.evidence_id"), F.col("n.evidence_id")).alias(c))
        elif c in REFRESHED or c == order:
            cols.append(F.when(F.col(f"n.{order}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"b.{order}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
    return j.select(*cols)


def upsert_counts(base: DataFrame, incoming: DataFrame, key: str = "identity_key") -> DataFrame:
    """Inserted, updated and repeated rows of a batch (A32): aggregates by key, so a hot key is combined before the shuffle."""
    n = incoming.groupBy(key).agg(F.count("*").alias("rows"))
    b = base.groupBy(key).agg(F.lit(1).alias("known"))
    j = n.join(b, key, "left")
    return j.agg(
        F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("inserted"), F.sum(F.when(F.col("known").isNotNull(), 1).otherwise(0)).alias("updated"), F.sum(F.col("rows") - 1).alias("repeated")
    )


def replace_partition(base: DataFrame, incoming: DataFrame, part: str, key: list[str], order: str) -> DataFrame:
    """Base without the parts that incoming brings anew, and incoming keep-last (U3, T-16)."""
    return base.join(incoming.select(part).distinct(), part, "left_anti").select(*base.columns).unionByName(keep_last(incoming, key, order))


def cross_posts(rows: DataFrame, fingerprint: str = "content_fingerprint", identity: str = "identity_key", scope: str = "access_scope") -> DataFrame:
    """Fingerprints met under more than one identity within a scope, with counts (J13, U6; scoped as T-12 asks).

    A group aggregate, not a self join: n copies give one row, not n squared.
    """
    got = rows.filter(F.col(fingerprint).isNotNull()).groupBy(scope, fingerprint).agg(F.count("*").alias("rows"), F.countDistinct(identity).alias("identities"), F.countDistinct("source").alias("sources"))
    return got.filter("identities > 1")


def nest_links(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence ids with their links: count, sorted query ids and sorted distinct alias ids."""
    per = links.groupBy("evidence_id").agg(
        F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_set("query_id")), ",").alias("query_ids"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("alias_ids")))), ",").alias("alias_ids")
    )
    ids = evidence.select("evidence_id").distinct()
    return ids.join(per, "evidence_id", "left").select("evidence_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("query_ids", F.lit("")).alias("query_ids"), F.coalesce("alias_ids", F.lit("")).alias("alias_ids"))


def orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """How many rows and distinct keys of child have no parent."""
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
    return lost.agg(F.lit(name).alias("rule"), F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))


def violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule; rules are SQL predicates that must not be false (V1, V2, V11, V16). One pass."""
    counts = rows.agg(*[F.coalesce(F.sum(F.expr(f"CASE WHEN NOT ({p}) THEN 1 ELSE 0 END")), F.lit(0)).alias(k) for k, p in rules.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, broken)")


def register_datasets(known: DataFrame, new: DataFrame) -> DataFrame:
    """Private datasets by (dataset_id, owner_scope): attested entries only, the last seq of a key holds (U8)."""
    every = known.unionByName(new.filter("attested"))
    rest = [c for c in every.columns if c not in ("dataset_id", "owner_scope")]
    got = every.groupBy("dataset_id", "owner_scope").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("r"))
    return got.select("dataset_id", "owner_scope", "r.*").select(*every.columns)


def reconcile_evidence(bundles: list[DataFrame]) -> DataFrame:
    """The evidence of several fact bundles, of a repeated evidence_id the row of the last bundle (U9, X7): one aggregate over their union."""
    every = reduce(DataFrame.unionByName, [b.withColumn("bundle", F.lit(i)) for i, b in enumerate(bundles)])
    rest = [c for c in every.columns if c not in ("evidence_id", "bundle")]
    return every.groupBy("evidence_id").agg(F.max_by(F.struct(*rest), F.col("bundle")).alias("r")).select("evidence_id", "r.*")
