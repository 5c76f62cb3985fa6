"""File sources and sinks: CSV, JSON lines, JSON documents, community exports, mapped provider payloads, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell, lenient_bool, nullify
from ..operators.store import violations
from .schemas import RULES, VOICE_ROW


def read_voice_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 20-column voice table; null tokens become null, booleans and numbers are read leniently (S1, F-18, F-27)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [c.strip().split()[0] for c in VOICE_ROW.replace("\n", " ").split(",")]
    kinds = {c.strip().split()[0]: c.strip().split()[1] for c in VOICE_ROW.replace("\n", " ").split(",")}
    cols = []
    for n in names:
        c = nullify(F.col(n)) if n in raw.columns else F.lit(None).cast("string")
        cols.append((lenient_bool(c) if kinds[n] == "boolean" else c.try_cast("double").cast("long") if kinds[n] == "long" else c.try_cast(kinds[n])).alias(n))
    return raw.select(*cols)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def _voice(df: DataFrame, platform: str, game: str) -> DataFrame:
    """Pads message columns (id, at, content, ...) to the voice row and derives its id."""
    d = {
        "source": F.lit(platform), "source_type": F.lit("community_export"), "game": F.lit(game), "content_type": F.lit("message"), "source_content_id": F.col("id").cast("string"),
        "created_at": F.col("at").try_cast("timestamp"), "text": F.trim("content"),
    } | {c: F.col(c) for c in df.columns if c in ("channel", "url", "parent_id", "engagement_score", "language", "metadata_json")}
    d["record_id"] = F.substring(F.sha2(F.concat_ws(":", d["source"], d["source_content_id"]), 256), 1, 20)
    cols = [c.strip().split() for c in VOICE_ROW.replace("\n", " ").split(",")]
    return df.select(*[d.get(n, F.lit(None)).cast(k).alias(n) for n, k in cols]).filter(F.coalesce(F.col("text"), F.lit("")) != "")


def read_export_csv(spark: SparkSession, path: str, platform: str, game: str) -> DataFrame:
    """Community export with id, timestamp, content and optional channel, reactions, url; blank messages are dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lost = {"id", "timestamp", "content"} - set(raw.columns)
    if lost:
        raise ValueError(f"export lacks {sorted(lost)}")
    df = raw.withColumnRenamed("timestamp", "at")
    if "reactions" in raw.columns:
        df = df.withColumn("engagement_score", F.coalesce(F.col("reactions").try_cast("double"), F.lit(0.0)))
    return _voice(df, platform, game)


EXPORT_JSON = "channel struct<name:string>, messages array<struct<id:string, timestamp:string, content:string, reactions:array<struct<count:long>>, reference:struct<messageId:string>>>"


def read_export_json(spark: SparkSession, path: str, platform: str, game: str) -> DataFrame:
    """Chat export with messages[]; reactions are summed, replies keep their parent."""
    m = read_json_document(spark, path, EXPORT_JSON).select(F.col("channel.name").alias("channel"), F.explode("messages").alias("m"))
    total = F.aggregate(F.coalesce("m.reactions", F.array().cast("array<struct<count:long>>")), F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["count"], F.lit(0).cast("long")))
    return _voice(m.select("m.id", F.col("m.timestamp").alias("at"), "m.content", "channel", F.col("m.reference.messageId").alias("parent_id"), total.alias("engagement_score")), platform, game)


def map_payload(df: DataFrame, payload: str, items: str, mapping: dict[str, str], required: tuple[str, ...] = ("id", "text", "created_at")) -> DataFrame:
    """Rows of a JSON payload column by dotted paths: items is the array, mapping gives each column's path in an item (S14, S15, F-29)."""
    element = F.from_json(F.get_json_object(payload, f"$.{items}"), "array<string>")
    x = df.select(F.explode(element).alias("item"))
    got = x.select(*[F.get_json_object("item", f"$.{p}").alias(c) for c, p in mapping.items()])
    return got.filter(" AND ".join(f"`{c}` IS NOT NULL AND trim(`{c}`) <> ''" for c in required if c in mapping))


def flatten_replies(df: DataFrame, root: str, children: str, depth: int = 3) -> DataFrame:
    """Nested replies to rows with parent and depth, level by level; the schema of df bounds the depth."""
    level = df.select(F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.explode(root).alias("node"))
    out = None
    for _ in range(depth + 1):
        flat = level.select("parent_id", "depth", "node.id", "node.text")
        out = flat if out is None else out.unionByName(flat)
        fields = level.schema["node"].dataType.fieldNames()
        if children not in fields:
            break
        level = level.select(F.col("node.id").alias("parent_id"), (F.col("depth") + 1).alias("depth"), F.explode(f"node.{children}").alias("node"))
    return out


def write_snapshot(df: DataFrame, path: str, parts: tuple[str, ...] = ("access_scope", "dataset_id", "source")) -> None:
    """JSON lines by scope, dataset and source (K1, K3); refuses rows that break the evidence rules."""
    check(df, "evidence")
    df.write.mode("error").partitionBy(*parts).json(path)


def check(df: DataFrame, record: str) -> None:
    rules = {k: p for k, p in RULES[record].items() if all(w in df.columns for w in _columns(p))}
    bad = violations(df, rules).filter("broken > 0").collect() if rules else []
    if bad:
        raise ValueError(f"{record} rows break rules: {[(r.rule, r.broken) for r in bad]}")


def _columns(predicate: str) -> set[str]:
    import re

    names = {c.strip().split()[0] for c in VOICE_ROW.replace("\n", " ").split(",")} | {"access_scope", "dataset_id", "relevance_score", "sentiment_score", "confidence"}
    return names & set(re.findall(r"[a-z_]+", predicate))


def flat_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so that any table can be written as CSV (K7, K8)."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(c).alias(c) if k.startswith(nested) else F.col(c) for c, k in df.dtypes])


def read_csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
    """CSV files of a folder as temporary views of their names (S2); a file with a header and a given schema, none is inferred."""
    for name, schema in schemas.items():
        spark.read.option("header", True).schema(schema).csv(f"{folder}/{name}.csv").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """The last statement of an SQL text over registered views (S3); comments and a closing semicolon are allowed."""
    statements = [x for x in "\n".join(line.split("--")[0] for line in text.splitlines()).split(";") if x.strip()]
    for x in statements[:-1]:
        spark.sql(x)
    return spark.sql(statements[-1])


def read_taxonomy(path: str) -> dict[str, list[str]]:
    """Topics and their terms from a JSON configuration {topic: [terms]}, checked: no empty topic, no term of two topics."""
    with open(path, encoding="utf-8") as f:
        topics = json.load(f)
    seen: dict[str, str] = {}
    for topic, terms in topics.items():
        if not topic or not isinstance(terms, list) or not terms or not all(isinstance(t, str) and t.strip() for t in terms):
            raise ValueError(f"topic {topic!r} needs a list of terms")
        for t in map(str.casefold, terms):
            if seen.setdefault(t, topic) != topic:
                raise ValueError(f"term {t!r} is in {seen[t]!r} and {topic!r}")
    return {k: [t.casefold() for t in v] for k, v in topics.items()}


def write_ordered_json(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in the order of key over all files (K5, K6)."""
    df.orderBy(key).write.mode("error").json(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    """Any table as CSV with a header, nested values as JSON text (K7, K8)."""
    flat_csv(df).write.mode("error").option("header", True).option("escape", '"').csv(path)


def write_manifest(spark: SparkSession, path: str, run_id: str, counts: dict[str, int], status: dict[str, str]) -> None:
    """One row for a run, appended (K9): rows by table and state by source."""
    spark.createDataFrame([(run_id, counts, status)], "run_id string, counts map<string,long>, status map<string,string>").coalesce(1).write.mode("append").json(path)


def latest_manifest(spark: SparkSession, path: str) -> dict:
    """The row of the greatest run id."""
    r = spark.read.schema("run_id string, counts map<string,long>, status map<string,string>").json(path).orderBy(F.desc("run_id")).first()
    return r.asDict() if r else {}


def check_manifest(manifest: dict, tables: dict[str, DataFrame]) -> list[str]:
    """Tables whose number of rows is not what the manifest says, by name."""
    return sorted(name for name, df in tables.items() if df.count() != manifest["counts"].get(name))


def markdown(title: str, df: DataFrame, width: int = 120) -> str:
    """A small result as a Markdown report (K10): a heading, the number of rows, a table with escaped and shortened cells."""
    names = df.columns
    rows = flat_csv(df).select(*[cell(F.coalesce(F.col(c).cast("string"), F.lit("")), width).alias(c) for c in names]).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([f"# {title}", "", f"{len(rows)} rows", "", line(names), line(["---"] * len(names)), *[line(r) for r in rows], ""])


def schema_json(df: DataFrame) -> str:
    """The schema of a table as JSON."""
    return df.schema.json()


# What each source can do, for plans and reports.
CAPABILITIES = [
    ("bilibili", "none", "page", True), ("steam", "none", "cursor", True), ("reddit", "oauth", "after", True), ("youtube", "key", "token", True), ("weibo", "license", "none", True), ("xiaohongshu", "license", "none", True),
    ("douyin", "license", "none", True), ("community_export", "none", "none", True), ("official", "none", "none", False), ("discord", "restricted", "none", False), ("qq", "restricted", "none", False),
]


def capabilities(spark: SparkSession) -> DataFrame:
    """source, auth, pagination, available: sources that are not available always answer so and give no rows."""
    return spark.createDataFrame(CAPABILITIES, "source string, auth string, pagination string, available boolean")
