"""Incremental behaviour as Structured Streaming: upserts by identity and first-seen evidence (ST1, U1)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert


class UpsertTable:
    """A Parquet table kept by versions: each batch writes a new version and then names it, so a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "identity_key", order: str = "ingest_seq"):
        self.spark, self.path, self.schema, self.key, self.order = spark, path, schema, key, order

    def version(self) -> int:
        """The last version that is named; versions are rows of a table, so any file system that Spark writes to will do."""
        try:
            return self.spark.read.schema("version long").json(f"{self.path}/versions").agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return -1
            raise

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}") if v >= 0 else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.version():
            return
        upsert(self.read(), batch, self.order, self.key).write.mode("overwrite").parquet(f"{self.path}/v{batch_id}")
        self.spark.createDataFrame([(batch_id,)], "version long").coalesce(1).write.mode("append").json(f"{self.path}/versions")

    def stream(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(rows: DataFrame, key: str, when: str, delay: str = "7 days") -> DataFrame:
    """Append-only stream of rows whose key is new within the watermark."""
    return rows.withWatermark(when, delay).dropDuplicatesWithinWatermark([key])
