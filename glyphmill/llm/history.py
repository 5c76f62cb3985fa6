"""Problem 3: duplicates of new batches against all history, by incremental record linkage.

A store keeps, in tables bucketed by their key, what a batch has to be held against: first runs of identity keys and of stored
fingerprints, the blocking keys of every distinct text (the symbol tables of near.py), the hashed wording of the texts, and the clusters as
a union-find forest: the representative that a text had when it came, and for the few representatives that were merged since, the one
that stands for them now. A batch is levelled and fingerprinted, probes the tables with its own keys, scores the pairs that meet with
learned weights, and changes the mapping of the representatives that its links touch. No text of the history is read again, and the
tables of the history do not move: only rows of the batch are shuffled, into the buckets.
"""

from __future__ import annotations

import hashlib
import random
import secrets
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import levelled, load, materialise, release, shared_dir, ship, spread, sweep
from .near import BITS, LONG, SIGN, Hashed, components, cut, keyed_of, linked, sketched

TRAIN_TEXTS = 400  # bound of the sample that the weights are fitted on
REPLAY = 2  # blocks of runs that a whole log is fed in


@dataclass
class Weights:
    """Log-odds weights of the compared fields (wording similarity, containment, ratio of sizes)."""

    bias: float
    fields: tuple[float, float, float]

    def __call__(self, *x: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(w) * v for w, v in zip(self.fields, x)]) + F.lit(self.bias) > 0


def agreement(a: str, b: str) -> tuple[float, float, float]:
    """Jaccard similarity and containment of the hashed wording of two levelled texts, ratio of its sizes."""
    x, y = (set(w.tolist()) for w in cut(*Hashed([a, b]).wording(), 2))
    both = len(x & y)
    return both / max(1, len(x | y)), both / max(1, min(len(x), len(y))), min(len(x), len(y)) / max(1, len(x), len(y))


def _edited(text: str, rng: random.Random) -> str:
    """A copy with small changes: units moved or dropped, characters and words changed."""
    words = text.split()
    if len(words) > 3:
        at = rng.randrange(1, len(words))
        if rng.random() < 0.4:
            words = words[at:] + words[:at]
        for _ in range(rng.randrange(1, 2 + len(words) // 8)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice(([], [words[i], words[i - 1]], [words[i][::-1]]))
    t = list(" ".join(words))
    for _ in range(rng.randrange(1, 2 + len(t) // 40)):
        if t:
            t[rng.randrange(len(t))] = rng.choice("xeо的一")
    if rng.random() < 0.3 and len(t) > 40:
        at = rng.randrange(len(t) - len(t) // 4)
        del t[at : at + len(t) // 4]
    return "".join(t)


def _quoting(text: str, source: str, rng: random.Random) -> str:
    """text with a stretch of source in place of a part, a fifth to three fifths of the whole: the same clauses, but no copy."""
    share = rng.uniform(0.2, 0.6)
    n, keep = int(len(source) * share), int(len(text) * (1 - share))
    a, at = rng.randrange(1 + len(source) - n), rng.randrange(1 + keep)
    return f"{text[:at]} {source[a : a + n]} {text[len(text) - keep + at :]}"


def fit_weights(texts: list[str], seed: int = 7) -> Weights:
    """Logistic regression on labelled pairs made of at most TRAIN_TEXTS texts: copies with small edits, and texts that quote another."""
    rng = random.Random(seed)
    texts = [t for t in map(levelled, texts[:TRAIN_TEXTS]) if t]
    x, y = [], []
    for t in texts:
        x.append(agreement(t, _edited(t, rng)))
        y.append(1)
        other = texts[rng.randrange(len(texts))]
        if agreement(t, other)[0] < 0.2:  # the sample may hold copies itself
            x.append(agreement(t, _quoting(other, t, rng)))
            y.append(0)
    if len(set(y)) < 2:
        return Weights(-4.5, (10.0, 0.0, 0.0))
    X, Y = np.c_[np.ones(len(x)), np.array(x)], np.array(y, float)
    w = np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ w))
        h = (X * (p * (1 - p))[:, None]).T @ X + 0.05 * np.eye(4)
        w -= np.linalg.solve(h, X.T @ (p - Y) + 0.05 * np.r_[0, w[1:]])
    return Weights(float(w[0]), (float(w[1]), float(w[2]), float(w[3])))


def learn(rows: DataFrame) -> Weights:
    """Weights from the TRAIN_TEXTS texts of smallest hash; the bound is fixed, and so is the choice of rows."""
    got = rows.select("text").orderBy(F.xxhash64("text"), "text").limit(TRAIN_TEXTS).collect()
    return fit_weights([r[0] for r in got])


def intake(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """ingest_seq, identity_key, content_fingerprint, text, rank (start of the run) of the rows of known runs; the JSON is read after the join."""
    start = runs.filter("run_id is not null").groupBy("run_id").agg(F.unix_micros(F.min("started_at")).alias("rank"))
    log = spread(evidence.select("ingest_seq", "identity_key", "content_fingerprint", "run_id", "payload_json"))
    text = F.get_json_object("payload_json", "$.original_text")
    return log.join(start, "run_id").select("ingest_seq", "identity_key", "content_fingerprint", text.alias("text"), "rank")


def packed(kind: str, key: Column) -> Column:
    """A key in 17 bytes: its kind and 128 bits, which are the first half of a SHA-256 digest and the MD5 of anything else; null stays null."""
    bits = F.when(key.rlike("^[0-9a-f]{64}$"), F.substring(key, 1, 32)).otherwise(F.md5(F.concat(F.lit("="), key)))
    return F.concat(F.encode(F.lit(kind), "utf-8"), F.unhex(bits))


class History:
    """Persisted linkage state under a folder that all executors share; add() takes one batch and returns its repeating rows.

    Tables are parquet, bucketed into `buckets` parts; they are only ever appended to. The rows of a batch carry its stamp, and count once
    the manifest, itself a Spark table, lists that stamp: a batch that failed half-way leaves nothing behind that a reader would see.
    compact() rewrites the rows that count. One writer at a time.
    """

    TABLES = {
        "marks": ("key binary, rank long", "key"),  # first runs of identity keys and stored fingerprints, several rows a key
        "blocks": ("key long, class long, sign long, more long", "key"),
        "texts": (f"class long, sign long, more long, size long, {' long, '.join(BITS)} long, keys array<long>, words array<int>", "class"),
        "clusters": ("class long, comp long", "class"),
        "roots": ("comp long, root long", "comp"),  # merged representatives and those that stand for them; the last row of a comp holds
        "firsts": ("comp long, rank long", "comp"),  # first runs of clusters, several rows a representative
    }
    MANIFEST = "version int, stamps array<long>, buckets int, weights array<double>, tables string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        try:
            got = spark.read.schema(self.MANIFEST).json(f"{self.path}/manifest").orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            got = []
        self.version, self.stamps, self.weights, self.folder = 0, [], None, "t0"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if got:
            r = got[0]
            self.version, self.stamps, self.buckets, self.folder = r["version"], list(r["stamps"]), r["buckets"], r["tables"]
            self.weights = Weights(r["weights"][0], tuple(r["weights"][1:])) if r["weights"] else None
        self.open()

    def name(self, table: str) -> str:
        return f"history_{hashlib.md5(f'{self.path}/{self.folder}'.encode()).hexdigest()[:12]}_{table}"

    def open(self) -> None:
        for t, (schema, key) in self.TABLES.items():
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name(t)} ({schema}, stamp long) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{self.folder}/{t}'")

    def close(self) -> None:
        """Forget the tables in the catalog; their files stay."""
        for t in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(t)}")

    def table(self, name: str, own: int | None = None) -> DataFrame:
        """The rows that count, and those of the batch under way."""
        return self.spark.table(self.name(name)).filter(F.col("stamp").isin([*self.stamps, *([own] if own else [])] or [0]))

    def put(self, table: str, df: DataFrame, stamp: int, placed: bool = False) -> None:
        """Append rows; placed: all rows of a key are in one partition of df already, so that each bucket gets one file or a few."""
        schema, key = self.TABLES[table]
        df = df if placed else df.repartition(self.buckets, key)
        df.select(*[c.split()[0] for c in schema.split(", ")], F.lit(stamp).cast("long").alias("stamp")).write.insertInto(self.name(table))

    def commit(self, stamps: list[int]) -> None:
        row = (self.version + 1, stamps, self.buckets, [self.weights.bias, *self.weights.fields] if self.weights else None, self.folder)
        self.spark.createDataFrame([row], self.MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.version, self.stamps = row[0], stamps

    def root_of(self, classes: DataFrame, own: int | None = None) -> DataFrame:
        """classes(class, ...) of the store with the representative that stands for each now, as root."""
        now = self.table("roots", own).groupBy("comp").agg(F.max_by("root", "stamp").alias("root"))
        got = classes.join(self.table("clusters", own).select("class", "comp"), "class")
        return got.join(now, "comp", "left").withColumn("root", F.coalesce("root", "comp")).drop("comp")

    def add(self, batch: DataFrame) -> DataFrame:
        """ingest_seq, kind of the rows of batch(ingest_seq, identity_key, content_fingerprint, text, rank) that repeat an earlier rank.

        kind is the first that holds of identity, exact (long text, same stored fingerprint) and near (long text in the cluster of an
        earlier rank). Earlier ranks are those of the history and of the batch itself. Rows without a rank neither repeat nor are
        repeated; null keys, fingerprints and texts match nothing and move nowhere; texts are read whole; repeated rows of one run do not
        count; an empty batch gives no row; other columns are ignored. Keys are aggregated before they are joined back to rows, and
        joined back only where they repeat, so a key that holds a third of all rows is reduced map-side and its rows are split by the join.
        """
        ship()
        spark, stamp = self.spark, (self.version + 1) << 32 | secrets.randbits(31)
        batch = batch.filter("rank is not null").select("ingest_seq", "identity_key", "content_fingerprint", "text", "rank")
        long = F.char_length("text") >= LONG
        if self.weights is None:
            self.weights = learn(batch.filter(long))
        rows = batch.select(F.col("ingest_seq").alias("id"), F.when(long, F.col("text")).alias("text"), "rank", packed("i", F.col("identity_key")).alias("i"), packed("e", F.col("content_fingerprint")).alias("e"))
        found = materialise(sketched(rows, ", rank long, i binary, e binary", long_only=True), "sketches")

        # Identity keys and stored fingerprints: rows of short texts are history for the latter but do not repeat by it.
        kinds = F.explode(F.filter(F.array(F.col("i"), F.col("e")), lambda k: k.isNotNull())).alias("key")
        now = found.select("rank", kinds).groupBy("key").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"))
        now = materialise(now, "now")
        self.put("marks", now, stamp, placed=True)
        first = self.table("marks", stamp).groupBy("key").agg(F.min("rank").alias("first"))
        hit = materialise(now.select("key", "last").join(first, "key").filter("first < last").select("key", "first"), "hit")
        mark = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
        marks = F.array(mark(0, F.col("i")), mark(1, F.when(F.col("class").isNotNull(), F.col("e"))))
        mine = found.select("id", "rank", F.explode(F.filter(marks, lambda k: k["key"].isNotNull())).alias("k"))
        marked = materialise(mine.select("id", "rank", "k.*").join(hit, "key").filter("first < rank").select("id", "kind"), "marked")

        # New texts go into their buckets first, so that the joins below find both sides in place.
        new = found.filter("words is not null").select("class", *SIGN, "size", *BITS, "keys", "words").repartition(self.buckets, "class").dropDuplicates(["class"])
        new = new.join(self.table("texts").select("class"), "class", "left_anti")
        self.put("texts", new, stamp, placed=True)
        texts = self.table("texts", stamp)
        slim = materialise(found.filter("class is not null").select("id", "class", "rank"), "classes")  # what is read of the batch from here on
        for df in (found, now, hit):
            release(df)
        sweep(spark)  # the sketches and their shuffle are gone before the blocks are shuffled
        self.put("blocks", keyed_of(texts.filter(F.col("stamp") == stamp)), stamp)
        sweep(spark)
        keyed = self.table("blocks", stamp).select("key", "class", *SIGN, (F.col("stamp") == stamp).alias("fresh"))

        def clusters_with(links: DataFrame) -> DataFrame:
            """Every class with its cluster under the links of this batch."""
            merged = components(self.rooted(links))
            every = self.root_of(self.table("clusters").select("class")).unionByName(texts.filter(F.col("stamp") == stamp).select("class", F.col("class").alias("root")))
            return every.join(merged.withColumnRenamed("class", "root"), "root", "left").select("class", F.coalesce("comp", "root").alias("comp"))

        links = linked(keyed, texts.select("class", "size", *BITS, "words"), self.weights, clusters_with)

        # Union-find: links join representatives; those that lose their place are re-pointed, with all that pointed to them.
        merged = components(self.rooted(links))
        fresh = texts.filter(F.col("stamp") == stamp).select("class")
        self.put("clusters", fresh.join(merged, "class", "left").select("class", F.coalesce("comp", "class").alias("comp")), stamp, placed=True)
        moved = materialise(merged.filter("class != comp").join(fresh, "class", "left_anti").select(F.col("class").alias("was"), F.col("comp").alias("root")), "moved")
        old = self.table("roots").groupBy("comp").agg(F.max_by("root", "stamp").alias("was"))
        self.put("roots", moved.select(F.col("was").alias("comp"), "root").unionByName(old.join(moved, "was").select("comp", "root")), stamp)

        # First runs of the clusters that the batch touches.
        sweep(spark)
        seen = slim.groupBy("class").agg(F.min("rank").alias("rank"), F.max("rank").alias("last"))
        seen = materialise(self.root_of(seen, stamp), "seen")
        lost = self.table("firsts").join(moved.withColumnRenamed("was", "comp"), "comp").select(F.col("root").alias("comp"), "rank")
        self.put("firsts", seen.select(F.col("root").alias("comp"), "rank").unionByName(lost).groupBy("comp").agg(F.min("rank").alias("rank")), stamp, placed=True)
        first = self.table("firsts", stamp).groupBy("comp").agg(F.min("rank").alias("first"))
        near = seen.join(first.withColumnRenamed("comp", "root"), "root").filter("first < last").select("class", "first")
        near = materialise(near, "near")
        copies = slim.join(near, "class").filter("first < rank").select("id", F.lit(2).alias("kind"))

        name = F.element_at(F.array(*map(F.lit, ("identity", "exact", "near"))), F.min("kind") + 1)
        out = materialise(marked.unionByName(copies).groupBy(F.col("id").alias("ingest_seq")).agg(name.alias("kind")), "repeats")
        self.commit([*self.stamps, stamp])
        for df in (slim, marked, links, merged, moved, seen, near):
            release(df)
        sweep(spark)
        return out

    def rooted(self, links: DataFrame) -> DataFrame:
        """Links between the representatives of their ends; classes of the batch stand for themselves."""
        ends = links.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        reps = materialise(self.root_of(ends).filter("class != root"), "reps")
        for end in ("a", "b"):
            links = links.join(reps.withColumnRenamed("class", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        return links.filter("a != b").distinct()

    def compact(self) -> None:
        """Rewrite what counts into a new folder with one stamp: first runs once a key, no roots, no rows of failed batches."""
        olds, names, was = {t: self.table(t) for t in self.TABLES}, [self.name(t) for t in self.TABLES], f"{self.path}/{self.folder}"
        classes = self.root_of(self.table("clusters").select("class")).withColumnRenamed("root", "comp")
        now = self.table("roots").groupBy("comp").agg(F.max_by("root", "stamp").alias("root"))
        firsts = self.table("firsts").join(now, "comp", "left").groupBy(F.coalesce("root", "comp").alias("comp")).agg(F.min("rank").alias("rank"))
        stamp = (self.version + 1) << 32 | secrets.randbits(31)
        self.folder = f"t{self.version + 1}-{uuid.uuid4().hex[:8]}"
        self.open()
        marks = olds["marks"].groupBy("key").agg(F.min("rank").alias("rank"))
        for t, df in {"marks": marks, "blocks": olds["blocks"], "texts": olds["texts"], "clusters": classes, "firsts": firsts}.items():
            self.put(t, df, stamp)
        self.commit([stamp])
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(was)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def replay(spark: SparkSession, blocks: Iterable[DataFrame], path: str | None = None) -> DataFrame:
    """Feed blocks of batches, in order, to a store (a new one where no path is given); the repeats of all."""
    store = History(spark, path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")
    out = [store.add(b) for b in blocks]
    store.close()
    return reduce(DataFrame.unionByName, out)


def in_blocks(evidence: DataFrame, runs: DataFrame, n: int = REPLAY) -> list[DataFrame]:
    """The log as n blocks of consecutive runs, like in their number of runs; a run is one row of runs, so its ranks are few."""
    runs = runs.filter("run_id is not null and started_at is not null")
    at = F.unix_micros("started_at")
    cuts = runs.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 100_000).alias("c")).first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    parts = [runs.filter((F.lit(True) if a is None else at > a) & (F.lit(True) if z is None else at <= z)) for a, z in zip(edges, edges[1:])]
    return [intake(evidence, p) for p in parts]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(spark, in_blocks(load(spark, sf_dir, "evidence"), load(spark, sf_dir, "runs")))
