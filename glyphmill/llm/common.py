"""Text levelling and cluster plumbing shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import shutil
import sys
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Look-alike letters (Unicode confusables), foreign letter followed by the Latin letter it resembles.
LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ӏl ԛq ԝw ѵv ɡg ɑa ɩi օo զq հh ոn ѡw "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY "
    "οo νv ρp ιi αa γy υu κk τt χx ϲc ϳj σo ωw "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
).split()
# Ignorable characters outside category Cf.
EXTRA_IGNORABLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0]

PROTOTYPE = {ord(p[0]): p[1] for p in LOOKALIKES}
IGNORABLE = {
    c
    for r in (range(0x110), range(0x600, 0x2100), range(0xFE00, 0x10000), range(0xE0000, 0xE1000))
    for c in r
    if unicodedata.category(chr(c)) == "Cf" or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF
} | {0xAD, *EXTRA_IGNORABLE}
_DROP = re.compile(f"[{re.escape(''.join(map(chr, sorted(IGNORABLE))))}]+")
_ALIKE = re.compile(f"[{''.join(map(chr, PROTOTYPE))}]")
SEPARATOR = "\ufdd0"


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    drop, alike, word = np.zeros(0x10000, bool), np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, bool)
    drop[[c for c in IGNORABLE if c < 0x10000]] = True
    for c, to in PROTOTYPE.items():
        alike[c] = ord(to)
    word[[m.start() for m in re.finditer(r"[^\W_]", "".join(map(chr, range(0x10000))))]] = True
    word[ord(SEPARATOR)] = False
    return drop, alike, word


_IS_DROP, _TO_ALIKE, _IS_WORD = _tables()


def compat(text: str | None) -> str:
    """Compatibility form without ignorable characters, white space collapsed; '' for null."""
    if not text:
        return ""
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFKC", _DROP.sub("", text)))
    return " ".join(text.split())


def skeleton(text: str | None) -> str:
    """compat() with every look-alike letter replaced by its prototype; case and marks stay."""
    text = compat(text)
    return text if text.isascii() or not _ALIKE.search(text) else text.translate(PROTOTYPE)


def without_ignorable(text: str) -> str:
    cp = codepoints(text)
    gone = _IS_DROP[np.minimum(cp, 0xFFFF)] & (cp < 0x10000) | (cp >= 0xE0000) & (cp < 0xE1000)
    return text if not gone.any() else as_text(cp[~gone])


def look_alike(text: str) -> str:
    """Every look-alike letter replaced by its prototype."""
    cp = codepoints(text)
    return as_text(np.where(cp < 0x10000, _TO_ALIKE[np.minimum(cp, 0xFFFF)], cp))


def level_many(texts: list[str | None]) -> list[str]:
    """Case-, punctuation-, spacing- and look-alike-free forms used to compare wording; '' for null. One pass over all texts."""
    if not len(texts):
        return []
    clean = [t if t is not None and t == t and SEPARATOR not in t else (t or "").replace(SEPARATOR, "") if isinstance(t, str) else "" for t in texts]
    t = SEPARATOR.join(clean)
    if not t.isascii():
        t = without_ignorable(unicodedata.normalize("NFKC", without_ignorable(t)))
    cp = codepoints(t.lower())
    bmp = np.minimum(cp, 0xFFFF)
    low = cp < 0x10000
    word = _IS_WORD[bmp] & low
    if not low.all():
        high = np.unique(cp[~low])
        word |= np.isin(cp, [c for c in high if chr(c).isalnum()])
        alike = np.where(low, _TO_ALIKE[bmp], cp)
    else:
        alike = _TO_ALIKE[bmp]
    cut = cp == ord(SEPARATOR)
    cp = np.where(word | cut, alike, np.uint32(32)).astype(np.uint32)
    blank = cp == 32
    edge = np.concatenate([[True], (blank | cut)[:-1]])
    cp = cp[~(blank & edge)]
    return [x[:-1] if x[-1:] == " " else x for x in as_text(cp).split(SEPARATOR)]


def levelled(text: str | None) -> str:
    return level_many([text])[0]


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def as_text(cp: np.ndarray) -> str:
    return cp.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="glyphmill-")
            import atexit

            atexit.register(shutil.rmtree, _OWN[app], True)
        base = _OWN[app]
    return base.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.written_at = path
    return got


def release(df: DataFrame) -> None:
    """Remove the table of materialise() once nothing reads it any more; other data frames are left alone."""
    at = getattr(df, "written_at", None)
    if at:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Collect the driver's garbage: Spark drops shuffle files once the plans that wrote them are gone, and else keeps them on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Two columns under fixed names, whatever else df holds."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as cores when the input has fewer (a small or single file)."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def ship() -> None:
    """Pickle this package by value, so that executors need not have it on their path."""
    from pyspark import cloudpickle

    for name in list(sys.modules):
        if name.startswith("glyphmill.llm") and sys.modules[name] is not None:
            cloudpickle.register_pickle_by_value(sys.modules[name])
