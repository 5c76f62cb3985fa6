"""Problem 5: language of every text and of its parts, by a byte convolutional network.

Texts are cut into parts at closing marks, line breaks and changes of script; addresses, handles and codes are left out. The UTF-8 bytes
of the parts, in windows of fixed length, go in batches through filters of several widths, max pooling and a softmax. The network is
trained in numpy on a bounded sample of labelled texts, once on all of it and once more without the windows that contradict their label.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IGNORABLE, compat, load, ship, spread

LANGS = ["de", "en", "es", "fr", "ja", "ko", "ru", "zh"]
# Other spellings of the codes.
ALIASES = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr", "jpn": "ja", "jp": "ja", "kor": "ko", "kr": "ko", "rus": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "cn": "zh", "german": "de", "english": "en", "spanish": "es", "french": "fr", "japanese": "ja", "korean": "ko", "russian": "ru", "chinese": "zh"}
MISSING = ["", "und", "unknown", "null", "none", "nan", "mul", "zxx"]
SAMPLE = 260  # labelled texts of each language that the network is trained on
TRAIN_WINDOWS = 1500  # at most so many windows of each language
WINDOW = 80
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
LONG = 24
PART_CONFIDENCE = 0.85
KIN_CONFIDENCE, KIN_LETTERS = 0.95, 36  # for a second language in the script of the first
PART_LETTERS = 18  # a whole clause; a character of a script without spaces counts as DENSE_LETTERS
DENSE_LETTERS = 3

_NOISE = re.compile(r"[a-z0-9._+-]*@[a-z0-9._+-]*|https?://[!-~]+|[a-z0-9._+-]+\.(?:example|test|invalid|com|org|net|html|txt)\b[!-~]*|\[[^\]]{1,12}\]|[^\s一-鿿]*\d[^\s一-鿿぀-ヿ가-힯]*")
_CUT = re.compile(r"[.!?。！？；;，,～~、\n…—/:：()（）|]+|\s-\s")
_RUN = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟー々]+(?:\s+[぀-ヿ㐀-鿿ー々]+)*|[가-힯]+(?:\s+[가-힯]+)*|[Ѐ-ӿ]+(?:[\s'’-]+[Ѐ-ӿ]+)*|[a-zß-ÿœ]+(?:[\s'’-]+[a-zß-ÿœ]+)*")


def label(tag: str | None) -> str | None:
    """One of LANGS, another lower-case primary tag, or None for a missing one."""
    t = re.split(r"[-_]", (tag or "").strip().lower())[0]
    return None if t in MISSING else ALIASES.get(t, t)


def label_of(x: Column) -> Column:
    """label() as an expression."""
    t = F.split(F.lower(F.trim(F.coalesce(x, F.lit("")))), "[-_]")[0]
    alias = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.when(~t.isin(MISSING), F.coalesce(alias[t], t))


def parts(text: str | None) -> list[str]:
    t = _NOISE.sub(" ", compat_lines(text).lower())
    return [m.group() for c in _CUT.split(t) for m in _RUN.finditer(c)]


def compat_lines(text: str | None) -> str:
    return "\n".join(compat(x) for x in (text or "").splitlines())


def letters(part: str) -> int:
    return sum(DENSE_LETTERS if "぀" <= c <= "鿿" else 2 if c >= "가" else 1 for c in part if c != " ")


def windows(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of the parts (0 where a part ends) and the part that each belongs to."""
    coded = [c.encode() for c in chunks]
    n = np.array([max(1, -(-len(c) // WINDOW)) for c in coded])
    out = np.zeros((int(n.sum()), WINDOW), np.uint8)
    at = 0
    for c, k in zip(coded, n):
        flat = np.frombuffer(c, np.uint8)
        out[at : at + k].reshape(-1)[: len(flat)] = flat
        at += k
    return out, np.repeat(np.arange(len(chunks)), n)


class ByteCNN:
    """Embedding of bytes, convolutions of several widths with ReLU and max pooling, softmax over LANGS."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.w = {"emb": r.normal(0, 0.5, (256, EMBED)), "out": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(LANGS))), "bias": np.zeros(len(LANGS))}
        for k in WIDTHS:
            self.w[f"f{k}"] = r.normal(0, np.sqrt(2 / (k * EMBED)), (k * EMBED, FILTERS))
            self.w[f"b{k}"] = np.zeros(FILTERS)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["emb"][0] = 0

    def _slide(self, e: np.ndarray, k: int) -> np.ndarray:
        n, length, d = e.shape
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (n, length - k + 1, k * d), (s[0], s[1], s[2]))

    def pooled(self, x: np.ndarray, keep: bool = False):
        e = self.w["emb"][x]
        pool, trace = [], []
        for k in WIDTHS:
            s = self._slide(e, k).reshape(-1, k * EMBED)
            h = (s @ self.w[f"f{k}"]).reshape(len(x), -1, FILTERS)
            if keep:
                trace.append((k, h.argmax(1)))
            pool.append(np.maximum(h.max(1) + self.w[f"b{k}"], 0))
        return np.concatenate(pool, 1), e, trace

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self.pooled(x[i : i + 256])[0] @ self.w["out"] + self.w["bias"] for i in range(0, len(x), 256)]
        return np.concatenate(out) if out else np.zeros((0, len(LANGS)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 3, rate: float = 0.004) -> None:
        """Adam on cross-entropy; deterministic for given data."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        share = np.bincount(y, minlength=len(LANGS)).astype(np.float32)
        weight = (len(y) / np.maximum(share, 1) / len(LANGS)) ** 0.5
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(order), 64):
                b = order[i : i + 64]
                xb, yb = x[b], y[b]
                p, e, trace = self.pooled(xb, True)
                z = p @ self.w["out"] + self.w["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                z[np.arange(len(b)), yb] -= 1
                z *= weight[yb][:, None] / len(b)
                g = {"out": p.T @ z, "bias": z.sum(0), "emb": np.zeros_like(self.w["emb"])}
                dp = (z @ self.w["out"].T) * (p > 0)
                for n, (k, at) in enumerate(trace):
                    d = dp[:, n * FILTERS : (n + 1) * FILTERS]
                    rows = np.arange(len(b))[:, None]
                    seen = self._slide(e, k)[rows, at]  # (batch, filters, k * embed)
                    g[f"f{k}"] = np.einsum("bfe,bf->ef", seen, d)
                    g[f"b{k}"] = d.sum(0)
                    back = (d[:, :, None] * self.w[f"f{k}"].T[None]).reshape(-1, k, EMBED)
                    byte = xb[rows[:, :, None], at[:, :, None] + np.arange(k)].ravel()
                    for c in range(EMBED):
                        g["emb"][:, c] += np.bincount(byte, back[:, :, c].ravel(), 256)
                g["emb"][0] = 0
                step += 1
                for name, w in self.w.items():
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v2[name] = 0.999 * v2[name] + 0.001 * g[name] ** 2
                    w -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)


def train(samples: list[tuple[str, str]]) -> ByteCNN:
    """Network fitted on (text, language) pairs; languages outside LANGS are left out."""
    xs, ys = [], []
    for text, lang in samples:
        if lang in LANGS:
            p = [c for c in parts(text) if letters(c) >= 6]
            if p:
                x, _ = windows(p)
                xs.append(x)
                ys.append(np.full(len(x), LANGS.index(lang)))
    net = ByteCNN()
    if not xs:
        return net
    x, y = np.concatenate(xs), np.concatenate(ys)
    first = np.concatenate([np.flatnonzero(y == k)[:TRAIN_WINDOWS] for k in range(len(LANGS))])
    x, y = x[first], y[first]
    net.fit(x, y, 2)
    z = net.logits(x)
    z = np.exp(z - z.max(1, keepdims=True))
    good = z[np.arange(len(y)), y] / z.sum(1) > 0.3
    if good.sum() > len(y) // 4:
        x, y = x[good], y[good]
    net = ByteCNN()
    net.fit(x, y, 4)
    return net


_CLUSTER = re.compile(r".[\u0300-\u036f\u1161-\u11ff\u3099\u309a]*", re.S)


def placed_parts(text: str | None) -> list[tuple[str, int, int]]:
    """The parts of a text with start and end in its code points; characters are levelled one cluster at a time, so each keeps its place."""
    out, where, ends = [], [], []
    for m in _CLUSTER.finditer(text or ""):
        for c in unicodedata.normalize("NFKC", "".join(x for x in m.group() if ord(x) not in IGNORABLE)):
            out.append(c.lower()[:1])
            where.append(m.start())
            ends.append(m.end())
    t = _NOISE.sub(lambda m: " " * len(m.group()), "".join(out))
    got, at = [], 0
    for m in [*_CUT.finditer(t), None]:
        stop = m.start() if m else len(t)
        got += [(r.group(), where[r.start()], ends[r.end() - 1]) for r in _RUN.finditer(t, at, stop)]
        at = m.end() if m else at
    return got


def segments(net: ByteCNN, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, language, confidence) of the stretches of every text, neighbours of one language joined."""
    placed = [placed_parts(t) for t in texts]
    out = []
    for spans, found in zip(placed, classify(net, texts, [[p for p, _, _ in x] for x in placed])):
        got: list[list] = []
        for (_, a, z), (_, lang, conf, n) in zip(spans, found):
            if got and got[-1][2] == lang:
                last = got[-1]
                last[1], last[3], last[4] = z, (last[3] * last[4] + conf * n) / max(1, last[4] + n), last[4] + n
            else:
                got.append([a, z, lang, conf, n])
        out.append([tuple(g[:4]) for g in got])
    return out


def classify(net: ByteCNN, texts: list[str | None], cut: list[list[str]] | None = None) -> list[list[tuple[str, str, float, int]]]:
    """For each text its parts as (part, language, confidence, letters), in order."""
    cut = [parts(t) for t in texts] if cut is None else cut
    flat = [p for c in cut for p in c]
    if not flat:
        return [[] for _ in texts]
    x, owner = windows(flat)
    z = net.logits(x)
    size = np.bincount(owner, minlength=len(flat))
    mean = np.zeros((len(flat), len(LANGS)), np.float64)
    np.add.at(mean, owner, z)
    z = mean / np.sqrt(size)[:, None]
    z = np.exp(z - z.max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    best, conf = z.argmax(1), z.max(1)
    out, at = [], 0
    for c in cut:
        out.append([(p, LANGS[best[at + i]], float(conf[at + i]), letters(p)) for i, p in enumerate(c)])
        at += len(c)
    return out


SCRIPT = {"ru": "cyrillic", "ja": "dense", "zh": "dense", "ko": "hangul"}


def held(found: list[tuple[str, str, float, int]]) -> dict[str, tuple[float, int]]:
    """Languages of a text with confidence and letters: those with a whole clause of sure parts, else the one of most letters.

    A second language in the script of a larger one needs surer and longer parts, as single clauses of names mislead.
    """
    total: dict[str, list] = {}
    weak: dict[str, float] = {}
    for _, lang, conf, n in found:
        weak[lang] = weak.get(lang, 0) + conf * n
        if n >= 8:
            s = total.setdefault(lang, [0, 0.0, 0, 0])
            s[0] += n
            s[1] += conf * n
            s[2] = max(s[2], n if conf >= PART_CONFIDENCE else 0)
            s[3] += n if conf >= KIN_CONFIDENCE else 0
    got: dict[str, tuple[float, int]] = {}
    for lang in sorted(total, key=lambda k: (-total[k][0], k)):
        n, sure, longest, firm = total[lang]
        kin = any(SCRIPT.get(k) == SCRIPT.get(lang) for k in got)
        if longest >= PART_LETTERS and (not kin or firm >= KIN_LETTERS):
            got[lang] = (sure / n, n)
    if not got and weak:
        top = min(weak, key=lambda k: (-weak[k], k))
        n = sum(x[3] for x in found)
        got = {top: (weak[top] / max(1, n), n)}
    return got


def sample(df: DataFrame, text: str, lang: str, size: int = SAMPLE) -> list[tuple[str, str]]:
    """At most size labelled texts of each language, those of smallest hash; counted and cut without a sort of all rows."""
    tags = df.groupBy(lang).count().withColumn("code", label_of(F.col(lang))).filter(F.col("code").isin(LANGS)).groupBy("code").agg(F.sum("count").alias("count")).collect()
    total: dict[str, int] = {}
    for t in tags:
        total[t["code"]] = total.get(t["code"], 0) + t["count"]
    out = []
    if not tags:
        return out
    share = F.create_map(*[x for k, n in total.items() for x in (F.lit(k), F.lit(min(1.0, 3.0 * size / n)))])
    h = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    rows = df.filter(F.col(lang).isNotNull() & (F.char_length(text) >= LONG)).select(F.col(text).alias("t"), label_of(F.col(lang)).alias("l"), h.alias("h")).withColumn("s", share[F.col("l")])
    got = rows.filter("l is not null and h < s * 1073741824").select("t", "l", "h").toPandas().sort_values(["h", "t"])
    for code_, g in got.groupby("l", sort=True):
        out += list(zip(g["t"].drop_duplicates().head(size), [code_] * size))
    return out


def detect(df: DataFrame, key: str = "evidence_id", text: str = "original_text", lang: str = "language", labelled: list[tuple[str, str]] = ()) -> DataFrame:
    """id, label, lang, confidence, letters, parts: one row for each language that a row's text holds.

    lang is null for texts without letters (null, empty, signs only); a text in one language has one row; label is the row's own label
    brought to a primary code, null if missing; whole texts are read; repeated rows give repeated results; other columns of df are
    ignored; an empty table gives no row.
    """
    ship()
    net = df.sparkSession.sparkContext.broadcast(train([*labelled, *sample(df, text, lang)]))
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("label"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, tag, found in zip(b["id"], b["label"], classify(net.value, list(b["text"]))):
                got = held(found)
                for k in sorted(got) or [None]:
                    c, n = got.get(k, (0.0, 0))
                    out.append((i, label(tag), k, c, n, [p for p, x, _, _ in found if x == k]))
            yield pd.DataFrame(out, columns=["id", "label", "lang", "confidence", "letters", "parts"])

    return spread(rows).mapInPandas(task, f"id {rows.schema['id'].dataType.simpleString()}, label string, lang string, confidence double, letters long, parts array<string>")


def detect_segments(df: DataFrame, key: str = "evidence_id", text: str = "original_text", lang: str = "language", labelled: list[tuple[str, str]] = ()) -> DataFrame:
    """id, segment, start_pos, end_pos, lang, confidence: one row for each stretch of a text in one language, in order from 0.

    Positions are code points, end exclusive. Texts without letters (null, empty, signs only) give no row; whole texts are read; repeated
    rows give repeated results; other columns of df are ignored; an empty table gives no row.
    """
    ship()
    net = df.sparkSession.sparkContext.broadcast(train([*labelled, *sample(df, text, lang)]))
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, k, *x) for i, found in zip(b["id"], segments(net.value, list(b["text"]))) for k, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "segment", "start_pos", "end_pos", "lang", "confidence"])

    return spread(rows).mapInPandas(task, f"id {rows.schema['id'].dataType.simpleString()}, segment int, start_pos int, end_pos int, lang string, confidence double")


def _known(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    known = load(spark, sf_dir, "moderation_samples").filter("text is not null and lang is not null").select("text", "lang").orderBy("sample_id").limit(1000)
    return [(t, label(k)) for t, k in known.collect()]


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_segments(load(spark, sf_dir, "bilibili"), labelled=_known(spark, sf_dir)).withColumnRenamed("id", "evidence_id")


def _run(spark: SparkSession, sf_dir: str, long: bool = False) -> DataFrame:
    df = load(spark, sf_dir, "bilibili")
    return detect(df.filter(F.char_length("original_text") >= LONG) if long else df, labelled=_known(spark, sf_dir))


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select(F.col("id").alias("evidence_id"), "label", "lang", F.round("confidence", 4).alias("confidence"), "letters")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each language of long texts whose label is missing or wrong, or which mix languages."""
    got = _run(spark, sf_dir, True).filter("lang is not null").select("id", "label", "lang", F.size("parts").alias("n"))
    per = got.groupBy("id", "label").agg(F.collect_set("lang").alias("langs"))
    case = per.filter(F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label")))
    return case.select(F.col("id").alias("evidence_id"), F.explode("langs").alias("lang")).distinct()
