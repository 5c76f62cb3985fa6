"""Problem 8: passages of held-out test items inside the corpus.

Texts are compared without case, punctuation, spacing and look-alikes. The passages' character q-grams form an index; a document's hits
are counted in overlapping bands of diagonals (position in the passage minus position in the document). By the q-gram lemma a stretch of
n characters with at most e edited ones keeps n - q + 1 - q * e of its q-grams in one band, so bands with fewer are no case; the regions
of the others are aligned word by word (characters in scripts without spaces) within the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codepoints, level_many, levelled, load, ship, spread
from .near import _B, _BI, mix

Q, Q_DENSE = 8, 4  # length of a q-gram, and in scripts without spaces
BAND = 48  # diagonals of a band; bands overlap by half
BUDGET, BUDGET_DENSE = 22, 9  # q-grams that the shortest stretch keeps within its edit budget
WORDS, WORDS_DENSE = 15, 23  # score of the alignment: a word +1, an edit -2
CLEAN, CLEAN_DENSE = 12, 20  # score of a stretch without any edit
BLOCK = 1_000_000  # characters of passages that are indexed, and sent to the executors, at once

_UNIT = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\s぀-ヿ㐀-鿿฀-๿]+")


def _dense(cp: np.ndarray) -> np.ndarray:
    return ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0x0E00) & (cp <= 0x0E7F)) | (cp >= 0x20000)


def qgrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, position, hash, whether dense) of the q-grams of texts without spaces."""
    gap = "\0" * Q
    cp = codepoints(gap.join(texts) + gap)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + Q
    doc = np.repeat(np.arange(len(texts)), lens)
    base = np.repeat(np.concatenate([[0], np.cumsum(lens)[:-1]]), lens)
    n = len(cp)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BI)]), dtype=np.uint64)
    pre = np.concatenate([[np.uint64(0)], np.cumsum(cp.astype(np.uint64) * power[:-1], dtype=np.uint64)])
    pos = np.arange(n) - base
    left = lens[doc] - Q - pos
    dense = _dense(cp)
    out = []
    for q, kind in ((Q, ~dense), (Q_DENSE, dense)):
        i = np.flatnonzero(kind & (left >= q))
        out.append((doc[i], pos[i], mix((pre[i + q] - pre[i]) * inverse[i] + np.uint64(q)), np.full(len(i), q == Q_DENSE)))
    d, p, h, z = (np.concatenate(x) for x in zip(*out))
    return d, p, h, z


class Index:
    """Passages (distinct after levelling) with their q-grams, sorted by hash."""

    def __init__(self, passages: list[tuple[list, str]]):
        self.items = [i for i, _ in passages]
        self.level = [t for _, t in passages]
        d, p, h, _ = qgrams([t.replace(" ", "") for t in self.level])
        order = np.argsort(h, kind="stable")
        self.passage, self.at = d[order].astype(np.int32), p[order].astype(np.int32)
        self.hash, self.first, n = np.unique(h[order], return_index=True, return_counts=True)
        self.count = n
        self.units = [units(t) for t in self.level]
        self.ids: dict[str, int] = {}
        self.coded = [np.array([self.ids.setdefault(x, len(self.ids)) for x in u], np.int32) for u, _ in self.units]

    def hits(self, d: np.ndarray, p: np.ndarray, h: np.ndarray, z: np.ndarray):
        """(text, position, passage, position in it, whether dense) of every q-gram of the texts that a passage holds."""
        if not len(self.hash) or not len(h):
            return (np.zeros(0, np.int64),) * 5
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        ok = self.hash[k] == h
        k, d, p, z = k[ok], d[ok], p[ok], z[ok]
        n = self.count[k]
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(d, n), np.repeat(p, n).astype(np.int64), self.passage[entry].astype(np.int64), self.at[entry].astype(np.int64), np.repeat(z, n)


def units(level: str) -> tuple[list[str], np.ndarray]:
    """Words and dense characters of a levelled text, and their starts in the text without spaces."""
    u = _UNIT.findall(level)
    return u, np.concatenate([[0], np.cumsum([len(x) for x in u])]).astype(np.int64)


WIDTH = 24  # half width of the alignment band, in units


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignments of unit ids (a, b) within WIDTH of the diagonal j - i = shift, all pairs at once.

    Returns scores, lengths of the longest stretch without an edit, and the last unit of a in the best alignment.
    """
    n, width = len(pairs), 2 * WIDTH + 1
    la, lb = max(len(a) for a, _, _ in pairs), max(len(b) for _, b, _ in pairs)
    A = np.full((n, la), -1, np.int32)
    B = np.full((n, lb + 2), -2, np.int32)
    for r, (a, b, _) in enumerate(pairs):
        A[r, : len(a)], B[r, 1 : len(b) + 1] = a, b
    shift = np.array([s for _, _, s in pairs])[:, None]
    col = np.arange(width)[None, :]
    old, run = np.zeros((n, width + 1), np.int32), np.zeros((n, width), np.int32)
    best, end, clean = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    row = np.arange(n)[:, None]
    for i in range(la):
        j = np.clip(i + shift + col - WIDTH + 1, 0, lb + 1)
        eq = A[:, i : i + 1] == B[row, j]
        s = np.maximum(old[:, :-1] + np.where(eq, 1, -2), old[:, 1:] - 2)
        s = np.maximum(np.maximum.accumulate(np.maximum(s, 0) + 2 * col, axis=1) - 2 * col, 0)
        run = np.where(eq, run + 1, 0)
        top = s.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], i
        np.maximum(clean, run.max(axis=1), out=clean)
        old[:, :-1] = s
    return best, clean, end


def leaks(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(index of the text, index of the passage) of the texts that hold a stretch of a passage."""
    level = level_many(texts)
    d, p, k, at, z = index.hits(*qgrams([t.replace(" ", "") for t in level]))
    if not len(d):
        return
    diagonal = at - p
    split: dict[int, tuple[list[str], np.ndarray]] = {}
    regions: dict[tuple[int, int, int, int], tuple[int, int]] = {}
    lowest = int(diagonal.min())
    for half in (0, BAND // 2):
        band = (diagonal - lowest + half) // BAND
        order = np.lexsort((p, band, k, d))
        dd, kk, bb, pp, aa = d[order], k[order], band[order], p[order], at[order]
        # a run of hits ends with its band, and at gaps wider than an edit budget leaves
        cut = np.concatenate([[True], (dd[1:] != dd[:-1]) | (kk[1:] != kk[:-1]) | (bb[1:] != bb[:-1]) | (pp[1:] - pp[:-1] > 4 * Q)])
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(dd))
        kept = np.add.reduceat(np.concatenate([[1], (pp[1:] != pp[:-1]).astype(int)]) | cut, start)
        enough = kept >= np.where(np.logical_or.reduceat(z[order], start), BUDGET_DENSE, BUDGET)
        for s, e in zip(start[enough], stop[enough]):
            doc, passage = int(dd[s]), int(kk[s])
            if doc not in split:
                split[doc] = units(level[doc])
            (_, where), (_, pwhere) = split[doc], index.units[passage]
            i0, i1 = np.searchsorted(where, [pp[s], pp[e - 1]], "right") - 1
            j0, j1 = np.searchsorted(pwhere, [aa[s:e].min(), aa[s:e].max()], "right") - 1
            regions.setdefault((doc, passage, int(i0), int(i1)), (int(j0), int(j1)))
    ids = index.ids
    jobs = sorted(((key, j) for key, j in regions.items()), key=lambda x: x[0][3] - x[0][2])
    found: set[tuple[int, int]] = set()
    for at0 in range(0, len(jobs), 256):
        part = jobs[at0 : at0 + 256]
        pairs = []
        for (doc, passage, i0, i1), (j0, j1) in part:
            a0, b0 = max(0, i0 - 12), max(0, j0 - 12)
            a = np.array([ids.get(x, -1) for x in split[doc][0][a0 : i1 + 24]], np.int32)
            pairs.append((a, index.coded[passage][b0 : j1 + 24], (j0 - b0) - (i0 - a0)))
        for (key, _), score, clean, end in zip(part, *align(pairs)):
            doc, passage, i0, _ = key
            z = max(0, i0 - 12) + end + 1
            tail = split[doc][0][max(0, z - 20) : z]
            dense = sum(len(x) == 1 and x >= "฀" for x in tail) * 2 > len(tail)
            if score >= (WORDS_DENSE if dense else WORDS) or clean >= (CLEAN_DENSE if dense else CLEAN):
                found.add((doc, passage))
    yield from found


def leaked(corpus: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage") -> DataFrame:
    """id, item: distinct pairs of a corpus row and a test item whose passage it holds wholly or partly.

    Null and empty texts and passages match nothing; repeated rows count once; items that share a passage are each reported; whole
    texts are searched whatever their length; other columns are ignored; empty tables give no row. Items are taken in blocks of at most
    BLOCK characters of passages, so what is sent to the executors at once is bounded.
    """
    ship()
    spark = corpus.sparkSession
    rows = spread(corpus.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull()))
    kind, ikind = (x.dataType.simpleString() for x in (rows.schema["id"], items.schema[item]))
    out = None

    def search(block: dict[str, list]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Index([(ids, t) for t, ids in block.items()]))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids = b["id"].to_numpy()
                got = [(ids[d], i) for d, k in leaks(sent.value, list(b["text"])) for i in sent.value.items[k]]
                yield pd.DataFrame(got, columns=["id", "item"])

        return rows.mapInPandas(task, f"id {kind}, item {ikind}")

    block: dict[str, list] = {}
    size = 0
    for i, t in items.select(item, passage).filter(F.col(passage).isNotNull()).distinct().orderBy(item).toLocalIterator():
        t = levelled(t)
        if not t:
            continue
        if t not in block and size + len(t) > BLOCK and block:
            out = search(block) if out is None else out.unionByName(search(block))
            block, size = {}, 0
        size += 0 if t in block else len(t)
        block.setdefault(t, []).append(i)
    if block:
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        return spark.createDataFrame([], f"id {kind}, item {ikind}")
    return out.distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))
