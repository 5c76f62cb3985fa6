"""Problem 6: one consistent form for texts that read alike.

After compatibility normalisation and deletion of ignorable characters, every look-alike letter opens a lattice of the letters it may
stand for. Each token's lattice is searched by Viterbi: paths are scored by character pairs counted over all texts, by staying in one
script and by agreeing with the script of the text's unambiguous letters. The lattice holds the same letters whichever of them was
written, so texts that read alike always get the same form.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOOKALIKES, codepoints, compat, load, materialise, ship, skeleton, spread

LONG = 24
SWITCH = 9.0  # cost of changing the script inside a token
FOREIGN = 3.0  # cost of a token in another script than the text's own letters
SMOOTH = 0.5


def script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c <= 0x1EFF:
        return "L"
    if 0x370 <= c <= 0x3FF:
        return "G"
    if 0x400 <= c <= 0x52F:
        return "C"
    return "A" if 0x530 <= c <= 0x58F else "L"


READINGS: dict[str, list[str]] = defaultdict(list)
for _p in LOOKALIKES:
    if script(_p[0]) != "L":
        READINGS[_p[1]].append(_p[0])
READINGS = {k: [k, *v] for k, v in READINGS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LATTICE = re.compile(f"[{''.join(READINGS)}]")


def count_pairs(texts: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of adjacent letters of one script over all texts; at most (letters of three alphabets) squared entries."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = defaultdict(int)
        for b in batches:
            cp = codepoints("\n".join(compat(t) for t in b["text"]) + "\n")
            kind = np.zeros(len(cp), np.int8)
            low = cp < 0x250
            letter = low & ((cp | 32) >= 97) & ((cp | 32) <= 122) | (cp >= 0xC0) & low
            kind[letter] = 1
            kind[(cp >= 0x370) & (cp <= 0x3FF)] = 2
            kind[(cp >= 0x400) & (cp <= 0x52F)] = 3
            # a token counts if all its letters are of one script
            a, z = cp[:-1].astype(np.int64), cp[1:].astype(np.int64)
            ka, kz = kind[:-1], kind[1:]
            start = np.flatnonzero((kz > 0) & (ka == 0)) + 1
            token = np.zeros(len(cp), np.int64)
            token[start] = 1
            token = np.cumsum(token)
            n = token[-1] + 1 if len(token) else 1
            seen = [np.bincount(token[kind == k], minlength=n) > 0 for k in (1, 2, 3)]
            mixed = (seen[0].astype(int) + seen[1] + seen[2]) > 1
            ok = ((ka > 0) | (kz > 0)) & ~mixed[np.where(kz > 0, token[1:], token[:-1])]
            pair = (np.where(ka > 0, a, 0) << 16 | np.where(kz > 0, z, 0))[ok]
            for p, c in zip(*np.unique(pair, return_counts=True)):
                total[int(p)] += int(c)
        if total:
            yield pd.DataFrame({"pair": list(total), "n": list(total.values())})

    got = texts.mapInPandas(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {(chr(p >> 16), chr(p & 0xFFFF)): n for p, n in got}


class Reader:
    """Viterbi search of token lattices under the counted character pairs."""

    def __init__(self, pairs: dict[tuple[str, str], int]):
        self.first: dict[str, float] = defaultdict(float)
        size: dict[str, set] = defaultdict(set)
        self.pairs = pairs
        for (a, z), n in pairs.items():
            self.first[(a, script(z if a == "\0" else a))] += n
            size[script(z if a == "\0" else a)].add(z)
        self.size = {k: len(v) for k, v in size.items()}
        self.known: dict[tuple[str, str], str] = {}

    def cost(self, a: str, z: str, s: str) -> float:
        return -math.log((self.pairs.get((a, z), 0) + SMOOTH) / (self.first.get((a, s), 0) + SMOOTH * (self.size.get(s, 0) + 30)))

    def token(self, t: str, own: str) -> str:
        """Cheapest reading of a token; ties go to the earlier reading, so the result depends on t and own alone."""
        got = self.known.get((t, own))
        if got is not None:
            return got
        best = {"\0": (0.0, "", "")}
        for ch in t:
            new = {}
            for r in READINGS.get(ch, (ch,)):
                s = script(r)
                new[r] = min(((c + self.cost(p, r, s) + (SWITCH if last and last != s else 0) + (FOREIGN if own and s != own else 0), path + r, s) for p, (c, path, last) in best.items()), key=lambda x: x[0])
            best = new
        got = min(((c + self.cost(r, "\0", last), path) for r, (c, path, last) in best.items()), key=lambda x: x[0])[1]
        if len(self.known) < 500_000:
            self.known[t, own] = got
        return got

    def read(self, text: str | None) -> str:
        """The consistent form of a text; '' for null and for text of ignorable characters only."""
        t = skeleton(text)
        if not _LATTICE.search(t):
            return t
        votes = {"L": 0, "C": 0, "G": 0, "A": 0}
        for ch in t if not t.isascii() else ():
            if ch.isalpha() and ch not in READINGS:
                if "ͰͿ" <= ch or ch < "ɐ":
                    c = ord(ch)
                    if c < 0x250 or 0x370 <= c <= 0x58F:
                        votes[script(ch)] += 1
        if t.isascii() or not votes["C"] + votes["G"] + votes["A"]:
            return t  # no letter of another alphabet is left that could not be Latin
        return _WORD.sub(lambda m: self.in_text(m.group(), votes), t)

    def in_text(self, word: str, votes: dict[str, int]) -> str:
        if not _LATTICE.search(word):
            return word
        fixed = {script(ch) for ch in word if ch not in READINGS}
        own = next(iter(fixed)) if len(fixed) == 1 else max(votes, key=lambda k: votes[k])
        return self.token(word, own)


def consistent(df: DataFrame, key: str = "evidence_id", text: str = "original_text") -> DataFrame:
    """id, text, form: every row of df with its consistent form.

    Null and empty texts get the form ''; equal texts get equal forms; whole texts are read whatever their length; other columns of df
    are ignored; an empty table gives no row.
    """
    ship()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    reader = rows.sparkSession.sparkContext.broadcast(count_pairs(rows.select("text")))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Reader(reader.value)
        for b in batches:
            yield b.assign(form=[r.read(t) for t in b["text"]])

    return spread(rows).mapInPandas(task, f"id {rows.schema['id'].dataType.simpleString()}, text string, form string")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = consistent(load(spark, sf_dir, "bilibili"))
    return got.select(F.col("id").alias("evidence_id"), F.col("text").alias("original_text"), F.col("form").alias("normalized_text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of long texts of one form that differ in their characters; distinct texts are paired first, then their rows."""
    got = consistent(load(spark, sf_dir, "bilibili")).filter((F.char_length("text") >= LONG) & F.col("id").isNotNull() & (F.col("form") != ""))
    hashed = materialise(got.select("id", F.sha2("form", 256).alias("form"), F.sha2("text", 256).alias("text")), "hashed").distinct()
    many = hashed.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo != hi").select("form")
    m = materialise(hashed.join(many, "form"), "forms")
    pairs = m.alias("a").join(m.alias("b"), F.expr("a.form = b.form and a.text != b.text and a.id < b.id"))
    return pairs.select(F.col("a.id").alias("evidence_id_a"), F.col("b.id").alias("evidence_id_b")).distinct()
