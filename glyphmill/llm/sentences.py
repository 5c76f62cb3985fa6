"""Problem 9: sentence boundaries across languages and scripts.

Every character of a batch gets a symbol that holds what its neighbourhood says (a closing mark that may end a sentence, a dot of an
abbreviation, a quote with what follows it). The rules about quotations, brackets and marks before closing quotes are compiled into a
finite transducer over these symbols. The stream of a batch is cut into chunks; each chunk is run as a function from entry state to exit
state, all chunks at once; the functions are composed by a parallel prefix scan, and a second run from the known states emits the ends.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codepoints, load, ship, spread

# Abbreviations (lower case, without the last dot).
NEVER_END = "dr mr mrs ms prof st sr sra srta dra hr hrn fr frl mme mlle mgr gen col lt sgt capt rev hon jr vs e.g i.e cf approx aprox env ca inkl exkl bzw vgl sog evtl ggf zzgl usw.a d.h z.b u.a ej ex incl excl esp см рис стр тыс млн млрд напр т.е т.к г.н ul núm".split()
BEFORE_NUMBER = "no nr núm fig figs ch chap vol pp p sec art par abb abs kap bd s ca approx aprox env circa рис гл стр табл ст п tel op lib ed".split()
MONTHS = "januar jänner februar märz april mai juni juli august september oktober november dezember".split()
THAI_FINAL = ["ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า"]
OPEN = {"„": "low", "“": "high", "«": "angle", "「": "corner", "『": "white", "‹": "angle", "﹁": "corner", "﹃": "white"}
CLOSE = {"”": "high", "»": "angle", "」": "corner", "』": "white", "›": "angle", "﹂": "corner", "﹄": "white"}
BRACKETS = ("([{（［｛【〔", ")]}）］｝】〕")

(OTHER, SPACE, NL, LOWER, UPPER, DIGIT, DENSE, THAI, DOT, HARD, FULL, ELL, OPENER, CLOSER, DQ, MARKUP, DASH, JOINER) = range(18)


def _classes() -> np.ndarray:
    t = np.zeros(0x30000, np.uint8)
    for c in range(0x3000):
        ch, cat = chr(c), unicodedata.category(chr(c))
        if ch.isspace():
            t[c] = SPACE
        elif cat == "Ll":
            t[c] = LOWER
        elif cat in ("Lu", "Lt"):
            t[c] = UPPER
        elif cat == "Nd":
            t[c] = DIGIT
        elif cat == "Pd":
            t[c] = DASH
        elif cat in ("Lo", "Lm"):
            t[c] = UPPER
    t[0xE00:0xE80] = np.where(t[0xE00:0xE80] == DIGIT, DIGIT, THAI)
    t[0x2E80:0x3000] = t[0x3021:0x30FF] = t[0x3400:0xA000] = t[0xF900:0xFB00] = t[0x20000:] = DENSE
    t[[0x3005, 0x3006, 0x3007]] = DENSE
    t[0x3000] = SPACE
    t[0xAC00:0xD7B0] = UPPER
    t[0xFF10:0xFF1A], t[0xFF21:0xFF3B], t[0xFF41:0xFF5B], t[0xFF66:0xFFA0] = DIGIT, UPPER, LOWER, DENSE
    for c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85  ":
        t[ord(c)] = NL
    for k, chars in ((DOT, "."), (HARD, "!?"), (FULL, "。！？｡।॥؟۔"), (ELL, "…"), (DQ, '"'), (OPENER, "¿¡《〈‘" + "".join(OPEN) + BRACKETS[0]), (CLOSER, "》〉" + "".join(CLOSE) + BRACKETS[1]), (JOINER, ",;:，；：、"), (MARKUP, "<#*")):
        for c in chars:
            t[ord(c)] = k
    return t


CLASS = _classes()
_QUOTES = ("none", "dq", "low", "high", "angle", "corner", "white")


def _compile() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Symbols, transition table and output table of the transducer. State: open quotation, open bracket, mark pending before a closer.

    A closing quote comes in three readings: what follows may begin a sentence (ok), goes on (no), or is one more closer (chain).
    """
    names = ["other", "space", "nl", "split", "pend", "low", "angle<", "corner<", "white<", "("]
    names += [f"{c}{v}" for c in ('"', "high", "angle>", "corner>", "white>", ")", "both") for v in (":ok", ":no", ":chain")]
    sym = {n: i for i, n in enumerate(names)}
    states = [(q, b, p) for q in _QUOTES for b in (0, 1) for p in (0, 1)]
    at = {s: i for i, s in enumerate(states)}
    move, out = np.zeros((len(names), len(states)), np.uint8), np.zeros((len(names), len(states)), bool)
    for (q, b, p), i in at.items():
        for n, k in sym.items():
            new, end = (q, b, 0), False
            base, _, follow = n.partition(":")
            closes = {'"': "dq", "high": "low", "both": "high", "angle>": "angle", "corner>": "corner", "white>": "white"}.get(base)
            if n == "nl":
                new = ("none", 0, 0)
            elif n == "space":
                new = (q, b, p)
            elif n == "split":
                end = q == "none" and not b
            elif n == "pend":
                new = (q, b, 1)
            elif n in ("low", "angle<", "corner<", "white<"):
                new = (n.rstrip("<") if q == "none" else q, b, 0)
            elif n == "(":
                new = (q, 1, 0)
            elif base == ")" or closes:
                stray = False
                if base == ")":
                    new = (q, 0, p)
                elif q == closes:
                    new = ("none", b, p)
                elif base == '"' and q == "none" and not p:
                    new = ("dq", b, 0)
                elif base == "high" and q == "none":
                    new = ("high", b, 0)
                else:
                    new, stray = (q, b, p), True
                opened = new[0] != "none" and q == "none"
                if not opened and p and new[0] == "none" and not new[1] and follow == "ok":
                    new, end = ("none", 0, 0), True
                elif follow != "chain" and not opened:
                    new = (*new[:2], 0)
                del stray
            move[k, i], out[k, i] = at[new], end
    return sym, move, out


SYM, MOVE, OUT = _compile()
_LIST = re.compile(r"[ \t　]*(?:[-*•·‣◦–—]|\(?\d{1,3}[.)]|[a-zA-Z]\)|[（(]?[一二三四五六七八九十]{1,3}[、)）])[ \t　]")
CHUNK = 512


def _words(texts: list[str]) -> set[int]:
    return {hash_word(codepoints(w)) for w in texts}


def hash_word(cp: np.ndarray) -> int:
    h = 0
    for c in cp:
        h = (h * 1_000_003 + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def symbols(stream: str) -> np.ndarray:
    """Transducer symbol of every character of a stream."""
    cp = codepoints(stream)
    n = len(cp)
    k = CLASS[np.minimum(cp, len(CLASS) - 1)] if n else np.zeros(0, np.uint8)
    k = np.where(cp >= 0x30000, DENSE, k).astype(np.uint8) if (cp >= 0x30000).any() else k
    k[(cp >= 0x1F000) & (cp < 0x20000)] = OTHER
    s = np.full(n, SYM["other"], np.uint8)
    s[k == SPACE], s[k == NL] = SYM["space"], SYM["nl"]
    if not n:
        return s
    pos = np.arange(n)
    blank = k == SPACE
    after = np.minimum.accumulate(np.where(blank, n, pos)[::-1])[::-1]  # next non-space from here on, inclusive
    nxt = np.append(after[1:], n)
    kx = np.append(k, NL)  # class at n is a line end

    term = (k >= DOT) & (k <= ELL)
    last = np.flatnonzero(term & ~np.append(term[1:], False))
    first = np.flatnonzero(term & ~np.concatenate([[False], term[:-1]]))
    size = last - first + 1
    total = lambda m: np.add.reduceat(m.astype(np.int32), first) if len(first) else np.zeros(0, int)  # a run may not overlap the next: gaps hold no marks
    full, hard = total(k == FULL) > 0, total(k == HARD) > 0
    ell = ~full & ~hard & ((size >= 3) | (total(k == ELL) > 0))
    dot = ~full & ~hard & ~ell
    x = nxt[last]
    kn, k2 = kx[x], kx[np.minimum(x + 1, n)]
    near = x == last + 1
    prev = kx[np.maximum(first - 1, 0)]
    prev[first == 0] = NL
    begins = (kn == UPPER) & ((k2 == LOWER) | (k2 == SPACE) | (k2 == DOT) | (k2 == UPPER))
    camel = (kn == LOWER) & (k2 == UPPER)
    lower = (kn == LOWER) & ~camel
    split = np.zeros(len(last), bool)
    split |= full
    split |= hard & np.where(near, begins & (k2 != UPPER) | (kn == DENSE) | (kn == THAI), True)
    split |= ell & np.where(near, begins, ~lower) & ~(near & (kn == DENSE)) & (kn != DASH) & (kn != JOINER)
    far_ok = (kn == UPPER) | (kn == DIGIT) | (kn == DENSE) | (kn == THAI) | (kn == OPENER) | (kn == DQ) | camel | (kn == OTHER) | (kn == MARKUP) | (kn == NL)
    cand = np.flatnonzero(dot)
    ok = np.where(near, begins & (k2 != UPPER) & ((prev == LOWER) | (prev == DIGIT)), far_ok)[cand] & True
    for j in np.flatnonzero(ok):
        i = cand[j]
        f = int(first[i])
        a = f
        while a > 0 and f - a < 24 and kx[a - 1] in (LOWER, UPPER, DIGIT, DOT, OTHER) and cp[a - 1] not in (40, 91):
            a -= 1
        word = stream[a:f]
        if not word:
            continue
        low, kk = word.lower(), int(kn[i])
        end = re.split(r"(?<=[^\W\d_]{2})[.]|-", low)[-1]
        if low in _NEVER or end in _NEVER:
            ok[j] = False
        elif kk == DIGIT and low in _NUMBERED:
            ok[j] = False
        elif len(word) == 1 and word.isalpha() and not near[i]:
            # an initial, or a part of a spaced abbreviation; "a. m." / "p. m." may close a sentence
            ok[j] = word == "m" and kk != DIGIT
        elif re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
            ok[j] = low in ("a.m", "p.m") and kk != LOWER
        elif word.isdigit() and kk == UPPER and len(word) < 3:
            e = int(x[i])
            m = re.match(r"[^\W\d_]+", stream[e : e + 12])
            ok[j] = not (m and m.group().lower() in _MONTHS)
    split[cand] = ok
    closing = (kn == CLOSER) & (near | (cp[np.minimum(x, n - 1)] == 0xBB)) | (kn == DQ) & near
    real = full | hard | ell | (dot & (prev != DOT))
    s[last[split & ~closing]] = SYM["split"]
    s[last[closing & real]] = SYM["pend"]

    # closers and quotes with what follows them
    def put(where: np.ndarray, name: str) -> None:
        y = nxt[where]
        ky, k3 = kx[y], kx[np.minimum(y + 1, n)]
        adj = y == where + 1
        chain = adj & ((ky == CLOSER) | (ky == DQ))
        good = (ky == NL) | (ky == UPPER) | (ky == DIGIT) | (ky == OPENER) | ((ky == DQ) & ~adj) | ((ky == LOWER) & (k3 == UPPER)) | (ky == MARKUP) | ((ky == THAI) & ~adj)
        s[where] = np.where(chain, SYM[name + ":chain"], np.where(good, SYM[name + ":ok"], SYM[name + ":no"]))

    put(np.flatnonzero(k == DQ), '"')
    quote = np.flatnonzero((k == OPENER) | (k == CLOSER))
    qc = cp[quote]
    for ch, name in OPEN.items():
        w = quote[qc == ord(ch)]
        if name == "high":
            put(w, "high")
        else:
            s[w] = SYM[name if name == "low" else name + "<"]
    for ch, name in CLOSE.items():
        put(quote[qc == ord(ch)], "both" if name == "high" else name + ">")
    for ch in BRACKETS[0]:
        w = quote[qc == ord(ch)]
        before = cp[np.maximum(w - 1, 0)]
        s[w[(w == 0) | ((before != 58) & (before != 59))]] = SYM["("]
    for ch in BRACKETS[1]:
        put(quote[qc == ord(ch)], ")")

    # Thai: a final particle before a space ends a sentence
    thai = np.flatnonzero((k == THAI) & np.append(blank[1:], False))
    for i in thai:
        if stream[max(0, i - 3) : i + 1].endswith(_THAI) and kx[nxt[i]] != NL:
            s[i] = SYM["split"]

    # list items are units: nothing inside their line splits
    edge = np.concatenate([[-1], np.flatnonzero(k == NL)])
    head = edge[:-1] + 1 if k[-1] == NL else edge + 1
    tail = np.append(edge[1:], n)[: len(head)]
    ok = head < tail
    for a, z in zip(head[ok], tail[ok]):
        if kx[a] not in (LOWER, UPPER, DENSE, THAI, HARD, DQ) and _LIST.match(stream, a, z):
            line = s[a:z]
            line[(line == SYM["split"]) | (line == SYM["pend"])] = SYM["other"]
    return s


_NEVER, _NUMBERED, _MONTHS, _THAI = set(NEVER_END), set(BEFORE_NUMBER), set(MONTHS), tuple(THAI_FINAL)


def run(s: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a sentence ends with each position: chunks as functions of the entry state, composed by a prefix scan."""
    n = len(s)
    if not n:
        return np.zeros(0, bool)
    lanes = -(-n // chunk)
    grid = np.full(lanes * chunk, SYM["nl"], np.uint8)
    grid[:n] = s
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    states = MOVE.shape[1]
    flat = MOVE.ravel()
    f = np.broadcast_to(np.arange(states, dtype=np.uint8), (lanes, states)).copy()
    for row in grid:
        f = flat[row.astype(np.int32)[:, None] * states + f]
    step = 1
    while step < lanes:  # inclusive scan: f[i] becomes the composition of all chunks up to i
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        f, step = g, step * 2
    at = np.concatenate([[0], f[:-1, 0]]).astype(np.uint8)
    ends = np.zeros((chunk, lanes), bool)
    oflat = OUT.ravel()
    for i, row in enumerate(grid):
        cell = row.astype(np.int32) * states + at
        ends[i], at = oflat[cell], flat[cell]
    return ends.T.ravel()[:n]


def spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of every sentence, in order."""
    stream = "\n".join(texts) + "\n"
    cp = codepoints(stream)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.concatenate([[0], np.cumsum(lens)])
    s = symbols(stream)
    solid = (s != SYM["space"]) & (s != SYM["nl"])
    cut = run(s) | (s == SYM["nl"])
    stop = np.flatnonzero(cut) + 1
    start = np.concatenate([[0], stop[:-1]])
    where = np.flatnonzero(solid)
    if not len(where):
        return (np.zeros(0, np.int64),) * 3
    a, z = np.searchsorted(where, start), np.searchsorted(where, stop)
    keep = a < z
    left, right = where[a[keep]], where[z[keep] - 1] + 1
    doc = np.searchsorted(base, left, "right") - 1
    del cp
    return doc, left - base[doc], right - base[doc]


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start_pos, end_pos of every sentence, in code points, end exclusive.

    Null, empty and blank texts give no row; repeated rows give repeated sentences; texts of any length are split whole; other columns
    of df are ignored; an empty table gives no row.
    """
    ship()
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["id"].to_numpy(), list(b["text"])
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 2_000_000 or i == len(texts) - 1:
                    d, a, z = spans(texts[at : i + 1])
                    yield pd.DataFrame({"id": ids[at : i + 1][d], "start_pos": a, "end_pos": z})
                    at, size = i + 1, 0

    return spread(rows).mapInPandas(task, f"id {rows.schema['id'].dataType.simpleString()}, start_pos long, end_pos long")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


if __name__ == "__main__":
    for _d, _a, _z in zip(*spans([sys.stdin.read()])):
        print(_a, _z)
