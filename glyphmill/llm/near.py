"""Near-copies by multi-index hashing over symbol fingerprints.

A text becomes a fingerprint of SEGMENTS x WIDTH symbols: its word and character grams are hashed into as many bins and each bin
keeps its smallest hash. The Hamming distance of two fingerprints is the number of symbols in which they differ. Each segment has
tables that leave out one of its symbols in turn: they enumerate the ball of radius 1 around the segment with a wildcard, so texts meet
where a segment differs in one symbol at most, and every pair at a distance under 2 x SEGMENTS is found. The complete distance of the
pairs that meet is taken in the same join, and the wording of those within it is compared exactly, as sets of hashed grams.

A fingerprint depends on its text alone, so tables of earlier batches stay valid. Buckets of boilerplate grow with the collection: one of
over LIMIT texts is parted by every further symbol, again and again. Pairs within the distance share that many symbols, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import codepoints, level_many, materialise, release, sweep

SEGMENTS, WIDTH = 5, 3
SYMBOLS = SEGMENTS * WIDTH
BALLS = [(g * WIDTH + i, g * WIDTH + j) for g in range(SEGMENTS) for i in range(WIDTH) for j in range(i + 1, WIDTH)]  # a segment without one symbol
LIMIT = 1000  # texts of a bucket that are compared at once; larger ones are parted by a further symbol
SPLITS = 3  # how often: pairs within the distance have at least 2 + SPLITS symbols in common, empty ones included
BLOCK = 512  # members compared at once in a bucket that is large still
SHARE = 0.33  # share of the filled symbols that have to agree: the complete distance
SIGN = ["sign", "more"]  # the fingerprint in eight bits a symbol, four of each in either column; 0 in sign is an empty bin
BITS = ["b0", "b1", "b2", "b3"]  # the wording as a bitmap of 256 bits, which bounds what two texts can have in common
SIMILAR = 0.45
LONG = 24
SLICE = 100_000  # code points that a task levels and hashes at once; each takes some eighty bytes while it does

_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PAD = 12


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Polynomial hashes of all stretches of levelled texts, which are joined with padding between them."""

    def __init__(self, texts: list[str]):
        self.cp = codepoints((" " * _PAD).join(texts) + " " * _PAD)
        n = len(self.cp)
        self.doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + _PAD)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _B)]), dtype=np.uint64)
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BI)]), dtype=np.uint64)
        self.pre = np.concatenate([[np.uint64(0)], np.cumsum(self.cp.astype(np.uint64) * power[:-1], dtype=np.uint64)])
        blank = self.cp == 32
        self.start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        self.end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        cp = self.cp
        self.dense = ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0x0E00) & (cp <= 0x0E7F)) | (cp >= 0x20000)
        self.hangul = (cp >= 0xAC00) & (cp <= 0xD7AF)

    def at(self, i: np.ndarray, k) -> np.ndarray:
        return mix((self.pre[i + k] - self.pre[i]) * self.inverse[i] + np.asarray(k).astype(np.uint64))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every gram of the fingerprint: five characters in scripts without spaces, else about two words."""
        first = self.start
        parts = [(np.flatnonzero(self.dense), 5), (first[self.hangul[first]], 6), (first[~self.hangul[first] & ~self.dense[first]], 12)]
        return self.doc[np.concatenate([i for i, _ in parts])], np.concatenate([self.at(i, k) for i, k in parts])

    def wording(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the grams of the exact comparison: word pairs, and three characters in scripts without spaces; sorted, distinct."""
        s, e = self.start, self.end
        h = self.at(s, e - s)
        doc = self.doc[s]
        after = np.append(np.where(doc[1:] == doc[:-1], h[1:], np.uint64(0)), np.uint64(0)) if len(s) else h
        dense = self.dense[s] & ~self.hangul[s]
        pair = mix(h + mix(after + np.uint64(1)))[~dense]
        n = np.maximum(1, (e - s)[dense] - 2)
        own = np.repeat(np.arange(len(n)), n)
        i = s[dense][own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        three = self.at(i, np.minimum(3, e[dense][own] - i))
        d, h = np.concatenate([doc[~dense], doc[dense][own]]), (np.concatenate([pair, three]) >> np.uint64(32)).astype(np.int64)
        both = np.unique(d << 32 | h)
        return both >> 32, (both & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def cut(owner: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """values by owner 0 .. n - 1, which is in order."""
    at = np.searchsorted(owner, np.arange(n + 1))
    return [values[a:z] for a, z in zip(at[:-1], at[1:])]


def bins(d: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n texts: the smallest hash in each of SYMBOLS bins, 0 for an empty one."""
    slot = d * SYMBOLS + (h % np.uint64(SYMBOLS)).astype(np.int64)
    order = np.lexsort((h, slot))
    slot, h = slot[order], h[order]
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
    out = np.zeros(n * SYMBOLS, np.uint64)
    out[slot[first]] = np.maximum(h[first], np.uint64(1))
    return out.reshape(n, SYMBOLS)


def sketch(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of levelled texts the table keys (one for each ball with a filled symbol), the columns of SIGN and the hashed wording."""
    hashed = Hashed(texts)
    full = bins(*hashed.grams(), len(texts))
    balls = np.arange(len(BALLS), dtype=np.uint64)
    left, right = full[:, [i for i, _ in BALLS]], full[:, [j for _, j in BALLS]]
    key = (mix(mix(left + balls + np.uint64(1)) + right) & ~np.uint64(15) | balls).view(np.int64)
    there = (left | right) != 0
    keys = [k[t] for k, t in zip(key, there)]
    low = np.where(full != 0, (full >> np.uint64(40)) % np.uint64(15) + np.uint64(1), np.uint64(0))
    high = np.where(full != 0, (full >> np.uint64(32)) & np.uint64(15), np.uint64(0))
    at = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(4)
    sign = np.stack([(x << at).sum(1, dtype=np.uint64).view(np.int64) for x in (low, high)], 1)
    return keys, sign, cut(*hashed.wording(), len(texts))


def bitmaps(words: list[np.ndarray]) -> np.ndarray:
    """One row of 256 bits, as four longs, for each array of hashed grams."""
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    h = np.concatenate(words).view(np.uint32) >> np.uint32(8) if len(owner) else np.zeros(0, np.uint32)
    set_ = np.zeros((len(words), 256), np.uint8)
    set_[owner, h & np.uint32(255)] = 1
    return np.packbits(set_, axis=1, bitorder="little").view(np.int64)


def slices(texts: list[str]) -> Iterator[list[str]]:
    """texts in order, in stretches of at most SLICE code points; a longer text is one of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def sketched(rows: DataFrame, extra: str = "", long_only: bool = False) -> DataFrame:
    """id, class (64-bit hash of the levelled text) and extra columns of every row of rows(id, text, ...), and keys, SIGN, size, BITS and words.

    These are null where the class came before in the same batch of rows, so a text that a third of all rows hold is sketched once
    a batch; with long_only, class too is null for a null text. The text itself moves no further.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            has = np.flatnonzero(b["text"].notna()) if long_only else np.arange(len(b))
            t = [x for part in slices([x or "" for x in b["text"].iloc[has]]) for x in level_many(part)]
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in t], np.uint64).view(np.int64)
            _, first = np.unique(h, return_index=True)
            keys, signs_, words = [], [np.zeros((0, 2), np.int64)], []
            for part in slices([t[i] for i in first]):
                for all_, some in zip((keys, words), (got := sketch(part))[::2]):
                    all_.extend(some)
                signs_.append(got[1])
            sign = np.concatenate(signs_)
            at = has[first]
            whole, *signs = (pd.Series(pd.NA, range(len(b)), "Int64") for _ in range(3))
            whole.iloc[has] = h
            for i, x in enumerate(signs):
                x.iloc[at] = sign[:, i]
            more = {"size": np.fromiter(map(len, words), np.int64, len(words)), **dict(zip(BITS, bitmaps(words).T))} if len(first) else {}
            for c, v in more.items():
                more[c] = pd.Series(pd.NA, range(len(b)), "Int64")
                more[c].iloc[at] = v
            lists = {"keys": np.full(len(b), None, object), "words": np.full(len(b), None, object)}
            for i, k, w in zip(at, keys, words):
                lists["keys"][i], lists["words"][i] = k, w
            rest = {c: b[c].reset_index(drop=True) for c in b.columns if c not in ("id", "text")}
            yield pd.DataFrame({"id": b["id"].reset_index(drop=True), "class": whole, **rest, "keys": lists["keys"], **dict(zip(SIGN, signs)), **{c: more.get(c) for c in ("size", *BITS)}, "words": lists["words"]})

    return rows.mapInPandas(task, f"id {rows.schema['id'].dataType.simpleString()}, class long{extra}, keys array<long>, {', '.join(f'{c} long' for c in (*SIGN, 'size', *BITS))}, words array<int>")


def filled(x: Column) -> Column:
    """Number of the symbols of x that are not 0."""
    low = F.lit(int("7" * SYMBOLS, 16))
    return F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(F.lit(int("8" * SYMBOLS, 16))))


def alike(a: str, b: str) -> Column:
    """Whether enough symbols of two fingerprints agree: the complete distance, up to chance hits of eight bits."""
    x, y = ([F.col(f"{side}.{c}") for c in SIGN] for side in (a, b))
    either, differ = filled(x[0].bitwiseOR(y[0])), filled(x[0].bitwiseXOR(y[0]).bitwiseOR(x[1].bitwiseXOR(y[1])))
    return either - differ >= either * SHARE


def keyed_of(classes: DataFrame) -> DataFrame:
    """key, class, SIGN, fresh: the table rows of sketches; a class may repeat."""
    return classes.filter("keys is not null").select(F.explode("keys").alias("key"), "class", *SIGN, F.lit(True).alias("fresh"))


def meeting(keyed: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(a < b: pairs of classes of keyed(key, class, SIGN, fresh) that meet within the distance, rows of buckets large to the end, the tables
    that the pairs are read from: to be released after).

    The pairs grow faster than the texts. They move once, as one set of b for each a and task, to where the bitmaps of a lie.
    keyed is partitioned by key (repartitioned, or the scan of a bucketed table), so nothing here moves by key again. At least one of a
    pair is fresh. All members of a bucket of up to limit classes meet; a larger one is parted by every further symbol, SPLITS times.
    """
    size = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bool_or("fresh").alias("any")).filter("n > 1 and any")
    size = materialise(size.select("key", "n"), "size")
    done = [size]
    of = lambda keys: keyed.join(keys.select("key").hint("shuffle_hash"), "key")  # noqa: E731  a set of keys is hashed, the table itself is not sorted
    some, large = of(size.filter(F.col("n") <= limit)), size.filter(F.col("n") > limit)
    pairs = _within(some, some, "key")
    rows = None
    if not large.isEmpty():
        rows = of(large).groupBy("key", "class", *SIGN).agg(F.max("fresh").alias("fresh"))  # repeats of a class leave here
        rows = materialise(rows.withColumn("part", F.col("key")).withColumn("last", F.lit(-1)), "large")
        for level in range(SPLITS + 1):
            n = rows.groupBy("part").agg(F.count("*").alias("n"), F.bool_or("fresh").alias("any")).filter("n > 1 and any").drop("any")
            sized = materialise(rows.join(n, "part"), "sized")
            release(rows)
            small, again = sized.filter(F.col("n") <= limit), sized.filter(F.col("n") > limit)
            pairs = pairs.unionByName(_within(small, small, "part"))
            rows = again
            if level == SPLITS or again.isEmpty():
                rows.written_at = sized.written_at
                break
            done.append(sized)
            at = F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))).alias("at")
            free = again.select("key", "class", *SIGN, "fresh", "part", "last", at).filter(F.col("at") > F.col("last"))
            ball = F.element_at(F.array(*[F.lit((1 << i) | (1 << j)) for i, j in BALLS]), (F.col("key").bitwiseAND(F.lit(15)) + 1).cast("int"))
            free = free.filter(ball.bitwiseAND(F.expr("shiftleft(1, at)")) == 0)
            symbol = [F.expr(f"shiftright({c}, 4 * at) & 15") for c in SIGN]
            rows = free.select("key", "class", *SIGN, "fresh", F.xxhash64("part", "at", *symbol).alias("part"), F.col("at").alias("last"))
            rows = materialise(rows, "parts")
    pairs = pairs.groupBy("a").agg(F.collect_set("b").alias("b")).select("a", F.explode("b").alias("b"))
    return pairs, rows, done


def _within(x: DataFrame, y: DataFrame, by: str) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), F.expr(f"x.{by} = y.{by} and x.class < y.class and (x.fresh or y.fresh)") & alike("x", "y"))
    return met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def hub_pairs(hot: DataFrame) -> DataFrame:
    """a < b: every member of the parts of hot with the smallest class of its part, within the distance."""
    side = F.struct("class", *SIGN, "fresh")
    ends = hot.groupBy("part").agg(F.min(side).alias("y"))
    met = hot.join(ends, "part").select(side.alias("x"), "y").filter(F.expr("x.class != y.class and (x.fresh or y.fresh)") & alike("x", "y"))
    return met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()


def rest_pairs(hot: DataFrame, comp: DataFrame) -> DataFrame:
    """a < b: the pairs of hot parts within the distance that may join two components of comp(class, comp).

    In each part the members outside its largest component are compared with all members, in salted blocks, so no pair that could join
    two components is left out and one component of any size costs nothing.
    """
    rows = hot.select("part", "class", *SIGN, "fresh").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    per = rows.groupBy("part", "comp").agg(F.count("*").alias("c")).groupBy("part")
    per = per.agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest")).filter("rest > 0")
    rows = materialise(rows.join(per, "part"), "hot")
    blocks, salts = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("n") / (8 * BLOCK)).cast("int")
    own = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    x = rows.filter("comp != top").select("part", "class", *SIGN, "fresh", "comp", "top", own(blocks, 1).alias("block"), every(salts).alias("salt"))
    y = rows.select("part", "class", *SIGN, "fresh", "comp", own(salts, 2).alias("salt"), every(blocks).alias("block"))
    apart = F.expr("x.part = y.part and x.block = y.block and x.salt = y.salt and x.comp != y.comp and (y.comp = x.top or x.class < y.class) and (x.fresh or y.fresh)")
    met = x.alias("x").join(y.alias("y"), apart & alike("x", "y"))
    pairs = materialise(met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct(), "pairs")
    release(rows)
    return pairs


Decision = Callable[[Column, Column, Column], Column]


def similar(jaccard: Column, containment: Column, ratio: Column) -> Column:
    return jaccard >= SIMILAR


def verified(pairs: DataFrame, texts: DataFrame, decide: Decision) -> DataFrame:
    """a, b: pairs whose wording passes decide(jaccard, containment, ratio of the sizes), which rises with what they have in common.

    texts: class, size, BITS, words; one row for each class. Most pairs fail by the bound that their bitmaps set; only the others fetch
    the wording itself, which is compared exactly.
    """

    def passes(n: Column) -> Column:
        x, y = F.col("sa").cast("double"), F.col("sb").cast("double")
        some = lambda c: F.greatest(F.lit(1.0), c)
        return decide(n / some(x + y - n), n / some(F.least(x, y)), F.least(x, y) / some(F.greatest(x, y)))

    total = lambda cols: reduce(lambda p, q: p + q, map(F.bit_count, cols))
    side = lambda c, cols: texts.select(F.col("class").alias(c), *[F.col(x).alias(f"{x[0] if x in ('size', 'words') else x}{c}") for x in cols])
    both = pairs.join(side("a", ["size", *BITS]), "a").join(side("b", ["size", *BITS]), "b")
    a, b = ([F.col(f"{x}{c}") for x in BITS] for c in "ab")
    common = total([p.bitwiseAND(q) for p, q in zip(a, b)]) + F.least(F.col("sa") - total(a), F.col("sb") - total(b))
    both = bounded = materialise(both.filter(passes(F.least(common, "sa", "sb").cast("double"))).select("a", "b", "sa", "sb"), "bounded")
    sweep(both.sparkSession)
    short = F.col("sa") <= F.col("sb")  # the shorter wording moves to the longer
    a, b = F.when(short, F.col("a")).otherwise(F.col("b")), F.when(short, F.col("b")).otherwise(F.col("a"))
    both = both.select(a.alias("a"), b.alias("b"), F.least("sa", "sb").alias("sa"), F.greatest("sa", "sb").alias("sb"))
    ends = both.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    texts = texts.join(ends.hint("shuffle_hash"), "class", "left_semi")
    both = both.join(side("a", ["words"]), "a").join(side("b", ["words"]), "b")
    got = materialise(both.filter(passes(F.size(F.array_intersect("wa", "wb")).cast("double"))).select("a", "b"), "links")
    release(bounded)
    return got


def linked(keyed: DataFrame, texts: DataFrame, decide: Decision, comps=None, limit: int = LIMIT) -> DataFrame:
    """a, b: links between classes of keyed (see meeting) whose wording passes decide.

    Where buckets stay large to the end, their members meet a hub first, and what the links so far leave apart is compared in full;
    comps(links) gives the components under those links.
    """
    pairs, hot, read = meeting(keyed, limit)
    links = verified(pairs, texts, decide)
    for df in read:
        release(df)
    if hot is not None and not hot.isEmpty():
        links = joined(links, verified(hub_pairs(hot), texts, decide))
        pairs = rest_pairs(hot, (comps or components)(links))
        links = joined(links, verified(pairs, texts, decide))
        release(pairs)
    if hot is not None:
        release(hot)
    return links


def joined(links: DataFrame, more: DataFrame) -> DataFrame:
    """The links of both tables; the tables themselves are removed."""
    every = materialise(links.unionByName(more).distinct(), "links")
    release(links)
    release(more)
    return every


def components(links: DataFrame) -> DataFrame:
    """class, comp (smallest class reached): union-find by hooking to the smallest neighbour and shortcutting, as joins, until it settles."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = materialise(both, "both")
    label = materialise(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "class"), "label")
    while True:
        near = links.join(label.select(F.col("class").alias("b"), "comp"), "b").select(F.col("a").alias("class"), "comp")
        hook = near.unionByName(label).groupBy("class").agg(F.min("comp").alias("comp"))
        jump = hook.join(label.select(F.col("class").alias("comp"), F.col("comp").alias("up")), "comp", "left")
        new = materialise(jump.select("class", F.coalesce(F.least("up", "comp"), F.col("comp")).alias("comp")), "label")
        moved = not new.join(label.withColumnRenamed("comp", "was"), "class").filter("comp != was").isEmpty()
        release(label)
        label = new
        if not moved:
            release(links)
            return label


def near_groups(rows: DataFrame, decide: Decision = similar, limit: int = LIMIT) -> DataFrame:
    """id, class, comp of every row of rows(id, text): rows of one comp are copies of one text."""
    found = materialise(sketched(rows), "sketches")
    keyed = keyed_of(found).repartition("key")
    texts = found.filter("words is not null").select("class", "size", *BITS, "words").dropDuplicates(["class"])
    comp = components(linked(keyed, texts, decide, limit=limit))
    return found.select("id", "class").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
