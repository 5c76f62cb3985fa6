"""Problem 7: encoding of all texts with a public tokenizer, by tree concatenation.

Long texts are cut into pieces that are encoded apart, in parallel, and joined in pairs. At each join only a window is encoded anew:
first the pre-tokens around it, from one that the left part has settled on to one where both scans agree; a pre-token that runs on
across the join is encoded in a window of tokens that grows until its first and last token agree with those of the two parts. A token
list of a byte-pair encoding is the right one if every two neighbours are, so agreement on one token at each side makes the join exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, ship, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PIECE = 2048  # code points; longer texts are cut into pieces of this size
LOOK = 3  # the pattern looks at most so far beyond a pre-token


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, {v: k for k, v in ranks.items()}


_SCAN = regex.compile(PATTERN)


@dataclass
class Part:
    """The encoding of text[start:end]: tokens, and the starts of the pre-tokens as scanned from start to end alone."""

    start: int
    end: int
    tokens: list[int]
    marks: list[int]


def encode_part(text: str, start: int, end: int, path: str) -> Part:
    own, _ = encoding(path)
    piece = text[start:end]
    return Part(start, end, own.encode_ordinary(piece), [start + m.start() for m in _SCAN.finditer(piece)])


def _single(own, data: bytes) -> list[int]:
    return own._core_bpe.encode_single_piece(data)


def _tail(tokens: list[int], size: int, names: dict[int, bytes]) -> int:
    """Index of the first of the last tokens that together hold size bytes."""
    i = len(tokens)
    while size > 0:
        i -= 1
        size -= len(names[tokens[i]])
    assert size == 0, "a pre-token starts inside a token"
    return i


def _head(tokens: list[int], size: int, names: dict[int, bytes]) -> int:
    i = 0
    while size > 0:
        size -= len(names[tokens[i]])
        i += 1
    assert size == 0, "a pre-token starts inside a token"
    return i


def _across(own, names: dict[int, bytes], left: list[int], right: list[int], grow: int = 8) -> list[int]:
    """Encoding of one pre-token from those of its two halves: a window around the join grows until both sides agree."""
    while True:
        i, j = max(0, len(left) - grow), min(len(right), grow)
        window = _single(own, b"".join(names[t] for t in left[i:] + right[:j]))
        if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
            return left[:i] + window + right[j:]
        grow *= 2


def join(text: str, a: Part, b: Part, path: str) -> Part:
    """The encoding of text[a.start:b.end], equal to encoding it at once."""
    own, names = encoding(path)
    if not a.marks or not b.marks:
        return encode_part(text, a.start, b.end, path)
    k = len(a.marks) - 1
    while k > 0 and a.marks[k] + LOOK > a.end:
        k -= 1
    p = a.marks[k]  # the pre-tokens before p are settled: what the pattern saw of them lies within a
    spans, right = [], 0
    for m in _SCAN.finditer(text, p, b.end):
        while right < len(b.marks) and b.marks[right] < m.start():
            right += 1
        if m.start() >= b.start and right < len(b.marks) and b.marks[right] == m.start():
            break
        spans.append(m.span())
    else:
        right = len(b.marks)
    q = b.marks[right] if right < len(b.marks) else b.end
    i = _tail(a.tokens, len(text[p : a.end].encode()), names)
    j = _head(b.tokens, len(text[b.start : q].encode()), names)
    mid: list[int] = []
    for s, e in spans:
        if s < a.end < e and s == a.marks[-1] and right <= 1 and e == q and s >= p:
            ai = _tail(a.tokens, len(text[s : a.end].encode()), names)
            mid += _across(own, names, a.tokens[ai:], b.tokens[:j])
        else:
            mid += _single(own, text[s:e].encode())
    return Part(a.start, b.end, a.tokens[:i] + mid + b.tokens[j:], a.marks[:k] + [s for s, _ in spans] + b.marks[right:])


def join_all(text: str, parts: list[Part], path: str) -> Part:
    while len(parts) > 1:
        parts = [join(text, *parts[i : i + 2], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode(text: str | None, path: str = TOKENIZER, piece: int = PIECE) -> list[int]:
    """Token ids of a text, [] for null and empty; text that looks like a special token is ordinary text."""
    if not text:
        return []
    if len(text) <= piece:
        return encoding(path)[0].encode_ordinary(text)
    return join_all(text, [encode_part(text, i, min(i + piece, len(text)), path) for i in range(0, len(text), piece)], path).tokens


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, piece: int = PIECE) -> DataFrame:
    """id, ids: one row for each row of df.

    Null and empty texts get an empty list; texts of any length are encoded whole, those over piece code points in pieces spread over
    the cluster; repeated rows give repeated results; other columns of df are ignored; an empty table gives no row.
    """
    ship()
    kind = df.schema[key].dataType.simpleString()
    rows = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text")))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, _ = encoding(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "ids": [own.encode_ordinary(t or "") for t in b["text"]]})

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [encode_part(t, 0, len(t), path) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "copy": b["copy"], "no": b["no"], "text": b["text"], "ids": [p.tokens for p in parts], "marks": [p.marks for p in parts]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("no")
        done, at = [], 0
        for t, ids, marks in zip(g["text"], g["ids"], g["marks"]):
            done.append(Part(at, at + len(t), list(map(int, ids)), [at + int(m) for m in marks]))
            at += len(t)
        return pd.DataFrame({"id": g["id"].iloc[:1], "ids": [join_all("".join(g["text"]), done, path).tokens]})

    size = F.char_length("text")
    short = rows.filter(F.coalesce(size, F.lit(0)) <= piece).mapInPandas(whole, f"id {kind}, ids array<int>")
    long = rows.filter(size > piece).withColumn("copy", F.monotonically_increasing_id())
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / piece)), lambda i: F.substring(F.col("text"), (i * piece + 1).cast("int"), F.lit(piece)))
    cut = long.select("id", "copy", F.posexplode(cut).alias("no", "text")).repartition("copy", "no")
    coded = cut.mapInPandas(pieces, f"id {kind}, copy long, no int, text string, ids array<int>, marks array<int>")
    return short.unionByName(coded.groupBy("copy").applyInPandas(merge, f"id {kind}, ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "ids")
