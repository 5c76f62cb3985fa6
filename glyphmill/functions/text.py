"""Text, hash and number functions as Column expressions; all stay inside whole-stage code generation unless marked Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

CJK = r"[㐀-鿿]"


def rnd(x: Column, n: int) -> Column:
    """Rounded through decimal, so that near ties agree between engines (T-3)."""
    return F.round(x.cast("decimal(18,6)"), n).cast("double")


def ratio(a: Column, b: Column, n: int = 4) -> Column:
    """a / b, 0 where b is 0 (F-37)."""
    return rnd(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), n)


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility form (Python: Spark has no built-in)."""
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def fingerprint_text(x: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, white space collapsed (F-3; Python)."""
    return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings (F-32; Python: levenshtein is another measure)."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def content_fingerprint(x: Column) -> Column:
    return F.sha2(fingerprint_text(x), 256)


def name_key(x: Column) -> Column:
    """Lower case without non-word characters (F-1)."""
    return F.regexp_replace(F.lower(x), r"(?U)[^\w]+", "")


def semantic_key(x: Column) -> Column:
    """Lower case, white space collapsed (F-7)."""
    return collapse(F.lower(x))


def tag_key(x: Column) -> Column:
    """Snake-case tag of a-z, 0-9 and CJK (F-6)."""
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9㐀-鿿]+", "_"), F.lit("_"))


def slug(x: Column, n: int = 48) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), F.lit("-")), 1, n)


def ascii_tokens(x: Column) -> Column:
    """Words of a-z and 0-9: what boundary-matched terms are counted in (F-9)."""
    return F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+")


@F.pandas_udf(StringType())
def normalise(x: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, white space collapsed, '' for null: what terms are matched in (F-4; Python)."""
    return x.map(lambda t: "" if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(StringType())
def word_form(x: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, runs of other characters than words to one blank, '' for null: what phrases are matched in (F-4; Python)."""
    return x.map(lambda t: "" if t is None else _NO_WORD.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())


_NO_WORD = re.compile(r"[^\w㐀-鿿]+")


def phrase_in(text: Column, phrase: Column) -> Column:
    """contains_phrase for a phrase that is a column; both in word form. An empty phrase is in nothing."""
    dense = F.contains(F.replace(text, F.lit(" "), F.lit("")), F.replace(phrase, F.lit(" "), F.lit("")))
    spaced = F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
    return (phrase != "") & F.when(phrase.rlike(CJK), dense).otherwise(spaced)


def is_word(term: str) -> bool:
    return term.isascii() and term.isalnum()


def term_count(text: Column, tokens: Column, terms: list[str]) -> Column:
    """Occurrences of terms in normalised text and its tokens (F-9): ASCII terms at boundaries, others as substrings."""
    words, rest = [t for t in terms if is_word(t)], [t for t in terms if not is_word(t)]
    n = term_hits(tokens, words).cast("bigint") if words else F.lit(0).cast("bigint")
    for t in rest:
        n = n + (F.regexp_count(text, F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])")).cast("bigint") if t.isascii() else substring_count(text, t))
    return n


def has_term(text: Column, tokens: Column, term: str) -> Column:
    if is_word(term):
        return F.array_contains(tokens, term)
    return text.rlike(rf"(?<![a-z0-9]){term}(?![a-z0-9])") if term.isascii() else F.contains(text, F.lit(term))


def first_position(text: Column, tokens: Column, terms: list[str]) -> Column:
    """Where the first of the terms that occur is found, from 1; null if none."""
    return F.array_min(F.array_compact(F.array(*[F.when(has_term(text, tokens, t), F.instr(text, t)) for t in terms])))


def term_hits(tokens: Column, terms: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda t: t.isin(terms)))


def substring_count(x: Column, term: str) -> Column:
    """Non-overlapping occurrences of a substring (F-10)."""
    x = F.coalesce(x, F.lit(""))
    return ((F.char_length(x) - F.char_length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("bigint")


def contains_phrase(text: Column, phrase: str) -> Column:
    """CJK phrases match without spaces, others as padded tokens (F-11)."""
    if any("㐀" <= c <= "鿿" for c in phrase):
        return F.contains(F.regexp_replace(text, r"\s+", ""), F.lit(phrase.replace(" ", "")))
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {phrase} "))


def sentences(x: Column) -> Column:
    """Rule-based sentence split used by the annotation operators (F-14)."""
    cut = F.split(x, r"(?<=[.!?。！？])\s*|\n+")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def html_text(x: Column) -> Column:
    """<br> to newline, tags dropped, basic entities decoded, lines collapsed and empty ones dropped (F-15)."""
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != ""), "\n")


def stable_id(prefix: str, *parts: Column, length: int = 20) -> Column:
    """Prefix and the first hex digits of the SHA-256 of the parts joined by ':' (F-30, P2)."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length))


def excerpt(x: Column, n: int) -> Column:
    return F.substring(collapse(x), 1, n)


def cell(x: Column, n: int) -> Column:
    """Table cell: collapsed, pipes escaped, cut with an ellipsis."""
    t = F.replace(collapse(x), F.lit("|"), F.lit("\\|"))
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


NULL_TOKENS = ["", "nan", "none", "null", "<na>"]


def nullify(x: Column) -> Column:
    """Textual null tokens to null (F-27)."""
    return F.when(F.lower(F.trim(x)).isin(NULL_TOKENS), None).otherwise(F.trim(x))


def lenient_bool(x: Column) -> Column:
    """true/1/yes, false/0/no, else null (F-18)."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def bucket(x: Column, *edges: float) -> Column:
    """How many of the rising edges x reaches (F-19)."""
    return sum(F.when(x >= e, 1).otherwise(0) for e in edges)


def has_cjk(x: Column) -> Column:
    return F.coalesce(x.rlike(CJK), F.lit(False))


def ordered_rank(x: Column, order: list[str]) -> Column:
    """Position of an enum value in its order, null if unknown (F-38)."""
    return F.when(F.array_position(F.array(*map(F.lit, order)), x) > 0, F.array_position(F.array(*map(F.lit, order)), x))


def alias_key(x: Column) -> Column:
    """Compatibility form, case-folded, without anything but letters and digits (F-2)."""
    return F.regexp_replace(normalise(x), r"(?U)[\W_]+", "")


def letter_bound_count(text: Column, term: str) -> Column:
    """Occurrences bounded by letters only, so that digits may adjoin (F-9b)."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?<![a-z]){term}(?![a-z])"))


def storage_amount(x: Column) -> Column:
    """Gigabytes that a requirements text asks for: a named amount, else one before 'available space' or 'storage' (F-16)."""
    t = F.lower(F.coalesce(x, F.lit("")))
    named, bare = r"(?:storage|hard drive|disk space)\s*:\s*(\d+(?:\.\d+)?)\s*(gb|mb|tb)", r"(\d+(?:\.\d+)?)\s*(gb|mb|tb)\s*(?:available space|storage)"
    pick = lambda n: F.coalesce(F.nullif(F.regexp_extract(t, named, n), F.lit("")), F.nullif(F.regexp_extract(t, bare, n), F.lit("")))
    return pick(1).cast("double") * F.when(pick(2) == "tb", 1024.0).when(pick(2) == "mb", 1 / 1024).otherwise(1.0)


def listed(x: Column) -> Column:
    """Comma-separated names without stars and blanks (F-17)."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(F.replace(t, F.lit("*"), F.lit("")))), lambda t: t != "")


def weight(x: Column) -> Column:
    """1 + log1p of a count, of which what is no number or negative counts as 0 (F-20)."""
    return 1 + F.log1p(F.greatest(F.lit(0.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def pseudonym(source: Column, author: Column) -> Column:
    """16 digits of the hash of source:author, null for a blank author."""
    a = F.trim(author)
    return F.when(F.length(a) > 0, F.substring(F.sha2(F.concat_ws(":", source, a), 256), 1, 16))


def utc_time(x: Column) -> Column:
    """ISO text or epoch seconds to a time; null where neither (F-25)."""
    return F.coalesce(F.timestamp_seconds(F.when(x.rlike(r"^\d{9,10}$"), x.try_cast("long"))), F.try_to_timestamp(x))


def percent(x: Column, n: int = 1) -> Column:
    return F.concat(F.format_number(100 * x, n), F.lit("%"))


# Hours named in Chinese.
HOURS = {"半": 0.5, "一": 1.0, "一个": 1.0, "两": 2.0, "二": 2.0, "三": 3.0, "四": 4.0}


def minutes(x: Column) -> Column:
    """Minutes that a text names, by hours in Chinese, then minutes, then hours in English; null if none (F-36)."""
    t = F.lower(F.coalesce(x, F.lit("")))
    get = lambda rx: F.nullif(F.regexp_extract(t, rx, 1), F.lit(""))
    zh, short, long = get(r"(\d+(?:\.\d+)?|半|一个|一|两|二|三|四)\s*(?:个)?小时"), get(r"(\d+)\s*(?:分钟|minutes?|mins?)"), get(r"(\d+(?:\.\d+)?)\s*(?:hours?|hrs?)")
    named = F.create_map(*[F.lit(v) for kv in HOURS.items() for v in kv])
    return F.coalesce(F.floor(60 * F.coalesce(named[zh], zh.try_cast("double"))), short.try_cast("bigint"), F.floor(60 * long.try_cast("double")))
