"""Text measures of one string column. Null and empty texts give 0 unless said otherwise."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from probity import const


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def words(t: Column) -> Column:
    """The lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(const.WORD), F.lit(0))


def count(t: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(pattern)), F.lit(0))


def letters(t: Column) -> Column:
    """How many letters a text has. What else it holds is dropped by runs, since regexp_count makes a string of each match."""
    return F.coalesce(F.length(F.regexp_replace(t, r"\P{L}+", "")), F.lit(0))


def lexical_diversity(ws: Column) -> Column:
    """Distinct words over words; fewer than two words: 0."""
    return F.when(F.size(ws) >= 2, F.size(F.array_distinct(ws)) / F.size(ws)).otherwise(F.lit(0.0))


def avg_word_length(ws: Column) -> Column:
    return ratio(F.length(F.array_join(ws, "")), F.size(ws))


def caps_share(t: Column) -> Column:
    return ratio(count(t, r"\p{Lu}"), letters(t))


def emoji_density(t: Column) -> Column:
    """Runs of emoji over characters."""
    return ratio(count(t, const.EMOJI), F.length(t))


def punctuation_share(t: Column) -> Column:
    return ratio(count(t, const.PUNCTUATION), F.length(t))


def repeated_runs(t: Column) -> Column:
    return count(t, const.REPEATS)


def urls(t: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(const.URL), F.lit(0))


def _any(u: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(u, F.lit(n))
    return out


def url_patterns(t: Column) -> Column:
    """struct(short_urls, suspicious_domains, total_urls); a URL counts once in each."""
    u = urls(t)
    return F.struct(
        F.size(F.filter(u, lambda x: _any(x, const.SHORTENERS))).alias("short_urls"),
        F.size(F.filter(u, lambda x: _any(x, const.SUSPICIOUS_TLDS))).alias("suspicious_domains"),
        F.size(u).alias("total_urls"),
    )


def keywords_present(t: Column, keywords: list[str] = const.SPAM_KEYWORDS) -> Column:
    """How many of the keywords the lower-cased text holds; presence, not occurrences."""
    low = F.lower(F.coalesce(t, F.lit("")))
    out = F.lit(0)
    for k in keywords:
        out = out + F.contains(low, F.lit(k)).cast("int")
    return out


def strip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def first_word(t: Column) -> Column:
    """The first token, lower-cased; '' for a blank text."""
    return F.lower(F.element_at(F.split(strip(F.coalesce(t, F.lit(""))), r"(?U)\s+"), 1))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"[.!?]+"), strip), lambda x: x != "")


def script_share(t: Column) -> Column:
    """Cyrillic letters over Cyrillic and Latin letters; null for null or blank, 0 without letters."""
    c, a = count(t, "[а-яёА-ЯЁ]"), count(t, "[a-zA-Z]")
    return F.when(t.isNull() | (strip(t) == ""), F.lit(None).cast("double")).otherwise(ratio(c, c + a))


@F.arrow_udf(DoubleType())
def _entropy(texts: pa.Array) -> pa.Array:
    """Entropy of each text's characters, some 256 thousand characters at a time."""
    items, out, at = texts.to_pylist(), [], 0
    while at < len(items):
        to, size = at, 0
        while to < len(items) and size < 1 << 18 and to - at < 1024:
            size += len(items[to] or "")
            to += 1
        part = [x or "" for x in items[at:to]]
        n = np.array([len(x) for x in part])
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        there = np.zeros(int(codes.max(initial=0)) + 1, bool)
        there[codes] = True
        place, kinds = np.cumsum(there) - 1, int(there.sum())
        cells = np.repeat(np.arange(len(part)), n) * kinds + place[codes]
        if len(part) * kinds <= 1 << 22:
            k = np.bincount(cells, minlength=len(part) * kinds).reshape(len(part), kinds)
            sums = (k * np.log2(np.maximum(k, 1))).sum(axis=1)
        else:
            found, k = np.unique(cells, return_counts=True)
            sums = np.bincount(found // kinds, weights=k * np.log2(k), minlength=len(part))
        some = np.maximum(n, 2)
        out.append(np.where(n > 1, np.maximum(0.0, np.log2(some) - sums / some), 0.0))
        at = to
    return pa.array(np.concatenate(out) if out else [], pa.float64())


def entropy(t: Column) -> Column:
    """Shannon entropy (log2) of the lower-cased characters; fewer than two, or null: 0."""
    return _entropy(F.lower(F.when(F.length(t) >= 2, t)))


def char_entropy(df: DataFrame, key: str, t: str) -> DataFrame:
    """(key, entropy) of each row; see entropy."""
    return df.select(key, entropy(F.col(t)).alias("entropy"))
