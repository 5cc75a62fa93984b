"""URL filters: rules by host and path, and a weighted vocabulary for what no rule fits.

A rule fits its host and all subdomains where the path starts with the rule's path; the longest one wins. The
rules are a table that may be of any size: each URL's host suffixes are joined with the rules' hosts and the
lengths of their paths, and the path's beginnings of these lengths with the rules themselves.

Other URLs are judged by an Aho-Corasick automaton over strict and soft terms, in host and path, whose
neighbours are neither letters nor digits: one strict term or SEVERAL distinct soft ones block.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probity.llm.common import fresh, sized, stage

STRICT = ("adult", "casino", "escorts", "hentai", "malware", "nsfw", "phishing", "porn", "porno", "sex", "slots", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "affiliate", "bet", "bets", "betting", "bonus", "cheap", "cialis", "click", "coupon", "crack", "deals", "doorway", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "lottery", "pharmacy", "pills", "poker", "popup", "replica", "seo", "spam", "tracker", "track", "win", "winner")
#: Distinct soft terms that block.
SEVERAL = 2
#: The vocabulary goes to every task; a larger one is an error.
VOCABULARY_BYTES = 64 << 20


def host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    h = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def counter(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
    """A function of a text column: struct(strict, soft), the distinct terms found, in order of the alphabet."""
    if sum(len(x) for x in (*strict, *soft)) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of over {VOCABULARY_BYTES} characters")
    weighed = {w.lower(): False for w in soft if w} | {w.lower(): True for w in strict if w}

    @F.arrow_udf("struct<strict:array<string>,soft:array<string>>")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = ahocorasick.Automaton()
        for w, hard in weighed.items():
            machine.add_word(w, (w, hard))
        machine.make_automaton()
        for texts in parts:
            both = []
            for text in texts.to_pylist():
                hits: tuple[set, set] = (set(), set())
                low = (text or "").lower()
                for end, (w, hard) in machine.iter(low) if weighed else ():
                    start = end - len(w) + 1
                    if not (start and low[start - 1].isalnum()) and not low[end + 1 : end + 2].isalnum():
                        hits[hard].add(w)
                both.append({"strict": sorted(hits[True]), "soft": sorted(hits[False])})
            yield pa.array(both, pa.struct([("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string()))]))

    return found


def longest_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places(host, path), distinct, with rule and rule_verdict of the longest rule that fits; others are left out.

    Of equally long rules the one of the longer host wins, of one rule with both verdicts block. The path's
    beginnings are cut to the lengths that a rule's host has, so a host of many rules stays one step."""
    low = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = stage(rules.where("host is not null and path is not null").select(low.alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct())
    labels = known.agg(F.max(F.size(F.split("r_host", r"\.", -1)))).first()[0] or 0  # beyond, no suffix is a rule's
    parts = F.split("host", r"\.", -1)
    starts = F.sequence(F.greatest(F.lit(1), F.size("_l") - labels + 1), F.size("_l"))
    tails = F.transform(starts, lambda i: F.array_join(F.slice("_l", i, F.size("_l")), "."))
    cut = places.withColumn("_l", parts).select("host", "path", F.explode_outer(tails).alias("r_host"))
    lengths = known.select("r_host", F.length("r_path").alias("len")).distinct()
    cut = cut.join(sized(lengths, 128), "r_host").where(F.length("path") >= F.col("len")).select("host", "path", "r_host", F.expr("substring(path, 1, len)").alias("r_path"))
    fit = cut.join(sized(known, 256), ["r_host", "r_path"])
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), "verdict", F.concat("r_host", "r_path").alias("rule"))
    return fit.groupBy("host", "path").agg(F.max(rank).alias("_b")).select("host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, several: int = SEVERAL) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that decides, else null), strict, soft (the terms
    found) and verdict: allow or block.

    rules(host, path, verdict): rows with a null host or path fit nothing. A null URL, or one without ://, has an
    empty host and path, no term and no rule: allow. Repeated rows each get their verdict; an empty table gives
    none; columns of pages named like a result are replaced."""
    names = ["host", "path", "rule", "strict", "soft", "verdict"]
    keep = [c for c in pages.columns if c.lower() not in names or c == url]
    hits = fresh(pages, "_hits")
    src = pages.select(*[pages[c] for c in keep], host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    fit = longest_rules(src.select("host", "path").distinct(), rules)
    found = counter(strict, soft)(F.concat("host", "path"))
    out = src.withColumn(hits, found).join(fit, ["host", "path"], "left")
    own = F.when((F.size(F.col(hits)["strict"]) > 0) | (F.size(F.col(hits)["soft"]) >= several), "block").otherwise("allow")
    return out.select(*keep, "host", "path", "rule", F.col(hits)["strict"].alias("strict"), F.col(hits)["soft"].alias("soft"), F.coalesce("rule_verdict", own).alias("verdict"))
