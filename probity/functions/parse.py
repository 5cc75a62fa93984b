"""Parsing of scraped values: markup, compact numbers, dates, label pages."""
from __future__ import annotations

import html
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from probity import const

# Fixed patterns of the page formats.
BR = r"(?iU)<\s*br\s*/?\s*>"
TAG = r"<[^>]+>"
IMAGE = r'(?i)<img[^>]+src="(https?://[^"]+)"'
VIDEO = r'(?i)<a[^>]+href="(/video[-\d_]+)"'
OUTLINK = r'(?i)<a[^>]+href="(https?://[^"]+)"[^>]*rel="[^"]*\bnofollow\b[^"]*"'
HREF = r'href="([^"]*)"'
PLAIN_URL = r"https?://[^\s)]+"
HASHTAG = r"(?<![\p{L}\p{N}_])#([\p{L}\p{N}_]{2,})"
MENTION = r"(?<![\p{L}\p{N}_])@([A-Za-z0-9_.]{2,})"


@F.pandas_udf(StringType())
def unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded; there is no built-in for all of them."""
    for s in parts:
        yield s.map(lambda x: None if x is None else html.unescape(x))


def strip_tags(t: Column, entities: bool = True) -> Column:
    """Breaks become newlines, tags go, references are decoded, blanks and newlines squeezed."""
    s = let(t, lambda x: F.when(F.contains(x, F.lit("<")), F.regexp_replace(F.regexp_replace(x, BR, "\n"), TAG, "")).otherwise(x))
    if entities:
        s = F.coalesce(unescape(F.when(F.contains(s, F.lit("&")), s)), s)

    def squeezed(x: Column) -> Column:
        x = F.regexp_replace(x, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
        return let(x, lambda y: trim(F.when(F.contains(y, F.lit("\n\n\n")), F.regexp_replace(y, r"\n{3,}", "\n\n")).otherwise(y)))

    return let(s, squeezed)


def trim(t: Column) -> Column:
    """Without white space of any kind at its ends, ASCII separators included. Most texts begin and end with a
    printed ASCII character, so the pattern, which tries every position, isn't run over them."""
    ends = lambda x: F.ascii(F.left(x, F.lit(1))).between(33, 126) & F.ascii(F.right(x, F.lit(1))).between(33, 126)
    return let(t, lambda x: F.when(ends(x), x).otherwise(F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")))


def tags_to_spaces(t: Column) -> Column:
    return F.regexp_replace(t, TAG, " ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that stands once in the plan, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


@lru_cache(maxsize=1)
def _digits() -> tuple[str, str]:
    """All decimal digits of Unicode beside ASCII's, and what they mean."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(t: Column) -> Column:
    """Decimal digits of any script become 0-9."""
    return let(t, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, *_digits())).otherwise(x))


def compact_decimal(t: Column) -> Column:
    """'1.2K' -> 1200, '1.5' -> 1 as decimal(38,0); blanks (U+0020) and commas are dropped. What is no number
    with an optional suffix k or m counts by its digits; none: 0. Digits of any script count. Numbers of that
    form go through a double, so beyond 2^53 they are the nearest one; null from 2^124 on, and where the digits
    of other texts are more than 38."""
    form = r"^(\d+(?:\.\d+)?)([kKmM]?)$"

    def value(s: Column) -> Column:
        suffix = F.lower(F.regexp_extract(s, form, 2))
        scaled = F.regexp_extract(s, form, 1).try_cast("double") * F.when(suffix == "k", 1000).when(suffix == "m", 1000000).otherwise(1)
        digits = F.regexp_replace(s, r"[^0-9]", "")
        other = F.when(digits == "", F.lit(0).cast("decimal(38,0)")).otherwise(digits.try_cast("decimal(38,0)"))
        return F.when(s.rlike(form), let(scaled, whole)).otherwise(other)

    def whole(x: Column) -> Column:
        # a double's whole part in two halves, both exact
        high = F.floor(F.when(x < 2.0**124, x) / 2.0**62)
        low = F.floor(x - high * F.lit(2.0**62))
        return (high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("decimal(38,0)")

    return let(ascii_digits(F.translate(trim(F.coalesce(t, F.lit(""))), " ,", "")), value)


def compact_number(t: Column) -> Column:
    """compact_decimal as a 64-bit integer; null where it is larger."""
    return compact_decimal(t).try_cast("long")


def features_in_text(t: Column) -> Column:
    """struct(hashtags, mentions, urls) of a text."""
    return F.struct(F.regexp_extract_all(t, F.lit(HASHTAG), F.lit(1)).alias("hashtags"), F.regexp_extract_all(t, F.lit(MENTION), F.lit(1)).alias("mentions"), F.regexp_extract_all(t, F.lit(PLAIN_URL), F.lit(0)).alias("urls"))


def attachments(t: Column) -> Column:
    return F.struct(F.regexp_extract_all(t, F.lit(IMAGE), F.lit(1)).alias("images"), F.regexp_extract_all(t, F.lit(VIDEO), F.lit(1)).alias("videos"), F.regexp_extract_all(t, F.lit(OUTLINK), F.lit(1)).alias("outlinks"))


@F.arrow_udf(StringType())
def _joined_data(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """JSON as its reader takes it: NaN and repeated keys are allowed, the last of a key counts."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            found = "".join(s for s in json.loads(t).get("data", []) if isinstance(s, str))
        except (ValueError, TypeError, RecursionError):
            return t
        return found.encode("utf-8", "replace").decode()

    for texts in parts:
        yield pa.array([one(t) for t in texts.to_pylist()], pa.string())


def unwrap_ajax(t: Column) -> Column:
    """The joined strings of a JSON object's `data`: the string items of an array, the keys of an object, a
    string itself, nothing without `data`. What is no JSON object, or has a null, number or truth value as
    `data`, comes back as it is, trimmed."""
    s = trim(F.coalesce(t, F.lit("")))
    return F.when(s.startswith("{"), _joined_data(F.when(s.startswith("{"), s))).otherwise(s)


def json_array_after(t: Column, key: str) -> Column:
    """The JSON array that follows the first match of the pattern `key`, up to the bracket that closes it; null
    without one. Brackets inside strings don't count, nor do escaped quotes end a string.

    Each escape becomes two plain characters, so a string is what stands between two quotes; strings, brackets
    and the rest in between are the tokens over which the depth is counted, until it is 0."""

    def tokens(tail: Column) -> Column:
        plain = F.regexp_replace(tail, r"(?s)\\.", "\x01\x01")
        return F.regexp_extract_all(plain, F.lit(r'"[^"]*(?:"|\z)|[\[\]]|[^"\[\]]+'), F.lit(0))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        at = a["at"] + F.length(x)
        return F.when(a["end"] > 0, a).otherwise(F.struct(depth.alias("depth"), at.alias("at"), F.when((depth == 0) & (x == "]"), at).otherwise(0).alias("end")))

    def closed(tail: Column) -> Column:
        return let(F.aggregate(tokens(tail), start, step, lambda a: a["end"]), lambda end: F.when(end > 0, F.substring(tail, F.lit(1), end)))

    return let(F.regexp_extract(t, f"(?s)(?:{key})(\\[.*)", 1), lambda tail: F.when(tail != "", closed(tail)))


def last_of_each(pairs: Column, key: str, value: str) -> Column:
    """A map of an array of structs: the last struct of a key counts; null keys are left out."""
    known = F.transform(pairs, lambda p, i: F.struct(p[key].alias("k"), i.alias("i"), p[value].alias("v")))
    by_key = F.array_sort(F.filter(known, lambda p: p["k"].isNotNull()))

    def last(rows: Column) -> Column:
        return F.filter(rows, lambda p, i: F.coalesce(p["k"] != F.get(rows, i + 1)["k"], F.lit(True)))

    return F.map_from_entries(F.transform(let(by_key, last), lambda p: F.struct(p["k"], p["v"])))


# The spelled numbers.
_NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


def relative_date(t: Column, now: Column, zone: str = "Europe/Moscow") -> Column:
    """Epoch seconds of a date text seen at `now` (epoch seconds): 'd mon yyyy [at h:mm am]', 'd mon [at ...]',
    and, whatever follows, 'today/yesterday at ...' and 'N hours/minutes ago' (digits or one to ten). A date
    without a year lies in now's year, or the year before where that were more than a day ahead. Unknown
    months count as January; what fits no form or no calendar is 0. Nothing depends on the session's zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("SECOND", now, epoch))
    full = r"(?U)^(\d{1,2})\s+([a-z]{3,5})[a-z]*(?:\s+(\d{4}))?(?:\s+at\s+(\d{1,2}):(\d{2})\s*(am|pm)?)?$"
    near = r"(?U)^(yesterday|today)\s+at\s+(\d{1,2}):(\d{2})\s*(am|pm)?"
    ago = r"(?U)^(\d+|" + "|".join(_NUMBERS) + r")\s+(hour|minute)s?\s+ago"

    def groups(s: Column, pattern: str, n: int) -> Column:
        # of a text that the whole pattern has matched: one match for all groups
        return F.split(F.regexp_replace(s, pattern, "\x01".join(f"${i}" for i in range(1, n + 1))), "\x01")

    def number(s: Column) -> Column:
        return F.when(s != "", s).try_cast("int")  # a cast of an empty text raises and catches an error, which takes longer than all the rest

    def seconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, half: Column) -> Column:
        hour = F.coalesce(number(hour), F.lit(0))
        hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        wall = F.try_make_timestamp_ntz(year, month, day, hour, F.coalesce(number(minute), F.lit(0)), F.lit(0))
        return F.timestamp_diff("SECOND", epoch, F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))

    def dated(g: Column) -> Column:
        month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, const.MONTHS)), F.substring(g[1], 1, 3)), F.lit(0)), F.lit(1)).cast("int")
        in_year = lambda y: seconds(y, month, g[0].try_cast("int"), g[3], g[4], g[5])
        this = let(in_year(F.year(local)), lambda x: F.when(x - now > 86400, in_year(F.year(local) - 1)).otherwise(x))
        return F.when(g[2] != "", in_year(g[2].try_cast("int"))).otherwise(this)

    def close(g: Column) -> Column:
        day = F.date_sub(F.to_date(local), F.when(g[0] == "yesterday", 1).otherwise(0))
        return seconds(F.year(day), F.month(day), F.day(day), g[1], g[2], g[3])

    def since(g: Column) -> Column:
        spelled = F.array_position(F.array(*map(F.lit, _NUMBERS)), g[0])
        n = F.coalesce(F.when(g[0].rlike(r"(?U)^\d"), g[0]).try_cast("long"), F.nullif(spelled, F.lit(0)))
        return now - n * F.when(g[1] == "hour", 3600).otherwise(60)

    def found(s: Column) -> Column:
        rest = r"[\s\S]*"
        return F.when(s.rlike(full), let(groups(s, full, 6), dated)).when(s.rlike(near), let(groups(s, near + rest, 4), close)).when(s.rlike(ago), let(groups(s, ago + rest, 2), since))

    return F.coalesce(let(F.lower(trim(F.coalesce(t, F.lit("")))), found), F.lit(0)).cast("long")


def day_first_date(t: Column) -> Column:
    """d.m.Y, d.m.y, d-m-Y or d/m/Y to a date, else null. Two-digit years from 69 on are of 19xx."""
    s = F.trim(t)
    two = F.regexp_extract(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", 3)
    p = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})$"
    year = F.when(two != "", two.try_cast("int") + F.when(two.try_cast("int") >= 69, 1900).otherwise(2000)).otherwise(F.regexp_extract(s, p, 4).try_cast("int"))
    d = F.when(two != "", F.regexp_extract(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", 1)).otherwise(F.regexp_extract(s, p, 1))
    m = F.when(two != "", F.regexp_extract(s, r"^(\d{1,2})\.(\d{1,2})\.(\d{2})$", 2)).otherwise(F.regexp_extract(s, p, 3))
    return F.to_date(F.try_make_timestamp(year, m.try_cast("int"), d.try_cast("int"), F.lit(0), F.lit(0), F.lit(0)))


def bot_label(page: Column) -> Column:
    """1, 0 or null from a label page."""
    text = F.lower(F.trim(F.regexp_replace(F.regexp_replace(tags_to_spaces(unescape(page)), " ", " "), r"\s+", " ")))
    card = F.contains(page, F.lit("/card/")) & (F.contains(text, F.lit("карточк")) | F.contains(text, F.lit("бот")))
    return F.when(card | text.rlike(r"получить\s+карточку\s+бота"), 1).when(text.rlike(r"этот\s+аккаунт\s+не\s+помечен\s+как\s+бот"), 0)


def registration_date(page: Column) -> Column:
    return day_first_date(F.regexp_extract(tags_to_spaces(page), r"[Рр]егистрация[^\d]*(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})", 1))
