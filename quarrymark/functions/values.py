"""Typed values: amounts, durations, clock times, ages, measures, counts; temporal cues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymark.functions.text import TENS, UNITS

# Patterns of the value kinds.
_NUM = r"\d+(?:[.,]\d+)?"
_CUR = r"(?:euros?|eur|€|dollars?|usd|\$|pounds?|gbp|£)"
AMOUNT = rf"(?i)(?:({_NUM})\s*{_CUR}|{_CUR}\s*({_NUM}))"
DURATION = rf"(?i)({_NUM})\s*(?:working\s+|business\s+|calendar\s+)?(seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b"
CLOCK = r"(?i)\b(\d{1,2})[:.](\d{2})\s*(am|pm)?\b|\b(\d{1,2})\s*(am|pm)\b"
AGE = rf"(?i)\b({_NUM})\s+years?\s+old\b|\b(?:at least|under|over|older than|younger than)\s+({_NUM})\b"
MEASURE = (
    rf"(?i)\b({_NUM})\s*(millimet(?:re|er)s?|mm|centimet(?:re|er)s?|cm|met(?:re|er)s?|kilomet(?:re|er)s?|"
    r"km|grams?|kg|kilograms?|litres?|liters?|percent|%)"
)
COUNT = rf"\b({_NUM})\b"
_WORDS = "|".join([*UNITS, *TENS, "hundred", "thousand", "dozen"])
_SAID = rf"(?:{_NUM}|{_WORDS})"

# Units by what they measure; every name also stands in the plural.
TIME_UNITS = "second|minute|hour|day|week|fortnight|month|year"
MONEY = "euro|dollar|pound|cent|rupee|eur|usd|gbp|inr"
SIZES = "mm|cm|km|kg|inch|foot|feet|mile|gram|kilogram|lit(?:re|er)|(?:milli|centi|kilo)?met(?:re|er)"
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


@dataclass(frozen=True)
class Kind:
    """How a kind of value is found and written: groups that may hold its number, the group of its unit, or a fixed unit."""

    pattern: str
    numbers: tuple[int, ...] = (1,)
    unit_group: int | None = None
    unit: str | None = None
    short: Callable[[Column], Column] = F.lower


KINDS: dict[str, Kind] = {
    "amount": Kind(AMOUNT, (1, 2), unit="cur"),
    "duration": Kind(DURATION, unit_group=2, short=lambda u: F.rtrim(F.lower(u), F.lit("s"))),
    "time": Kind(CLOCK, (1, 4)),
    "age": Kind(AGE, (1, 2), unit="y"),
    "measure": Kind(MEASURE, unit_group=2, short=lambda u: F.left(F.lower(u), F.lit(2))),
    "count": Kind(COUNT),
}

# A text states a value of a kind when this occurs in it.
PRESENCE = {
    "duration": rf"(?i)\b(?:{_SAID}|an?)\s+(?:\w+ing\s+|calendar\s+|business\s+)?(?:{TIME_UNITS})s?\b",
    "amount": rf"(?i)[€$£₹]\s*\d|\d\s*(?:%|[€$£₹]|percent\b|(?:{MONEY})s?\b)|\bfree of charge\b|\bno charge\b",
    "count": rf"(?i)\b(?:{_SAID})\b",
    "frequency": rf"(?i)\b(?:once|twice|per|each|every)\b|\b(?:hour|dai|week|month|year|annual)ly\b|\b{_SAID}\s+times\b",
    "time": rf"(?i)\b(?:{'|'.join(MONTHS + DAYS)}|noon|midnight|\d{{1,2}}:\d{{2}}|\d{{1,2}}\s*[ap]m|(?:1[89]|20)\d{{2}})\b",
    "age": rf"(?i)\b{_SAID}\s+years?\s+old\b|\b(?:older|younger)\s+than\s+{_SAID}\b|\bage(?:d)?\s+{_SAID}\b",
    "measure": rf"(?i)\b\d+(?:[.,]\d+)?\s*(?:{SIZES})s?\b",
}

# Spelled units and their signs; endings in -re and -er, and plurals, are one unit.
UNIT_SIGNS = {
    "meter": "m", "millimeter": "mm", "centimeter": "cm", "kilometer": "km", "gram": "g", "kilogram": "kg", "liter": "l",
    "milliliter": "ml", "second": "s", "minute": "min", "hour": "h", "percent": "%",
}


def plain(number: Column) -> Column:
    """Decimal point, no trailing `.0`."""
    return F.regexp_replace(F.translate(number, ",", "."), r"\.0$", "")


def _clock(found: Column) -> Column:
    """24-hour time of a match with hour, minutes and half of the day."""
    hour, half = found["number"].cast("int"), F.lower(found["half"])
    of_day = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    minutes = F.when(found["minutes"] == "", "00").otherwise(found["minutes"])
    return F.concat_ws(":", F.lpad(of_day.cast("string"), 2, "0"), minutes)


def typed_values(text: Column, kind: str) -> Column:
    """Distinct values of one kind as "number unit", in order of appearance."""
    k = KINDS[kind]
    group = lambda g: F.regexp_extract_all(text, F.lit(k.pattern), F.lit(g))
    # of alternative groups only one takes part in a match, the others are empty
    merged = lambda gs: reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), map(group, gs))  # noqa: E731, E501
    if kind == "time":
        found = F.arrays_zip(
            merged(k.numbers).alias("number"), F.transform(group(2), lambda m: F.coalesce(m, F.lit(""))).alias("minutes"), merged((3, 5)).alias("half")
        )
        return F.array_distinct(F.transform(found, _clock))
    numbers = F.transform(merged(k.numbers), plain)
    if k.unit_group is not None:
        numbers = F.zip_with(numbers, group(k.unit_group), lambda n, u: F.concat_ws(" ", n, k.short(u)))
    elif k.unit is not None:
        numbers = F.transform(numbers, lambda n: F.concat_ws(" ", n, F.lit(k.unit)))
    return F.array_distinct(numbers)


def has_value(text: Column, kind: str) -> Column:
    return text.rlike(PRESENCE[kind])


def counts_noun(text: Column, noun: Column) -> Column:
    """A number followed within three words by the noun."""
    spans = F.regexp_extract_all(F.lower(text), F.lit(COUNTED), 1)
    return F.exists(spans, lambda s: F.array_contains(F.split(F.trim(s), r"\s+"), F.lower(noun)))


# A number in digits or words, and up to three words after it.
COUNTED = rf"\b(?:\d+(?:[.,]\d+)?|{_WORDS})\b((?:\s+[\p{{L}}\p{{N}}_-]+){{1,3}})"


def unit_sign(unit: Column) -> Column:
    """Sign of a spelled unit; anything else keeps its singular."""
    single = F.regexp_replace(F.regexp_replace(F.lower(unit), r"(?<=..)s$", ""), r"(met|lit)re$", "$1er")
    signs = F.create_map(*[F.lit(x) for pair in UNIT_SIGNS.items() for x in pair])
    return F.coalesce(F.try_element_at(signs, single), single)


def temporal_cue(text: Column) -> Column:
    """(kind, valid_at, valid_to): ISO date, else month and year, else year, else words for now and for the past."""
    low = F.lower(text)
    iso = F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1)
    month_rx = r"\b(" + "|".join(MONTHS) + r") (\d{4})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(low, month_rx, 1))
    month_start = F.make_date(F.regexp_extract(low, month_rx, 2).try_cast("int"), month.cast("int"), F.lit(1))
    year = F.regexp_extract(low, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")

    def cue(kind: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.cast("string").alias("valid_at"), end.cast("string").alias("valid_to"))

    none = F.lit(None)
    return (
        F.when(iso.try_cast("date").isNotNull(), cue("date", iso, iso))
        .when(low.rlike(month_rx), cue("month", month_start, F.last_day(month_start)))
        .when(year.isNotNull(), cue("year", F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))))
        .when(low.rlike(r"\b(?:currently|now|today|at present|nowadays)\b"), cue("current", none, none))
        .when(low.rlike(r"\b(?:previously|formerly|used to|in the past|before)\b"), cue("past", none, none))
        .otherwise(cue("none", none, none))
    )
