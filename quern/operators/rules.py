"""Timelines, quantities and stances that single sentences state, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR = r"((?:20|21)[0-9]{2})"
DECADE = r"(?i)\b(?:(early|mid|late)[ -](?:the )?)?((?:20|21)[0-9]0)s\b"
SPAN = rf"(?i)\b(?:between|from)? ?{YEAR} ?(?:and|to|-|–) ?{YEAR}\b"
MEDIAN = rf"(?i)\bmedian\b[^.]*?\b{YEAR}\b"
AHEAD = r"(?i)\b(?:within|in|over)(?: the next)? ([0-9]{1,3})(?: ?(?:-|–|to) ?([0-9]{1,3}))? years\b"
DATED = rf"(?i)\b(?:by|before|in) {YEAR}\b"
#: Sentences that state a chance belong to the probability rules.
CHANCE = r"[0-9] ?%|(?i)\b[0-9]+ (?:in|out of) [0-9]+\b|\bpercent\b"
PAST = r"(?i)\b(?:ago|was|were|had been|used to)\b"


def timeline(sentence: Column) -> Column:
    """struct(form, low, high, unit) of the first rule that holds: decade, span, median, years ahead, dated; else null."""

    def value(form: str, low: Column, high: Column, unit: str) -> Column:
        return F.struct(F.lit(form).alias("form"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(unit).alias("unit"))

    part = lambda pattern, i: F.regexp_extract(sentence, pattern, i)
    number = lambda pattern, i: part(pattern, i).try_cast("int")
    third, decade = F.lower(part(DECADE, 1)), number(DECADE, 2)
    first = F.when(third == "mid", 4).when(third == "late", 7).otherwise(0)
    last = F.when(third == "early", 3).when(third == "mid", 6).otherwise(9)
    a, b = number(SPAN, 1), number(SPAN, 2)
    near, far = number(AHEAD, 1), F.coalesce(number(AHEAD, 2), number(AHEAD, 1))
    found = (
        F.when(sentence.rlike(DECADE), value("range", decade + first, decade + last, "year"))
        .when(sentence.rlike(SPAN) & (a <= b), value("range", a, b, "year"))
        .when(sentence.rlike(MEDIAN), value("point", number(MEDIAN, 1), number(MEDIAN, 1), "year"))
        .when(sentence.rlike(AHEAD) & ~sentence.rlike(PAST) & (near <= far), F.when(near == far, value("point", near, far, "years_ahead")).otherwise(value("range", near, far, "years_ahead")))
        .when(sentence.rlike(DATED), value("point", number(DATED, 1), number(DATED, 1), "year"))
    )
    return F.when(~sentence.rlike(CHANCE), found)


#: Words that scale a number (fixed values).
SCALES = {"hundred": 1e2, "thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def quantity(sentence: Column, units: list[str]) -> Column:
    """struct(value, unit) of the first number before one of ``units``, scale words applied; else null."""
    pattern = rf"(?i)(?<![0-9.,])([0-9][0-9,]*(?:\.[0-9]+)?)(?: ({'|'.join(SCALES)}))? ({'|'.join(units)})\b"
    number = F.regexp_replace(F.regexp_extract(sentence, pattern, 1), ",", "").try_cast("double")
    word, scale = F.lower(F.regexp_extract(sentence, pattern, 2)), F.lit(1.0)
    for name, factor in SCALES.items():
        scale = F.when(word == name, factor).otherwise(scale)
    return F.when(sentence.rlike(pattern), F.struct((number * scale).alias("value"), F.lower(F.regexp_extract(sentence, pattern, 3)).alias("unit")))


def stance(sentence: Column, cues: list[tuple[str, str]]) -> Column:
    """The label of the first pattern of ``cues`` that a sentence in the first person fits; else null."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(cues):
        out = F.when(sentence.rlike(pattern), label).otherwise(out)
    return F.when(sentence.rlike(r"(?i)\b(?:i|my|we|our)\b"), out)
