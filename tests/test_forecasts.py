"""Statements of probability: cases worked out by hand, and number spans against plain code."""

import random
import re

from pyspark.sql import functions as F

from quern.functions import arrays
from quern.functions import text as tx
from quern.operators import forecasts

#: text -> [(rule, outcome, kind, low, high, value_text, horizon)]
CASES = {
    "There is a 10 percent chance of human extinction by 2040.": [("sentence", "extinction", "point", 0.1, 0.1, "10 percent", "by 2040")],
    "My credence is 5-20% for catastrophic harm by 2035.": [("sentence", "catastrophe", "range", 0.05, 0.2, "5-20%", "by 2035")],
    "My credence is between 10 and 20 percent for catastrophic harm by 2035.": [("sentence", "catastrophe", "range", 0.1, 0.2, "10 and 20 percent", "by 2035")],
    "I think 10 people would be affected.": [],
    "The probability of extinction is 0.10 before 2050.": [("sentence", "extinction", "point", 0.1, 0.1, "0.10", "before 2050")],
    "The chance of extinction is 1 in 20.": [("sentence", "extinction", "point", 0.05, 0.05, "1 in 20", None)],
    "I give a 1/4 chance of a takeover within ten years.": [("sentence", "takeover", "point", 0.25, 0.25, "1/4 chance", "within ten years")],
    "My probability of AGI is 50% by 2030 and 80% by 2040.": [("sentence", "agi", "point", 0.5, 0.5, "50%", "by 2030"), ("sentence", "agi", "point", 0.8, 0.8, "80%", "by 2040")],
    "The probability of AGI is 50%.": [],  # an arrival needs a time near the number
    # signs, groups, ends of ranges that do not parse, values that are none
    "The chance of extinction is -5%.": [],
    "The chance of extinction is minus 5%.": [],
    "The chance of extinction is 1 000%.": [],
    "The chance of extinction is 150% to 20%.": [],
    "The chance of extinction is 20 to +30%.": [],
    "The chance of extinction is 3 in 2.": [],
    # two outcomes, a denial, a comparison
    "There is a 10% chance of extinction and a 30% chance of AGI by 2040.": [],
    "The chance of extinction is not 10%.": [],
    "There is a 10% chance of extinction compared with a pandemic.": [],
    # a condition and a cause are no outcomes
    "If we build AGI, the chance of extinction is 10% by 2100.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", "by 2100")],
    "There is a 10% chance of extinction from advanced AI takeover.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", None)],
    # a clause that names something else
    "There is a 10% chance of extinction and a 90% chance of rain.": [],
    "The chance is 10% for rain, and extinction is worse.": [],
    # of somebody else, or a question
    "Critics say the chance of extinction is 10%.": [],
    "Is the chance of extinction 10%?": [],
    # across sentences
    "Within ten years. I think the chance of extinction is 10%.": [("horizon_before", "extinction", "point", 0.1, 0.1, "10%", "within ten years")],
    "By 2040 much will change. The chance of extinction is 10%.": [("horizon_before", "extinction", "point", 0.1, 0.1, "10%", "by 2040")],
    "By 2040 a takeover may come. The chance of extinction is 10%.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", None)],
    "Will it be by 2040? The chance of extinction is 10%.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", None)],
    "Before 2040 the chance is 20%. The chance of extinction is 10%.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", None)],
    "I put the probability at 20%. By that I mean extinction by 2100.": [("that_means", "extinction", "point", 0.2, 0.2, "20%", "by 2100")],
    "I put the probability at 20%. That means extinction at 30%.": [],
    "I put the probability at 20%. It rains. That means extinction.": [],
    "The probability of AGI is hard to say. 30% probability by 2040.": [("list_item", "agi", "point", 0.3, 0.3, "30%", "by 2040")],
    "The probability of rain is hard to say. 30% probability by 2040.": [],
    "What about extinction this century? I'll give a probability of 15% for that.": [("for_that", "extinction", "point", 0.15, 0.15, "15%", None)],
    "What about rain? I'll give a probability of 15% for that.": [],
    "In 2050. <<<SPEAKER_GAP>>>The chance of extinction is 10%.": [("sentence", "extinction", "point", 0.1, 0.1, "10%", None)],
    "": [],
}
SHOWN = ["rule", "outcome", "kind", "low", "high", "value_text", "horizon"]


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in forecasts.statements(docs, "id", "text", **options).orderBy("id", "part", "index", "start", "value_text").collect():
        out[r.id].append(r)
    return out


def test_cases(spark):
    got = found(spark, [*CASES, None])
    shown = {t: [tuple(r[c] for c in SHOWN) for r in rows] for t, rows in zip([*CASES, None], got.values())}
    assert {t: shown[t] for t in CASES if shown[t] != CASES[t]} == {}
    assert shown[None] == []


def test_cases_within_long_texts_keep_their_places(spark):
    filler = "Nothing of note is said here. " * 800
    several = [t for t, rows in CASES.items() if rows and "GAP" not in t]
    texts = [f"{filler}\n\n{t}\n{filler}" for t in several]
    for text, case, rows in zip(texts, several, found(spark, texts).values()):
        assert [tuple(r[c] for c in SHOWN) for r in rows] == CASES[case]
        for r in rows:
            assert text[r.start : r.stop] == r.evidence


def test_many_numbers_are_kept_unless_a_bound_is_set(spark):
    text = "The chance of extinction is " + ", or ".join(f"{k}%" for k in range(1, 12)) + "."
    assert len(found(spark, [text])[0]) == 11
    assert found(spark, [text], most=6)[0] == []


def test_nearest_outcome_of_a_clause(spark):
    texts = {
        "There is a 10% chance of extinction and a 30% chance of takeover.": [("extinction", 0.1), ("takeover", 0.3)],
        "The odds of extinction are 10%, the odds of AGI 40%.": [("agi", 0.4), ("extinction", 0.1)],
        "Extinction 10% takeover is my probability.": [],  # as near to one as to the other
        "The probability of takeover or extinction is 10%.": [("extinction", 0.1)],
        "The probability is 10%, and extinction is worse.": [],
    }
    got = found(spark, list(texts), by_nearest=True)
    assert {t: sorted((r.outcome, r.low) for r in rows) for t, rows in zip(texts, got.values())} == texts


def plain_numbers(text):
    """(form, kind, text, start, stop): later forms give way to earlier ones."""
    taken = []
    for form, pattern in (("percent", forecasts.PERCENT), ("decimal", forecasts.DECIMAL), ("fraction", forecasts.FRACTION), ("one_in", forecasts.ONE_IN)):
        for m in re.finditer(pattern.replace("(?iU)", "(?i)"), text):
            if all(m.end() <= s or m.start() >= e for *_, s, e in taken):
                ranged = form in ("percent", "decimal") and m[3] is None
                taken.append((form, "range" if ranged else "point", m[0].strip(), m.start(), m.end()))
    return sorted(taken, key=lambda x: x[3])


def test_number_spans_against_plain_code(spark):
    rng = random.Random(7)
    words = ["10%", "5 percent", ".5%", "0.3", ".25", "1 in 20", "3 / 4 chance", "2/3 chance", "to", "and", "-", "–", "20%", "99.5 %", "1,000%", "+7%", "in", "12", "5-20%", "0.1-0.3", "0.9 to", "é", "1 in 5%", "7 in 10.5", "100 percentage", "a", "."]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    for r in df.select("t", forecasts.numbers(F.col("t")).alias("n")).collect():
        assert [(x.form, x.kind, x.text, x.start, x.stop) for x in r.n] == plain_numbers(r.t), r.t


def odd_texts(n=300):
    rnd = random.Random(5)
    return [(i, "".join(rnd.choice(["A", "b 5%", ".", "!", "?", " ", "  ", "\n", "\t", "\r\n", " ", " ", "’", "“", forecasts.GAP, "😀"]) for _ in range(rnd.randrange(25)))) for i in range(n)] + [(n, None), (n + 1, "")]


def test_sentences_wanted_keep_their_places_and_neighbours(spark):
    """Rows of the sentences wanted are those of all sentences, and only they are made."""
    docs = spark.createDataFrame(odd_texts(), "id int, text string")
    every = forecasts.sentences_of(docs, "id", "text")
    wanted = forecasts.sentences_of(docs, "id", "text", lambda c: c.rlike("[0-9]"))
    assert sorted(map(str, wanted.collect())) == sorted(map(str, every.where(F.col("sentence").rlike("[0-9]")).collect())) != []
    texts = {i: (t or "").translate(str.maketrans("’‘“”", "''\"\"")) for i, t in odd_texts()}
    for r in every.collect():
        t = texts[r.id]
        assert t[r.start : r.stop] == r.sentence
        assert r.before is None or t[r.before_start :].startswith(r.before)
        assert r.after is None or t[: r.after_stop].endswith(r.after)


def test_sentence_gap_is_the_plain_pattern(spark):
    plain = r"(?<=[.!?])\s+|\n+"
    df = spark.createDataFrame(odd_texts(), "id int, text string")
    cut = lambda p: (F.split("text", p, -1), F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    for r in df.select(F.array(*cut(plain)).alias("a"), F.array(*cut(tx.SENTENCE_GAP)).alias("b")).collect():
        assert r.a == r.b


def test_number_spans_without_and_with_hits(spark):
    """Forms that a text does not have give an empty array, a null text gives null, and a few hits have their places."""
    df = spark.createDataFrame([("no",), (None,), ("",), ("😀 1 a 22 b 333",)], "t string")
    got = [r.s if r.s is None else [tuple(x) for x in r.s] for r in df.select(arrays.spans(F.col("t"), r"\d+").alias("s")).collect()]
    assert got == [[], None, [], [(2, 3, "1"), (6, 8, "22"), (11, 14, "333")]]
