"""Probabilities that a text states, each bound to one outcome, within a sentence and across sentences.

All of it is column expressions over arrays, without Python workers. A document is cut into sentences
that know the one before and the one after them, so no window and no shuffle is needed; only sentences
that speak of a chance, or lie beside one that does, are looked at further.

*Numbers* are typed spans. Forms are looked for in a fixed order, and a span that overlaps one of an
earlier form is dropped, wherever it starts. What is signed, grouped by blanks or one end of a range that
does not parse is no number; with more than ``most`` of them a sentence states none, if ``most`` is set.

*Outcomes* are a table of the caller: names, patterns, and whether an outcome is a risk, an arrival or
only a rival. What stands in a condition or names a cause is no outcome. A sentence that denies, compares
or names two outcomes abstains, unless ``nearest`` is asked for: then each number takes the outcome
nearest to it in its own clause, and abstains on a tie. A clause beside a number must name an outcome or hold
nothing but words that carry a number on.

*Across sentences*: a horizon in the sentence before; "that means ..." after a number without an outcome; a
list item after "probability of ..."; "I'll give a probability of ... for that" after a question.

Defined cases: null and empty texts state nothing; long texts are read whole; offsets count characters of
the text; repeated rows state the same again; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import arrays
from quern.functions import text as tx
from quern.functions.arrays import held
from quern.operators.extract import CUE as CHANCE
from quern.operators.extract import abstain


@dataclass(frozen=True)
class Outcome:
    """``kind``: risk (has a probability as such), arrival (only with a time near the number) or rival (is never asked for)."""

    name: str
    pattern: str
    kind: str = "risk"


# The forms of numbers, in the order in which they take overlaps. Each looks first for the character that it begins with.
START = r"(?<![\w.,/+−-])"
PERCENT_NUMBER = r"(?:\d{1,3}(?:\.\d+)?|\.\d+)"
PERCENT_UNIT = r"(?:%|percent\b)"
DECIMAL_NUMBER = r"0?\.\d+"
LINK = r"\s*(?:–|-|to|and)\s*"
PERCENT = rf"(?iU)(?=[\d.]){START}(?:({PERCENT_NUMBER})\s*{PERCENT_UNIT}?{LINK}({PERCENT_NUMBER})\s*{PERCENT_UNIT}(?![\w%])|({PERCENT_NUMBER})\s*{PERCENT_UNIT}(?![\w%]))"
DECIMAL = rf"(?iU)(?=[0.]){START}(?:({DECIMAL_NUMBER})(?![\w.%]){LINK}({DECIMAL_NUMBER})(?![\w.%])|({DECIMAL_NUMBER})(?![\w.%]))"
FRACTION = rf"(?iU)(?=[~\s\d]){START}~?\s*(\d{{1,2}})\s*/\s*(\d{{1,2}})\s+chance\b"
ONE_IN = rf"(?iU)(?=\d){START}(\d{{1,4}})\s+in\s+(\d{{1,6}})(?![\w%]|[.,]\d)"
CUE = r"(?iU)\b(?:chance|probability|prob\.?|odds|credence|p\s*\(\s*doom\s*\)|likelihood)\b|p\(doom\)"
RISK_PERCENT = (r"(?iU)\brisk\b", r"(?iU)%|\bpercent\b")
INTRODUCER = r"(?isU)^.*\b((?:chance|probability|credence|likelihood|odds|risk)\b.*)$"
# What is no outcome, and what makes a sentence abstain.
CONDITION = r"(?iU)\b(?:if|unless|given|assuming|conditional on)\b[^,;.!?]{0,180}"
CAUSE = r"(?iU)\b(?:from|caused by|due to|because of|of building)\s+(?:(?:an?|the|advanced|powerful|ai)\s+)*(?:agi|asi|superintelligence|takeover|catastrophe)\b"
CAUSER = r"(?iU)\b(?:agi|asi|superintelligence)(?=-caused\b|\s+(?:will|could|would|may)\s+(?:cause|lead to|result in)\b)"
DENIED = r"(?iU)\b(?:no|not|never|without|avoid\w*|prevent\w*|avert\w*|escape\w*|absence|unlike|versus)\b|n't\b|\bfail\w*\s+to\b|\b(?:rather than|instead of|compared with|compared to)\b"
CLAUSE = r"(?iU)[;,]|\b(?:and|or|but)\b"
# Words that may stand beside a number without naming what it is the chance of.
CARRIES_ON = """
a an the and or but of for that this it chance probability credence likelihood odds percent i we my we'll i'll will would could may might
estimate assign expect think believe see happen occur arrive there give put risk personal currently between greater lower upper high low
disturbingly live human species permanently involuntarily by before within in at end over next year years decade decades century centuries
roughly about around more less than least most is to above from now posting report
""".split()
# Horizons, and how sentences refer to one another.
YEAR = r"(?:20|21)\d{2}"
NUMBER_WORD = r"(?:\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|forty|fifty)"
NEAR = 110
ANAPHORA = r"(?iU)^(?:by that i mean|that means|i mean|which means|in other words|that is,)(?!\w)"
HORIZON_FIRST = r"(?iU)^(?:within|if|by|before|assuming|given|unless)\b"
SPEAKER = r"^[A-Z][A-Za-z .'\-]{0,60}:\s"
LIST_ITEM = rf"(?iU)^(?:[*\-]\s*)?(?:roughly\s+)?~?(\d{{1,3}}(?:\.\d+)?)%\s+probability\s+by\s+({YEAR})\b"
PROBABILITY_OF = r"(?iU)\bprobability of\s+"
FOR_THAT = (r"(?iU)\bi'll give a probability of\b", r"(?iU)\bfor that\b")
BYLINE = r"^[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+){1,3}\s+(?:writes|wrote)\s+that\s+"
GAP = "<<<SPEAKER_GAP>>>"
#: Characters of a statement's evidence that are kept.
EVIDENCE = 1200

#: Outcomes of the published reports, in the order in which the first one that fits is taken.
OUTCOMES = (
    Outcome("extinction", r"\bextinction\b"),
    Outcome("disempowerment", r"\bdisempower(?:ed|ment)\b|\bloss of control\b"),
    Outcome("mass_human_death", r"\b(?:most humans die|humans die|kill everyone)\b"),
    Outcome("takeover", r"\btakeover\b"),
    Outcome("catastrophe", r"\bcatastroph(?:ic|e)\b"),
    Outcome("doom", r"\bdoom\b|\bexistential risk\b|\b(?:irreversibly messed up|messed up our future)\b"),
    Outcome("human_level", r"\bhuman[-\s]level\b", "arrival"),
    Outcome("transformative", r"\btransformative\b", "arrival"),
    Outcome("asi", r"\b(?:asi|superintelligence)\b", "arrival"),
    Outcome("agi", r"\bagi\b|\bartificial general intelligence\b", "arrival"),
    Outcome("employment", r"\b(?:jobs?|workers?|employment|unemployment)\b", "rival"),
    Outcome("tasks", r"\b(?:tasks?|coding|software engineering)\b", "rival"),
    Outcome("economy", r"\b(?:productivity|gdp|wages?|economic growth)\b", "rival"),
)


# ---- numbers


def speaks_of_chance(c: Column) -> Column:
    return c.rlike(CUE) | (c.rlike(RISK_PERCENT[0]) & c.rlike(RISK_PERCENT[1]))


def _typed(c: Column, form: str, pattern: str) -> Column:
    """Spans of one form with their values; those that are no probability have a null ``low``."""

    def group(t: Column, i: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("double")

    def limits(t: Column) -> Column:
        """struct(kind, low, high), whether they fit or not."""
        if form not in ("percent", "decimal"):
            return arrays.once(F.try_divide(group(t, 1), group(t, 2)), lambda x: F.struct(F.lit("point").alias("kind"), x.alias("low"), x.alias("high")))
        scale = F.lit(100.0 if form == "percent" else 1.0)
        value = lambda x, i: (F.coalesce(x, group(t, i)) / scale).alias(("low", "high")[i - 1])
        return arrays.once(group(t, 3), lambda x: F.struct(F.when(x.isNull(), "range").otherwise("point").alias("kind"), value(x, 1), value(x, 2)))

    def checked(s: Column, v: Column) -> Column:
        low, high = v["low"], v["high"]
        fits = (low >= 0) & (low <= high) & (high <= 1) if form in ("percent", "decimal") else low <= 1
        value = lambda x: F.when(fits, x)
        return F.struct(F.lit(form).alias("form"), v["kind"].alias("kind"), value(low).alias("low"), value(high).alias("high"), F.trim(s["text"]).alias("text"), s["start"].alias("start"), s["stop"].alias("stop"))

    def read(s: Column) -> Column:
        return arrays.once(limits(s["text"]), lambda v: checked(s, v))

    return F.transform(arrays.spans(c, pattern), read)


def numbers(c: Column, most: int | None = None) -> Column:
    """All spans of numbers of a sentence, of whatever value, in order; none if there are more than ``most``."""
    taken = _typed(c, "percent", PERCENT)
    for form, pattern in (("decimal", DECIMAL), ("fraction", FRACTION), ("one_in", ONE_IN)):
        # the spans so far travel in an accumulator, for a lambda would compute them anew for each span
        free = F.aggregate(_typed(c, form, pattern), taken, lambda acc, s: F.when(F.exists(acc, lambda a: (a["start"] < s["stop"]) & (a["stop"] > s["start"])), acc).otherwise(F.concat(acc, F.array(s))))
        taken = free
    ordered = F.array_sort(taken, lambda a, b: a["start"] - b["start"])
    # one element, so that the array is computed once
    return ordered if most is None else F.get(F.transform(F.array(ordered), lambda x: F.when(F.size(x) <= most, x).otherwise(F.slice(x, F.lit(1), F.lit(0)))), F.lit(0))


def stands_alone(c: Column, s: Column) -> Column:
    """Whether a span is no part of something larger: a sign, a grouped number, or a range that does not parse."""
    before, behind = F.substring(c, F.lit(1), s["start"]), F.substring(c, s["stop"] + 1, F.length(c))
    signed = before.rlike(r"[-−+]\s*$") | before.rlike(r"(?iU)\b(?:plus|minus|negative|positive)\s*$") | before.rlike(r"\d[\s']+$")
    year_and = before.rlike(rf"(?iU)\b(?:by|before|in|around)\s*{YEAR}\s*and\s*$")
    ends = before.rlike(r"(?iU)[\d.,]+\s*(?:to|and|[–-])\s*$") & ~year_and
    begins = behind.rlike(r"(?iU)^\s*(?:to|and|[–-])\s*[+−-]?\s*(?:\d|\.\d)")
    return ~signed & ((s["kind"] == "range") | (~ends & ~begins))


# ---- outcomes


def named(c: Column) -> Column:
    """A text without its conditions and causes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, CONDITION, " "), CAUSE, " "), CAUSER, " ")


def first_outcome(c: Column, outcomes: tuple[Outcome, ...], *kinds: str) -> Column:
    """The name of the first outcome of these kinds that a text names; null if none."""
    fits = [F.when(c.rlike("(?iU)" + o.pattern), F.lit(o.name)) for k in kinds for o in outcomes if o.kind == k]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def abstains(plain: Column, outcomes: tuple[Outcome, ...]) -> Column:
    """Whether a sentence, without its conditions and causes, denies, compares, or names two outcomes."""
    count = sum((plain.rlike("(?iU)" + o.pattern).cast("int") for o in outcomes), F.lit(0))
    return plain.rlike(DENIED) | (count > 1)


def _names(t: Column, outcomes: tuple[Outcome, ...]) -> Column:
    return t.rlike("(?iU)" + "|".join(o.pattern for o in outcomes if o.kind != "rival"))


def tails(c: Column, spans: Column) -> Column:
    """What stands behind each number, up to the next one."""
    stops = F.concat(F.transform(F.slice(spans, F.lit(2), F.size(spans)), lambda s: s["start"]), F.array(F.length(c)))
    return F.zip_with(spans, stops, lambda s, stop: F.substring(c, s["stop"] + 1, stop - s["stop"]))


def lead(c: Column, spans: Column, tail: Column, outcomes: tuple[Outcome, ...]) -> Column:
    """What stands before the first number: from the word that speaks of a chance on, or all of it, or nothing if the outcome follows."""
    prefix = named(F.substring(c, F.lit(1), F.get(spans, F.lit(0))["start"]))
    introduced = F.nullif(F.regexp_extract(prefix, INTRODUCER, 1), F.lit(""))
    behind = F.get(F.split(F.get(tail, F.lit(0)), CLAUSE), F.lit(0))
    return F.coalesce(introduced, F.when(speaks_of_chance(behind) & _names(behind, outcomes), F.lit("")), prefix)


def carried_on(regions: Column, outcomes: tuple[Outcome, ...]) -> Column:
    """Whether each clause beside the numbers names an outcome or only carries a number on."""

    def clause_fits(t: Column) -> Column:
        words = F.regexp_extract_all(F.lower(t), F.lit(r"[a-z]+(?:'[a-z]+)?"), F.lit(0))
        return _names(t, outcomes) | (F.size(F.array_except(words, F.lit(CARRIES_ON))) == 0)

    return F.forall(regions, lambda t: F.forall(F.split(F.regexp_replace(named(t), BYLINE, ""), CLAUSE), clause_fits))


def places(c: Column, outcomes: tuple[Outcome, ...]) -> Column:
    """Where a text names outcomes: array of (start, stop, name)."""

    def of(o: Outcome) -> Column:
        return F.transform(arrays.spans(c, "(?iU)" + o.pattern), lambda y: F.struct(y["start"].alias("start"), y["stop"].alias("stop"), F.lit(o.name).alias("name")))

    return F.concat(*[of(o) for o in outcomes if o.kind != "rival"])


def nearest(c: Column, s: Column, found: Column) -> Column:
    """The outcome, of the places ``found``, nearest to a number within its clause; null on a tie or without one."""

    def reach(o: Column) -> Column:
        """Characters between number and outcome; null if a clause ends between them."""
        low, high = F.least(o["stop"], s["stop"]), F.greatest(o["start"], s["start"])
        between = F.substring(c, low + 1, high - low)
        return F.when(~between.rlike(CLAUSE), high - low)

    def first(order: Column) -> Column:
        tie = F.exists(F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda x: (x["d"] == F.get(order, F.lit(0))["d"]) & (x["name"] != F.get(order, F.lit(0))["name"]))
        return F.when(~F.coalesce(tie, F.lit(False)), F.get(order, F.lit(0))["name"])

    apart = F.filter(F.transform(found, lambda o: F.struct(reach(o).alias("d"), o["name"].alias("name"))), lambda x: x["d"].isNotNull())
    return arrays.once(F.array_sort(apart), first)


# ---- horizons


def horizon_near(c: Column) -> Column:
    """``by 2040`` or ``within ten years``; null without such a word."""
    by = F.regexp_extract(c, rf"(?iU)\b((?:by|before)\s+{YEAR})\b", 1)
    within = F.regexp_extract(c, rf"(?iU)\bwithin\s+({NUMBER_WORD})\s+years\b", 1)
    return F.when(by != "", F.regexp_replace(F.lower(by), r"\s+", " ")).when(within != "", F.concat(F.lit("within "), within, F.lit(" years")))


def horizon(c: Column) -> Column:
    """The time that a sentence speaks of: a year, some years, or a decade."""
    ahead = F.regexp_extract(c, rf"(?iU)\bin\s+({NUMBER_WORD})\s+years\b", 1)
    year = F.regexp_extract(c, rf"(?iU)\b(?:around|in)\s+({YEAR})\b", 1)
    past = (year.try_cast("int") < 2024) & c.rlike(rf"(?iU)\bin\s+{YEAR}\b")
    decade = F.regexp_extract(c, r"(?iU)\b((?:(?:early|mid|late)\s+)?(?:20|21)\d0s)\b", 1)
    coming = F.regexp_extract(c, r"(?iU)\b((?:(?:over|in|within)\s+)?the next decade)\b", 1)
    one = lambda x: F.regexp_replace(x, r"\s+", " ")
    return F.coalesce(
        horizon_near(c),
        F.when((ahead != "") & ~c.rlike(r"(?iU)\b(?:ago|was|were|had)\b"), F.concat(F.lit("in "), ahead, F.lit(" years"))),
        F.when((year != "") & ~past, F.concat(F.lit("in "), year)),
        F.when(decade != "", one(decade)),
        F.when(coming != "", F.lower(one(coming))),
        F.when(c.rlike(r"(?iU)\bthis decade\b"), F.lit("this decade")),
    )


# ---- sentences


def sentences_of(docs: DataFrame, id: str, text: str, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, part, index, sentence, start, stop, before, before_start, after, after_stop) of every sentence, or of those ``where`` holds.

    A speaker's gap parts what is said; sentences on either side of it are no neighbours. Only the sentences
    wanted become rows, each with its neighbours.
    """
    plain = F.col(text)
    for sign, simple in (("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"')):
        plain = F.replace(plain, F.lit(sign), F.lit(simple))

    def said(z: Column) -> Column:
        ends = arrays.running_sums(F.transform(z["parts"], lambda p: F.length(p) + len(GAP)))
        return F.zip_with(z["parts"], ends, lambda p, e: F.struct(p.alias("text"), (e - F.length(p) - len(GAP)).cast("int").alias("at")))

    # as the one element of an array the text is parted once
    pieces = F.get(F.transform(F.array(F.struct(F.split(plain, GAP, -1).alias("parts"))), said), F.lit(0))
    cut = docs.select(id, F.posexplode(pieces).alias("part", "p")).select(id, "part", F.col("p.at").alias("at"), tx.sentence_spans(F.col("p.text")).alias("s"))
    wanted = F.transform("s", lambda x, i: i)
    if where is not None:
        wanted = F.filter(wanted, lambda i: where(F.get("s", i)["text"]))
    beside = F.transform(wanted, lambda i: F.struct(i.alias("index"), F.get("s", i).alias("own"), F.get("s", i - 1).alias("before"), F.get("s", i + 1).alias("after")))
    rows = cut.select(id, "part", "at", F.explode(beside).alias("b"))
    place = lambda c: F.col("at") + F.col(c)
    return rows.select(
        id, "part", F.col("b.index").alias("index"), F.col("b.own.text").alias("sentence"), place("b.own.start").alias("start"), place("b.own.stop").alias("stop"),
        F.col("b.before.text").alias("before"), place("b.before.start").alias("before_start"), F.col("b.after.text").alias("after"), place("b.after.stop").alias("after_stop"),
    )


def numbers_stated(docs: DataFrame, id: str, text: str, most: int | None = None) -> DataFrame:
    """(id, sentence_index, sentence, form, low, high, start, stop, horizon_end, before, after) of each probability, whatever it is of.

    ``form`` is point or range, ``start`` and ``stop`` are places in the sentence.
    """
    own = sentences_of(docs, id, text, lambda c: c.rlike("[0-9]") & c.rlike(CHANCE) & abstain(c).isNull())
    ends = F.coalesce(tx.target_dates(F.col("sentence"))["end"], tx.target_dates(F.col("after"))["end"])
    rows = held(own, horizon_end=ends, spans=numbers(F.col("sentence"), most))
    good = F.filter("spans", lambda s: s["low"].isNotNull() & stands_alone(F.col("sentence"), s))
    found = rows.select(id, F.col("index").alias("sentence_index"), "sentence", "horizon_end", "before", "after", F.explode(good).alias("s"))
    return found.select(id, "sentence_index", "sentence", F.col("s.kind").alias("form"), "s.low", "s.high", "s.start", "s.stop", "horizon_end", "before", "after")


OWN = "array<struct<kind:string,low:double,high:double,value_text:string,outcome:string,horizon:string>>"


def _read(df: DataFrame, at: str, c: Column, when: Column, outcomes: tuple[Outcome, ...], most: int | None, by_nearest: bool) -> DataFrame:
    """Add ``{at}_spans``, ``{at}_rest`` (what binds them fits) and ``{at}_own``, the statements of a text ``c`` where ``when`` holds."""
    name = lambda x: F.col(f"{at}_{x}")
    df = held(df, **{f"{at}_c": F.when(when, c)})
    df = held(df, **{f"{at}_spans": numbers(name("c"), most), f"{at}_plain": named(name("c"))})
    df = held(df, **{f"{at}_risk": first_outcome(name("plain"), outcomes, "risk"), f"{at}_arrival": first_outcome(name("plain"), outcomes, "arrival"), f"{at}_tails": tails(name("c"), name("spans")), f"{at}_time": horizon(name("c"))})
    df = held(df, **{f"{at}_rest": F.when(F.size(name("spans")) > 0, ~abstains(name("plain"), outcomes) & carried_on(F.concat(F.array(lead(name("c"), name("spans"), name("tails"), outcomes)), name("tails")), outcomes))})

    if by_nearest:
        df = held(df, **{f"{at}_places": places(name("c"), outcomes)})

    def bind(s: Column) -> Column:
        soon = horizon_near(F.substring(name("c"), s["start"] + 1, F.lit(NEAR)))
        key = nearest(name("c"), s, name("places")) if by_nearest else F.coalesce(name("risk"), F.when(soon.isNotNull(), name("arrival")))
        return F.struct(s["kind"].alias("kind"), s["low"].alias("low"), s["high"].alias("high"), s["text"].alias("value_text"), key.alias("outcome"), F.coalesce(soon, name("time")).alias("horizon"))

    ok = speaks_of_chance(name("c")) if by_nearest else name("rest") & speaks_of_chance(name("c"))
    good = F.filter(name("spans"), lambda s: F.coalesce(ok, F.lit(False)) & s["low"].isNotNull() & stands_alone(name("c"), s))
    own = F.filter(F.transform(good, bind), lambda s: s["outcome"].isNotNull())
    return held(df, **{f"{at}_own": F.coalesce(own, F.array().cast(OWN))})


def statements(docs: DataFrame, id: str, text: str, outcomes: tuple[Outcome, ...] = OUTCOMES, most: int | None = None, not_speaker: Column | None = None, by_nearest: bool = False) -> DataFrame:
    """(id, part, index, rule, outcome, kind, low, high, value_text, horizon, start, stop, evidence) of all statements.

    ``rule``: sentence, horizon_before, that_means, list_item or for_that. ``not_speaker`` tells of a column ``sentence``
    whether it is somebody else's, beyond what ``extract.abstain`` knows; ``most`` numbers are trusted in a
    sentence, all if None; ``by_nearest`` binds numbers to the nearest outcome instead of abstaining.
    """
    c = F.col
    rows = sentences_of(docs, id, text, lambda x: x.rlike("[0-9]") & speaks_of_chance(x) & abstain(x).isNull())
    rows = rows if not_speaker is None else rows.where(~not_speaker)
    rows = _read(rows, "s", c("sentence"), F.lit(True), outcomes, most, by_nearest)

    def usable(other: str) -> Column:
        return c(other).isNotNull() & ~c(other).rlike(SPEAKER) & ~c(other).rlike(r"\?\s*$") & abstain(c(other)).isNull()

    def points(spans: Column) -> Column:
        """The different single percentages."""
        return F.array_distinct(F.transform(F.filter(spans, lambda s: (s["form"] == "percent") & (s["kind"] == "point") & s["low"].isNotNull()), lambda s: s["low"]))

    def agrees(other: str) -> Column:
        """Whether the sentence and another do not state different percentages."""
        a, b = c("s_points"), c(f"{other}_points")
        return (F.size(a) == 0) | (F.size(b) == 0) | ((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0))

    # what the sentences beside one say is looked for only where a rule asks for it
    leads, explains = c("before").rlike(HORIZON_FIRST), c("after").rlike(ANAPHORA)
    listed, answers = c("sentence").rlike(LIST_ITEM), c("sentence").rlike(FOR_THAT[0]) & c("sentence").rlike(FOR_THAT[1])
    prior = F.coalesce(*[F.when(c("before").rlike(PROBABILITY_OF + r"(?:human\s+|the\s+)?(?:" + o.pattern + ")"), F.lit(o.name)) for o in outcomes if o.kind != "rival"])
    rows = held(
        rows, usable_before=usable("before"), usable_after=usable("after"), covered=F.size("s_own") > 0, asked=_names(c("sentence"), outcomes),
        s_points=points(c("s_spans")), before_points=F.when(usable("before") & leads, points(numbers(c("before")))), after_points=F.when(usable("after") & explains, points(numbers(c("after")))),
        prior=F.when(listed, prior), what=F.when(leads | answers, first_outcome(c("before"), outcomes, "risk")), whole=F.concat_ws(" ", "sentence", "after"), pair=F.concat_ws(" ", "before", "sentence"), single=F.get(c("s_spans"), F.lit(0)),
    )
    bare = ~c("covered") & ~c("asked") & c("usable_after") & explains & _names(c("after"), outcomes) & agrees("after")
    rows = held(
        rows, bare=F.coalesce(bare, F.lit(False)), lent=F.when(c("usable_before") & leads & agrees("before"), horizon(c("before"))),
        sound=F.coalesce((listed | answers) & c("single.low").isNotNull() & stands_alone(c("sentence"), c("single")) & c("s_rest") & ~abstains(named(c("pair")), outcomes), F.lit(False)),
    )
    rows = _read(rows, "w", c("whole"), c("bare"), outcomes, most, by_nearest)

    def made(rule: str, s: Column, outcome: Column, horizon_: Column, start: str, stop: str, evidence: str) -> Column:
        value = [s[x].alias(x) for x in ("kind", "low", "high")]
        return F.struct(F.lit(rule).alias("rule"), outcome.alias("outcome"), *value, s["text" if s is c_single else "value_text"].alias("value_text"), horizon_.alias("horizon"), c(start).alias("start"), c(stop).alias("stop"), F.substring(c(evidence), 1, EVIDENCE).alias("evidence"))

    c_single = c("single")

    def explicit(s: Column) -> Column:
        takes = s["horizon"].isNull() & c("lent").isNotNull() & (c("what").isNull() | (c("what") == s["outcome"]))
        return F.when(takes, made("horizon_before", s, s["outcome"], c("lent"), "before_start", "stop", "pair")).otherwise(made("sentence", s, s["outcome"], s["horizon"], "start", "stop", "sentence"))

    meant = F.slice(F.filter("w_own", lambda s: F.contains(c("sentence"), s["value_text"])), 1, 1)
    item = ~c("covered") & listed & ~c("asked") & c("prior").isNotNull() & c("sound")
    until = F.concat(F.lit("by "), F.regexp_extract("sentence", LIST_ITEM, 2))
    answer = ~c("covered") & answers & (F.size("s_spans") == 1) & (c("single.form") == "percent") & (c("single.kind") == "point")
    same = ~c("asked") | (c("s_risk") == c("what"))
    found = F.concat(
        F.transform("s_own", explicit),
        F.transform(meant, lambda s: made("that_means", s, s["outcome"], s["horizon"], "start", "after_stop", "whole")),
        F.array_compact(F.array(F.when(item, made("list_item", c_single, c("prior"), until, "before_start", "stop", "pair")))),
        F.array_compact(F.array(F.when(answer & c("what").isNotNull() & same & c("sound"), made("for_that", c_single, c("what"), F.coalesce("s_time", horizon(c("before"))), "before_start", "stop", "pair")))),
    )
    return rows.select(id, "part", "index", F.explode(found).alias("f")).select(id, "part", "index", "f.*")
