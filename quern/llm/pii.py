"""Personal data by weak supervision, with DataFrame functions only.

Base spans (e-mail, IP address, card, phone) follow fixed patterns and always stay. Beyond them,
broader patterns propose candidates: masked e-mail addresses, plain phone and identity numbers,
account numbers, secrets, names after a title or beginning with a known given name. Regex, gazetteer
and context labelers vote on each (1, 0, or -1 for no vote). For each kind of candidate,
expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is. To
abstain is an outcome of its own there, for a labeler that speaks up more often on one side says
something by its silence too, and one that only ever votes one way keeps its weight. The patterns'
posteriors then train a naive Bayes classifier of span features, which decides on the candidates.

Texts are read once: candidates with their votes and features are written to the shared folder, all
of them train the model, and the same table is judged by it. Vote patterns and features are few
whatever the input, so the model is a literal of that last step, and texts are never shuffled.

Defined cases: a null text counts as empty; empty texts have no spans; long texts are read whole;
spans of one start go in the order of ``KINDS`` and then by their end; a candidate that overlaps a
base span is no span; overlapping candidates may both stay, and ``redact`` then takes the first;
repeated rows have the same spans; rows with a null id are read like others; without any candidate
in the table only base spans are found; an empty table gives an empty table; extra columns pass
through, and a column that has the name of an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import written

KINDS = ("email", "ip", "card", "phone", "id", "secret", "name")

# The base patterns. Possessive forms of the plain ones: a match can only begin where a run of its
# characters begins or the last match ended, so runs are read once. Runs of 12 to 19 digits are
# matched as a whole, other runs not at all.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"

# Candidates. Runs are possessive and without a longest length, so nothing is cut or passed over for its size.
MASKED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z.,+$€£#])\(?[0-9]{2,4}\)?[ ./-](?:[0-9]{2,4}[ ./-]){1,3}[0-9]{2,4}(?![0-9A-Za-z]|[ .-][0-9])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|(?:sk|pk|ghp|xoxb|AKIA)[-_]?[0-9A-Za-z]{16,}+)(?![0-9A-Za-z])"
TITLED = r"(?<![\p{L}])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Señora?|Madame|Monsieur)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)*+"

#: Given names and last parts of domains; ``propose`` takes others.
GIVEN_NAMES = "anna anne carlos charles david elena emma frank hans ines james jean john jose juan julia karl klaus laura luis maria marie martin mary michael paul peter pierre robert sofia thomas".split()
DOMAINS = "com org net edu gov info io de fr es eu uk".split()
CUES = r"(?i)(?:tel|phone|call|fax|mobile|mail|contact|token|key|secret|password|ssn|card|telefon|téléphone|teléfono|correo|konto)\W{0,8}$"
ANTI = r"(?i)(?:page|version|vol|isbn|no|nr|chapter|\$|€|£|#)\W{0,3}$"

LABELERS = ("format", "checksum", "gazetteer", "cue", "anti", "assigned")
ROUNDS = 20
#: Chances of the outcomes (no vote, 0, 1) from which expectation-maximisation starts, and the rows they count as.
START_YES, START_NO, START_ROWS = (0.4, 0.1, 0.5), (0.5, 0.3, 0.2), 2.0
#: Features are hashed to this many weights.
FEATURES = 256
#: Posterior from which a candidate is a span.
SURE = 0.8


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    signs = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(signs, lambda d, i: F.when(i % 2 == 1, F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


SPAN = "array<struct<start:int,stop:int,match:string>>"


def find(text: Column, pattern: str, guard: Column) -> Column:
    """All matches of ``pattern`` with start and stop in code points; none where ``guard`` is false."""

    def place(both: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            hit = F.get(both.hits, i)
            start = acc["at"] + F.length(F.get(both.gaps, i))
            stop = start + F.length(hit)
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), hit.alias("match")))).alias("out"))

        first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(both.hits) - 1), first, add, lambda acc: acc["out"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # the one-element array binds matches and gaps once
    bound = F.transform(F.array(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))), lambda b: F.when(F.size(b.hits) > 0, place(b)).otherwise(F.array().cast(SPAN)))
    return F.when(guard & text.rlike(pattern), F.get(bound, F.lit(0))).otherwise(F.array().cast(SPAN))


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """All base spans as (start, rank, stop, kind), sorted."""

    def kept(kind: str, found: Column, good) -> Column:
        rank = KINDS.index(kind)
        return F.transform(F.filter(found, good), lambda s: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), s.stop.alias("stop"), F.lit(kind).alias("kind")))

    return F.array_sort(
        F.concat(
            kept("email", find(text, EMAIL, F.contains(text, F.lit("@"))), lambda s: F.lit(True)),
            kept("ip", find(text, IP, F.lit(True)), lambda s: s.match.rlike(OCTETS)),
            kept("card", find(text, CARD, F.lit(True)), lambda s: luhn(digits_of(s.match))),
            kept("phone", find(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(digits_of(s.match)).between(9, 15)),
        )
    )


def mod97(account: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end and letters as 10 to 35."""
    signs = F.split(F.concat(F.substring(account, 5, 1_000), F.substring(account, 1, 4)), "")
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def candidates(text: Column, base: Column, names: Sequence[str] = GIVEN_NAMES) -> Column:
    """Proposed spans that no base span overlaps, with their surroundings."""

    def proposed(kind: str, found: Column) -> Column:
        return F.transform(
            found,
            lambda s: F.struct(
                F.lit(kind).alias("kind"),
                s.start.alias("start"),
                s.stop.alias("stop"),
                s.match.alias("match"),
                F.substring(text, F.greatest(F.lit(1), s.start - 23), F.least(F.lit(24), s.start)).alias("before"),
                F.substring(text, s.stop + 1, F.lit(2)).alias("after"),
            ),
        )

    given = r"(?<![\p{L}])(?:" + "|".join(n[:1].upper() + n[1:] for n in names) + r")(?: \p{Lu}\p{Ll}++)++"
    proposals = F.concat(
        proposed("email", find(text, MASKED, text.rlike(r"at[)\]]"))),
        proposed("number", find(text, NUMBER, F.lit(True))),
        proposed("account", find(text, ACCOUNT, F.lit(True))),
        proposed("secret", find(text, SECRET, F.lit(True))),
        proposed("name", find(text, f"{TITLED}|{given}" if names else TITLED, F.lit(True))),
    )
    return F.filter(proposals, lambda c: ~F.exists(base, lambda b: (b.start < c.stop) & (c.start < b.stop)))


def votes(c: Column, names: Sequence[str] = GIVEN_NAMES, domains: Sequence[str] = DOMAINS) -> Column:
    """One vote per labeler: 1, 0 or -1 for none."""
    digits = digits_of(c.match)
    word = F.lower(F.element_at(F.split(F.regexp_replace(c.match, r"[)\]]$", ""), r"[ .()\[\]]+"), -1))
    known = F.exists(F.split(F.lower(c.match), r"\.? "), lambda w: w.isin(list(names)))
    return F.array(
        F.when(c.kind == "number", c.match.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("int")).when(c.kind == "email", 1).when(c.kind == "name", c.match.rlike(f"^{TITLED}$").cast("int")).otherwise(-1),
        F.when((c.kind == "number") & (F.length(digits) >= 12), luhn(digits).cast("int")).when(c.kind == "account", (mod97(F.replace(c.match, F.lit(" "))) == 1).cast("int")).when(c.kind == "secret", (c.match.rlike("[0-9]") & c.match.rlike("[A-Za-z]")).cast("int")).otherwise(-1),
        F.when(c.kind == "name", known.cast("int")).when(c.kind == "email", word.isin(list(domains)).cast("int")).otherwise(-1),
        F.when(c.before.rlike(CUES), 1).otherwise(-1),
        F.when(c.before.rlike(ANTI), 0).otherwise(-1),
        F.when(c.before.rlike("[=:] ?[\"']?$"), 1).otherwise(-1),
    )


def features(c: Column) -> Column:
    """Numbers of a candidate's features, below ``FEATURES``."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring(c.match, 1, 12), "[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a")
    named = (
        F.concat(F.lit("kind "), c.kind),
        F.concat(F.lit("shape "), c.kind, shape),
        F.concat(F.lit("size "), c.kind, F.least(F.lit(12), F.floor(F.length(c.match) / 4)).cast("string")),
        F.concat(F.lit("before "), F.regexp_replace(F.regexp_replace(F.substring(c.before, -1, 1), r"\p{L}", "a"), "[0-9]", "9")),
        F.concat(F.lit("after "), F.regexp_replace(F.regexp_replace(F.substring(c.after, 1, 1), r"\p{L}", "a"), "[0-9]", "9")),
        F.concat(F.lit("word "), F.lower(F.regexp_extract(c.before, r"(\p{L}+)\W*$", 1))),
    )
    return F.transform(F.array(*named), lambda f: F.pmod(F.xxhash64(f), F.lit(FEATURES)).cast("int"))


def posterior(v: Column, model: Column) -> Column:
    """The chance that a candidate with votes ``v`` is personal data under (prior, yes, no)."""
    places = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
    chance = lambda side, i: F.get(F.get(model[side], i), F.get(v, i) + 1)
    prior = F.log(model["prior"] / (1 - model["prior"]))
    return 1 / (1 + F.exp(-F.aggregate(places, prior, lambda acc, i: acc + F.log(chance("yes", i) / chance("no", i)))))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Expectation-maximisation over (kind, votes, n): per kind the prior and each labeler's chances of its outcomes.

    ``patterns`` has a row per kind and distinct vector of votes, at most 3 to the number of labelers.
    """
    k = len(LABELERS)
    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("rows"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    clamp = lambda p: F.least(F.lit(0.99), F.greatest(F.lit(0.005), p))
    row = lambda chances: F.array(*[F.array(*map(F.lit, chances))] * k)
    start = F.struct(F.lit(0.5).alias("prior"), row(START_YES).alias("yes"), row(START_NO).alias("no"))

    def step(model: Column, _: Column) -> Column:
        known = F.transform("rows", lambda r: F.struct(r.votes.alias("votes"), (r.n * posterior(r.votes, model)).alias("yes"), (r.n * (1 - posterior(r.votes, model))).alias("no")))

        def rates(bound: Column) -> Column:
            def chances(side: str, at: tuple) -> Column:
                whole = total(F.transform(bound, lambda r: r[side])) + START_ROWS
                own = lambda i, o: total(F.transform(F.filter(bound, lambda r: F.get(r.votes, i) == o - 1), lambda r: r[side]))
                return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array(*[clamp((own(i, o) + START_ROWS * p) / whole) for o, p in enumerate(at)]))

            yes, no = total(F.transform(bound, lambda r: r.yes)), total(F.transform(bound, lambda r: r.no))
            return F.struct(clamp((yes + 1) / (yes + no + 2)).alias("prior"), chances("yes", START_YES).alias("yes"), chances("no", START_NO).alias("no"))

        return F.get(F.transform(F.array(known), rates), F.lit(0))

    return rows.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("model"))


def propose(docs: DataFrame, text: str = "text", names: Sequence[str] = GIVEN_NAMES, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Add ``base`` and ``_candidates`` (kind, start, stop, match, votes, features)."""
    rest = [c for c in docs.columns if c not in ("base", "_candidates", "_t")]
    rows = docs.select(*rest, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).select("*", base_spans(F.col("_t")).alias("base"))
    # the match itself goes no further than the kind of number that it is
    local = lambda c: (c.kind == "number") & c.match.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$")
    found = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.stop.alias("stop"), local(c).alias("local"), votes(c, names, domains).alias("votes"), features(c).alias("features"))
    return rows.select(*rest, "base", F.transform(candidates(F.col("_t"), F.col("base"), names), found).alias("_candidates"))


def train(proposed: DataFrame) -> tuple[float, list[float]]:
    """(bias, weights) of the span classifier, from all candidates of a table that ``propose`` made."""
    found = proposed.select(F.explode("_candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    # few vote patterns and features: all counts come from this bounded table
    counts = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).select("kind", "votes", "n", F.explode("features").alias("feature"))
    table = counts.groupBy("kind", "votes", "feature").agg(F.sum("n").alias("n"))
    per_row = 6
    patterns = table.groupBy("kind", "votes").agg((F.sum("n") / per_row).alias("n"))
    # one row per kind of candidate on the right
    judged = table.join(F.broadcast(reliabilities(patterns)), "kind").withColumn("q", posterior(F.col("votes"), F.col("model")))
    sums = judged.groupBy("feature").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    yes, no = sum(r.yes for r in sums) / per_row, sum(r.no for r in sums) / per_row
    share = min(0.95, max(0.05, (yes + 1) / (yes + no + 2)))
    bias = math.log(share / (1 - share))
    weights = [0.0] * FEATURES  # a feature's log odds against the bias, shrunk towards it
    for r in sums:
        weights[r.feature] = math.log((r.yes + 2 * share) / (r.no + 2 * (1 - share))) - bias
    return bias, weights


def decide(proposed: DataFrame, model: tuple[float, list[float]]) -> DataFrame:
    """Add ``spans`` to a table that ``propose`` made, in place of its candidates."""
    bias, weights = model
    table = F.lit(weights).cast("array<double>")

    def sure(c: Column) -> Column:
        score = F.aggregate(F.transform(c.features, lambda f: F.get(table, f)), F.lit(float(bias)), lambda a, x: a + x)
        return (score >= math.log(SURE / (1 - SURE))) & F.exists(c.votes, lambda v: v == 1)

    def span(c: Column) -> Column:
        kind = F.when(c.kind == "number", F.when(c.local, "phone").otherwise("id")).when(c.kind == "account", "id").otherwise(c.kind)
        rank = F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(KINDS)])
        return F.struct(c.start.alias("start"), rank.alias("rank"), c.stop.alias("stop"), kind.alias("kind"))

    found = F.transform(F.filter("_candidates", sure), span)
    return proposed.withColumn("spans", F.array_sort(F.concat("base", found))).drop("_candidates")


def detect(docs: DataFrame, text: str = "text", model: tuple[float, list[float]] | None = None, names: Sequence[str] = GIVEN_NAMES, domains: Sequence[str] = DOMAINS) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (start, rank, stop, kind), sorted; stops are exclusive.

    Without a ``model`` the candidates of ``docs`` train one; what was found, with all columns, is
    then written to the shared folder first.
    """
    proposed = propose(docs, text, names, domains)
    if model is None:
        proposed = written(proposed)
        model = train(proposed)
    return decide(proposed, model)


def redact(docs: DataFrame, text: str = "text", model: tuple[float, list[float]] | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; null texts stay null."""
    t = F.col(text)

    def add(acc: Column, s: Column) -> Column:
        fresh = s.start >= acc["at"]
        piece = F.concat(acc["out"], F.substring(t, acc["at"] + 1, s.start - acc["at"]), F.lit("["), F.upper(s.kind), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s.stop).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", first, add, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    found = detect(docs, text, model)
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(t)).select(*docs.columns)


def count_of(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts, their digest, all spans, and how many the method added."""
    proposed = written(propose(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text"))
    found = decide(proposed, train(proposed))
    return found.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in KINDS[:4]],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
