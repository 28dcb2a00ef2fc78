"""Base spans against plain regular expressions; labelers, training and redaction on fixtures."""

import hashlib
import math
import random
import re
from collections import Counter

import regex
import xxhash

from quern.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        s = sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d))))
        return 12 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    order = list(PLAIN)
    found = [(m.start(), order.index(k), m.end()) for k, p in PLAIN.items() for m in p.finditer(text or "") if good(k, m[0])]
    return [(order[k], a, b) for a, k, b in sorted(found)]


def ours(spans):
    return [(s.kind, s.start, s.stop) for s in spans]


def test_base_spans_of_random_texts(spark):
    rng = random.Random(8)
    bits = ["a", "b@", "@", ".c", "x.y", "4111 1111 1111 1111", "4111111111111111", "1", "22", "333", ".", "-", " ", "  ", "+", "(", ")", "+1 (555) 555-1234", "10.0.0.1", "256.1.1.1", "0001.2.3.4", "1.2.3.4.5.6.7.8", "é", "🙂", "_m@n.o_p@q.r", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "a" * 100_000 + "@x.com", "1" * 100_000, "1.2." * 20_000, "a@" + "b." * 20_000 + "c", "+1" + " " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string").repartition(4)
    for r in pii.detect(df, model=(0.0, [0.0] * pii.FEATURES)).collect():
        assert ours(r.base) == plain(r.text), r.text


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op3_pii(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in want) for k in PLAIN)
        assert set(text.split(",")) <= set(r.spans.split(",")) | {""}


YES, NO = [0.4, 0.1, 0.5], [0.5, 0.3, 0.2]


def plain_chance(votes, model):
    prior, yes, no = model
    return 1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(yes[i][v + 1] / no[i][v + 1]) for i, v in enumerate(votes)))))


def plain_em(table, rounds):
    """(prior, yes, no) after expectation-maximisation over (votes, n)."""
    model = 0.5, [YES] * 6, [NO] * 6
    clamp = lambda p: min(0.99, max(0.005, p))
    for _ in range(rounds):
        q = [plain_chance(v, model) for v, _ in table]
        sides = [[n * p for (_, n), p in zip(table, q)], [n * (1 - p) for (_, n), p in zip(table, q)]]
        rates = [[[clamp((sum(x for x, (v, _) in zip(w, table) if v[i] == o - 1) + 2 * start[o]) / (sum(w) + 2)) for o in range(3)] for i in range(6)] for w, start in zip(sides, (YES, NO))]
        model = clamp((sum(sides[0]) + 1) / (sum(sides[0]) + sum(sides[1]) + 2)), *rates
    return model


VOTES = [([1, 1, -1, 1, -1, -1], 40), ([0, 0, -1, -1, 0, -1], 60), ([1, 0, -1, -1, -1, -1], 5), ([0, 1, -1, 1, -1, 1], 4), ([-1, -1, 1, -1, -1, -1], 9)]


def test_reliabilities_follow_plain_em(spark):
    rows = [("number", v, float(n)) for v, n in VOTES] + [("name", v, float(n * n)) for v, n in VOTES[:3]]
    got = {r.kind: r.model for r in pii.reliabilities(spark.createDataFrame(rows, "kind string, votes array<int>, n double"), 7).collect()}
    for kind, table in (("number", VOTES), ("name", [(v, n * n) for v, n in VOTES[:3]])):
        prior, yes, no = plain_em(table, 7)
        assert abs(got[kind].prior - prior) < 1e-9
        assert all(abs(a - b) < 1e-9 for side, want in ((got[kind].yes, yes), (got[kind].no, no)) for x, y in zip(side, want) for a, b in zip(x, y))


def test_weights_survive_large_tables(spark):
    """Labelers that only ever vote one way, and labelers with both, keep their weight in a 10,000-fold table."""
    weights = []
    for times in (1, 100, 10_000):
        m = pii.reliabilities(spark.createDataFrame([("number", v, float(n * times)) for v, n in VOTES], "kind string, votes array<int>, n double")).first().model
        weights.append([max(abs(math.log(y[o] / n[o])) for o in range(3)) for y, n in zip(m.yes, m.no)])
    for i in (0, 1, 3, 4):  # format, checksum, cue, anti
        assert all(w[i] > 0.7 for w in weights), (pii.LABELERS[i], [w[i] for w in weights])


def plain_votes(kind, text, before, names=pii.GIVEN_NAMES, domains=pii.DOMAINS):
    d = re.sub("[^0-9]", "", text)
    full = lambda p: regex.fullmatch(p, text) is not None
    luhn = sum((x * 2 - 9 if x * 2 > 9 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    format_ = {"number": int(full(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}")), "email": 1, "name": int(full(pii.TITLED))}.get(kind, -1)
    check = -1
    if kind == "number" and len(d) >= 12:
        check = int(luhn)
    elif kind == "secret":
        check = int(bool(re.search("[0-9]", text) and re.search("[A-Za-z]", text)))
    elif kind == "account":
        plain = text.replace(" ", "")
        check = int(int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    gazetteer = -1
    if kind == "name":
        gazetteer = int(any(w in names for w in re.split(r"\.? ", text.lower())))
    elif kind == "email":
        gazetteer = int(re.split(r"[ .()\[\]]+", re.sub(r"[)\]]$", "", text))[-1].lower() in domains)
    return [format_, check, gazetteer, 1 if re.search(pii.CUES, before, re.ASCII) else -1, 0 if re.search(pii.ANTI, before, re.ASCII) else -1, 1 if re.search("[=:] ?[\"']?$", before) else -1]


def plain_features(kind, text, before, after):
    def shape(x):
        return regex.sub(r"\p{Ll}", "a", regex.sub(r"\p{Lu}", "A", re.sub("[0-9]", "9", x)))

    sign = lambda x: re.sub("[0-9]", "9", regex.sub(r"\p{L}", "a", x))
    word = regex.search(r"(\p{L}+)\W*$", before, regex.ASCII)
    named = [f"kind {kind}", f"shape {kind}{shape(text[:12])}", f"size {kind}{min(12, len(text) // 4)}", f"before {sign(before[-1:])}", f"after {sign(after[:1])}", f"word {word[1].lower() if word else ''}"]
    return [xxhash.xxh64_intdigest(x.encode(), 42) % pii.FEATURES for x in named]


def plain_all(docs):
    """All spans of (id, text) by plain code: candidates, votes, expectation-maximisation, naive Bayes."""
    given = r"(?<![\p{L}])(?:" + "|".join(n.capitalize() for n in pii.GIVEN_NAMES) + r")(?: \p{Lu}\p{Ll}++)++"
    patterns = [("email", pii.MASKED), ("number", pii.NUMBER), ("account", pii.ACCOUNT), ("secret", pii.SECRET), ("name", f"{pii.TITLED}|{given}")]
    found, spans = [], {}
    for i, text in docs:
        text = text or ""
        base = plain(text)
        spans[i] = [(a, pii.KINDS.index(k), b, k) for k, a, b in base]
        for kind, p in patterns:
            for m in regex.finditer(p, text):
                if not any(a < m.end() and m.start() < b for _, a, b in base):
                    before, after = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2]
                    found.append((i, kind, m, plain_votes(kind, m[0], before), plain_features(kind, m[0], before, after)))
    yes, no = [0.0] * pii.FEATURES, [0.0] * pii.FEATURES
    for kind in {f[1] for f in found}:
        table = Counter(tuple(f[3]) for f in found if f[1] == kind)
        model = plain_em([(list(v), n) for v, n in table.items()], pii.ROUNDS)
        for f in found:
            if f[1] == kind:
                q = plain_chance(f[3], model)
                for x in f[4]:
                    yes[x] += q
                    no[x] += 1 - q
    share = min(0.95, max(0.05, (sum(yes) / 6 + 1) / (sum(yes) / 6 + sum(no) / 6 + 2)))
    bias = math.log(share / (1 - share))
    weight = [math.log((y + 2 * share) / (n + 2 * (1 - share))) - bias if y + n else 0.0 for y, n in zip(yes, no)]
    for i, kind, m, votes, features in found:
        if bias + sum(weight[x] for x in features) >= math.log(pii.SURE / (1 - pii.SURE)) and 1 in votes:
            local = re.search(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", m[0])
            name = {"number": "phone" if local else "id", "account": "id"}.get(kind, kind)
            spans[i].append((m.start(), pii.KINDS.index(name), m.end(), name))
    return {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s)) for i, s in spans.items()}


def test_all_spans_against_plain_code(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(9)
    bits = ["Dr. Maria Lopez came", "Anna Berg", "call 555-123-4567", "tel: (555) 123 4567", "page 12-34-5678", "ssn 123-45-6789", "IBAN DE89 3704 0044 0532 0130 00", "XX00 1234 5678 9012", "ann (at) mail (dot) com", "key=sk-" + "a1" * 20, "secret: " + "0f" * 20, "hash " + "0f" * 20, "words only.", "a.b@c.org", "10.1.2.3", "Frau Éva Ünal"]
    docs += [(10**6 + k, "\n".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detect(df).select("doc_id", pii.joined("spans").alias("s")).collect()}
    want = plain_all(docs)
    assert got == want
    assert sum("name:" in x for x in want.values()) and sum("id:" in x for x in want.values()) and sum("secret:" in x for x in want.values())


def test_spans_have_no_longest_length(spark):
    texts = ["token = " + "a1" * 400 + " x", "x" * 300 + " (at) " + "y" * 200 + ".".join([""] + ["z"] * 30) + ".com", "Dr. Maria" + " Lopez" * 20_000, "Anna" + " Berg" * 20_000, "secret: sk-" + "A1" * 300]
    rows = pii.propose(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[c.stop - c.start for c in r["_candidates"]] for r in rows] == [[800], [len(texts[1])], [len(texts[2])], [len(texts[3])], [603]]
    long = spark.createDataFrame([(1, "w " * 60_000 + "a@b.cd " + "w " * 60_000), (1, None)], "doc_id long, text string")
    assert sorted(len(r.text or "") for r in pii.redact(long).collect()) == [0, 240_008]


def test_added_spans_and_redaction(spark):
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    texts = ["call me: (555) 123-4567 now", "tel 555-123-4567", "write to ann (at) mail (dot) com soon", f'token = "{key}" x', "Dr. Maria Lopez came", "plain words only, page 12", "mail a.b@c.org, ip 10.1.2.3!", None, "a@b.cd" * 2]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] * 3, "doc_id long, text string, spans string")
    found = {r.doc_id: (r.text or "", ours(r.spans)) for r in pii.detect(df).collect()}
    cut = {i: [(k, t[a:b]) for k, a, b in s] for i, (t, s) in found.items()}
    assert cut[0] == [("phone", "(555) 123-4567")] and ("secret", key) in cut[3] and ("email", "ann (at) mail (dot) com") in cut[2]
    assert cut[5] == [] and cut[7] == []
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[6] == "mail [EMAIL], ip [IP]!" and clean[5] == texts[5] and clean[7] is None
    assert pii.detect(df.limit(0)).count() == 0
