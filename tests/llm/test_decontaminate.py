"""Leaks against plain code on windows, and re-parameterised questions."""

import regex

import pytest

from quern.llm import decontaminate as dc


TOKEN = regex.compile(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+|[$€£%]|[.!?:\n]")


def plain(docs, items, size=5, least=0.8):
    def read(text):
        t = []
        for m in TOKEN.finditer(text or ""):
            w = m[0]
            before = t[-1] if t else (4, "")
            if w in ".!?:\n":
                t.append((4, w))
            elif w[0].isdigit():
                t.append((1, w))
            elif w in "$%€£" or (w.lower() in dc.UNITS and before[0] == 1):
                t.append((2, w.lower()))
            elif w[0].isupper() and len(w.encode()) > 1 and before[0] != 4:
                t.append((3, w.lower()))
            else:
                t.append((0, w.lower()))
        t = [x for x in t if x[0] != 4]
        runs = {}
        for a in range(len(t) - size + 1):
            runs.setdefault(tuple(k or w for k, w in t[a : a + size]), []).append((a, [x for x in t[a : a + size] if x[0]]))
        return runs

    out = set()
    read_items = {i: read(t) for i, t in items}
    for d, text in docs:
        own = read(text)
        for i, runs in read_items.items():
            both = runs.keys() & own.keys()
            if not runs or len(both) < least * len(runs):
                continue
            lines = {}
            for w in both:
                for a, x in runs[w]:
                    for b, y in own[w]:
                        found, pairs = lines.setdefault(b - a, (set(), set()))
                        found.add(w)
                        pairs.update(zip(x, y))
            line = max(lines, key=lambda k: (len(lines[k][0]), -abs(k), k))
            pairs = lines[line][1]
            if len({x for x, _ in pairs}) == len(pairs):
                out.add((d, i, all(x == y for x, y in pairs)))
    return out


ITEM = "Yesterday Tom had 5 apples and gave 2 apples to Ann before Tom ate 1 kg of bread and 3 pears."
CASES = [
    ("intro words here. " + ITEM + " outro", True),
    (ITEM.replace("Tom", "Peter").replace("5", "17").replace(" 2 ", " 4 "), True),
    (ITEM.replace("Tom had", "Peter had").replace("Tom ate", "Susan ate"), False),
    ("Yesterday someone had apples and gave apples to others.", False),
    (" ".join(ITEM.split()[:9]), False),
    (None, False),
    ("", False),
]


@pytest.mark.parametrize("text,leak", CASES)
def test_templates(text, leak):
    assert bool(plain([(1, text)], [(7, ITEM)])) == leak


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, place string"), spark.createDataFrame(items, "item_id long, text string")


def test_cases(spark):
    docs = [(i, t) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0]), (50, "w " * 60_000 + ITEM), (None, ITEM)]
    items = [(7, ITEM), (8, "too short"), (9, None), (10, "")]
    d, i = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id, r.exact) for r in dc.leaks(d, i).collect()}
    assert got == plain([x for x in docs if x[0] is not None], items)
    assert {r[0] for r in got} == {0, 1, 50}
    kept = dc.clean(d, i)
    assert kept.columns == d.columns and kept.count() == len(docs) - 4
    assert dc.leaks(d.limit(0), i).count() == 0 and dc.leaks(d, i.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.exact) for r in dc.op6_decontaminate(spark, sf).collect()}
    assert got == plain(docs, items)
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    assert whole <= {(d, i) for d, i, _ in got}


def test_exact_copy_after_an_inconsistent_one(spark):
    mixed = ITEM.replace("Tom had", "Peter had").replace("Tom ate", "Susan ate")
    d, i = frames(spark, [(1, mixed), (2, mixed + "\n" + ITEM), (3, ITEM + "\n" + mixed)], [(7, ITEM)])
    assert sorted((r.doc_id, r.exact) for r in dc.leaks(d, i).collect()) == [(2, True), (3, True)]


def test_verbatim_in_running_text_and_in_lower_case(spark):
    short = "Se que trabajan mucho hoy"
    named = "Yesterday Tom met Ann near Rome while Peter and Susan went from Paris to London with Max"
    docs = [(1, "foo bar, " + short + " y mas"), (2, named.lower()), (3, "foo bar se que descansan mucho hoy"), (4, named.lower().replace("ann", "bob").replace("paris", "oslo"))]
    d, i = frames(spark, docs, [(7, short), (8, named)])
    assert sorted((r.doc_id, r.item_id, r.exact) for r in dc.leaks(d, i).collect()) == [(1, 7, True), (2, 8, True)]


def test_short_items(spark):
    """Items of fewer than five words leak where they stand with their own words and values."""
    docs = [(1, "We ask: is 7 prime? Yes."), (2, "we ask: is 8 prime? no."), (3, "prime is 7"), (4, None), (5, "It is. 7 prime")]
    items = [(1, "Is 7 prime?"), (2, "Yes"), (3, ""), (4, None), (5, "none of these four")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, place int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    got = sorted((r.doc_id, r.item_id) for r in dc.leaks(d, i).collect())
    assert got == [(1, 1), (1, 2), (5, 1)] or got == [(1, 1), (1, 2)]
    assert sorted(r.doc_id for r in dc.clean(d, i).collect()) in ([2, 3, 4, 5], [2, 3, 4])
