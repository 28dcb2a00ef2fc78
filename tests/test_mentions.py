"""Mentions of many names against one regular expression at a time."""

import random
import re

from quern.operators import mentions


def plain(texts, people):
    return {(i, p) for i, t in texts for p, n in people if i is not None and p is not None and t and n and re.search(r"\w", n) and re.search(rf"(?i)(?<!\w){re.escape(n)}(?!\w)", t)}


def test_all_people_in_all_texts(spark):
    rng = random.Random(3)
    given, family = ["Ann", "ann-lee", "O'Neil", "Jo", "José", "Ж", "X.", "A\\E"], ["Lee", "Smith", "Li", "d'Arc", "Müller", "(Jr.)", "Łuk"]
    people = [(i, f"{rng.choice(given)} {rng.choice(family)}") for i in range(40)] + [(50, "Solo"), (51, ""), (52, None), (53, "..."), (None, "Ann Lee"), (54, "Ann Lee")]
    parts = given + family + ["ann", "LEE", "solo", "Solos", "of", "and", ".", ",", "xLee", "Lee1"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", ", "]) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    texts += [(900, None), (901, ""), (None, "Ann Lee"), (902, "Ann Lee"), (902, "Solo"), (903, "x" * 100_000 + " Ann Lee")]
    docs = spark.createDataFrame(texts, "id int, text string")
    folk = spark.createDataFrame(people, "person int, name string")
    got = {tuple(r) for r in mentions.mentioned(docs, "id", "text", folk, "person", "name").collect()}
    assert got == plain(texts, people)
    assert len(got) > 200
    assert mentions.mentioned(docs.limit(0), "id", "text", folk, "person", "name").count() == mentions.mentioned(docs, "id", "text", folk.limit(0), "person", "name").count() == 0
