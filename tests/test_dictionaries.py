"""Dictionaries of substrings on hard fixtures: overlaps, nulls, several automata, equal names."""

from __future__ import annotations

import random

from tidemark.operators import dictionary


def test_contained_terms_in_one_and_many_automata(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [(i % 45, text(rng.randrange(40)) if i % 10 else None) for i in range(50)]
    terms = [(text(rng.randrange(5)),) for _ in range(60)] + [(None,), ("a",), ("a",)]
    want = sorted((k, t) for k, x in texts for t in {t for (t,) in terms if t} if x is not None and t in x)
    df, vocabulary = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(terms, "term string")
    assert sorted(tuple(r) for r in dictionary.contained(df, "id", "text", vocabulary).collect()) == want
    monkeypatch.setattr(dictionary, "CHARS", 30)
    assert sorted(tuple(r) for r in dictionary.contained(df, "id", "text", vocabulary).collect()) == want
    assert dictionary.contained(df, "id", "text", vocabulary.limit(0)).count() == 0


def test_the_first_rule_in_order_wins(spark):
    rules = spark.createDataFrame([("mesh", "hernia", 2), ("glove", "gloves", 1), ("mesh", "late", 9), ("surg", "surgery", 3)], "term string, label string, place int")
    texts = spark.createDataFrame([(1, "surgical mesh"), (2, "mesh gloves"), (3, "none"), (4, None)], "id int, text string")
    assert sorted(tuple(r) for r in dictionary.first_rule(texts, "id", "text", rules).collect()) == [(1, 2, "mesh", "hernia"), (2, 2, "glove", "gloves")]


def test_first_rules_are_told_in_the_scan(spark, monkeypatch):
    """Many terms in a text, repeated keys, one automaton and several: a text is one row for each automaton, not one for each term."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [(i % 25, text(rng.randrange(30)) if i % 10 else None) for i in range(30)]
    rules = [(text(rng.randrange(5)), f"l{i % 7}", f"p{rng.randrange(40)}") for i in range(60)]
    first = {}
    for term, label, place in rules:
        if term:
            first[term] = min(first.get(term, (place, label)), (place, label))
    want = {}
    for k, x in texts:
        for term, (place, label) in first.items():
            if x is not None and term in x:
                want.setdefault(k, []).append((place, term, label))
    want = sorted((k, len(v), min(v)[1], min(v)[2]) for k, v in want.items())
    monkeypatch.setattr(dictionary, "contained", None)  # a row for each term
    for chars in (dictionary.CHARS, 30):
        monkeypatch.setattr(dictionary, "CHARS", chars)
        found = dictionary.first_rule(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(rules, "term string, label string, place string"))
        assert sorted(tuple(r) for r in found.collect()) == want


def test_same_names_step_by_step(spark):
    ours = [(1, "cj medical"), (2, "ab scientific"), (3, "hamilton"), (4, ""), (5, None), (6, "blue cross care group"), (7, "a b")]
    theirs = [(1, "c j medical"), (2, "ab scientific"), (3, "hamilton rentals"), (4, "care blue"), (5, "x"), (6, "a"), (7, "medical"), (7, "medical")]
    found = dictionary.same_names(spark.createDataFrame(ours, "l int, name string"), spark.createDataFrame(theirs, "r int, name string"), "l", "r", "name")
    want = []
    for i, a in ours:
        for j, b in theirs:
            if a and b:
                x, y, common = a.replace(" ", ""), b.replace(" ", ""), len(set(a.split()) & set(b.split()))
                how = "equal" if a == b else "contains" if a in b or b in a else "joined" if x in y or y in x else "words" if common >= 2 else None
                want += [(i, j, how)] if how else []
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and {h for *_, h in want} == {"equal", "contains", "joined", "words"}


def test_labels_and_mentions(spark):
    index = spark.createDataFrame([("wound care products", "wound", 2), ("care", "general", 1), ("", "none", 0)], "term string, label string, place int")
    names = spark.createDataFrame([(1, "wound care"), (2, "wound"), (3, "eye"), (4, None), (5, "wound")], "id int, name string")
    assert sorted(tuple(r) for r in dictionary.labelled_by_name(names, "id", "name", index).collect()) == [(1, "general"), (2, "wound"), (5, "wound")]
    things = spark.createDataFrame([("s", 1, "Foley (latex)"), ("s", 2, "(odd)"), ("t", 3, "foley")], "sup string, thing int, name string")
    texts = spark.createDataFrame([("s", 10, "Recall of FOLEYS"), ("s", 11, None), ("u", 12, "foley")], "sup string, alert int, body string")
    assert [tuple(r) for r in dictionary.mentions(things, texts, "sup", "thing", "name", "alert", "body").collect()] == [(1, 10)]
