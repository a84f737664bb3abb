from __future__ import annotations

import re

import pytest
from dirgauge.llm import licences

PLAIN = [
    "The cat sat under the table in the garden of the old house.",
    "All of the members reserved their rights to speak at the meeting.",
    "You may use this form to ask for a permit.",
    "He worked under the terms of the contract for three years.",
    "The right of all persons to be heard is reserved by law.",
    "Free of charge, the tour of the museum begins at noon.",
    "She asked for permission to copy the file and use it in the source.",
    "It was released under the pressure of the public and the law.",
]
NOTICES = {
    "All rights reserved.": "proprietary",
    "Copyright 2020 X. All rights reserved.": "proprietary",
    "Released under the MIT License.": "mit",
    "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.": "apache-2.0",
    "This work is licensed under the\nGNU General Public License, version 3.": "gpl",
    "Licensed under the Foo License, Version 9.1.": "unknown",
    "Redistribution of the binary forms is not permitted without a written contract.": None,
}


def brute_words(text):
    return [w for w in (x.rstrip(".") for x in re.findall(r"[\w.]+", text.lower().replace("_", " "))) if w]


def brute_pairs(text):
    w = brute_words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def brute_share(text, family=None):
    pairs = brute_pairs(text)
    known = [brute_pairs(t) for f, t in licences.TEMPLATES if family in (None, f)]
    return max(len(pairs & t) / len(t) for t in known)


@pytest.fixture(scope="module")
def scanned(spark):
    """The documents, and the rows that the scan gives for them: 400 of plain English, and every notice between other lines."""
    plain = [(i, "\n".join(f"{PLAIN[(i + j) % len(PLAIN)]} Day {i * 7 + j}." for j in range(len(PLAIN)))) for i in range(400)]
    told = [(10_000 + i, f"A heading.\n\n{x}\n\nMore words follow.") for i, x in enumerate(NOTICES)]
    docs = spark.createDataFrame(plain + told, "doc_id bigint, text string").repartition(4).cache()
    return plain + told, licences.scan(docs, licences.train(docs)).collect()


def test_notices_are_told_apart_also_wrapped_and_beside_other_words(scanned):
    found = {r.doc_id: (r.paragraph, r.family) for r in scanned[1]}
    for i, family in enumerate(NOTICES.values()):
        assert found.get(10_000 + i) == (family and (2, family))


def test_plain_english_has_no_licence(scanned):
    assert not [r for r in scanned[1] if r.doc_id < 10_000 and r.family != "unknown"]


def test_candidates_and_shares_equal_a_comparison_with_every_template(scanned):
    docs, rows = scanned
    expected = {}
    for doc_id, text in docs:  # sentences of these documents end at line ends, and the notices stand between blank lines
        for block in text.split("\n\n"):
            lines = [block] if doc_id >= 10_000 else block.split("\n")
            for line in lines:
                if brute_share(line) >= licences.CANDIDATE:
                    expected[doc_id, text[: text.index(line)].count("\n")] = line
    assert {(r.doc_id, r.paragraph) for r in rows} == set(expected)
    for r in rows:
        if r.family != "unknown":
            assert r.contained == pytest.approx(brute_share(expected[r.doc_id, r.paragraph], r.family)) and r.contained >= licences.CONTAINED


def test_paragraphs(spark):
    text = "One two\nthree four.\nFive!\n\n six,\r\nseven\n  \n\neight (nine.)\nten | \neleven\n"
    rows = licences.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n.\n"), (5, "x")], "doc_id int, text string")).collect()
    found = {(r.doc_id, r.paragraph): " ".join(r.text.split()) for r in rows}
    assert found == {(1, 0): "One two three four.", (1, 2): "Five!", (1, 4): "six, seven", (1, 8): "eight (nine.)", (1, 9): "ten |", (1, 10): "eleven", (5, 0): "x"}


def test_a_long_text_is_read_whole(spark):
    text = "word word. " * 40_000 + "\n" + "no end of a sentence\n" * 5_000 + "Released under\nthe MIT License."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [(r.doc_id, r.paragraph, len(r.hits)) for r in licences.candidates(docs, licences.Templates(spark)).collect()] == [(1, 1, 4)]


def test_every_paragraph_teaches(spark):
    """Background is all different paragraphs that are no candidates, once each, however many there are."""
    templates = licences.Templates(spark)
    classes = sorted(set(templates.families)) + ["unknown"]
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('The reader of day ', id, ' waits.\nLine ', id % 50, ' is repeated.\nAll rights reserved.') AS text")
    rows = licences._background(licences.sifted(docs, templates).where("NOT candidate"), [["terms", "of", "the"], ["version", "2.0"]], templates, classes).collect()
    unknown = [r for r in rows if r.label == len(classes) - 1]
    assert sum(r.weight for r in unknown) == 2 * (9_000 + 50)
    assert all(r.aside is False for r in rows if r.label != len(classes) - 1)
    made = sum(r.weight for r in rows if r.label != len(classes) - 1)
    assert 0.2 * 9_050 < made < 0.3 * 9_050
    vocabulary = {" ".join(w[i : i + n]) for w in templates.words for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    assert all(set(r.grams) <= vocabulary and len(set(r.grams)) == len(r.grams) for r in rows)


def test_one_pass_finds_what_training_and_scanning_find(spark, scanned):
    docs, rows = scanned
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert {(r.doc_id, r.paragraph, r.family) for r in licences.find(frame).collect()} == {(r.doc_id, r.paragraph, r.family) for r in rows}
