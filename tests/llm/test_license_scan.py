import random
import re
import time

from tessera.llm.license_scan import TEMPLATES, Matcher, best_labels, phrase_places, scan_licenses, words_of

TEXTS = [
    None, "", "Released under the MIT License.", "x under the MIT-license UNDER THE MIT LICENSE y", "Licensed under the Apache License, Version 2.0.",
    "CC BY-NC 4.0", "This work is licensed under the GNU General Public License, version 3.", "under the license " * 3000 + " mit", "é" * 5, "ccc by nc cc by nc",
    "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies of the Software",
]


def test_scan(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, labels int")
    rows = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, t in enumerate(TEXTS):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        places = [(j, n) for p, n in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")) for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        assert (rows[i].n_words, rows[i].n_base) == (len(w), len(places))
        assert (rows[i].first_word, rows[i].last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert rows[i].base_labels == ",".join(sorted({n for _, n in places})) and 0 <= rows[i].score <= 1
    assert rows[6].labels == "gpl-3" and rows[10].labels == "mit" and rows[9].n_base == 1
    # 4 of the 5 tokens of a template in a block: the threshold is met, whatever their order
    assert (rows[7].labels, rows[7].score) == ("mit", 0.8)
    assert scan_licenses(df.limit(0)).count() == 0


def brute(words, threshold=0.8):
    """Every block of every template's width, by counting alone."""
    want = set()
    for t in TEMPLATES:
        tokens, width = set(words_of(t.text)), 8
        while width < len(words_of(t.text)):
            width *= 2
        for lo in range(0, max(len(words), 1), width):
            share = len(set(words[lo : lo + 2 * width]) & tokens) / len(tokens)
            if share >= threshold - 1e-12:
                want.add((t.label, frozenset(tokens), lo, lo + 2 * width, share))
    return want


def test_join_returns_every_block_at_the_threshold():
    rng = random.Random(1)
    matcher = Matcher(TEMPLATES, {"the": 99, "under": 50, "license": 20}, 0.8)
    pool = [w for t in TEMPLATES for w in words_of(t.text)]
    found = 0
    for i in range(600):
        words = rng.choices(pool, k=rng.randint(0, 60)) if i % 2 else [w for w in words_of(rng.choice(TEMPLATES).text) if rng.random() < 0.93] + rng.choices(["x", "y", "the"], k=rng.randint(0, 20))
        got = list(matcher.blocks(words))
        want = brute(words)
        assert {(t.label, frozenset(t.tokens), lo, hi, share) for t, lo, hi, share in got} == want and len(got) == len(want)
        found += len(want)
        best = {m[0] for m in want if not any((o[4], len(o[1])) > (m[4], len(m[1])) and o[2] < m[3] and m[2] < o[3] for o in want)}
        assert best_labels(got) == best
    assert found > 300


def test_labels(spark):
    texts = {
        "This work is licensed under the GNU General Public License, version 1": ("gpl-2,gpl-3", 8 / 9), "This work is licensed under the GNU General Public License, version 3": ("gpl-3", 1.0),
        "licensed under the GNU Lesser General Public License, version 3": ("lgpl-3", 1.0), "This Source Code Form is subject to the terms of the Public License, v. 2.0": ("mpl-2", 15 / 16), "the license " * 9: ("", 0.0),
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r, (labels, score) in zip(scan_licenses(df).orderBy("doc_id").collect(), texts.values(), strict=True):
        assert (r.labels, round(r.score, 9)) == (labels, round(score, 9))


def test_phrases_in_linear_time():
    assert phrase_places("cc by nc cc by nc by".split()) == [(0, "cc-by-nc"), (3, "cc-by-nc")]
    words = "cc by nc x".split() * 250_000
    began = time.perf_counter()
    assert phrase_places(words) == [(4 * i, "cc-by-nc") for i in range(250_000)]
    assert time.perf_counter() - began < 10
