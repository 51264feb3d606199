import random
import re

import numpy as np
import pyarrow as pa

from tessera.llm.common import word_hashes, words
from tessera.llm.substring_dedup import COVER, PERIOD, remove_repeats


def brute(rows):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, pos string, h int").repartition(parts)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(map(tuple, remove_repeats(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    return got


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abé　漢", k=rng.randint(1, 4)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rng.choice([0, 3, 60, 150]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            at = rng.randint(0, len(w))
            w[at:at] = p[a:]
        rows.append((rng.randint(0, 10**6), rng.choice([" ", "\n", " \t "]).join(w)))
    rows = list({d: (d, t) for d, t in rows}.values())
    rows += [(2_000_000 + i, rows[i][1]) for i in range(20)] + [(3_000_000, None), (3_000_001, ""), (3_000_002, "same " * 3000), (3_000_003, "same " * 60), (None, rows[3][1]), (-5, rows[5][1])]
    got = check(spark, rows)
    assert sum(r[2] for r in got) > 1000
    check(spark, rows, 1)


def test_repeated_rows_and_empty(spark):
    t = " ".join(map(str, range(60)))
    check(spark, [(1, t), (1, t), (2, t), (2, t + " more"), (0, "short"), (3, "a " + t)])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_and_hashes():
    texts = ["", " a  bc ", None, "bc", "\x0b\x0c", "é　a a", "x"]
    from tessera.llm.common import text_bytes

    data, offsets = text_bytes(pa.array(texts))
    s, e, first = words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == ["a", "bc", "bc", "é　a", "a", "x"]
    assert np.diff(first).tolist() == [0, 2, 0, 1, 0, 2, 1]
    h = word_hashes(data, s, e)
    assert h[0] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 4
