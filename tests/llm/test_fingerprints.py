import hashlib
import random

import numpy as np

from tessera.llm.common import GOLDEN, mix
from tessera.llm.fingerprints import MARK, anchors, fingerprint_neighbours, likeness, sketches, syncmer_anchors

RNG = random.Random(3)
PROSE = [" ".join("".join(RNG.choices(["th", "re", "on", "ing", "é", "ha"], k=RNG.randint(1, 5))) for _ in range(n)) for n in (300, 400, 5, 90, 2, 1000)]
TEXTS = [*PROSE, None, "", "ab", "𝒳y漢" * 40, PROSE[0], PROSE[0]]


def brute(t, k=12, s=5):
    codes = [MARK] * (k - 1) + [ord(c) for c in t]

    def h(xs):
        v = 0
        for i, x in enumerate(xs):
            v = (v * int(GOLDEN) + x if i else x) % 2**64
        return int(mix(np.array([v], np.uint64))[0])

    out = []
    for i in range(len(codes) - k + 1):
        inner = [h(codes[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(codes[i : i + k])))
    return out


def test_anchors_against_brute_force():
    texts = [t or "" for t in TEXTS]
    doc, at, h = anchors(texts)
    for i, t in enumerate(texts[:5] + texts[6:10]):
        i = i if i < 5 else i + 1
        assert list(zip(at[doc == i].tolist(), h[doc == i].tolist(), strict=True)) == brute(t)


def brute_likeness(t, o, size=64):
    """All anchors' hashes, their first places, and the longest common order among the smallest of the union."""
    x, y = {}, {}
    for text, into in ((t, x), (o, y)):
        for at, h in brute(text):
            into.setdefault(h >> 32, at)
    if not t or not o or not x or not y:
        return float(t == o)
    x, y = ({h: z[h] for h in sorted(z)[:size]} for z in (x, y))
    union = sorted({*x, *y})[:size]
    both = sorted((x[h], y[h]) for h in union if h in x and h in y)
    longest = []
    for i, (_, q) in enumerate(both):
        longest.append(1 + max((longest[j] for j in range(i) if both[j][1] < q), default=0))
    return max(longest, default=0) / len(union)


def test_likeness_against_brute_force():
    texts = [*PROSE, "", "ab", "𝒳y漢" * 40, PROSE[0][:800] + PROSE[1][:400], PROSE[1][len(PROSE[1]) // 2 :] + PROSE[1][: len(PROSE[1]) // 2], PROSE[5][:2000] + " new words " + PROSE[5][2000:]]
    found = sketches(texts)
    for i, t in enumerate(texts):
        for j, o in enumerate(texts):
            if len(t) > 11 and len(o) > 11 or t == o or not t or not o:
                assert likeness(found[i], found[j]) == brute_likeness(t, o), (i, j)
    # the same anchors in another order: half of them stay in place
    assert 0.4 < likeness(found[1], found[10]) < 0.75 < 0.85 < likeness(found[5], found[11])


def test_neighbours(spark):
    ids = [7, 3, 100, 50, 51, 9, 1, 2, 4, 60, 8, 999]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, part string").repartition(3)
    rows = {r.doc_id: r for r in fingerprint_neighbours(df).collect()}
    order = sorted(zip(ids, [t or "" for t in TEXTS], strict=True), reverse=True)
    assert len(rows) == len(ids)
    for (i, t), (_, o) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        e = t[: len(t) - n] + o[:n]
        a, b, c = sketches([t, e, o])
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))
        assert (r.fingerprint == "") == (not t)
    assert rows[7].fingerprint == rows[8].fingerprint == rows[999].fingerprint
    assert rows[9].near_edited > 0.25 and rows[9].near_next < 0.2


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint_neighbours(empty).count() == 0 and syncmer_anchors(empty).count() == 0
    one = fingerprint_neighbours(spark.createDataFrame([(5, "abcabc")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcaab").hexdigest() and one[0].near_next == 1.0
    null = spark.createDataFrame([(None, "abc def"), (1, "xyz"), (1, "xyz")], "doc_id long, text string")
    assert fingerprint_neighbours(null).count() == 3
