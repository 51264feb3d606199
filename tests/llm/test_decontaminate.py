import random
import re

import pytest

from tessera.llm.decontaminate import drop_leaks, find_leaks


def tokens(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(rows, items, n=5, t=0.8):
    out = []
    for i, text in items:
        w = tokens(text)
        k = min(n, len(w))
        if not k:
            continue
        own = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, doc in rows:
            v = tokens(doc)
            shared = len(own & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)})
            if shared >= t * len(own) - 1e-9:
                out.append((d, i, shared, len(own), shared / len(own)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["th", "Re", "é", "on", "X"], k=rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 6, 14, 30, 59, 200])))) for i in range(25)] + [(90, None), (91, ""), (92, "!!! ??"), (93, "One two, three four FIVE six")]
    rows = []
    for d in range(120):
        w = [word() for _ in range(rng.choice([0, 2, 30, 300]))]
        for _ in range(rng.randint(0, 2)):
            p = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if p:
                    p[rng.randrange(len(p))] = word()
            at = rng.randint(0, len(w))
            w[at:at] = [x + rng.choice(["", "", ",", "&&&"]) for x in p]
        rows.append((d, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, "x one two three: FOUR five six " + "pad " * 20000)], items


def test_against_brute_force(spark, tables):
    rows, items = tables
    df = spark.createDataFrame([(d, t, "c", 0.5) for d, t in rows], "doc_id long, text string, item_id string, containment double").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) > 40
    assert sorted(map(tuple, find_leaks(df, it).collect())) == want
    assert sorted(map(tuple, find_leaks(df, it, block_bytes=400).collect())) == want
    bad = {d for d, *_ in want}
    for size in (1 << 20, 400):
        kept = drop_leaks(df, it, block_bytes=size)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [d for d, _ in rows if d not in bad]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0 and drop_leaks(docs, items).count() == 1
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert find_leaks(docs.union(docs), spark.createDataFrame([(1, "a B! c d e"), (1, "a B! c d e")], "item_id long, text string")).count() == 2
