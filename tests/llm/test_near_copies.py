import random

import numpy as np
import pyarrow as pa

from tessera.llm.common import read_table
from tessera.llm.near_copies import Texts, drop_near_copies, near_copy_links, shared


def shingles(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(x, y):
    return not x and not y or 5 * len(x & y) >= 4 * len(x | y)


def kept(rows):
    """Brute force: the least id of each component of texts alike."""
    texts = {}
    for d, t in sorted(rows):
        texts.setdefault(shingles(t), []).append(d)
    sets = list(texts)
    root = {s: min(texts[s]) for s in sets}
    up = {r: r for r in root.values()}

    def find(i):
        return i if up[i] == i else find(up[i])

    holders = {}
    for s in sets:
        for h in s or [()]:
            holders.setdefault(h, []).append(s)
    pairs = {(a, b) for own in holders.values() for i, a in enumerate(own) for b in own[:i]}
    for a, b in pairs:
        if alike(a, b):
            x, y = sorted((find(root[a]), find(root[b])))
            up[y] = x
    return sorted(r for r in up if find(r) == r)


def found(spark, rows):
    return sorted(r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def word(rng, letters="abcdefgh", k=6):
    return "".join(rng.choices(letters, k=k))


def changed(rng, text, k):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = word(rng, "xyz")
    return " ".join(w)


def test_copies_with_words_changed(spark):
    """Few words changed, some to just under and some to just over the threshold; long and short texts; chains of changes."""
    rng = random.Random(12)
    rows = []
    for n, k, many in ((60, 1, 150), (400, 6, 60), (400, 9, 60), (47, 1, 40), (5, 1, 10), (3, 0, 6), (1500, 30, 8)):
        for _ in range(many):
            t = " ".join(word(rng) for _ in range(n))
            rows += [t, changed(rng, t, k).upper(), t + " more"]
            for _ in range(3):
                rows.append(t := changed(rng, t, max(1, n // 60)))
    rows = list(enumerate(rng.sample(rows, len(rows))))
    assert found(spark, rows) == kept(rows)


def test_texts_ruled_by_one_mark(spark):
    """Such texts share a fingerprint, and their near copies differ in as few bits as the others."""
    rng = random.Random(3)
    texts = [" ".join(f"{word(rng)} |" for _ in range(30)) for _ in range(300)]
    rows = [*texts, *texts, *[changed(rng, t, 1) for t in texts], *[changed(rng, t, 3) for t in texts]]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    assert found(spark, rows) == kept(rows)


def test_texts_of_one_passage(spark):
    """Most of each text is one passage, so that unlike texts share most bands; copies and near copies are found all the same."""
    rng = random.Random(5)
    passage = " ".join(word(rng) for _ in range(75))
    texts = [f"{passage} " + " ".join(word(rng) for _ in range(25)) for _ in range(500)]
    rows = [*texts, *texts[:50], *[changed(rng, t, 2) for t in texts]]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    want, got = kept(rows), found(spark, rows)
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.01 * len(texts), len(set(got) - set(want))


def test_many_copies_around_one_text(spark):
    rng = random.Random(6)
    t = " ".join(word(rng) for _ in range(130))
    rows = [t] * 200 + [changed(rng, t, rng.randint(1, 7)) for _ in range(400)]
    rows = list(enumerate(rng.sample(rows, len(rows))))
    want, got = kept(rows), found(spark, rows)
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 0.01 * len(want), (len(want), len(got))


def test_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == kept(rows)


def test_nulls_repeats_and_names(spark):
    """Null and empty texts are copies; null ids and clashing names stay; repeated rows go together; links are true."""
    rng = random.Random(1)
    t = " ".join(word(rng) for _ in range(100))
    rows = [(1, t, "s"), (2, t + " x", "s"), (2, t + " x", "t"), (None, t, "s"), (5, None, "s"), (6, "", "s"), (7, " \n", "s"), (8, "w " * 40000, "s"), (9, "Ab  c", "s"), (10, "aB c", "s")]
    df = spark.createDataFrame(rows, "id long, words string, _gone string").withColumnsRenamed({"id": "_key"}).repartition(3)
    got = drop_near_copies(df, doc_id="_key", text="words")
    assert got.columns == df.columns
    assert sorted((r._key for r in got.collect()), key=str) == [1, 5, 8, 9, None]
    assert {tuple(r) for r in near_copy_links(df, doc_id="_key", text="words").collect()} == {(1, 2), (5, 6), (5, 7), (9, 10)}
    named = spark.createDataFrame([("1", t), ("x", t), ("3", t)], "doc_id string, text string")
    assert sorted(r.doc_id for r in drop_near_copies(named).collect()) == ["1", "x"]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (3, 5, 40, 40)] + ["", "A b", "a B", None, "a b c d", "a b c d e"]
    t = Texts(pa.array(texts), 5)
    for i, a in enumerate(texts):
        assert len(t.shingles(i)) == len(shingles(a))
        for j, b in enumerate(texts):
            x, y = shingles(a), shingles(b)
            assert abs(shared(t.shingles(i), t.shingles(j)) - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-9
