import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.simhash import ball_edges, fingerprints, hex_fingerprint, simhash_components


def brute_fp(t):
    w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_documents(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choices(["The", "of", "é", "then", "ER", "x"], k=rng.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    texts = [None, "", " \t\n", "ÀB cd Ef", *base, *base[:20], *[t + " tail" for t in base], *[t.upper() for t in base[:9]], "one " * 30000]
    rows = [(i * 7 % 1009, t, "c", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(3)
    got = {r.doc_id: r for r in simhash_components(df).withColumn("hex", hex_fingerprint(F.col("fp"))).collect()}
    fp = {d: brute_fp(t) for d, t, *_ in rows}
    ids = list(fp)
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert len(got) == len(rows)
    for d in ids:
        assert (got[d].hex, got[d].component_id) == (f"{fp[d]:016x}", want[d])


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_ball_hashing_finds_all_links(spark, radius):
    rng = random.Random(9)
    fps = set()
    for _ in range(60 if radius < 3 else 12):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {tuple(sorted(r)) for r in ball_edges(df, radius).collect()}
    true = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= radius}
    assert got <= true and components(signed, got) == components(signed, true)


def test_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in components({x for e in edges for x in e}, edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(empty).count() == 0 and fingerprints(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (None, "other words here now"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash_components(df).collect()) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
