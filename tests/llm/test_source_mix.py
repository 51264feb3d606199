import random
import re

import pytest

from tessera.llm.source_mix import mix_documents, pareto_mix


def filled(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {}, set()
    left = share * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in capped]
        if not rest:
            return target
        spent = sum(target[s] for s in capped)
        target |= {s: (left - spent) * w[s] / sum(w[x] for x in rest) for s in rest}
        above = {s for s in rest if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
        capped |= above


def check(spark, rows, near):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    got = pareto_mix(df).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size[r[0]]
    want = filled(sizes)
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        s = source[g.doc_id]
        assert g["size"] == size[g.doc_id] and g.source_size == sizes[s] and g.target == pytest.approx(want[s], rel=1e-9)
        assert g.taken == g["size"] * g.copies and 0 <= g.taken <= 2 * g["size"]
        taken[s] += g.taken
    for s in sizes:
        longest = max(size[d] for d in source if source[d] == s)
        assert abs(taken[s] - want[s]) <= max(near * longest, 1e-6)
    mixed = mix_documents(df)
    assert mixed.columns == [*df.columns, "mix_copies"]
    assert sorted((r.doc_id, r.mix_copies) for r in mixed.collect()) == sorted((g.doc_id, g.copies) for g in got if g.copies)
    again = pareto_mix(df.repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mix_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]), rng.choice(["a", "b", "c", "é", "z", None, "big", "big", "big", "big"]), "t") for i in range(700)]
    check(spark, rows + [(9001, None, "empty", "t"), (9002, " \t", "a", "t"), (9003, "x  y\n\vz" + " q", "b", "t")], 0.51)


def test_few_rows(spark):
    check(spark, [(1, "one two three", "a", "")], 0.51)
    check(spark, [(1, None, None, "")], 1)
    check(spark, [(1, "a b", "x", ""), (2, "c", "y", ""), (3, "d " * 5000, "y", "")], 0.51)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert pareto_mix(empty).count() == 0 and mix_documents(empty).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_inclusion_in_proportion_to_size(spark):
    """Over many seeds each document is sampled as often as its inclusion probability says; the order isn't that of the draws."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), rng.choice("ab")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    size = {d: len(t.split()) for d, t, _ in rows}
    seeds, taken, inclusion = 12, {}, {}
    for seed in range(seeds):
        for r in pareto_mix(df, weights=(3.0, 1.0), share=0.6, seed=seed).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
            inclusion[r.doc_id] = r.inclusion
    by_source = {s: [d for d, _, x in rows if x == s] for s in "ab"}
    for s, want in filled({s: sum(size[d] for d in ids) for s, ids in by_source.items()}, (3.0, 1.0), 0.6).items():
        ids = by_source[s]
        assert sum(inclusion[d] * size[d] for d in ids) == pytest.approx(want, rel=1e-6)
        for n in set(size.values()):
            own = [d for d in ids if size[d] == n]
            p = inclusion[own[0]]
            mean = sum(taken[d] for d in own) / seeds / len(own)
            assert abs(mean - p) < 4 * (p * (1 - p) / seeds / len(own)) ** 0.5 + 0.03, (s, n, p, mean)
    assert max(inclusion.values()) == 1.0 and len(set(inclusion.values())) > 5


def test_many_sources_and_a_clashing_name(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 9), f"h{rng.randrange(300)}", "t") for i in range(900)]
    check(spark, rows, 0.51)
    df = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, source string, mix_copies int")
    assert mix_documents(df).columns == [*df.columns, "_mix_copies"]
