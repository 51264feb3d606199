import re

import duckdb

import corpus_pipeline
from tessera.llm.common import read_table
from tests.llm.test_decontaminate import brute

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = read_table(spark, DATA, "documents")
    columns, labels = docs.columns, dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet'").fetchall()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, DATA)
        assert docs.columns == (columns if name != "mixing" else [*columns, "mix_copies"])
        after = {r.doc_id: r for r in docs.collect()}
        seen[name] = (before, after)
        assert set(after) <= set(before)
    before, after = seen["quality"]
    assert sum(labels[d] == 1 and d not in after for d in labels if d in before) <= 2 and sum(labels[d] == 0 and d in after for d in labels) <= 2
    before, after = seen["near_dedup"]
    least = {}
    for d, r in sorted(before.items()):
        least.setdefault(r.text, d)
    assert not any(least[before[d].text] != d for d in after)
    before, after = seen["decontamination"]
    bad = {d for d, *_ in brute([(d, r.text) for d, r in before.items()], items)}
    assert set(after) == set(before) - bad
    before, after = seen["secrets"]
    assert set(after) == set(before)
    for d, r in after.items():
        assert (r.text == before[d].text) or "[secret]" in r.text and r.n_chars == len(r.text)
        assert not re.search(r"[0-9a-f]{32}", r.text or "")
    before, after = seen["mixing"]
    assert all(r.mix_copies in (1, 2) for r in after.values())


def test_run_equals_its_stages(spark):
    docs = read_table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect()))
