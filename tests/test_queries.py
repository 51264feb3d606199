"""Every query against the SQL it must agree with, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows, columns = df.collect(), sorted(df.columns)
    assert rows, "no rows"
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, (columns, different[:3], len(different))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
