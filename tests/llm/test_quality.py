import math
import re
import zlib

import duckdb
import numpy as np

from tessera.llm.common import text_bytes
from tessera.llm.quality import FEATURES, keep_good, quality_scores, statistics

DATA = "/root/testdata/sf0.01"


def auc(y, s):
    r = np.argsort(np.argsort(s, kind="stable")) + 1.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    truth = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    held = [r for d, r in rows.items() if d in truth and r.held_out]
    y, s = np.array([truth[r.doc_id] for r in held]), np.array([r.score for r in held])
    print("held-out AUC", auc(y, s), "accuracy", np.mean([r.predicted == truth[r.doc_id] for r in held]))
    assert auc(y, s) > 0.9 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here.", "s"), (2, None, "s"), (3, "", "s"), (3, "", "s"), (None, "x " * 50000, "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality_scores(docs, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_scores(docs, labels).count() == 5 and quality_scores(docs.limit(0), labels).count() == 0
    assert keep_good(docs, none).columns == docs.columns and keep_good(docs, none).count() == 5


def test_other_names(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i + 1), 0.5) for i in range(20)], "id long, label string, x double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    got = quality_scores(docs, labels, target="y", doc_id="id", text="label")
    assert got.columns == ["id", "held_out", "score", "predicted"] and got.count() == 20


def test_statistics_are_finite_and_each_texts_own():
    import pyarrow as pa

    texts = ["", None, "  \n ", "a", "A!! B!! " * 3000, "é ü\nñ", "word " * 3]
    x = statistics(*text_bytes(pa.array(texts)))
    assert x.shape == (7, len(FEATURES)) and np.isfinite(x).all()
    for i, t in enumerate(texts):
        assert np.allclose(x[i], statistics(*text_bytes(pa.array([t], pa.string())))[0])


def features(text):
    """The statistics of one text, counted one by one."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    share = lambda part, whole: math.log((part + 0.25) / (whole + 1.0))
    n, lengths = len(words), [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean * mean, 0))
    open_end = lambda c: c >= 0x80 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A
    out = [math.log1p(n), math.log1p(mean), math.log1p(spread), share(sum(x <= 3 for x in lengths), n), share(sum(x >= 16 for x in lengths), n), share(len(set(words)), n), share(sum(not open_end(w[-1]) for w in words), n), math.log1p(n / (data.count(b"\n") + 1))]
    for letters in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)), b".,;:", b"!?", b"|<>\\/_=~^", b"#$%&*@+", b"\n", b"'\"()[]{}-`"):
        out.append(share(sum(data.count(c) for c in letters), len(data)))
    return out


def test_scores_equal_brute_force(spark):
    """Shrunk covariances, log densities by determinants and inverses, and the link, all anew in NumPy."""
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()
    truth = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    x = np.array([features(t) for _, t in docs])
    import pyarrow as pa

    assert np.allclose(x, statistics(*text_bytes(pa.array([t for _, t in docs], pa.string()))), atol=1e-9)
    train = np.array([d in truth and zlib.crc32(str(d).encode()) % 5 != 0 for d, _ in docs])
    y = np.array([truth.get(d, -1) for d, _ in docs])
    n = [int((train & (y == k)).sum()) for k in (0, 1)]
    means = [x[train & (y == k)].mean(0) for k in (0, 1)]
    covs = [np.cov(x[train & (y == k)].T, bias=True) for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    logs = []
    for k in (0, 1):
        a = min(1.0, 0.1 + 18 / (n[k] + 18))
        c = (1 - a) * covs[k] + a * pooled
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(18)
        d = x - means[k]
        logs.append(-0.5 * (d @ np.linalg.inv(c) * d).sum(1) - 0.5 * np.linalg.slogdet(c)[1])
    d = logs[1] - logs[0] + math.log((n[1] + 1) / (n[0] + 1))
    margin = np.sign(d) * np.log1p(np.abs(d))
    middle = (np.clip(((margin[train] + 10) / 20 * 400).astype(int), 0, 399) + 0.5) / 400 * 20 - 10
    w = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-(w[0] * middle + w[1])))
        g = np.array([((q - y[train]) * middle).sum() + 0.1 * (w[0] - 1), (q - y[train]).sum() + 0.1 * w[1]])
        v = q * (1 - q)
        w = w - np.linalg.solve(np.array([[(v * middle**2).sum() + 0.1, (v * middle).sum()], [(v * middle).sum(), v.sum() + 0.1]]), g)
    want = dict(zip([i for i, _ in docs], 1 / (1 + np.exp(-(w[0] * margin + w[1]))), strict=True))
    got = quality_scores(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert len(got) == len(docs) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
