"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest of its s-mers (by a fixed hash) is its first or its last: a property of
the k-mer alone, so an edit elsewhere never changes it. Texts are led by k - 1 marks that no text holds, so that short texts
have k-mers too. A fingerprint is the sketch of the `size` smallest anchor hashes, each with the place where it first stands.
The likeness of two is the share of the smallest hashes of their union that both hold and that follow each other in one order
in both texts: the estimate of the anchor sets' Jaccard similarity, less what matches out of place.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import GOLDEN, column, mix, only, segments

K, S, SIZE = 12, 5, 64
MARK = 0x110000


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of all texts: the text's number, the k-mer's last code point in it (from 0), and its 64-bit hash.
    k - s + 1 must be a power of two."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lead = k - 1
    firsts = np.cumsum(sizes + lead) - sizes  # where each text's own code points begin
    codes = np.full(int((sizes + lead).sum()), MARK, np.uint64)
    own = np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    codes[own] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes[: len(codes) - s + 1].copy()
    for j in range(1, s):
        small *= GOLDEN
        small += codes[j : len(codes) - s + 1 + j]
    small = mix(small)
    least, width = small, 1
    while width < k - s + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = len(least)
    at = np.flatnonzero((small[:n] == least) | (small[k - s : k - s + n] == least))
    at = at[codes[at + k - 1] != MARK]
    hashes = codes[at]
    for j in range(1, k):
        hashes *= GOLDEN
        hashes += codes[at + j]
    doc = np.searchsorted(firsts, at + k - 1, "right") - 1
    return doc, at + k - 1 - firsts[doc], mix(hashes)


def sketches(texts: list[str], size: int = SIZE, k: int = K, s: int = S) -> list[np.ndarray]:
    """The `size` smallest distinct anchor hashes of each text: the upper 32 bits of each above the 32 of its first place. A text
    without anchors has the hash of its whole, an empty text none."""
    doc, at, hashes = anchors(texts, k, s)
    placed = (hashes >> np.uint64(32) << np.uint64(32)) | np.minimum(at, 2**32 - 1).astype(np.uint64)
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        part = placed[edges[i] : edges[i + 1]]
        few = np.partition(part, 4 * size)[: 4 * size] if len(part) > 4 * size else part
        found = first_places(few)
        if len(found) < size and len(few) < len(part):  # many repeats
            found = first_places(part)
        found = found[:size]
        if not len(found) and t:
            whole = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=4).digest()
            found = np.frombuffer(whole, ">u4").astype(np.uint64) << np.uint64(32)
        out.append(found)
    return out


def first_places(placed: np.ndarray) -> np.ndarray:
    """The first place of each hash, in the order of hashes."""
    placed = np.sort(placed)
    new = np.ones(len(placed), bool)
    new[1:] = placed[1:] >> np.uint64(32) != placed[:-1] >> np.uint64(32)
    return placed[new]


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def in_order(places: list[int]) -> int:
    """The length of the longest run of growing places, others between them left out."""
    ends: list[int] = []
    for p in places:
        i = bisect_left(ends, p)
        ends[i : i + 1] = [p]
    return len(ends)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the smallest `size` hashes of the union that both hold in one order; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y = ({p >> 32: p & 0xFFFFFFFF for p in s.tolist()} for s in (a, b))
    union = sorted(x.keys() | y.keys())[:size]
    both = sorted((x[h], y[h]) for h in union if h in x and h in y)
    return in_order([q for _, q in both]) / len(union)


def edited(text: str, other: str) -> str:
    """text with its last third (rounded down, code points) replaced by the first as many of other, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


#: Text that a range of rows holds at most, about.
RANGE_BYTES = 256 << 20


def in_order_with_next(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows by descending doc_id, dealt to partitions by ranges of it, each followed by a copy of the row after its last
    (is_tail), which after the lowest range is the row with the largest id. No partition needs another to know what follows.

    Quantiles of the ids give the ranges: as many as the session's shuffle partitions, or more where these would hold over
    RANGE_BYTES of text, so that a task's share stays the same as the table grows. Rows that repeat one id are one range.
    """
    spark = docs.sparkSession
    low = -(2**63)
    ids = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(low)).alias("k"))
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    splits = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10 * max(parts, 100)).alias("s")).first().s or []
    edges = np.unique(np.array(splits, np.int64)) if parts > 1 else np.zeros(0, np.int64)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, int] = {}
        for batch in batches:
            k = column(batch, "k").to_numpy(zero_copy_only=False)
            for b in np.unique(where := np.searchsorted(edges, k)):
                best[int(b)] = max(best.get(int(b), low), int(k[where == b].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.int64())], names=["b", "top"])

    # one row for each range at most
    top = {r.b: r.top for r in ids.mapInArrow(tops, "b int, top long").groupBy("b").agg(F.max("top").alias("top")).collect()}
    filled = sorted(top)
    after = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # the range that b's first row is copied to

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches):
            k = column(batch, "k").to_numpy(zero_copy_only=False)
            where = np.searchsorted(edges, k).astype(np.int32)
            first = np.flatnonzero(np.array([top[b] for b in where.tolist()], np.int64) == k)
            rows = pa.array(np.concatenate([np.arange(len(k)), first]))
            to = np.concatenate([where, np.array([after[b] for b in where[first].tolist()], np.int32)])
            tail = np.concatenate([np.zeros(len(k), bool), np.ones(len(first), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(tail), *[column(batch, n).take(rows) for n in ("k", "id", "text")]], names=["part", "is_tail", "k", "id", "text"])

    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(low)).alias("k"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("is_tail", T.BooleanType()), T.StructField("k", T.LongType()), T.StructField("id", docs.schema[doc_id].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(deal, schema).repartitionById(parts, F.col("part")).sortWithinPartitions("is_tail", F.desc("k"), "text")


def fingerprint_neighbours(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs: fingerprints as
    16 hex digits an anchor, its hash and its place.

    The edited text takes its last third from the next row by descending doc_id (after the last: the first). Rows that
    repeat a doc_id follow each other by text; texts are taken whole, some MB of them at a time; a null doc_id comes last; a null text is empty: its fingerprint is the empty
    string, like another empty text (1.0) and unlike any other (0.0). A table of one row is its own next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()

        def out(ids: list, texts: list[str], follow: str) -> pa.RecordBatch:
            others = [edited(t, o) for t, o in zip(texts, [*texts[1:], follow], strict=True)]
            own = sketches([*texts, follow], size)
            new = sketches(others, size)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kind),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in others], pa.string()),
                    pa.array(map(shown, own[:-1]), pa.string()),
                    pa.array(map(shown, new), pa.string()),
                    pa.array([likeness(a, b, size) for a, b in zip(own, new, strict=False)], pa.float64()),
                    pa.array([likeness(a, b, size) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                ],
                names=[doc_id, *NAMES],
            )

        kind = None
        for batch in segments(batches, most=4 << 20):
            kind = column(batch, "id").type
            ids, texts = column(batch, "id").to_pylist(), [t or "" for t in column(batch, "text").to_pylist()]
            n = sum(not x for x in column(batch, "is_tail").to_pylist())
            if held:
                ids, texts, n = [held[0], *ids], [held[1], *texts], n + 1
            if n < len(ids):  # the first tail row follows the last
                if n:
                    yield out(ids[:n], texts[:n], texts[n])
                return
            held = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield out(ids[:-1], texts[:-1], texts[-1])

    kinds = [T.LongType(), *[T.StringType()] * 3, *[T.DoubleType()] * 2]
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(n, k) for n, k in zip(NAMES, kinds, strict=True)]])
    return in_order_with_next(docs, doc_id, text).select("id", "text", "is_tail").mapInArrow(run, schema)


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def syncmer_anchors(docs: DataFrame, k: int = K, s: int = S, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, position, anchor: every closed syncmer of every text, for positional matching (equal anchors at a steady
    distance mark a shared passage). Null and empty texts give no row; repeated rows give theirs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, text, 4 << 20):
            doc, at, h = anchors([t or "" for t in column(batch, text).to_pylist()], k, s)
            yield pa.RecordBatch.from_arrays([column(batch, doc_id).take(pa.array(doc)), pa.array(at), pa.array(h.view(np.int64))], names=[doc_id, "position", "anchor"])

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("position", T.LongType()), T.StructField("anchor", T.LongType())])
    return only(docs, doc_id, text).mapInArrow(run, schema)
