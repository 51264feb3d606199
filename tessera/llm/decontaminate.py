"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by the size class of their shingle sets. A class of up to u shingles gives its items sketches of their
k = u - ceil(t u) + 1 least hashes: a document that holds the share t of an item's shingles misses too few of them to miss
the whole sketch, however long it is, so no leak is lost. Documents that hold a sketch value are verified by the exact
containment of the item's shingles, word by word. Documents are only read, never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, mix, only, segments, stored, text_bytes, window_hashes, word_hashes, words

#: Bytes that end a word: all of ASCII but letters and digits.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False
MULTIPLIER = 0x8EBC6AF09C88C6E3
#: Text of the items that one pass over the documents looks for, in bytes: what is sent to the executors stays under about
#: twice this.
BLOCK_BYTES = 32 << 20


class Shingles:
    """Words of a batch of texts in lower case, and the hashes of all runs of n of them."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.string())))
        self.starts, self.ends, self.first = words(self.data, offsets, OUTSIDE)
        self.hashes = word_hashes(self.data, self.starts, self.ends, outside=OUTSIDE)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of n words within one text, and their hashes."""
        h = window_hashes(self.hashes, n, MULTIPLIER)
        at = np.flatnonzero(self.row[: len(h)] == self.row[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        return at, mix(h[at] + np.uint64(n))

    def shown(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n))


class Index:
    """The sketches of a block of items, as arrays; an item's full shingle set is made from its text when a document holds one of
    its sketch's values, and kept while it is among the KEPT last ones asked for."""

    KEPT = 2048

    def __init__(self, items: list[tuple[int, str | None]], shingle: int, threshold: float):
        s = Shingles(pa.array([t for _, t in items], pa.string()))
        self.items, self.size, self.texts = [], [], []
        sketch: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        by_n = {n: s.runs(n) for n in {min(int(c), shingle) for c in np.diff(s.first)} - {0}}
        for i, (item, text) in enumerate(items):
            n = min(int(s.first[i + 1] - s.first[i]), shingle)
            if not n:
                continue
            at, h = by_n[n]
            lo, hi = np.searchsorted(at, [s.first[i], s.first[i + 1]])
            own = np.unique(h[lo:hi])
            number, q = len(self.items), len(own)
            self.items.append(item)
            self.size.append(n)
            self.texts.append(text)
            upper = (1 << (q - 1).bit_length()) if q > 1 else 1  # the largest size in the item's class
            k = upper - math.ceil(threshold * upper - 1e-9) + 1
            values, owners = sketch.setdefault(n, ([], []))
            values.append(own[:k])
            owners.append(np.full(min(k, q), number, np.int32))
        self.threshold = threshold
        #: for each run length: all sketch values in order, and the items that have them
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (values, owners) in sketch.items():
            v, o = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(v, kind="stable")
            self.sketches[n] = (v[order], o[order])
        self.made: dict[int, dict[int, bytes]] = {}

    def own(self, number: int) -> dict[int, bytes]:
        """The hashes and words of an item's shingles."""
        out = self.made.pop(number, None)
        if out is None:
            s, n = Shingles(pa.array([self.texts[number]], pa.string())), self.size[number]
            out = {int(x): s.shown(int(a), n) for a, x in zip(*s.runs(n), strict=True)}
            if len(self.made) >= self.KEPT:
                del self.made[next(iter(self.made))]
        self.made[number] = out
        return out

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item's number, shared shingles, item's shingles) of what meets the threshold."""
        s, out = Shingles(texts), []
        for n, (values, owners) in self.sketches.items():
            at, h = s.runs(n)
            first = np.searchsorted(values, h)
            hit = np.flatnonzero(values[np.minimum(first, len(values) - 1)] == h)
            last = np.searchsorted(values, h[hit], "right")
            pairs = {(row, number) for row, a, b in zip(s.row[at[hit]].tolist(), first[hit], last, strict=True) for number in owners[a:b].tolist()}
            edges = np.searchsorted(at, s.first)
            found: dict[int, dict[int, int]] = {}
            for row, number in sorted(pairs):
                if row not in found:
                    part = slice(edges[row], edges[row + 1])
                    found = {row: dict(zip(h[part].tolist(), at[part].tolist(), strict=True))}
                here, own = found[row], self.own(number)
                shared = sum(x in here and s.shown(here[x], n) == said for x, said in own.items())
                if shared >= self.threshold * len(own) - 1e-9:
                    out.append((row, number, shared, len(own)))
        return sorted(out)


def blocks(items: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The items in blocks of about `most` bytes of text, dealt by a hash of the row; each block alone is on the driver."""
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        found = [(r.item, r.text) for r in part.collect()]
        if found:
            yield sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment: each item of which a document holds `threshold` of the distinct
    shingles. Words are runs of letters, digits and non-ASCII characters, in lower case.

    An item of fewer words is one shingle of all of them; one without words (or null) is nowhere; items with one id and
    several texts are searched each. A null or empty document has nothing; repeated rows give their rows again.
    """

    def search(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in segments(batches, text, 6 << 20):
                found = index.leaks(column(batch, text))
                rows = pa.array([r for r, *_ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [column(batch, doc_id).take(rows), pa.array([index.items[i] for _, i, *_ in found], pa.int64()), *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)], pa.array([s / q for *_, s, q in found], pa.float64())],
                    names=[doc_id, *NAMES],
                )

        return only(docs, doc_id, text).mapInArrow(run, schema)

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(n, T.LongType()) for n in NAMES[:3]], T.StructField("containment", T.DoubleType())])
    out: list[DataFrame] = []
    for block in blocks(items, item_id, item_text, block_bytes):
        found = search(Index(block, shingle, threshold))
        if out:  # of several blocks each result is written before the next block comes to the driver
            out[-1] = stored(out[-1], "leaks") if not hasattr(out[-1], "_tessera_path") else out[-1]
            found = stored(found, "leaks")
        out.append(found)
    return reduce(DataFrame.union, out) if out else docs.sparkSession.createDataFrame([], schema)


NAMES = ("item_id", "n_shared", "n_shingles", "containment")


def drop_leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item as find_leaks() tells; decided where the rows are. Null and empty
    texts stay; repeated rows stay or go together; texts are taken whole. Of several blocks of items each result is written
    before the next block comes to the driver."""

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in segments(batches, text, 6 << 20):
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, *_ in index.leaks(column(batch, text))]] = False
                yield batch.filter(pa.array(clean))

        return run

    out = None
    for block in blocks(items, item_id, item_text, block_bytes):
        before = docs if out is None else stored(out, "clean")
        out = before.mapInArrow(keep(Index(block, shingle, threshold)), docs.schema)
    return docs if out is None else out
