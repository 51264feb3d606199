"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing.

Fingerprints within r bits of each other share a variant within r / 2 flips of both. So every distinct fingerprint emits all
variants of up to ceil(r / 2) flips, rows are dealt by variant, and neighbours in a variant's group are verified by their
true distance. A group holds at most the fingerprints in a small ball, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, only, segments, stored
from tessera.llm.components import connected_components

BITS = 64


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `size` words of the text with A-Z lower-cased, joined by one space, repeats included;
    of all words where there are fewer; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(w), max(1, len(w) - size + 1)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts, f = [0, *ends[: n - 1]], xxhash.xxh64_intdigest
    return np.fromiter((f(line[a : b - 1], 42) for a, b in zip(starts, ends[min(size, len(w)) - 1 :], strict=False)), np.uint64, n)


def bit_sums(h: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, in the order that np.packbits and a view as uint64 undo."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 16):
        total += np.unpackbits(np.ascontiguousarray(h[a : a + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def simhash(h: np.ndarray) -> int:
    """Bit by bit, whether over half of the hashes have it set."""
    return int(np.packbits(bit_sums(h) * 2 > len(h)).view(np.uint64)[0]) if len(h) else 0


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp: the 64-bit SimHash of each whole text as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, text):
            fp = np.array([simhash(shingle_hashes(t, shingle)) for t in column(batch, text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, doc_id), pa.array(fp.view(np.int64))], names=[doc_id, "fp"])

    return only(docs, doc_id, text).mapInArrow(run, T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())]))


def flips(most: int) -> list[int]:
    """All masks of up to `most` of 64 bits, as signed numbers."""
    masks = [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(BITS), n)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ball_edges(distinct: DataFrame, radius: int) -> DataFrame:
    """a, b: links between distinct fingerprints (fp) at most `radius` bits apart that connect all that such pairs connect.

    Two at most `radius` apart share a variant that is within radius // 2 flips of one and within the rest of the other. In a
    variant's group, then, every fingerprint links to the least of the nearer kind, if there is one: any such two are within
    the radius, and every pair that the variant brings together is connected through it. A group is a ball around a variant:
    its size is bounded by the number of variants, whatever the number of fingerprints.
    """
    near, far = flips(radius // 2), flips((radius + 1) // 2)
    masks = F.array(*[F.lit(m).cast("long") for m in far])
    variants = distinct.select("fp", F.posexplode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("i", "v"))
    centre = F.min(F.when(F.col("i") < len(near), F.col("fp"))).over(Window.partitionBy("v"))
    pairs = variants.withColumn("centre", centre).where("centre <> fp").select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b")).distinct()
    return pairs.where(distance(F.col("a"), F.col("b")) <= radius)


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for each row of docs: the least doc_id reachable over links of fingerprints that differ in
    `radius` bits or fewer; documents of one fingerprint are linked.

    Texts without words (null, empty, white space) have fingerprint 0, linked like any other. Null doc_ids take part and get
    their component's least id, null if there is none. Repeated rows give a row each. Texts are taken
    whole, some MB of them at a time.
    """
    fps = stored(fingerprints(docs, shingle, doc_id, text).withColumnRenamed(doc_id, "id"), "fingerprints")
    n = fps.count()
    least = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct", n)
    roots = stored(connected_components(ball_edges(least.select("fp"), radius), rows=n), "roots", n)
    joined = least.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "least")
    named = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_fp = joined.select("f", "root").join(named, F.col("root") == F.col("r")).select("f", "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("f")).select(F.col("id").alias(doc_id), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
