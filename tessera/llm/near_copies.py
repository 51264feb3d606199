"""One document of each group of near copies: SimHash candidates by ball hashing, verified by exact 5-word shingles.

Copies with a few words changed keep most of their 5-word shingles but move several bits of a fingerprint of these; so the
fingerprints that the ball hashing of simhash.py links are taken over single words. A 64-bit fingerprint still can't reach
every pair at a Jaccard similarity of 0.8 (see the README), and what shares a ball may be unrelated. So all documents
also meet in MinHash bands: 24 keys of 5 hashes, in which two texts at the threshold share a key with a probability of 0.9999.

Each group of candidates is a star on its least member, linear in the group. In a group that isn't connected after that
(texts of one passage, or around one text that all differ from) a pair may have missed each other; its members meet again
under every two of their keys together and in other stars, which part them down to those that share what is their own.

Every link is verified: texts whose distinct shingles fit the sketch by these, others by a sketch of their least hashes with
room for its error and then by all their shingles. Nothing under the threshold is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, column, drop_stored, fresh, mix, segments, signed, stored, text_bytes, window_hashes, word_hashes, words
from tessera.llm.components import connected_components
from tessera.llm.simhash import ball_edges, bit_sums

SIZE = 128  # hashes in a sketch
BANDS, ROWS = 24, 5
RUN, WHOLE = 0x9FB21C651E98DF25, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Odd multipliers, one for each MinHash.
ORDERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Room for the error of a sketch, in standard errors.
ERRORS = 3.5


class Texts:
    """The words of a batch of texts in lower case, as hashes, and the hashes of their shingles, end to end."""

    def __init__(self, texts: pa.Array, shingle: int):
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        s, e, self.first = words(data, offsets)
        self.h = word_hashes(data, s, e)
        n = np.diff(self.first)
        #: a text of fewer words is one shingle of them all
        size = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.runs = np.zeros(self.at[-1], np.uint64)
        of = np.repeat(np.arange(len(n)), size)
        place = np.arange(len(of)) - self.at[:-1][of]
        for k in {min(int(x), shingle) for x in np.unique(n)} - {0}:
            h = window_hashes(self.h, k, RUN)
            own = np.flatnonzero(np.minimum(n, shingle)[of] == k)
            self.runs[own] = mix(h[self.first[:-1][of[own]] + place[own]] + np.uint64(k))

    def words(self, i: int) -> np.ndarray:
        return self.h[self.first[i] : self.first[i + 1]]

    def shingles(self, i: int) -> np.ndarray:
        """The distinct shingles of a text, in order."""
        return np.unique(self.runs[self.at[i] : self.at[i + 1]])

    def __len__(self) -> int:
        return len(self.at) - 1

    def bands(self) -> np.ndarray:
        """A row of BANDS keys for each text that has shingles."""
        has = np.flatnonzero(np.diff(self.at))
        keys = np.zeros((len(has), BANDS), np.uint64)
        if len(has):
            for j, a in enumerate(ORDERS):
                keys[:, j // ROWS] = mix(keys[:, j // ROWS] + np.minimum.reduceat(self.runs * a, self.at[has]) + np.uint64(j))
        return keys


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a text's words."""
    return int(np.packbits(bit_sums(own) * 2 > len(own)).view(np.uint64)[0]) if len(own) else 0


def whole(own: np.ndarray) -> list[int]:
    """Two hashes of a text's words in their order."""
    return [int(window_hashes(own, len(own), m)[0]) if len(own) else 0 for m in WHOLE]


def sketched(docs: DataFrame, shingle: int, doc_id: str, text: str) -> DataFrame:
    """id, w0, w1, fp, n, sketch, bands: hashes of the whole text, its fingerprint, its number of distinct shingles, the least
    SIZE of these (32 bits) and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, "text", 2 << 20):
            t = Texts(column(batch, "text"), shingle)
            keys = t.bands()
            where = np.cumsum(np.diff(t.at) > 0) - 1
            rows = []
            for i in range(len(t)):
                own, sets = t.words(i), t.shingles(i)
                low = np.unique((sets >> np.uint64(32)).astype(np.uint32))[:SIZE]
                rows.append((*whole(own), fingerprint(own), len(sets), low.tobytes(), signed(keys[where[i]]).tolist() if len(sets) else []))
            cols = list(zip(*rows, strict=True))
            hashes = [pa.array(signed(np.array(c, np.uint64))) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *hashes, pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.list_(pa.int64()))], names=["id", "w0", "w1", "fp", "n", "sketch", "bands"])

    return named(docs, doc_id, text).mapInArrow(run, "id long, w0 long, w1 long, fp long, n long, sketch binary, bands array<long>")


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").try_cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")


def shared(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets, given as sorted arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def verdict(a: bytes, b: bytes, similarity: float) -> int:
    """What two sketches tell: 1 alike, -1 not, 0 if all shingles must decide."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if len(x) < SIZE and len(y) < SIZE:  # these are all shingles
        return 1 if shared(x, y) >= similarity - 1e-9 else -1
    union = np.union1d(x, y)[:SIZE]
    estimate = np.isin(union, np.intersect1d(x, y, assume_unique=True)).mean()
    return 0 if estimate >= similarity - ERRORS * (similarity * (1 - similarity) / SIZE) ** 0.5 else -1


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, similarity: float, rows: int) -> DataFrame:
    """The pairs (a, b) of which the distinct shingles are alike, as a stored table. docs: id, text; rows: about how many pairs
    there are at most."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [verdict(x, y, similarity) for x, y in zip(column(batch, "s_a").to_pylist(), column(batch, "s_b").to_pylist(), strict=True)]
            told = np.array(told, np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(told)], names=["a", "b", "told"]).filter(pa.array(told >= 0))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, "text", 2 << 20):
            t = Texts(column(batch, "text"), shingle)
            found = [t.shingles(i) for i in range(len(t))]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(found))))], names=["id", "shingles"])

    def beside(pairs: DataFrame, rows: DataFrame, what: str, *more) -> DataFrame:
        of = lambda n: rows.select(F.col("id").alias(f"id_{n}"), F.col(what).alias(f"s_{n}"), F.col("n").alias(f"n_{n}") if "n" in rows.columns else F.lit(0).alias(f"n_{n}"))
        return pairs.join(of("a"), F.col("a") == F.col("id_a")).join(of("b"), (F.col("b") == F.col("id_b")) & F.expr(" and ".join(["true", *more]))).select("a", "b", "s_a", "s_b")

    # sizes alone part texts that can't be alike
    near = beside(pairs, reps, "sketch", f"least(n_a, n_b) >= {similarity!r} * greatest(n_a, n_b) - 1e-9")
    told = stored(near.mapInArrow(judge, "a long, b long, told int"), "told", rows)
    unsure = told.where("told = 0").select("a", "b")
    ids = stored(unsure.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "ids", rows)
    # distinct: of rows that repeat an id one text was sketched, which may not be this one's; any of them counts
    full = stored(docs.join(ids, F.col("id") == F.col("wanted"), "left_semi").mapInArrow(sets, "id long, shingles array<long>"), "shingles")
    # a row at a time in the JVM, so that long texts never meet in a batch
    both = F.size(F.array_intersect("s_a", "s_b"))
    exact = beside(unsure, full, "shingles").where(both >= (F.size("s_a") + F.size("s_b") - both) * F.lit(similarity) - F.lit(1e-9)).select("a", "b")
    out = stored(told.where("told = 1").select("a", "b").union(exact).distinct(), "links", rows)
    for table in (told, ids, full):
        drop_stored(table)
    return out


def rooted(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows (id, ...) with the root of their component: themselves where they have none."""
    if groups is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(groups, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def star(keyed: DataFrame, order: Column, rows: int) -> DataFrame:
    """a, b: each member of a group (key, id, root) beside the group's first by `order`, if their roots differ. rows: about how
    many members there are at most."""
    heads = keyed.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id"), F.col("root"))).alias("m"), F.min("root").alias("x"), F.max("root").alias("y"))
    heads = stored(heads.where("x <> y").select(F.col("key").alias("k"), F.col("m.id").alias("head"), F.col("m.root").alias("head_root")), "heads", rows)
    pairs = keyed.join(heads, F.col("key") == F.col("k")).where("root <> head_root").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    out = stored(pairs.distinct(), "pairs", rows)
    drop_stored(heads)
    return out


def fingerprint_pairs(reps: DataFrame, radius: int, rows: int) -> DataFrame:
    """a, b: documents of one fingerprint beside its least, and the least of fingerprints that share a ball."""
    least = stored(reps.groupBy("fp").agg(F.min("id").alias("head")).withColumnRenamed("fp", "f"), "least", rows)
    same = reps.select("id", "fp").join(least, F.col("fp") == F.col("f")).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    of = lambda n: least.select(F.col("f").alias(f"f{n}"), F.col("head").alias(f"h{n}"))
    near = ball_edges(least.select(F.col("f").alias("fp")), radius).join(of(1), F.col("a") == F.col("f1")).join(of(2), F.col("b") == F.col("f2"))
    out = stored(same.union(near.select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b"))), "pairs", 2 * rows)
    drop_stored(least)
    return out


def representatives(docs: DataFrame, shingle: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """The least document of each text, sketched, as a stored table; a, b: every other document beside the one of its text; and
    the number of documents."""
    every = sketched(docs, shingle, doc_id, text)
    rows = stored(every.groupBy("id").agg(F.min(F.struct("w0", "w1", "fp", "n", "sketch", "bands")).alias("m")).select("id", "m.*"), "sketches")
    n = rows.count()
    least = stored(rows.groupBy("w0", "w1").agg(F.min("id").alias("head")).select(F.col("w0").alias("v0"), F.col("w1").alias("v1"), "head"), "least", n)
    copies = stored(rows.join(least, (F.col("w0") == F.col("v0")) & (F.col("w1") == F.col("v1"))).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")), "copies", n)
    reps = stored(rows.join(copies.select(F.col("b").alias("c")), F.col("id") == F.col("c"), "left_anti").select("id", "fp", "n", "sketch", "bands"), "reps", 8 * n)
    drop_stored(rows)
    drop_stored(least)
    return reps, copies, n


def _linked(docs: DataFrame, shingle: int, similarity: float, radius: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """copies (a, b) of one text; verified links (a, b) between the least documents of texts; their components (node, root)."""
    reps, copies, n = representatives(docs, shingle, doc_id, text)
    texts = named(docs, doc_id, text)
    by_ball = fingerprint_pairs(reps, radius, n)
    keyed = stored(reps.select("id", F.explode("bands").alias("key")), "keyed", BANDS * n)
    by_band = star(keyed.withColumn("root", F.col("id")), F.col("id"), BANDS * n)
    links = verified(by_ball.union(by_band).distinct(), reps, texts, shingle, similarity, 4 * n)
    drop_stored(by_ball)
    drop_stored(by_band)
    groups = stored(connected_components(links, rows=4 * n), "groups", n)
    # groups that are still in parts: their members meet under each two of their keys, in stars on another member
    roots = stored(rooted(keyed, groups), "rooted", BANDS * n)
    drop_stored(keyed)
    parts = stored(roots.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(F.col("key").alias("k")), "parts", BANDS * n)
    mine = roots.join(parts, F.col("key") == F.col("k")).groupBy("id", "root").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    twos = mine.select("id", "root", F.explode("keys").alias("one"), "keys").select("id", "root", "one", F.explode(F.filter("keys", lambda k: k >= F.col("one"))).alias("two"))
    twos = stored(twos.select("id", "root", F.xxhash64("one", "two").alias("key")), "twos", BANDS * n)
    again = star(twos, F.xxhash64("id", "key"), BANDS * n)
    more = verified(again, reps, texts, shingle, similarity, 4 * n)
    for table in (roots, parts, twos, again, reps):
        drop_stored(table)
    both = groups.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(more)
    joined = stored(connected_components(both, rows=n), "joined", n)
    drop_stored(groups)
    return copies, links.union(more), joined


def near_copy_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b: links between documents of one text, and verified links between the least documents of different texts, which
    connect the groups of near copies; not all pairs of a group."""
    copies, links, groups = _linked(docs, shingle, similarity, radius, doc_id, text)
    drop_stored(groups)
    return copies.union(links)


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, but for those of documents that a chain of texts, each with at least `similarity` of
    the distinct shingles of two neighbours in common, links to one of smaller id.

    Words are runs without ASCII white space, A-Z lower-cased. Texts without words (null, empty) are copies of each other;
    one of fewer words than a shingle is one shingle. Rows that repeat a doc_id are one document, that of the least
    hashes, and stay or go together; rows whose doc_id is null or no integer stay. Texts are taken whole, however long.
    """
    copies, _, groups = _linked(docs, shingle, similarity, radius, doc_id, text)
    gone, key = fresh(docs, "gone"), fresh(docs, "key")
    ids = stored(copies.select(F.col("b").alias(gone)).union(groups.where("node <> root").select("node")), "gone")
    drop_stored(copies)
    drop_stored(groups)
    keyed = docs.withColumn(key, F.col(f"`{doc_id}`").try_cast("long"))
    return keyed.join(ids.hint("shuffle_hash"), F.col(key) == F.col(gone), "left_anti").drop(key)
