"""Removal of passages that repeat across documents, found through difference-cover anchors.

Every two residues modulo PERIOD have equal shifts into COVER: so if two documents share a run of WINDOW words at any places,
some shift under PERIOD brings both places to cover positions, and the SPAN = WINDOW - PERIOD + 1 words from there on agree.
Only at cover positions (6 of 31) are runs of SPAN words hashed. Anchors that two documents share are candidates; around them
all windows of WINDOW words are hashed in full, and the least document of each window's sequence keeps it.

Nothing is gathered by key: each batch sends one row for each hash, for its least document, and settles the other documents
itself; where in a document a hash stands is found again from its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import GOLDEN, column, mix, only, segments, signed, stored, text_bytes, window_hashes, word_hashes, words

WINDOW = 50
#: A perfect difference set (fixed values): the differences of its members modulo 31 are all residues.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
SPAN = WINDOW - PERIOD + 1
#: Multipliers of the two halves of hashes of word runs.
M1, M2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: The lowest two bits of g: a place to be compared with other batches', or one that is known to be shared.
COMPARE, KNOWN = 0, 1
#: What a hash is of: a run of words, or a whole text.
RUN, WHOLE = 0, -1
# without nulls, so that both readers of the dealt rows see one plan
ROW = T.StructType([T.StructField(n, T.LongType(), False) for n in ("h", "g", "doc", "pos")])


def span_rows(hashes: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signed(a) if a.dtype == np.uint64 else a, pa.int64()) for a in hashes], names=["h", "g", "doc", "pos"])


class Words:
    """The words of a batch of texts as hashes, end to end."""

    def __init__(self, texts: pa.Array, size: int):
        self.data, offsets = text_bytes(texts)
        self.starts, self.ends, self.first = words(self.data, offsets)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        self.rows = len(offsets) - 1
        n = len(self.hashes) - size + 1
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.place = np.arange(len(self.hashes)) - self.first[:-1][self.row]
        #: whether the run of `size` words from each word on stays in its text
        self.fits = self.row[: max(n, 0)] == self.row[size - 1 :] if n > 0 else np.zeros(0, bool)

    def whole(self, multiplier: int) -> np.ndarray:
        """A hash of all words of each text."""
        size = np.diff(self.first)
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, multiplier | 1, np.uint64), dtype=np.uint64)
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers[self.place], out=total[1:])
        return mix((total[self.first[1:]] - total[self.first[:-1]]) ^ size.astype(np.uint64))

    def copies(self, pos: np.ndarray, row: np.ndarray, told: np.ndarray) -> np.ndarray:
        """The texts that a place tells to copy a smaller document's, if the hash told is theirs."""
        out = np.zeros(self.rows, bool)
        told_whole = pos == WHOLE
        out[row[told_whole][signed(self.whole(M1))[row[told_whole]] == told[told_whole]]] = True
        return out


def begins(*keys: np.ndarray) -> np.ndarray:
    """Which of the sorted rows begin a run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def settle(h: np.ndarray, g: np.ndarray, doc: np.ndarray, what: int, both_sides: bool) -> pa.RecordBatch:
    """One row for each (h, g) of a batch, its least document's, and what the batch can settle by itself under keys of their
    own (g says KNOWN): a larger document's hash is a repeat; with both_sides, where another document is enough, the least
    one's too if the batch has two."""
    order = np.lexsort((doc, g, h))
    h, g, doc = h[order], g[order], doc[order]
    one = begins(h, g, doc)
    h, g, doc = h[one], g[one], doc[one]
    new = begins(h, g)
    known = ~new
    if both_sides:
        group = np.cumsum(new) - 1
        shared = np.zeros(int(new.sum()), bool)
        shared[group[~new]] = True
        known = shared[group]
    own = mix(doc[known].view(np.uint64) * GOLDEN + h[known])
    rows = [np.concatenate([h[new], h[known]]), np.concatenate([g[new], spread(own)]), np.concatenate([doc[new], doc[known]])]
    return span_rows([*rows, np.full(len(rows[0]), what, np.int64)])


def within(h: np.ndarray, row: np.ndarray, told: np.ndarray, told_row: np.ndarray) -> np.ndarray:
    """Which (hash, row) pairs are among those told."""
    key = lambda x, r: mix(x ^ mix(r.astype(np.uint64) + np.uint64(1)))
    if not len(told) or not len(h):
        return np.zeros(len(h), bool)
    hit = np.isin(row, np.unique(told_row))
    hit[hit] = np.isin(key(h[hit], row[hit]), key(told.view(np.uint64), told_row))
    return hit


def spread(own: np.ndarray) -> np.ndarray:
    """Second halves that say KNOWN (bit 0 set, bit 1 clear) and differ, so that known rows of one hash part."""
    return own << np.uint64(2) | np.uint64(KNOWN)


def second(h: np.ndarray) -> np.ndarray:
    """A second half that never says KNOWN."""
    return h | np.uint64(3)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """Rows (h, g, doc, pos) of anchors at cover positions (g = COMPARE) and of whole texts (pos = WHOLE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, most=8 << 20):
            doc = column(batch, "doc_id")
            has = ~np.asarray(doc.is_null())
            doc = doc.fill_null(0).to_numpy(zero_copy_only=False)
            w = Words(column(batch, "text"), SPAN)
            size = np.diff(w.first)
            long = np.flatnonzero(has & (size >= WINDOW))
            place = w.place
            whole = [w.whole(M1)[long], second(w.whole(M2)[long])]
            d = doc[long]
            order = np.lexsort((d, whole[1], whole[0]))
            copy = np.zeros(w.rows, bool)  # of a text of this batch in a smaller or the same document
            copy[long[order[~begins(whole[0][order], whole[1][order])]]] = True
            yield settle(whole[0], whole[1], d, WHOLE, False)
            h = window_hashes(w.hashes, SPAN, M1)
            if len(h):
                usable = has & (size >= WINDOW) & ~copy
                at = np.flatnonzero(w.fits & np.isin(place[: len(h)] % PERIOD, COVER) & usable[w.row[: len(h)]])
                yield settle(h[at], np.full(len(at), COMPARE, np.uint64), doc[w.row[at]], RUN, True)

    return only(docs, "doc_id", "text").mapInArrow(run, ROW)


def shared_places(rows: DataFrame, both_sides: bool) -> DataFrame:
    """doc, pos (what it is of) and h of the rows that are known or whose (h, g) other documents hold: any, or a smaller one.

    The rows are dealt by (h, g) once; what documents share is summed up there and the rows pass it by, so that no task holds
    the rows of a hash, however many there are."""
    dealt = rows.repartition("h", "g", "pos")
    heads = dealt.groupBy("h", "g", "pos").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
    heads = heads.select(F.col("h").alias("h_"), F.col("g").alias("g_"), F.col("pos").alias("pos_"), "least").hint("shuffle_hash")
    other = F.col("doc") > F.col("least")
    if both_sides:
        other = F.col("least").isNotNull() & (other | (F.col("pos") != WHOLE))
    found = dealt.join(heads, (F.col("h") == F.col("h_")) & (F.col("g") == F.col("g_")) & (F.col("pos") == F.col("pos_")), "left")
    return found.where((F.col("g").bitwiseAND(F.lit(3)) == KNOWN) | other).select("doc", "pos", "h")


def places_by_document(places: DataFrame) -> DataFrame:
    """A row for each document: its shared hashes and what they are of, as many at most as it has words."""
    return places.groupBy(F.col("doc").alias("d")).agg(F.collect_list("pos").alias("pos"), F.collect_list("h").alias("h"))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and the row of each."""
    lists = col.fill_null([]) if col.null_count else col
    n = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def window_rows(joined: DataFrame) -> DataFrame:
    """Rows of all windows around candidate anchors; a text that copies a smaller document's has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, most=8 << 20):
            w = Words(column(batch, "text"), WINDOW)
            doc = column(batch, "doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            pos, row = flat(column(batch, "pos"))
            copy = w.copies(pos, row, flat(column(batch, "h"))[0])
            h = window_hashes(w.hashes, SPAN, M1)
            at = np.flatnonzero((w.row[: len(h)] == w.row[SPAN - 1 :]) & np.isin(w.place[: len(h)] % PERIOD, COVER) & ~copy[w.row[: len(h)]]) if len(h) else np.zeros(0, np.int64)
            told = flat(column(batch, "h"))[0][pos == RUN]
            at = at[within(h[at], w.row[at], told, row[pos == RUN])]
            # a window contains an anchor at p if it begins in [p - PERIOD + 1, p]
            mark = np.zeros(len(w.hashes) + 1, np.int32)
            np.add.at(mark, np.maximum(at - PERIOD + 1, w.first[:-1][w.row[at]]), 1)
            np.add.at(mark, at + 1, -1)
            h = window_hashes(w.hashes, WINDOW, M1)
            if not len(h):
                continue
            at = np.flatnonzero((np.cumsum(mark)[: len(h)] > 0) & w.fits)
            if len(at):
                g = window_hashes(w.hashes, WINDOW, M2)
                yield settle(h[at], second(g[at]), doc[w.row[at]], RUN, False)

    return joined.select("doc_id", "text", "pos", "h").mapInArrow(run, ROW)


def removed(w: Words, pos: np.ndarray, row: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which words are covered by repeated windows: all of a copied text, else those of windows whose hash is told."""
    out = w.copies(pos, row, told)[w.row]
    h = window_hashes(w.hashes, WINDOW, M1)
    at = np.flatnonzero(w.fits)
    at = at[within(h[at], w.row[at], told[pos == RUN], row[pos == RUN])]
    mark = np.zeros(len(w.hashes) + 1, np.int32)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + WINDOW, -1)
    return out | (np.cumsum(mark)[:-1] > 0)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for each row of docs: its words without those that a window covers whose words
    also begin in a document of smaller doc_id; kept words are joined by one space.

    Windows are judged on the input. A repeat within one document stays, as do texts under WINDOW words. A null text has no
    words; rows with a null doc_id keep all and take nothing from others; rows that repeat a doc_id count as one document.
    """
    # without aliases where none are needed: they would keep Spark from seeing that both joins read one shuffle
    plain = (doc_id, text) == ("doc_id", "text") and docs.schema["doc_id"].dataType == T.LongType()
    base = docs.select("doc_id", "text") if plain else docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    candidates = stored(places_by_document(shared_places(anchor_rows(base), True)), "candidates")
    # one shuffle of the texts, read by both joins: the same plan in both, as null ids are set apart
    dealt = base.where("doc_id is not null").repartition(F.col("doc_id"))
    around = dealt.join(candidates.hint("shuffle_hash"), F.col("doc_id") == F.col("d"))
    copies = candidates.where(F.array_contains("pos", F.lit(WHOLE).cast("long"))).select(F.col("d").alias("doc"), F.explode(F.arrays_zip("pos", "h")).alias("p")).select("doc", "p.pos", "p.h").where(F.col("pos") == WHOLE)
    repeats = places_by_document(shared_places(window_rows(around), False).union(copies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, most=8 << 20):
            texts = column(batch, "text")
            w = Words(texts, WINDOW)
            pos, row = flat(column(batch, "pos"))
            told, _ = flat(column(batch, "h"))
            gone = removed(w, pos, row, told)
            n_gone = np.bincount(w.row[gone], minlength=w.rows)
            kept = []
            for i, t in enumerate(texts.to_pylist()):
                parts = (t or "").encode().split()
                if n_gone[i]:
                    mask = gone[w.first[i] : w.first[i + 1]]
                    parts = [p for p, g in zip(parts, mask.tolist(), strict=True) if not g]
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.diff(w.first)), pa.array(n_gone), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    joined = dealt.join(repeats.hint("shuffle_hash"), F.col("doc_id") == F.col("d"), "left").select("doc_id", "text", "pos", "h")
    joined = joined.union(base.where("doc_id is null").withColumns({"pos": F.lit(None).cast("array<long>"), "h": F.lit(None).cast("array<long>")}))
    out = joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
    return out.select(F.col("doc_id").alias(doc_id), "n_words", "n_removed", "kept_text")
