"""Exact token counts of every prefix of a text under a byte-level BPE, by dynamic programming over prefixes.

For a merge-rank BPE the encoding of a prefix is the encoding of a shorter prefix plus one last token: among the tokens that
end there, exactly one forms a pair with the shorter prefix's last token that the merges keep apart. So one pass over the
prefixes of a piece finds the last token and count of each, and counts add up over pieces. The counts of all prefixes are
stored as steps, by how much each code point changes the count; totals, truncation and budget questions are sums of these,
without encoding anything again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import column, only, segments

#: The piece pattern of the tokenizer file's byte-level splitter (a fixed value of the format).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contractions whose own prefixes are split in two pieces.
SPLIT_INSIDE = ("'re", "'ve", "'ll")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts of all prefixes of texts, as the tokenizer file's library would encode each prefix.

    Memory is bounded: the cache of token pairs is emptied at `cache` entries, that of pieces at `cache` times 200 bytes.
    """

    def __init__(self, path: str, cache: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        model = spec["model"]
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        self.specials = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)
        known = set(self.specials)
        self.vocab = {raw(t): i for t, i in model["vocab"].items() if t not in known}
        self.token = {i: t for t, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self.pieces = regex.compile(PIECES).findall
        self.space = regex.compile(r"\s+").fullmatch
        self.runs = regex.compile(r"\s\s").search
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.cache, self.apart = cache, {}
        #: the steps of each piece after a text that doesn't end in white space
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> list[bytes]:
        """The plain merge loop, used only to judge pairs of tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def judge(self, key: int, left: int, right: int) -> bool:
        """Whether the merges keep two tokens apart; for left -1, whether they make the token from its bytes."""
        if len(self.apart) >= self.cache:
            self.apart.clear()
        r = self.token[right]
        out = self.apart[key] = self.merge(r) == [r] if left < 0 else self.merge(self.token[left] + r) == [self.token[left], r]
        return out

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ..., piece: the dynamic programme."""
        known, apart, longest = self.vocab.get, self.apart.get, self.longest
        last, count = [-1], [0]
        for end in range(1, len(piece) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = known(piece[start:end])
                if token is not None:
                    left = last[start]
                    key = left << 20 | token
                    ok = apart(key)
                    if ok or ok is None and self.judge(key, left, token):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return count

    def prefix_list(self, piece: str) -> list[int]:
        """Counts at each code point of a piece, from 1 on, as prefixes that end inside the piece are encoded."""
        by_byte, at, out = self.prefixes(piece.encode()), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(by_byte[at])
        if piece in SPLIT_INSIDE:
            out[1] = self.prefix_list(piece[0])[-1] + self.prefix_list(piece[1])[-1]
        return out

    def learnt(self, piece: str) -> bytes:
        if self.held > 200 * self.cache:
            self.known.clear()
            self.held = 0
        out = self.known[piece] = steps_of(self.prefix_list(piece), 0)
        self.held += 6 * len(piece) + 100
        return out

    def _plain(self, text: str) -> bytes:
        """The steps of a text without special strings."""
        known = self.known
        if not self.runs(text):
            return b"".join([known[p] if p in known else self.learnt(p) for p in self.pieces(text)])
        return self._with_runs(text)

    def _with_runs(self, text: str) -> bytes:
        """As _plain(), where white space may stand in a row: a prefix that ends in such a run sees it as one piece, though its
        last character begins the next piece when the text goes on."""
        out, at, before, last = [], 0, 0, 0  # before: tokens of the pieces so far; last: of the prefix that ends here
        run_at, run_before = -1, 0  # where the run of white space before this place begins
        for p in self.pieces(text):
            own = self.known[p] if p in self.known else self.learnt(p)
            blank = self.space(p) is not None
            lead = len(p) if blank else 1 if self.space(p[0]) else 0
            begins = run_at if run_at >= 0 else at
            if lead and at + lead - begins > 1:
                seen = run_before if run_at >= 0 else last
                values = [seen + n for n in self.prefix_list(text[begins : at + lead])[at - begins :]]
                values += [before + n for n in np.cumsum(np.frombuffer(own, "<i2"))[lead:].tolist()]
                out.append(steps_of(values, last))
            elif last != before:
                out.append(steps_of([before + n for n in np.cumsum(np.frombuffer(own, "<i2")).tolist()], last))
                values = None
            else:
                out.append(own)
                values = None
            if blank:
                if run_at < 0:
                    run_at, run_before = at, last
            else:
                run_at = -1
            before += int(np.frombuffer(own, "<i2").sum())
            last = values[-1] if values else before
            at += len(p)
        return b"".join(out)

    def steps(self, text: str) -> np.ndarray:
        """By how much each code point of the text changes the number of tokens; special strings count as one token each."""
        if self.special is None or not any(s in text for s in self.specials):
            return np.frombuffer(self._plain(text), "<i2")
        out, at = [], 0
        for m in self.special.finditer(text):
            # up to the last letter of a special string a prefix holds only ordinary text
            run = np.frombuffer(self._plain(text[at : m.end() - 1]), "<i2")
            whole = int(np.frombuffer(self._plain(text[at : m.start()]), "<i2").sum()) + 1
            out += [run, np.array([whole - int(run.sum())], "<i2")]
            at = m.end()
        return np.concatenate([*out, np.frombuffer(self._plain(text[at:]), "<i2")])

    def count(self, text: str) -> int:
        return int(self.steps(text).sum())

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text (code points)."""
        return prefix_counts(packed(self.steps(text)), len(text))

    def cut(self, text: str, budget: int) -> int:
        """The length of the longest prefix with at most `budget` tokens."""
        return longest_fit(self.steps(text), budget)


def steps_of(values: list[int], before: int) -> bytes:
    return np.diff(np.array([before, *values], np.int64)).astype("<i2").tobytes()


def longest_fit(steps: np.ndarray, budget: int) -> int:
    """Counts of prefixes are not monotone: the last that fits is asked for."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def packed(steps: np.ndarray) -> bytes:
    """Steps as stored: a signed byte for each code point, or two (little-endian) in a text with a step that needs them."""
    return steps.astype("<i1" if not len(steps) or -128 <= steps.min() and steps.max() <= 127 else "<i2").tobytes()


def prefix_counts(stored: bytes, n_chars: int) -> np.ndarray:
    """The token counts of prefixes of 0, 1, ..., n_chars code points from stored steps."""
    steps = np.frombuffer(stored, "<i1" if len(stored) == n_chars else "<i2")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter in each Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars, prefix_steps: tokens of each whole text, whether they exceed `limit`, the
    length in code points of the longest prefix that keeps to it, and the stored counts of all prefixes, as packed() has them;
    prefix_counts(prefix_steps, length of the text) are the counts, of which the other columns are read.

    A null text is empty (0 bytes, 0 tokens, no steps); repeated rows give a row each; other columns are left out. Texts are
    taken whole, some MB of them at a time. path: a tokenizer file that each executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in segments(batches, text, 4 << 20):
            texts = [t or "" for t in column(batch, text).to_pylist()]
            steps = [c.steps(t) for t in texts]
            n = [int(x.sum(dtype=np.int64)) for x in steps]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, doc_id),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                    pa.array([len(t) if x <= limit else longest_fit(s, limit) for t, x, s in zip(texts, n, steps, strict=True)], pa.int64()),
                    pa.array([packed(s) for s in steps], pa.binary()),
                ],
                names=[doc_id, "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_steps"],
            )

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField(doc_id, kind), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")], T.StructField("over_limit", T.BooleanType()), T.StructField("cut_chars", T.LongType()), T.StructField("prefix_steps", T.BinaryType())])
    return only(docs, doc_id, text).mapInArrow(run, schema)


def prefix_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, prefix_tokens: for each text the token counts of its prefixes of 0, 1, ... code points, stored as array<int>.

    A null text gives [0]. n tokens of a prefix of k code points: prefix_tokens[k]; does it fit: prefix_tokens[k] <= n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in segments(batches, text, 1 << 20):
            texts = column(batch, text).to_pylist()
            for at in range(0, len(texts), 64):
                rows = [c.prefix_counts(t or "") for t in texts[at : at + 64]]
                yield pa.RecordBatch.from_arrays([column(batch, doc_id).slice(at, 64), pa.array(rows, pa.list_(pa.int32()))], names=[doc_id, "prefix_tokens"])

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return only(docs, doc_id, text).mapInArrow(run, schema)
