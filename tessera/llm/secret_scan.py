"""Secrets in text: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of a character class. A window slides over each; the counts of its characters change by one in
and one out, and so does the sum of c * log2(c) that gives the entropy. Windows at or over the class's threshold are joined
into spans; runs that the allow-list explains as a whole are suppressed, and of other runs the tokens that hold a placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, only, segments

#: Fixed patterns of the base kinds, with the least length of the given group.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Units of entropy times window in a bit.
UNIT = 1 << 40
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "entropy")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@dataclass(frozen=True)
class CharClass:
    """A character class for candidates: its letters (as between the brackets of a pattern), the window, the least entropy of a window in bits, how many of
    lower case, upper case and digits a window must mix, and its least number of digits (one alone often ends a plain name)."""

    name: str
    letters: str
    window: int
    bits: float
    mixed: int
    digits: int = 0


@dataclass(frozen=True)
class EntropyRules:
    classes: tuple[CharClass, ...] = (
        CharClass("hex", "0-9A-Fa-f", 24, 3.0, 2),
        CharClass("lower", "a-z0-9", 20, 3.4, 2, 2),
        CharClass("upper", "A-Z0-9", 20, 3.4, 2),
        CharClass("base64", "A-Za-z0-9+/_=\\-", 20, 3.75, 3),
    )
    #: Runs explained otherwise as a whole: UUIDs, numbers, paths and dashed words.
    allow: tuple[str, ...] = (
        r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
        r"[0-9+/_=-]+",
        r"[A-Za-z]*(?:[/_-][A-Za-z]*)+",
    )
    #: Words of placeholders: the token between '/', '_', '=' or '-' that holds one is left out, the rest of its run is not.
    placeholders: tuple[str, ...] = ("example", "placeholder", "changeme", "abcdefghij", "0123456789", "xxxxxx")
    literals: frozenset[str] = field(default_factory=frozenset)


def windows_over(run: str, size: int, bits: float, mixed: int, digits: int = 0) -> list[tuple[int, int]]:
    """Spans of run covered by windows of `size` characters with at least `bits` of entropy and `mixed` kinds of character,
    of which `digits` digits."""
    if len(run) < size:
        return []
    # in whole units, so that sums that change by steps don't drift
    xlog = [0, *[round(c * math.log2(c) * UNIT) for c in range(1, size + 2)]]
    most = math.floor((math.log2(size) - bits) * size * UNIT)
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in run]
    counts: dict[str, int] = {}
    kinds = [0, 0, 0, 0]
    summed, found = 0, []
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        summed += xlog[n + 1] - xlog[n]
        counts[c] = n + 1
        kinds[kind[i]] += 1
        if i >= size:
            old = run[i - size]
            n = counts[old]
            summed += xlog[n - 1] - xlog[n]
            counts[old] = n - 1
            kinds[kind[i - size]] -= 1
        if i >= size - 1 and summed <= most and sum(map(bool, kinds[:3])) >= mixed and kinds[2] >= digits:
            a, b = i - size + 1, i + 1
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], b)
            else:
                found.append((a, b))
    return found


class Scanner:
    def __init__(self, rules: EntropyRules):
        self.rules = rules
        self.runs = [(c, re.compile(f"[{c.letters}]{{{c.window},}}")) for c in rules.classes]
        self.allow = re.compile("|".join(f"(?:{a})" for a in rules.allow)) if rules.allow else None
        self.token = re.compile("[^/_=-]+")
        self.placeholder = re.compile("|".join(map(re.escape, rules.placeholders)), re.I) if rules.placeholders else None
        # every run of a class lies in one of all classes' letters, as long as the shortest window
        self.any = re.compile(f"[{''.join(c.letters for c in rules.classes)}]{{{min(c.window for c in rules.classes)},}}") if rules.classes else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for k, (name, pattern, group, least) in enumerate(BASE):
            if name == "hex":
                pattern = HEX_RUN  # the same runs: a maximal run under 32 characters fails in either
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
        return sorted(out)

    def parts(self, text: str, start: int, end: int) -> Iterator[tuple[int, str]]:
        """What is left of a run without the tokens that hold a placeholder, with the place of each part."""
        run = text[start:end]
        if self.placeholder is not None and self.placeholder.search(run):
            at = 0
            for t in self.token.finditer(run):
                if self.placeholder.search(t[0]):
                    yield start + at, run[at : t.start()]
                    at = t.end()
            yield start + at, run[at:]
        else:
            yield start, run

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        spans = []
        for c, pattern in self.runs:
            for m in pattern.finditer(text):
                run = m[0]
                if run in self.rules.literals or self.allow is not None and self.allow.fullmatch(run):
                    continue
                for at, part in self.parts(text, m.start(), m.end()):
                    spans += [(at + a, at + b) for a, b in windows_over(part, c.window, c.bits, c.mixed, c.digits)]
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return [(a, 3, b) for a, b in joined if not any(s <= a and b <= e for s, _, e in base)]

    def scan(self, text: str) -> tuple[list, list]:
        base = self.base(text)
        more = self.entropy(text, base) if self.any is not None and self.any.search(text) else []
        return base, sorted(base + more)


def shown(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, rules: EntropyRules = EntropyRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of (kind, start, end) in code points, ordered by start, then kind.

    base holds the fixed patterns' matches, spans these and the entropy method's that no base span covers. A null or empty
    text has none; repeated rows give a row each; equal starts are ordered assign, access, hex, entropy. Texts are taken whole,
    some MB of them at a time, in time linear in their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in segments(batches, text, 4 << 20):
            both = [s.scan(t or "") for t in column(batch, text).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([column(batch, doc_id), *cols], names=[doc_id, "base", "spans"])

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("base", SPAN), T.StructField("spans", SPAN)])
    return only(docs, doc_id, text).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[secret]", rules: EntropyRules = EntropyRules(), text: str = "text") -> DataFrame:
    """docs with each secret in `text` replaced by `mark` (overlapping spans by one mark); all columns and rows stay, a null
    text stays null. An n_chars column of whole numbers, where there is one, is counted anew for texts that changed. Repeated rows
    change alike; texts are taken whole, some MB of them at a time."""
    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, T.IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(rules)
        for batch in segments(batches, text, 4 << 20):
            old = column(batch, text).to_pylist()
            new = [t if t is None else redact(t, s.scan(t)[1], mark) for t in old]
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            cols[text] = pa.array(new, cols[text].type)
            if counted:
                cols["n_chars"] = pa.array([n if t == o else len(t) for n, t, o in zip(cols["n_chars"].to_pylist(), new, old, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def secret_digest(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: find_secrets() as one line a document."""
    found = find_secrets(docs, rules)
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
