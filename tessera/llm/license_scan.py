"""Licence notices by exact set-similarity join of text blocks with licence templates.

Tokens are ordered by their frequency over the whole corpus, rarest first. A block can hold a share t of a template's tokens
only if it holds one of the template's first |T| - ceil(t |T|) + 1 tokens (prefix filter), has at least ceil(t |T|) tokens
(length filter), and if at the first token found enough of the template is still left (positional filter). What passes is
counted exactly. Blocks: for templates of up to w words, the words [k w, (k + 2) w), so that any run of w words lies in one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import LOWER, column, only, segments

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: int(LOWER[c]) for c in range(0x41, 0x5B)}
#: Phrases whose words in a row name a licence (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Usual notices of well-known licences (fixed values).
TEMPLATES = (
    Template("mit", "Released under the MIT License"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2"),
    Template("lgpl-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    Template("lgpl-3", "licensed under the GNU Lesser General Public License, version 3"),
    Template("agpl-3", "licensed under the GNU Affero General Public License, version 3"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: str | None) -> list[str]:
    """Words of a text with A-Z lower-cased."""
    return WORD.findall((text or "").translate(FOLD))


@dataclass(frozen=True)
class Prepared:
    """A template with its tokens in global order."""

    label: str
    tokens: tuple[str, ...]
    need: int
    width: int


class Matcher:
    """Templates by the tokens of their prefixes."""

    def __init__(self, templates: tuple[Template, ...], order: dict[str, int], threshold: float):
        self.templates: list[Prepared] = []
        self.by_token: dict[str, list[int]] = {}
        for t in templates:
            n_words = len(words_of(t.text))
            tokens = tuple(sorted(set(words_of(t.text)), key=lambda w: (order.get(w, 0), w)))
            need = math.ceil(threshold * len(tokens) - 1e-9)
            for w in tokens[: len(tokens) - need + 1]:
                self.by_token.setdefault(w, []).append(len(self.templates))
            self.templates.append(Prepared(t.label, tokens, need, max(8, 1 << (n_words - 1).bit_length())))

    def blocks(self, words: list[str]) -> Iterator[tuple[Prepared, int, int, float]]:
        """Each block of the text that meets a template's threshold: the template, the block's first word and the one after its
        last, and the containment."""
        hits: dict[int, set[int]] = {}
        by_token = self.by_token.get
        for i, w in enumerate(words):
            for number in by_token(w, ()):
                at = i // self.templates[number].width
                hits.setdefault(number, set()).update((max(at - 1, 0), at))
        for number, found in hits.items():
            t = self.templates[number]
            for k in found:
                block = set(words[k * t.width : (k + 2) * t.width])
                if len(block) < t.need:
                    continue
                first = next((i for i, w in enumerate(t.tokens) if w in block), len(t.tokens))
                if len(t.tokens) - first < t.need:
                    continue
                overlap = sum(w in block for w in t.tokens)
                if overlap >= t.need:
                    yield t, k * t.width, (k + 2) * t.width, overlap / len(t.tokens)


def best_labels(matches: list[tuple[Prepared, int, int, float]]) -> set[str]:
    """The labels of the matches that no better match overlaps: one of more containment or, of the same, of more tokens (the
    notice of a licence whose name holds another's). Of ties each is named."""
    out: set[str] = set()
    better: list[tuple[int, int]] = []  # spans of matches better than the ones looked at
    ranked = sorted(((share, len(t.tokens), lo, hi, t.label) for t, lo, hi, share in matches), reverse=True)
    for _, ties in groupby(ranked, key=lambda m: m[:2]):
        spans = list(ties)
        out |= {label for *_, lo, hi, label in spans if not any(a < hi and lo < b for a, b in better)}
        better = joined([*better, *[(lo, hi) for _, _, lo, hi, _ in spans]])
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def phrase_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand in a row."""
    line, out = f" {' '.join(words)} ", []
    for phrase, label in PHRASES:
        at, word, counted = line.find(f" {phrase} "), -1, 0
        while at >= 0:
            word += line.count(" ", counted, at + 1)
            counted = at + 1
            out.append((word, label))
            at = line.find(f" {phrase} ", at + 1)
    return sorted(out)


def token_order(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> dict[str, int]:
    """How often each template token stands in all texts: at most one row for each of these tokens reaches the driver."""
    wanted = frozenset(w for t in templates for w in words_of(t.text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in segments(batches, text, 4 << 20):
            for t in column(batch, text).to_pylist():
                total.update(filter(wanted.__contains__, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    counted = only(docs, text).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in counted.collect()}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base: places of the fixed phrases, first_word and last_word their smallest and largest first word (null without any);
    labels: theirs and those of templates of which a block holds `threshold` of the distinct tokens, but where such blocks
    overlap only the best ones (the largest share, then the most tokens; of ties each); score: 1 with a phrase, else the largest share of a template that
    meets `threshold` in a block, else 0. A null or empty text has no words; repeated rows give a row each; equal labels are
    named once. Texts are taken whole, some MB of them at a time, in time linear in their words.
    """
    matcher = Matcher(templates, token_order(docs, templates, text), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, text, 4 << 20):
            rows = []
            for t in column(batch, text).to_pylist():
                words = words_of(t)
                places = phrase_places(words)
                base = {label for _, label in places}
                matches = list(matcher.blocks(words))
                score = 1.0 if places else max((share for *_, share in matches), default=0.0)
                rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | best_labels(matches))), score))
            cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([column(batch, doc_id), *[pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)]], names=[doc_id, *NAMES])

    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *[T.StructField(n, T.LongType()) for n in NAMES[:4]], *[T.StructField(n, T.StringType()) for n in NAMES[4:6]], T.StructField("score", T.DoubleType())])
    return only(docs, doc_id, text).mapInArrow(run, schema)


NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
KINDS = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64())
