"""License scans: an exact containment join of token windows against license templates.

Template tokens are put in one global order, rarest in the corpus first (ties by token). A template
is found where a window of a text, SPAN times as long as the template, holds the template's share of
its distinct tokens; nothing else decides. Lines that name a license are told from others of the same
wording by a single word, so their share is 1; texts have CONTAINMENT. Windows run across line ends,
as licenses are wrapped, and are bounded, so scattered words don't count. Such a window must hold one
of the template's first ``n - ceil(share * n) + 1`` tokens (prefix filter); around each of these in
the text there must be enough of those tokens that do not come before it in the order (length and
positional filter: a window whose rarest token is another is looked at from there). In texts that
pass, all windows are counted exactly: a token's place adds to the windows that begin after its last
place before, so one sort gives the distinct tokens of every window. Every place of every text is
looked at.

Words are compared by 64-bit hashes of their folded bytes. Templates are a bounded parameter; the
corpus is read twice, once for token counts and once for the scan, and nothing is shuffled but one
row of counts per task. Defined results: null or empty text has no words, labels "" and score 0; a
label found both by phrase and by template is named once; repeated rows are scanned alike; a null
doc_id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .kernel import PUNCTUATION, Words, pieces, utf8, words

#: The phrases of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a text's distinct words that a window must hold.
CONTAINMENT = 0.8
#: Passages of common licenses, by label.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("cc0", "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved. Unauthorized copying of this file via any medium is strictly prohibited"),
)
#: Lines that name a license, by label.
LINES = (
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("rights-reserved", "All rights reserved"),
)
#: (label, text, share of its distinct words).
TEMPLATES = tuple((label, text, CONTAINMENT) for label, text in TEXTS) + tuple((label, text, 1.0) for label, text in LINES)
#: Words of a window by words of its template.
SPAN = 1.25


def hashed(text: str) -> np.ndarray:
    raw, at = utf8(pa.array([text]))
    return words(raw, at, PUNCTUATION, fold=True).hash


def batch_words(column: pa.Array) -> Words:
    raw, at = utf8(column)
    return words(raw, at, PUNCTUATION, fold=True)


def token_counts(docs: DataFrame, templates=TEMPLATES) -> dict[int, int]:
    """How often each template token stands in the corpus. Each task sends a row per token at most."""
    vocabulary = np.unique(np.concatenate([hashed(t) for _, t, _ in templates]))

    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in pieces(batches):
            w = batch_words(batch.column("text"))
            at = np.searchsorted(vocabulary, w.hash)
            at[at == len(vocabulary)] = 0
            total += np.bincount(at[vocabulary[at] == w.hash], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["token", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = {r["token"]: r["n"] for r in rows}
    return {int(v): counts.get(i, 0) for i, v in enumerate(vocabulary)}


def window_counts(place: np.ndarray, token: np.ndarray, span: int) -> np.ndarray:
    """Distinct tokens in the window of ``span`` words that begins at each place; places rise."""
    order = np.lexsort((place, token))
    last = np.full(len(place), -span)
    again = token[order[1:]] == token[order[:-1]]
    last[order[1:][again]] = place[order[:-1][again]]
    # a place counts in the windows that begin after the token's last place, and hold it
    since = np.sort(np.maximum(last + 1, place - span + 1))
    return np.searchsorted(since, place, "right") - np.arange(len(place))


class Scanner:
    """Finds phrases and template blocks in batches of texts."""

    def __init__(self, counts: dict[int, int], templates=TEMPLATES):
        self.phrases = [(hashed(p), label) for p, label in PHRASES.items()]
        tokens = sorted(counts, key=lambda t: (counts[t], t))
        rank = {t: i for i, t in enumerate(tokens)}
        self.keys = np.array(sorted(rank), np.uint64)
        self.ranks = np.array([rank[int(k)] for k in self.keys], np.int64)
        self.templates = []
        for label, text, share in templates:
            own = hashed(text)
            ordered = np.unique([rank[int(h)] for h in own])
            need = math.ceil(share * len(ordered) - 1e-9)
            member = np.zeros(len(tokens), bool)
            member[ordered] = True
            self.templates.append((label, member, need, math.ceil(SPAN * len(own)), ordered[: len(ordered) - need + 1]))

    def blocks(self, w: Words) -> dict[int, list[tuple[str, float]]]:
        """By row: (label, containment) of the templates that a window holds."""
        out: dict[int, list[tuple[str, float]]] = {}
        if not len(w.hash) or not len(self.keys):
            return out
        at = np.searchsorted(self.keys, w.hash)
        at[at == len(self.keys)] = 0
        place = np.flatnonzero(self.keys[at] == w.hash)
        rank, row = self.ranks[at[place]], w.row()[place]
        for label, member, need, span, prefix in self.templates:
            own = np.flatnonzero(member[rank])
            # rows stand a window apart, so no window meets two of them
            p, t, r = place[own] + row[own] * span, rank[own], row[own]
            possible = np.zeros(len(w.first) - 1, bool)
            for token in prefix:
                here = np.flatnonzero(t == token)
                if len(here):
                    later = p[t >= token]
                    near = np.searchsorted(later, p[here] + span) - np.searchsorted(later, p[here] - span, "right")
                    possible[r[here[near >= need]]] = True
            own = np.flatnonzero(possible[r])
            if not len(own):
                continue
            held = window_counts(p[own], t[own], span)
            best = np.zeros(len(possible), np.int64)
            np.maximum.at(best, r[own], held)
            for i in np.flatnonzero(best >= need):
                out.setdefault(int(i), []).append((label, best[i] / member.sum()))
        return out

    def scan(self, column: pa.Array) -> list[pa.Array]:
        w = batch_words(column)
        n = len(column)
        n_base, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        labels: list[set[str]] = [set() for _ in range(n)]
        ends = w.first[1:]
        rows = w.row()
        for phrase, label in self.phrases:
            k = len(phrase)
            m = max(0, len(w.hash) - k + 1)
            place = np.flatnonzero(np.logical_and.reduce([w.hash[j : j + m] == phrase[j] for j in range(k)])) if m else np.zeros(0, np.int64)
            place = place[place + k <= ends[rows[place]]]
            owner = rows[place]
            n_base += np.bincount(owner, minlength=n)
            for i, p in zip(owner, place - w.first[owner]):
                labels[i].add(label)
                first[i] = p if first[i] < 0 else min(first[i], p)
                last[i] = max(last[i], p)
        score = np.array([float(bool(x)) for x in labels])
        base = [",".join(sorted(x)) for x in labels]
        for i, found in self.blocks(w).items():
            labels[i] |= {label for label, _ in found}
            score[i] = max(score[i], *(s for _, s in found))
        none = first < 0
        return [pa.array(np.diff(w.first)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base, pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score)]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanner = Scanner(token_counts(docs, templates), templates)

    def rows(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *scanner.scan(batch.column("text"))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
