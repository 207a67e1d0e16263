"""License scans by MinHash over overlapping windows.

Texts are compared as lower-case words (ASCII letters are folded, ASCII punctuation separates) and their
word pairs. A template of n words is looked for in windows of n words and a quarter of them to either side,
one at each word of a text; a text shorter than that is one window. It matches where a window contains at
least ``CONTAINMENT`` of the template's distinct pairs.

Candidates come from a bottom-k MinHash of the template. A window at the threshold may lack d of the
template's pairs, d the whole part of (1 - threshold) times their number; as it cannot lack d + 1, it holds
one of any d + 1 of them. So each template is indexed by its d + 1 least hashes, as bands of one, and a
window is a candidate if it holds one of these. No match is missed, whatever the place or the kind
of the edit. Candidate windows are verified exactly, by a running count of distinct pairs.

Row-local: templates travel with the task, their number is bounded by ``MAX_TEMPLATES``. Defined cases: null
and empty texts match nothing; templates of fewer than two words are refused; repeated rows are
reported each; a template is reported once for a text, at the first pair of it in its best window (the first
of equally good ones).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canasta.llm.shared import small_batches
from canasta.llm.words import BYTE_VALUES, Ranges, chunks, mixed, texts_of, words_of

CONTAINMENT = 0.8
MAX_TEMPLATES = 10_000

# Customary notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
    "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
    "or (at your option) any later version.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or "
    "(at your option) any later version.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
    "held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
    "License 2.0 which is available at",
    "GFDL": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free "
    "Documentation License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
    "International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
    "International License.",
    "proprietary": "All rights reserved.",
}

_LETTERS = np.arange(256)
_SEPARATES = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LETTERS[65:91] += 32
_FOLDED = BYTE_VALUES[_LETTERS]


def _words(data: np.ndarray, offsets: np.ndarray):
    return words_of(data, offsets, _SEPARATES, _FOLDED)


def _pairs(words) -> np.ndarray:
    """Hash of the pair that begins at each word; those across texts are never looked at."""
    return Ranges(words.values).windows(2) if len(words.values) > 1 else np.zeros(0, np.uint64)


def _runs(places: np.ndarray, window: int, low: int, high: int):
    """(first, end) of the stretches of pairs that windows around ``places`` cover, inside low to high."""
    apart = np.flatnonzero(np.diff(places) >= 2 * window - 1)
    begin = places[np.concatenate([[0], apart + 1])] - window + 1
    end = places[np.concatenate([apart, [len(places) - 1]])] + window
    return zip(np.maximum(begin, low).tolist(), np.minimum(end, high).tolist(), strict=True)


def _best(own: np.ndarray, pairs: np.ndarray, window: int) -> tuple[int, int]:
    """Most distinct members of ``own`` (sorted) in a window of ``pairs``, and the place of the first of them."""
    code = np.minimum(np.searchsorted(own, pairs), len(own) - 1)
    at = np.flatnonzero(own[code] == pairs)
    code = code[at]
    order = np.argsort(code, kind="stable")
    before = np.full(len(at), -1, np.int64)
    same = code[order][1:] == code[order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]
    # a pair is new to the windows that begin after its last occurrence
    edges = np.zeros(len(pairs) + 1, np.int64)
    np.add.at(edges, np.maximum(before + 1, np.maximum(0, at - window + 1)), 1)
    np.add.at(edges, at + 1, -1)
    counts = np.cumsum(edges[:-1])
    start = int(counts.argmax())
    return int(counts[start]), int(at[np.searchsorted(at, start)])


class Index:
    """Templates by the least hashes of their pairs, as many as one more than a match may lack."""

    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.names = sorted(templates)
        self.containment = containment
        self.windows, self.pairs = [], []
        rows = []
        for number, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            words = _words(raw, np.array([0, len(raw)]))
            n = len(words.values)
            if n < 2:
                raise ValueError(f"template {name} has fewer than two words")
            own = np.unique(_pairs(words))
            self.windows.append(n + 2 * (n // 4) - 1)
            self.pairs.append(own)
            lacking = int((1 - containment) * len(own) + 1e-9 * len(own))
            rows += [(int(p), number) for p in own[np.argsort(mixed(own))][: lacking + 1]]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.owners = np.array([r[1] for r in rows], np.int64)
        self.small = np.zeros(1 << 16, bool)
        self.small[self.keys & np.uint64(0xFFFF)] = True

    def hits(self, words, pairs: np.ndarray) -> np.ndarray:
        """(text, template, place) of all pairs of the texts that are among a template's least, in order."""
        at = np.flatnonzero(self.small[pairs & np.uint64(0xFFFF)])
        at = at[words.doc[at] == words.doc[at + 1]]
        low = np.searchsorted(self.keys, pairs[at], side="left")
        count = np.searchsorted(self.keys, pairs[at], side="right") - low
        row = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        found = np.column_stack([words.doc[at], self.owners[row], at])
        return found[np.lexsort(found.T[::-1])]

    def matches(self, words):
        """(text, template, containment, first word) of the best window of each template in each text."""
        pairs = _pairs(words)
        hits = self.hits(words, pairs)
        out = []
        borders = np.flatnonzero((np.diff(hits[:, :2], axis=0) != 0).any(axis=1)) + 1
        for group in np.split(hits, borders) if len(hits) else []:
            text, template = int(group[0, 0]), int(group[0, 1])
            own, window = self.pairs[template], self.windows[template]
            first, last = int(words.first[text]), int(words.first[text + 1]) - 1
            best = (0, 0)
            for begin, end in _runs(group[:, 2], window, first, last):
                count, place = _best(own, pairs[begin:end], window)
                best = max(best, (count, first - begin - place))
            share = best[0] / len(own)
            if share >= self.containment - 1e-9:
                out.append((text, self.names[template], share, -best[1]))
        return out


def find_licenses(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    containment: float = CONTAINMENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, license, containment and first_word of every template that a document holds."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates, containment))
    small_batches(docs.sparkSession)

    def scan(batches):
        index = shared.value
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for at, end in chunks(offsets):
                rows = index.matches(_words(data, offsets[at : end + 1]))
                if rows:
                    text, name, share, first = zip(*rows, strict=True)
                    ids = batch.column(0).take(pa.array([at + t for t in text]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(name), pa.array(share), pa.array(first, pa.int32())],
                        ["doc_id", "license", "containment", "first_word"],
                    )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, license string, containment double, first_word int")
