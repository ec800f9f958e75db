"""Licence scans with a positional index of rare tokens.

Templates are licence notices and grants, each a list of mandatory key phrases at known word positions. The document frequency of
every licence word is counted over all documents. In each phrase the two words of the highest IDF are anchors; a file's anchor words are looked up in the
index of (template, position) postings, postings of the two anchors are intersected by relative position, and what is left is
verified: every mandatory phrase must stand, word for word, where the alignment puts it, give or take the template's slack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as W
from .shared import gathered, lowered, text_buffer, tune

SLICE = 4 << 20


@dataclass(frozen=True)
class Template:
    """``phrases``: (word position, phrase) in order; the first is at 0. ``slack``: words by which a later phrase may be off its position."""

    license_id: str
    name: str
    phrases: tuple[tuple[int, str], ...]
    slack: int = 0


def _notice(license_id: str, name: str, phrase: str) -> Template:
    return Template(license_id, name, ((0, phrase),))


def _text(license_id: str, name: str, text: str, *phrases: str, slack: int = 12) -> Template:
    """A longer text of which some phrases are mandatory, each where the text has it, give or take the slack."""
    words = WORD.findall(text.lower())
    places = []
    for phrase in phrases:
        own = WORD.findall(phrase.lower())
        places.append(next(i for i in range(len(words)) if words[i : i + len(own)] == own))
    return Template(license_id, name, tuple((p - places[0], q) for p, q in zip(places, phrases, strict=True)), slack)


WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND"""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the
above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted
to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS"""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your
option) any later version."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(license_id: str, title: str, version: str) -> Template:
    text = _GNU.format(title, version)
    return _text(license_id, "header", text, f"GNU {title} as published by the Free Software Foundation", f"version {version} of the License", slack=4)


#: SPDX identifiers, as tags name them.
SPDX = (
    "MIT MIT-0 Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause 0BSD ISC MPL-2.0 EPL-1.0 EPL-2.0 Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 BSL-1.0 Zlib Artistic-2.0 WTFPL PostgreSQL Python-2.0"
).split()

TEMPLATES = (
    *[_notice(i, "tag", f"spdx license identifier {i}") for i in SPDX],
    _text("MIT", "text", _MIT, "Permission is hereby granted, free of charge, to any person obtaining a copy", "without restriction, including without limitation the rights to use", "The above copyright notice and this permission notice shall be included in all copies", "the software is provided as is without warranty of any kind", slack=24),
    _notice("MIT", "heading", "the mit license mit"),
    _notice("MIT", "heading with copyright", "mit license copyright"),
    _text("Apache-2.0", "header", _APACHE, "under the apache license version 2 0", "you may not use this file except in compliance with the license", "distributed under the license is distributed on an as is basis", slack=24),
    _notice("Apache-2.0", "short", "apache license 2 0"),
    _notice("Apache-2.0", "shorter", "apache license v2"),
    _notice("Apache-2.0", "heading", "apache license version 2 0 january 2004"),
    _gnu("GPL-3.0", "General Public License", "3"),
    _gnu("GPL-2.0", "General Public License", "2"),
    _gnu("LGPL-3.0", "Lesser General Public License", "3"),
    _gnu("LGPL-2.1", "Lesser General Public License", "2 1"),
    _gnu("AGPL-3.0", "Affero General Public License", "3"),
    _notice("GPL-3.0", "short", "under the gplv3"),
    _notice("GPL-2.0", "short", "under the gplv2"),
    _notice("GPL-3.0", "heading", "gnu general public license version 3 29 june 2007"),
    _notice("GPL-2.0", "heading", "gnu general public license version 2 june 1991"),
    _text("BSD-3-Clause", "text", _BSD, "redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software", slack=24),
    _text("BSD-2-Clause or BSD-3-Clause", "text", _BSD, "redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", slack=24),
    _text("ISC", "text", _ISC, "permission to use copy modify and or distribute this software", "with or without fee is hereby granted", "this permission notice appear in all copies"),
    _text("Zlib", "text", _ZLIB, "provided as is without any express or implied warranty", "permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented", slack=24),
    _text("MPL-2.0", "header", _MPL, "subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    _notice("MIT", "notice", "under the mit license"),
    Template("MIT", "grant", ((0, "permission is hereby granted free of charge"), (26, "without restriction including without limitation")), 24),
    _notice("Apache-2.0", "notice", "under the apache license version 2 0"),
    _notice("Apache-2.0", "address", "www apache org licenses license 2 0"),
    _notice("GPL-3.0", "notice", "gnu general public license version 3"),
    _notice("GPL-2.0", "notice", "gnu general public license version 2"),
    Template("GPL", "grant", ((0, "you can redistribute it and or modify it"), (13, "gnu general public license")), 12),
    _notice("LGPL", "notice", "gnu lesser general public license"),
    _notice("AGPL-3.0", "notice", "gnu affero general public license"),
    _notice("CC-BY-NC-4.0", "notice", "under cc by nc 4 0"),
    _notice("CC-BY-4.0", "notice", "under cc by 4 0"),
    _notice("CC-BY-SA-4.0", "notice", "under cc by sa 4 0"),
    _notice("CC-BY-NC-4.0", "name", "creative commons attribution noncommercial 4 0 international"),
    _notice("CC-BY-4.0", "name", "creative commons attribution 4 0 international"),
    _notice("CC-BY-SA-4.0", "name", "creative commons attribution sharealike 4 0 international"),
    _notice("CC0-1.0", "name", "cc0 1 0 universal"),
    _notice("MPL-2.0", "notice", "mozilla public license version 2 0"),
    _notice("MPL-2.0", "short", "mozilla public license v 2 0"),
    _notice("EPL-2.0", "notice", "eclipse public license 2 0"),
    Template("BSD", "grant", ((0, "redistribution and use in source and binary forms"), (16, "provided that the following conditions are met")), 12),
    _notice("BSD-3-Clause", "notice", "bsd 3 clause license"),
    _notice("BSD-2-Clause", "notice", "bsd 2 clause license"),
    _notice("ISC", "grant", "permission to use copy modify and or distribute this software"),
    _notice("Unlicense", "notice", "released into the public domain"),
    _notice("BSL-1.0", "notice", "boost software license version 1 0"),
    _notice("Zlib", "notice", "under the zlib license"),
)

def words_of(phrase: str) -> list[str]:
    return WORD.findall(phrase.lower())


def hash_words(words: list[str]) -> np.ndarray:
    raw, offsets = text_buffer(pa.array([" ".join(words)]))
    starts, ends, _ = W.spans(raw, offsets)
    return W.word_hashes(raw, starts, ends, W.Powers())


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for _, p in t.phrases for w in words_of(p)})


def frequency_counter(hashes: np.ndarray):
    """Counts, for each slice, the documents that hold each word of the vocabulary."""
    order = np.argsort(hashes)
    ordered = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers()
        total = np.zeros(len(hashes), np.int64)
        documents = 0
        for batch in gathered(batches, "text", SLICE):
            raw, offsets = text_buffer(batch.column("text"))
            starts, ends, first = W.spans(raw, offsets)
            h = W.word_hashes(raw, starts, ends, powers)
            documents += batch.num_rows
            at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
            hit = np.flatnonzero(ordered[at] == h)
            doc = np.searchsorted(first, hit, "right") - 1
            seen = np.unique(doc * len(hashes) + order[at[hit]])
            total += np.bincount(seen % len(hashes), minlength=len(hashes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int64)), pa.array(np.concatenate(([documents], total)))], ["word", "documents"])

    return run


def frequencies(texts: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """All documents, and those that hold each word."""
    hashes = np.concatenate([hash_words([w]) for w in words])
    rows = texts.mapInArrow(frequency_counter(hashes), "word long, documents long").groupBy("word").agg(F.sum("documents").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return found.get(-1, 0), {w: found.get(i, 0) for i, w in enumerate(words)}


@dataclass(frozen=True)
class Phrase:
    at: int
    hashes: np.ndarray
    #: The positions within the phrase of its words of the highest and the second highest IDF.
    anchors: tuple[int, int]


def index_of(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[list[Phrase]]:
    """The phrases of each template with their anchors: the words in the fewest documents (ties: the longer word, then the first)."""
    out = []
    for t in templates:
        own = []
        for at, p in t.phrases:
            words = words_of(p)
            rare = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), -len(words[i]), i))
            own.append(Phrase(at, hash_words(words), (rare[0], rare[min(1, len(rare) - 1)])))
        out.append(own)
    return out


def scanner(templates: tuple[Template, ...], index: list[list[Phrase]]):
    ids = [t.license_id for t in templates]
    names = [t.name for t in templates]
    slack = [t.slack for t in templates]
    # postings: a phrase's rarest word, with the templates and phrases that it anchors
    anchors = np.unique(np.array([p.hashes[p.anchors[0]] for own in index for p in own], np.uint64))

    def places(phrase: Phrase, h: np.ndarray, hits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, document) where the phrase stands: both anchors at their relative positions, within one document, all words equal."""
        a, b = phrase.anchors
        p = hits[h[hits] == phrase.hashes[a]] - a
        k = len(phrase.hashes)
        p = p[(p >= 0) & (p + k <= len(h))]
        p = p[h[p + b] == phrase.hashes[b]]
        doc = np.searchsorted(first, p, "right") - 1
        inside = p + k <= first[doc + 1]
        p, doc = p[inside], doc[inside]
        same = (h[p[:, None] + np.arange(k)] == phrase.hashes).all(axis=1) if len(p) else np.zeros(0, bool)
        return p[same], doc[same]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers()
        for batch in gathered(batches, "text", SLICE):
            raw, offsets = text_buffer(batch.column("text"))
            starts, ends, first = W.spans(raw, offsets)
            h = W.word_hashes(raw, starts, ends, powers)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)
            hits = np.flatnonzero(anchors[at] == h)
            if not len(hits):
                continue
            rows: list[tuple[int, int, int]] = []
            for t, phrases in enumerate(index):
                p, doc = places(phrases[0], h, hits, first)
                for phrase in phrases[1:]:
                    if not len(p):
                        break
                    q, q_doc = places(phrase, h, hits, first)
                    # a place of this phrase in the same document, within the slack of where the first phrase puts it
                    low = np.searchsorted(q, np.maximum(p + phrase.at - slack[t], first[doc]))
                    high = np.searchsorted(q, np.minimum(p + phrase.at + slack[t] + 1, first[doc + 1]))
                    p, doc = p[high > low], doc[high > low]
                rows.extend((d, t, w) for d, w in zip(doc.tolist(), (p - first[doc]).tolist(), strict=True))
            if rows:
                d, t, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([ids[i] for i in t]), pa.array([names[i] for i in t]), pa.array(w, pa.int32())], ["doc_id", "license_id", "template", "doc_word"])

    return run


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Licences found: (doc_id, license_id, template, doc_word). Full texts, headers with their version clauses, SPDX tags, headings and short notices are known.

    One row for each place where a template stands: the word of the document, from 0, at which its first phrase begins. Words are compared in lower case whatever stands between them.

    Nulls: a null doc_id is kept as null; a null or empty text holds no licence. Rows that repeat give the same places each, which count
    once. Templates that stand at the same place are all given. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    tune(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered("text").alias("text"))
    _, frequency = frequencies(texts, vocabulary(templates))
    index = index_of(templates, frequency)
    return texts.mapInArrow(scanner(templates, index), "doc_id long, license_id string, template string, doc_word int").distinct()


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """The same by looking for every phrase at every word."""
    phrases = sorted({tuple(words_of(p)) for t in templates for _, p in t.phrases})
    number = {p: i for i, p in enumerate(phrases)}
    rows = ", ".join(f"({i}, {list(p)})" for p, i in number.items())
    parts = []
    for t in templates:
        own = [(at, number[tuple(words_of(p))]) for at, p in t.phrases]
        near = "".join(f" AND EXISTS (SELECT 1 FROM o b WHERE b.row = a.row AND b.phrase = {i} AND b.pos BETWEEN a.pos + {at - t.slack} AND a.pos + {at + t.slack})" for at, i in own[1:])
        parts.append(f"SELECT DISTINCT doc_id, '{t.license_id}' AS license_id, '{t.name}' AS template, pos::INTEGER AS doc_word FROM o a WHERE phrase = {own[0][1]}{near}")
    return f"""
WITH p(phrase, words) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
e AS (SELECT row, doc_id, w, unnest(range(len(w))) AS pos FROM d),
o AS (SELECT row, doc_id, pos, phrase FROM e JOIN p ON e.w[pos + 1] = p.words[1] AND e.w[pos + 1 : pos + len(p.words)] = p.words)
{" UNION ALL ".join(parts)}"""
