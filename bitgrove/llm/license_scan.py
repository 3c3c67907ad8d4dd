"""License scan with a positional rare-token index.

The index is built from license templates: notices, names, and tags of a machine-readable form. For every template it holds
the words of its mandatory key phrases that are of highest inverse document frequency (counted over the whole
corpus), with their positions. A file looks up only those rare words; each occurrence at position p of a rare word at template
position q votes for the alignment p - q, and votes of different rare words for (nearly) one alignment are
intersected. An alignment that all rare words agree on is verified: all key phrases must stand, as consecutive words, near their
places. As rare words are words of key phrases, nothing that could be verified is passed over. A verified place
gives the label; the score tells how much of the template stands there in order.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, table

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Fixed values: (label, notice, mandatory key phrases). Opening words of public licenses and their usual notices.
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license as published")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("related and neighboring rights", "public domain worldwide")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
)

# Fixed values: (label, name under which texts cite the license); a name is its own key phrase.
NAMES = (
    ("mit", "mit license"), ("mit", "mit licence"), ("apache-2.0", "apache license 2 0"), ("apache-2.0", "apache 2 0 license"), ("bsd", "bsd license"),
    ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("isc", "isc license"), ("gpl-2.0", "gnu general public license version 2"), ("gpl-2.0", "gplv2"),
    ("gpl-3.0", "gnu general public license version 3"), ("gpl-3.0", "gplv3"), ("lgpl-2.1", "lesser general public license version 2 1"),
    ("lgpl-3.0", "lesser general public license version 3"), ("agpl-3.0", "affero general public license version 3"), ("mpl-1.1", "mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla public license version 2 0"), ("mpl-2.0", "mozilla public license 2 0"), ("epl-1.0", "eclipse public license v1 0"), ("epl-2.0", "eclipse public license v2 0"),
    ("unlicense", "the unlicense"), ("zlib", "zlib license"), ("bsl-1.0", "boost software license"), ("artistic-2.0", "artistic license 2 0"), ("cc0-1.0", "cc0 1 0"),
    ("cc-by-3.0", "cc by 3 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-nc-3.0", "cc by nc 3 0"), ("cc-by-nd-4.0", "cc by nd 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"), ("cc-by-3.0", "creative commons attribution 3 0"), ("cc-by-sa-3.0", "creative commons attribution sharealike 3 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0"), ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0"),
)

# License identifiers that follow the tag "SPDX-License-Identifier:"; longer forms of an identifier begin with it.
TAG = "spdx license identifier"
IDENTIFIERS = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0",
    "EPL-1.0", "EPL-2.0", "Unlicense", "Zlib", "BSL-1.0", "Artistic-2.0", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0",
)


def _tagged(identifier: str) -> tuple[str, str, tuple[str, ...]]:
    phrase = f"{TAG} {identifier.lower().replace('-', ' ').replace('.', ' ')}"
    return identifier.lower(), phrase, (phrase,)


TEMPLATES = (*NOTICES, *((label, name, (name,)) for label, name in NAMES), *map(_tagged, IDENTIFIERS))

#: Rare words that index a template at most, and places by which an alignment may shift (inserted or lost words).
RARE, SLACK = 4, 3

_SPACED = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text after lower-casing A-Z: runs of ASCII letters and digits and of all beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]
    #: rarest first
    rare: list[bytes]


def vocabulary(templates=TEMPLATES) -> set[str]:
    return {w for _, notice, _ in templates for w in notice.split()}


def build_index(df: dict[str, int], docs: int, templates=TEMPLATES) -> tuple[list[Template], dict[bytes, list[tuple[int, int]]]]:
    """Templates and the postings rare word -> [(template, position)]; df: documents that hold each license word."""
    idf = {w: math.log((docs + 1) / (df.get(w, 0) + 1)) for w in vocabulary(templates)}
    made, postings = [], defaultdict(list)
    for number, (label, notice, phrases) in enumerate(templates):
        words = notice.split()
        keys = []
        for phrase in phrases:
            p = phrase.split()
            at = next(k for k in range(len(words)) if words[k : k + len(p)] == p)
            keys.append((at, [x.encode() for x in p]))
        first = {w: words.index(w) for phrase in phrases for w in phrase.split()}
        chosen = sorted(first, key=lambda w: (-idf[w], first[w]))[:RARE]
        for w in chosen:
            for q in (k for k, x in enumerate(words) if x == w):
                postings[w.encode()].append((number, q))
        made.append(Template(label, [w.encode() for w in words], keys, [w.encode() for w in chosen]))
    return made, dict(postings)


def _in_order(words: list[bytes], template: list[bytes], start: int) -> float:
    """Share of the template's words that stand in order, each within the slack of its place."""
    hit, shift = 0, 0
    for q, word in enumerate(template):
        at = start + q + shift
        for off in sorted(range(-SLACK, SLACK + 1), key=abs):
            if 0 <= at + off < len(words) and words[at + off] == word:
                hit, shift = hit + 1, shift + off
                break
    return hit / len(template)


def match_templates(words: list[bytes], templates: list[Template], postings: dict[bytes, list[tuple[int, int]]]) -> dict[str, float]:
    """label -> best share over the verified alignments of its templates."""
    held = set(words)
    able = {number for number, t in enumerate(templates) if held.issuperset(t.rare)}
    if not able:
        return {}
    votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
    for p, word in enumerate(words):
        for number, q in postings.get(word, ()):
            if number in able:
                votes[number, p - q].add(word)
    found: dict[str, float] = {}
    for (number, start), own in votes.items():
        t = templates[number]
        agreed = set(own)
        for off in range(1, SLACK + 1):
            agreed |= votes.get((number, start - off), set()) | votes.get((number, start + off), set())
        if len(agreed) < len(t.rare):
            continue
        for at, phrase in t.keys:
            if not any(words[k : k + len(phrase)] == phrase for k in range(max(0, start + at - SLACK), start + at + SLACK + 1)):
                break
        else:
            found[t.label] = max(found.get(t.label, 0.0), _in_order(words, t.words, start))
    return found


def base_places(words: list[bytes]) -> dict[str, list[int]]:
    """label -> word numbers where its phrase starts."""
    joined = b" " + b" ".join(words) + b" "
    out = {}
    for phrase, label in BASE_PHRASES.items():
        needle = b" " + phrase.encode() + b" "
        at = joined.find(needle)
        counted, spaces = 0, 0
        places = []
        while at >= 0:
            spaces += joined.count(b" ", counted, at)
            counted = at
            places.append(spaces)
            at = joined.find(needle, at + 1)
        if places:
            out[label] = places
    return out


def license_word_counts(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each word of the license vocabulary (a fixed, small set), and all documents."""
    vocab = {w.encode() for w in vocabulary()}
    schema = "word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch.column(0):
                for w in vocab.intersection(words_of(text.as_py())):
                    counts[w.decode()] += 1
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=arrow_schema(schema))

    per_task = map_arrow(docs.select(F.col(text_col).cast("string").alias("t")), run, schema)
    found = {r["word"]: r["n"] for r in per_task.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs.

    Base places are those of BASE_PHRASES; labels holds the base labels and those of templates whose key phrases stand, score the
    best share of a template's words in order, 1 where a base phrase stands. Null text counts as empty: no words, no labels, score 0.
    Repeated rows are scanned each; other columns are ignored; an empty table gives no rows.
    """
    df, total = license_word_counts(docs, text_col)
    templates, postings = build_index(df, total)
    anchors = {t.rare[0] for t in templates}  # a file without any of them can't hold a key phrase
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(schema)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                words = words_of(text.as_py())
                places = base_places(words)
                starts = [p for found in places.values() for p in found]
                labels = match_templates(words, templates, postings) if not anchors.isdisjoint(words) else {}
                for col, value in zip(cols, (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *labels})), 1.0 if places else max(labels.values(), default=0.0))):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(shape)[1:]))], schema=shape)

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_arrow(src, run, schema).withColumnRenamed("id", id_col)


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
