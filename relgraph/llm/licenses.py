"""Licence scans (operator 1): a positional rare-token index over licence templates.

The index holds, for each word of a template, the places where it stands. IDF comes from all documents. In
each file the highest-IDF words of a template are looked up; their places less the places in the template
vote for where the template begins; and where enough weight agrees, its mandatory key phrases must stand
word for word and enough of the template's weight must stand at about its place.

The base phrases are templates of their own whose key phrase is the whole phrase: their rarest word is looked
up and the other words must stand at their relative positions, which gives every place exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded, slices, split_words, table

CHUNK_BYTES = 16 << 20
#: phrase: label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Public licence texts and notices, as lower-cased words.
_MIT = """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
"""
_ISC = """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this
software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
tortious action arising out of or in connection with the use or performance of this software
"""
_BSD_2 = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution
"""
_BSD_3 = """
neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission
"""
_APACHE = """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of
the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
language governing permissions and limitations under the license
"""
_GPL = """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
software foundation either version {} of the license or at your option any later version this program is distributed in the hope that it will be
useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
license for more details
"""
_MPL = """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can
obtain one at http mozilla org mpl 2 0
"""
_UNLICENSE = """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the
use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented
"""
#: label: (template, mandatory key phrases).
TEMPLATES = {
    "mit-text": (_MIT, ("permission is hereby granted free of charge", "the rights to use copy modify merge publish distribute sublicense")),
    "isc": (_ISC, ("permission to use copy modify and or distribute this software", "the author disclaims all warranties")),
    "bsd-2-clause": (_BSD_2, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    "bsd-3-clause": (_BSD_3, ("may be used to endorse or promote products derived from this software",)),
    "apache-2.0-notice": (_APACHE, ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license")),
    "gpl-2.0-notice": (_GPL.format(2), ("this program is free software", "either version 2 of the license")),
    "gpl-3.0-notice": (_GPL.format(3), ("this program is free software", "either version 3 of the license")),
    "mpl-2.0": (_MPL, ("mozilla public license v 2 0",)),
    "unlicense": (_UNLICENSE, ("free and unencumbered software",)),
    "zlib": (_ZLIB, ("the origin of this software must not be misrepresented",)),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-attribution": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "mit-notice": ("released under the mit license", ("mit license",)),
}
#: Highest-IDF words of a template that vote, how far words may have moved (at least, and as a share of the template's
#: length, as lost or added words move all that follows), and the shares of weight that are needed.
ANCHORS, SHIFT, DRIFT, VOTE_SHARE, MATCH_SHARE = 8, 3, 0.15, 0.4, 0.55


class Index:
    """Postings of all templates, with IDF weights."""

    def __init__(self, base: dict[str, str], templates: dict[str, tuple[str, tuple[str, ...]]], df: dict[str, int], n_docs: int):
        self.base, self.templates = base, templates
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary(base, templates)}
        self.words = {w.encode(): i for i, w in enumerate(self.idf)}
        self.weight = np.array(list(self.idf.values()))
        number = lambda text: [self.words[w.encode()] for w in text.split()]
        self.phrases = [(number(p), label) for p, label in base.items()]
        self.entries = []
        for label, (text, keys) in templates.items():
            ids = number(text)
            rare = sorted(set(ids), key=lambda i: (-self.weight[i], ids.index(i)))[:ANCHORS]
            places = {i: [k for k, x in enumerate(ids) if x == i] for i in set(ids)}
            self.entries.append((label, ids, rare, places, [number(k) for k in keys], sum(self.weight[i] for i in set(rare)), sum(self.weight[i] for i in ids)))
        self.rare = np.zeros(len(self.words), bool)
        for e in self.entries:
            self.rare[e[2][0]] = True  # a file without a template's rarest word can't hold its key phrases …
            self.rare[[max(k, key=lambda i: self.weight[i]) for k in e[4]]] = True  # … nor without theirs
        for ids, _ in self.phrases:
            self.rare[max(ids, key=lambda i: self.weight[i])] = True


def vocabulary(base: dict[str, str], templates: dict[str, tuple[str, tuple[str, ...]]]) -> list[str]:
    return sorted({w for text in [*base, *(t for t, _ in templates.values()), *(k for _, ks in templates.values() for k in ks)] for w in text.split()})


def _numbered(texts: pa.Array, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word in `words`, or -1, and the words per text."""
    flat, counts, _ = split_words(texts, alnum=True)
    codes, distinct = coded(flat)
    number = np.fromiter((words.get(w, -1) for w in distinct.to_pylist()), np.int64, len(distinct))
    return number[codes] if len(codes) else np.zeros(0, np.int64), counts


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all documents each of the licence words occurs, and the number of documents."""
    numbers = {w.encode(): i for i, w in enumerate(words)}

    def run(batches):
        total, n = np.zeros(len(numbers), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                found, counts = _numbered(part.column("text"), numbers)
                at = np.flatnonzero(found >= 0)
                doc = np.searchsorted(np.cumsum(counts), at, "right")
                total += np.bincount(np.unique(doc * len(numbers) + found[at]) % len(numbers), minlength=len(numbers))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(numbers)), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["word", "n"])

    rows = docs.selectExpr("cast(text as string) as text").mapInArrow(run, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: n.get(i, 0) for i, w in enumerate(words)}, n.get(-1, 0)


def phrase_at(found: np.ndarray, ids: list[int], weight: np.ndarray) -> np.ndarray:
    """Where the words `ids` stand consecutively: postings of the rarest, intersected by relative position."""
    lead = max(range(len(ids)), key=lambda k: weight[ids[k]])
    at = np.flatnonzero(found == ids[lead]) - lead
    at = at[(at >= 0) & (at + len(ids) <= len(found))]
    for k, i in enumerate(ids):
        at = at[found[at + k] == i]
    return at


def scan_file(found: np.ndarray, index: Index) -> tuple[list[str], float]:
    """Labels of the templates that stand in one file, and the best share of a template's weight that does."""
    where = np.flatnonzero(found >= 0)
    places = defaultdict(list)
    for p, w in zip(where.tolist(), found[where].tolist(), strict=True):
        places[w].append(p)
    labels, best = [], 0.0
    for label, ids, rare, spots, keys, rare_weight, all_weight in index.entries:
        present = [i for i in rare if i in places]
        if not present or any(i not in places for k in keys for i in k):
            continue
        votes: dict[int, set] = defaultdict(set)
        shift = max(SHIFT, int(DRIFT * len(ids)))
        for i in present:
            for p in places[i]:
                for k in spots[i]:
                    votes[(p - k) // (shift + 1)].add(i)
        for cell in sorted(votes):
            own = votes[cell] | votes.get(cell + 1, set())
            if sum(index.weight[i] for i in own) < VOTE_SHARE * rare_weight:
                continue
            first = cell * (shift + 1)
            begin, end = max(0, first - shift), first + 2 * (shift + 1) + len(ids) + shift
            window = found[begin:end]
            if any(not len(phrase_at(window, k, index.weight)) for k in keys):
                continue
            near = [set(found[max(0, first + k - shift) : max(0, first + k + 2 * (shift + 1))].tolist()) for k in range(len(ids))]
            share = sum(index.weight[i] for i, around in zip(ids, near, strict=True) if i in around) / all_weight
            if share >= MATCH_SHARE:
                labels.append(label)
                best = max(best, float(share))
                break
    return labels, min(best, 1.0)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, base: dict = BASE, templates: dict = TEMPLATES) -> DataFrame:
    """A row for every row of `docs`: counts and places of the base phrases, all labels, and a score from 0 to 1.

    Null and empty texts have no words and no labels (empty strings); repeated rows are scanned alike; other
    columns are ignored; an empty table gives an empty result.
    """
    index = Index(base, templates, *document_frequencies(docs, vocabulary(base, templates)))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                found, counts = _numbered(part.column("text"), index.words)
                ends = np.cumsum(counts)
                first = ends - counts
                hit = np.zeros(part.num_rows, bool)
                at = np.flatnonzero((found >= 0) & index.rare[np.maximum(found, 0)])
                hit[np.searchsorted(ends, at, "right")] = True
                rows = [(int(n), 0, None, None, "", "", 0.0) for n in counts]
                for i in np.flatnonzero(hit).tolist():
                    own = found[first[i] : ends[i]]
                    spots, basic = [], set()
                    for ids, label in index.phrases:
                        if len(p := phrase_at(own, ids, index.weight)):
                            spots.append(p)
                            basic.add(label)
                    more, share = scan_file(own, index)
                    spots = np.concatenate(spots) if spots else np.zeros(0, np.int64)
                    rows[i] = (
                        len(own), len(spots), int(spots.min()) if len(spots) else None, int(spots.max()) if len(spots) else None,
                        ",".join(sorted(basic)), ",".join(sorted(basic | set(more))), 1.0 if basic else share,
                    )
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(list(c), f.type) for c, f in zip(columns, list(_OUT)[1:], strict=True)]], schema=_OUT)

    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return texts.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
