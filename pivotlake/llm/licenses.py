"""Licence scans by a positional rare-token index.

The document frequency of every licence word is counted over the whole corpus (the licence
vocabulary is fixed, so the counts are a bounded table). The index holds, for every notice
template, its rarest words with their positions. A file's words that are in the index vote
for ``(template, file position - template position)``; votes that agree on a relative
position make an alignment, whose words are then compared, piece by piece where words were
inserted or lost, and whose mandatory key phrase is verified in place. Every occurrence votes;
nothing is capped.

Defined results: null texts are empty: no words, null first and last place, empty labels,
score 0; null ids pass through; repeated rows repeat; an empty table gives an empty table; a
text of any length is read whole, and of alignments with equally many votes that are at most
``DRIFT`` words apart each is verified. A notice that has lost all but one of its rare words is
not found, however many of its other words stand. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import table

#: Phrases whose places are reported, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence bodies, as their words.
MIT_BODY = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
shall be included in all copies or substantial portions of the software the software is provided as is without warranty
of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
the use or other dealings in the software"""
BSD_BODY = """redistribution and use in source and binary forms with or without modification are permitted provided that
the following conditions are met redistributions of source code must retain the above copyright notice this list of
conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""
BSD_ENDORSEMENT = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission"""
ISC_BODY = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
granted provided that the above copyright notice and this permission notice appear in all copies the software is
provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness"""
APACHE_NOTICE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance
with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing
permissions and limitations under the license"""
GPL_NOTICE = """this program is free software you can redistribute it and or modify it under the terms of the gnu general
public license as published by the free software foundation either version {} of the license or at your option any later
version"""
ZLIB_BODY = """this software is provided as is without any express or implied warranty in no event will the authors be held
liable for any damages arising from the use of this software permission is granted to anyone to use this software for
any purpose including commercial applications and to alter it and redistribute it freely"""

#: Notice texts: label, words, mandatory key phrase.
TEMPLATES = (
    ("mit", MIT_BODY, "merge publish distribute sublicense"),
    ("bsd", BSD_BODY, "redistributions in binary form must reproduce"),
    ("bsd-3-clause", BSD_ENDORSEMENT, "endorse or promote products"),
    ("isc", ISC_BODY, "with or without fee"),
    ("apache-2.0", APACHE_NOTICE, "apache license version 2 0"),
    ("gpl-3.0", GPL_NOTICE.format(3), "either version 3 of the license"),
    ("gpl-2.0", GPL_NOTICE.format(2), "either version 2 of the license"),
    ("zlib", ZLIB_BODY, "without any express or implied warranty"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("cc0-1.0", "licensed under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd"),
)

#: Rarest distinct words of a template that the index holds.
RARE = 4
#: Share of a template's words that must stand at their places.
MATCHED = 0.7
#: Words by which votes compete for one alignment, and by which pieces of a notice may be moved
#: against each other at a time (inserted or lost words).
DRIFT, REACH = 2, 8

#: ASCII bytes outside 0-9 and letters part words; A-Z are lowered; other bytes are word bytes.
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def licence_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _vocabulary() -> frozenset[bytes]:
    return frozenset(w.encode() for _, t, _ in TEMPLATES for w in t.split())


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, df)`` over all documents, for words of the fixed vocabulary; each task sends
    one row per word. The row with an empty word counts the documents."""
    ship(docs.sparkSession)
    vocabulary = _vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                df[b""] += 1
                df.update(vocabulary.intersection(licence_words(t.as_py() or b"")))
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in df], "df": list(df.values())}, schema=pa.schema([("word", pa.string()), ("df", pa.int64())]))

    return docs.select(text_col).mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


class RareIndex:
    """Postings of the rarest words of every template: word -> [(template, position)]."""

    def __init__(self, df: dict[str, int]):
        n = max(df.get("", 0), 1)
        idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1))
        self.templates = [[w.encode() for w in t.split()] for _, t, _ in TEMPLATES]
        self.phrases = [b" " + p.encode() + b" " for _, _, p in TEMPLATES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need = []
        for k, (_, t, _) in enumerate(TEMPLATES):
            rare = sorted(set(t.split()), key=lambda w: (-idf(w), w))[:RARE]
            self.need.append(min(2, len(rare)))
            for q, w in enumerate(t.split()):
                if w in rare:
                    self.postings[w.encode()].append((k, q))
        self.rare = frozenset(self.postings)

    def find(self, words: list[bytes], present: set[bytes]) -> list[tuple[int, int, float]]:
        """``(template, start, matched share)`` of all verified alignments."""
        hits = present & self.rare
        if len(hits) < 2:
            return []
        votes: dict[tuple[int, int], dict[bytes, int]] = defaultdict(dict)
        for p, w in enumerate(words):
            if w in hits:
                for k, q in self.postings[w]:
                    votes[k, p - q].setdefault(w, q)
        found = []
        for (k, at), voters in votes.items():
            near = set().union(*(votes.get((k, at + d), ()) for d in range(-REACH, REACH + 1)))
            if len(near) < self.need[k] or len(voters) < max(len(votes.get((k, at + d), ())) for d in range(-DRIFT, DRIFT + 1)):
                continue
            same, low, high = align(words, self.templates[k], at, min(voters.values()))
            window = b" " + b" ".join(words[low : high + 1]) + b" "
            if same >= MATCHED and self.phrases[k] in window:
                found.append((k, low, same))
        return found


def align(words: list[bytes], template: list[bytes], at: int, anchor: int) -> tuple[float, int, int]:
    """The matched share of a template whose word ``anchor`` stands at ``at + anchor``, and the first
    and last matched place. To both sides of the anchor words are compared place by place; where
    one differs, two of the template's words in a row, at most ``REACH`` further on or back, begin
    a new piece. Every new piece costs a tenth of a word."""
    matched, pieces, low, high = 1, 0, at + anchor, at + anchor
    there = lambda p, q: 0 <= p < len(words) and words[p] == template[q]
    for step, end in ((1, len(template)), (-1, -1)):
        shift = at
        for q in range(anchor + step, end, step):
            if not there(shift + q, q):
                ahead = q + step
                if not 0 <= ahead < len(template):
                    continue
                move = next((m for d in range(1, REACH + 1) for m in (d, -d) if there(shift + m + q, q) and there(shift + m + ahead, ahead) and (shift + m + q > high if step > 0 else shift + m + q < low)), 0)
                if not move:
                    continue
                shift, pieces = shift + move, pieces + 1
            matched, low, high = matched + 1, min(low, shift + q), max(high, shift + q)
    return (matched - 0.1 * pieces) / len(template), low, high


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand, in a text joined by single spaces
    with a space at either end."""
    out, place, last, at = [], 0, 0, joined.find(phrase)
    while at >= 0:
        place += joined.count(b" ", last, at)
        out.append(place)
        last, at = at, joined.find(phrase, at + 1)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row (``SCHEMA``). ``score`` is 1 where a base phrase stands, else
    the best matched share of a verified notice, else 0. Only the corpus counts of the fixed
    vocabulary come to the driver."""
    index = RareIndex({r["word"]: r["df"] for r in document_frequencies(docs, text_col).collect()})
    base = [(b" " + p.encode() + b" ", frozenset(w.encode() for w in p.split()), label) for p, label in BASE.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                words = licence_words(t.as_py() or b"")
                present = set(words)
                places, labels = [], set()
                if any(need <= present for _, need, _ in base):
                    joined = b" " + b" ".join(words) + b" "
                    for phrase, _, label in base:
                        if own := _places(joined, phrase):
                            places += own
                            labels.add(label)
                found = index.find(words, present)
                more = labels | {TEMPLATES[k][0] for k, _, _ in found}
                score = 1.0 if places else max((s for _, _, s in found), default=0.0)
                rows.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(scan, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
