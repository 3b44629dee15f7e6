"""License scans: an exact set-similarity join of text blocks with license templates, and phrases word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import LOWER_BYTES, byte_class, documents, raw, slices, small_batches, word_hashes, words

#: The phrases that are searched word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as (label, wording), sentences of the licenses and the short forms of their names. A block meets a
#: template that has PERCENT of its different words: of four words or fewer all, so that a short form isn't met by that of
#: another license.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", "identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "cc0 1 0"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "identifier gpl 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "identifier gpl 3 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "under the mit license"),
    ("mit", "mit license copyright"),
    ("mit", "license identifier mit"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license 2"),
    ("mpl-2.0", "identifier mpl 2 0"),
    ("no-copying", "no part of this publication may be reproduced or transmitted in any form without written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
PERCENT = 80


def window(template: str) -> int:
    """How many words a block has: those of the template and a quarter more, so that a few others may stand between.

    A template of up to four words, all of which must be met, has blocks of its own length: with others between, "under the Apache
    License" and the German word "mit" after it would be the short MIT form.
    """
    n = len(template.split())
    return n if n <= 4 else -(-5 * n // 4)


#: Of a text whose A-Z are lower-case: [^\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD = byte_class(inside=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))


def _vocabulary(terms: list[str]) -> np.ndarray:
    """Sorted hashes of different words; a word's number is its place."""
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), WORD)
    return np.sort(word_hashes(data, starts, ends))


def _numbers(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of each word, or -1 for one outside the vocabulary."""
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == h, at, -1)


class _Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], percent: int):
        self.templates, self.phrases, self.percent = templates, phrases, percent
        terms = sorted({w for text in [*(t for _, t in templates), *phrases] for w in text.split()})
        self.vocabulary = _vocabulary(terms)
        self.number = {w: int(_numbers(self.vocabulary, _vocabulary([w]))[0]) for w in terms}
        self.runs = [(np.array([self.number[w] for w in p.split()]), label) for p, label in phrases.items()]
        self.sets = [(label, frozenset(self.number[w] for w in t.split())) for label, t in templates]
        self.windows = [window(t) for _, t in templates]

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each word of the vocabulary stands in a partition."""
        total = np.zeros(len(self.vocabulary), np.int64)
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for _, _, d, o in slices(data, offsets):
                d = LOWER_BYTES[d]
                starts, ends, _ = words(d, o, WORD)
                n = _numbers(self.vocabulary, word_hashes(d, starts, ends))
                total += np.bincount(n[n >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    def order(self, counts: dict[int, int]) -> None:
        """Global order: rarest words first. Each template then has its prefix: a block with enough of its words has one of these."""
        rank = {w: i for i, w in enumerate(sorted(range(len(self.vocabulary)), key=lambda w: (counts.get(w, 0), w)))}
        size = len(self.vocabulary)
        self.least = [-(-len(s) * self.percent // 100) for _, s in self.sets]
        #: A word's place in each template, rarest first, or the size of the vocabulary.
        self.places = np.full((len(self.sets), size), size)
        for t, (_, words_) in enumerate(self.sets):
            self.places[t, sorted(words_, key=rank.get)] = np.arange(len(words_))
        self.prefix = [len(s) - least for (_, s), least in zip(self.sets, self.least, strict=True)]

    def join(self, t: int, at: np.ndarray, known: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks that meet template t: indices of their first words, and the share of the template's words they have.

        `at` are the places of the vocabulary's words in all documents of a slice, `known` their numbers, `stop` where the document
        of each ends. Of all blocks those that begin with a word of the template are enough.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        wide, least, total = self.windows[t], self.least[t], len(self.sets[t][1])
        place = self.places[t][known]
        posted = at[place <= self.prefix[t]]
        if not len(posted):
            return none
        # Prefix: only words of the template within reach of a posting of its rarest ones
        index = np.flatnonzero(place < total)
        after = np.searchsorted(posted, at[index])
        reach = (posted[np.minimum(after, len(posted) - 1)] - at[index] < wide) & (after < len(posted))
        reach |= (at[index] - posted[np.maximum(after - 1, 0)] < wide) & (after > 0)
        index = index[reach]
        where, place = at[index], place[index]
        end = np.searchsorted(where, np.minimum(where + wide, stop[index]))
        # Length: how many words of the template the block has, repeats included
        first = np.flatnonzero(end - np.arange(len(where)) >= least)
        if not len(first):
            return none
        # Position: before the rarest common word a template has only words that the block lacks
        lead = np.full(len(first), total)
        longest = int((end[first] - first).max())
        for d in range(longest):
            inside = first + d < end[first]
            lead[inside] = np.minimum(lead[inside], place[first[inside] + d])
        first = first[total - lead >= least]
        order = np.argsort(place, kind="stable")
        before = np.full(len(where), -1)
        same = place[order[1:]] == place[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        met = np.zeros(len(first), np.int64)
        for d in range(longest):
            j = np.minimum(first + d, len(where) - 1)
            met += (first + d < end[first]) & (before[j] < first)
        enough = met >= least
        return index[first[enough]], met[enough] / total

    def scan(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(1))
            rows = len(offsets) - 1
            n_words, n_base = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            first, last = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
            base, found = [set() for _ in range(rows)], [set() for _ in range(rows)]
            score = np.zeros(rows)
            for a, b, d, o in slices(data, offsets):
                d = LOWER_BYTES[d]
                starts, ends, counts = words(d, o, WORD)
                n_words[a:b] = counts
                n = _numbers(self.vocabulary, word_hashes(d, starts, ends))
                begins = np.concatenate([[0], np.cumsum(counts)])
                doc = np.repeat(np.arange(b - a), counts)
                for run, label in self.runs:
                    at = np.flatnonzero(n == run[0])
                    at = at[at + len(run) <= len(n)]
                    for j in range(1, len(run)):
                        at = at[(n[at + j] == run[j]) & (doc[at + j] == doc[at])]
                    for place, x in zip((at - begins[doc[at]]).tolist(), (doc[at] + a).tolist(), strict=True):
                        n_base[x] += 1
                        first[x], last[x] = min(first[x], place), max(last[x], place)
                        base[x].add(label)
                at = np.flatnonzero(n >= 0)
                known, stop = n[at], begins[doc[at] + 1]
                for t, (label, _) in enumerate(self.sets):
                    blocks, shares = self.join(t, at, known, stop)
                    meets = doc[at[blocks]] + a
                    np.maximum.at(score, meets, shares)
                    for x in np.unique(meets).tolist():
                        found[x].add(label)
            none = n_base == 0
            score[~none] = 1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x | y)) for x, y in zip(base, found, strict=True)]), pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: every place where the words of a phrase of PHRASES stand one after another. The method adds the labels of all
    templates of which some block has `percent` of the different words. Blocks are all runs of as many words as the template has and
    (from five words on) a quarter more, however they are wrapped into lines; a shorter text is a block. Words are ordered by how often they stand in the
    whole corpus (a first pass, of which one number per word of the templates comes to the driver). Only blocks with a word of a
    template's prefix are looked at; length and position bound what they can have, and what passes is counted out. score is the best
    share of a template's words, 1 with a base place, 0 without any label.

    The templates, a fixed list, go to every task; texts are never shuffled. Null text is empty: no words, labels "".
    Rows that repeat an id, or have none, are rows of their own; an empty table gives none. Texts of any length are read in slices of
    whole documents. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scanner = _Scanner(TEMPLATES if templates is None else templates, PHRASES, percent)
    counts = docs.select(F.col(text_col)).mapInArrow(scanner.count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    scanner.order({r["word"]: r["n"] for r in counts})
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scanner.scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


_VALUES = ", ".join(f"({i}, '{label}', string_split('{text}', ' '), {window(text)})" for i, (label, text) in enumerate(TEMPLATES))
SQL = {
    "op2_license_scan": rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM w),
f AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
b AS (
  SELECT doc_id, i, 'cc-by' AS label FROM f WHERE x = 'cc' AND y = 'by'
  UNION ALL SELECT doc_id, i, 'gpl' FROM f WHERE x = 'general' AND y = 'public' AND z = 'license'
  UNION ALL SELECT doc_id, i, 'reserved' FROM f WHERE x = 'all' AND y = 'rights' AND z = 'reserved'
),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t AS (SELECT t, label, len(list_distinct(s)) AS n, wide, list_distinct(s) AS s FROM (VALUES {_VALUES}) AS v(t, label, s, wide)),
v AS (SELECT t, n, wide, unnest(s) AS x FROM t),
e AS (SELECT doc_id, t, i, x, n, wide, count(*) OVER (PARTITION BY doc_id, t) AS c FROM p JOIN v USING (x)),
m AS (SELECT doc_id, t, max(len(list_distinct(s)) / n) AS share FROM (SELECT doc_id, t, n, list(x) OVER (PARTITION BY doc_id, t ORDER BY i RANGE BETWEEN CURRENT ROW AND wide - 1 FOLLOWING) AS s FROM e WHERE 100 * c >= {PERCENT} * n) WHERE 100 * len(list_distinct(s)) >= {PERCENT} * n GROUP BY doc_id, t),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m JOIN t USING (t) UNION ALL SELECT doc_id, label FROM b) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""
}
