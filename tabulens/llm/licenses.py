"""License scans by an exact set-similarity join of text blocks with templates.

A block is a run of up to half again as many consecutive words as the template has, across lines. Tokens are ordered by their
frequency in the whole corpus, the rarest first. A block that contains enough of a template's words must hold one of the
words in the template's prefix, so only the surroundings of such words are looked at; length and position bounds leave few
of these, and in each the best block is found exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.llm.common import BATCH_BYTES, Rows, as_bytes, blocks, bounded, text_or_empty

#: Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences that public licenses or their notices are known by, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license see license file": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "distributed under the gnu general public license version": "gpl",
    "this work is licensed under a creative commons attribution international license": "cc-by",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd",
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software": "unlicense",
}
#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8
#: Bytes that a table of templates may have: it goes to every task.
TEMPLATE_BYTES = 16 << 20

#: Lower-cases A-Z and blanks the ASCII signs that are no part of a word.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


@dataclass
class Templates:
    """Templates with their words in global order, and an index of their prefixes.

    ``frequency`` maps a word to its count in the corpus; words that it lacks count as absent there.
    """

    texts: dict[str, str]
    frequency: dict[bytes, int]
    containment: float = CONTAINMENT
    sets: list[list[bytes]] = field(init=False)
    index: dict[bytes, list[int]] = field(init=False)

    def __post_init__(self) -> None:
        self.labels = list(self.texts.values())
        lists = [t.encode().translate(_FOLD).split() for t in self.texts]
        self.sets = [sorted({*x}, key=self.rank) for x in lists]
        self.needs = [math.ceil(self.containment * len(s) - 1e-9) for s in self.sets]
        self.vocabulary = {w for s in self.sets for w in s}
        self.places = [{w: i for i, w in enumerate(s)} for s in self.sets]
        self.widths = [len(x) * 3 // 2 for x in lists]
        self.index = defaultdict(list)
        for t, s in enumerate(self.sets):
            for w in s[: len(s) - self.needs[t] + 1]:
                self.index[w].append(t)
        self.index = dict(self.index)

    def rank(self, word: bytes) -> tuple[int, bytes]:
        return self.frequency.get(word, 0), word

    def likely(self, t: int, block: set[bytes]) -> bool:
        """Whether the block may hold enough of the template's words: by its length, then by the place of its rarest one."""
        if len(block) < self.needs[t]:
            return False
        return len(self.sets[t]) - min(map(self.places[t].__getitem__, block)) >= self.needs[t]

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, float, int]]:
        """(template, containment, first word) of the best block of each template that a block holds enough of, the first of equals."""
        if not (known := self.vocabulary.intersection(words)) or self.index.keys().isdisjoint(known):
            return
        at = [i for i, w in enumerate(words) if w in known]
        near: dict[int, list[int]] = defaultdict(list)
        for i in at:
            for t in self.index.get(words[i], ()):
                near[t].append(i)
        for t, hits in near.items():
            place, width, best, where = self.places[t], self.widths[t], 0, 0
            begin = hits[0]
            for k, hit in enumerate(hits):
                if k + 1 < len(hits) and hits[k + 1] - hit < 2 * width:
                    continue
                # no block with a prefix word lies outside of begin - width + 1 .. hit + width - 1
                own = [i for i in at[bisect_left(at, begin - width + 1) : bisect_left(at, hit + width)] if words[i] in place]
                begin = hits[k + 1] if k + 1 < len(hits) else 0
                if not self.likely(t, {words[i] for i in own}):
                    continue
                held: Counter[bytes] = Counter()
                kinds = left = 0
                for i in own:
                    held[words[i]] += 1
                    kinds += held[words[i]] == 1
                    while i - own[left] >= width:
                        held[words[own[left]]] -= 1
                        kinds -= held[words[own[left]]] == 0
                        left += 1
                    if kinds > best:
                        best, where = kinds, own[left]
            if best >= self.needs[t]:
                yield t, best / len(self.sets[t]), where


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(index of the first word, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at, place, last = joined.find(key), 0, 0
        while at >= 0:
            place, last = place + joined.count(b" ", last, at), at
            out.append((place, label))
            at = joined.find(key, at + 1)
    return out


def template_table(table: DataFrame, text: str = "text", label: str = "label") -> dict[str, str]:
    """Templates from a table (text, label); rows without a text, a word or a label are left out, of equal texts the least label holds.

    Raises ValueError if there are more than TEMPLATE_BYTES of them, counted before anything is read to the driver.
    """
    rows = table.select(F.trim(F.col(text).cast("string")).alias("text"), F.col(label).cast("string").alias("label")).dropna()
    rows = rows.groupBy("text").agg(F.min("label").alias("label"))
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > TEMPLATE_BYTES:
        raise ValueError("the templates are too large to go to every task")
    found = {r["text"]: r["label"] for r in rows.orderBy("text").collect()}
    return {t: x for t, x in found.items() if t.encode().translate(_FOLD).split()}


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of ``vocabulary`` occurs in all texts; as many rows as it has words reach the driver."""
    wanted = frozenset(vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                total.update(w for w in data.translate(_FOLD).split() if w in wanted)
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select(text_or_empty(text).alias("text_")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | DataFrame | None = None, containment: float = CONTAINMENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) for every whole text.

    ``matches`` lists (template, containment, first_word) of the join, the best block of each. Texts without words, empty
    and null ones have no match, null first and last word, empty labels and score 0. Templates are a dictionary from text
    to label, or a table of ``template_table``, and go to every task; repeated rows and null keys stay as they are; other
    columns of ``docs`` play no part.
    """
    bounded(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    templates = template_table(templates) if isinstance(templates, DataFrame) else TEMPLATES if templates is None else templates
    frequency = word_counts(docs, {w for t in templates for w in t.encode().translate(_FOLD).split()}, text)
    schema = pa.schema([(key, pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = Templates(templates, frequency, containment), list(templates)
        out = Rows(schema)
        for part in blocks(batches, BATCH_BYTES, "text_"):
            for k, data in zip(part.column(0).to_pylist(), as_bytes(part.column(1)), strict=True):
                words = data.translate(_FOLD).split()
                places = phrase_places(words, phrases)
                best = {t: (share, at) for t, share, at in known.matches(words)}
                base = {label for _, label in places}
                at = [i for i, _ in places]
                labels = base | {known.labels[t] for t in best}
                score = max([1.0 if places else 0.0, *(share for share, _ in best.values())])
                row = k, len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"template": names[t], "containment": s, "first_word": i} for t, (s, i) in sorted(best.items())]
                yield from out.add(row, 200)
        yield from out.flush()

    kind = f"{key} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template: string, containment: double, first_word: long>>"
    return docs.select(F.col(key).cast("long").alias(key), text_or_empty(text).alias("text_")).mapInArrow(run, kind)
