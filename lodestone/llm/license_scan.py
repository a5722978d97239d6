"""Licence detection by a positional index of rare licence words.

Every licence template is indexed by its words with their positions. Of a file only the
licence words of high inverse document frequency (over the templates) are looked up; each
hit votes for a template at a relative position, and postings are intersected by adding up the
votes of one (template, position). Where more of a template's rare words are out of place than its
share of missing weight allows, its text is not looked at; else a candidate stands if enough of the template's weight
is in place and all its mandatory key phrases are. Fixed base phrases are counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import fresh, trimmed

#: Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Parameter: (label, opening or notice of the public licence, mandatory key phrases).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights cc0", ("waived all copyright",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
)

#: Bytes of words, lower-cased; all others part them. UTF-8 bytes from 0x80 on belong to words.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(_WORD_BYTES).split()


def _starts(at: list[bytes], phrase: list[bytes], places: list[int], anchor: int) -> list[int]:
    n = len(phrase)
    return [p - anchor for p in places if p >= anchor and at[p - anchor : p - anchor + n] == phrase]


@dataclass
class Index:
    """The positional index. ``rare_share`` of the templates at most hold a word that is looked up."""

    templates: tuple = TEMPLATES
    base: dict = field(default_factory=lambda: dict(BASE))
    rare_share: float = 0.34
    least: float = 0.7

    def __post_init__(self):
        self.bodies = [t.encode().split() for _, t, _ in self.templates]
        holds = Counter(w for b in self.bodies for w in set(b))
        self.idf = {w: math.log((1 + len(self.bodies)) / n) for w, n in holds.items()}
        rare = {w for w, n in holds.items() if n <= max(1, self.rare_share * len(self.bodies))}
        self.postings = defaultdict(list)
        self.rare_weight = []
        for t, body in enumerate(self.bodies):
            kept = {w for w in body if w in rare} or {max(body, key=self.idf.__getitem__)}
            self.rare_weight.append(sum(self.idf[w] for w in body if w in kept))
            for p, w in enumerate(body):
                if w in kept:
                    self.postings[w].append((t, p))
        self.weight = [sum(map(self.idf.__getitem__, b)) for b in self.bodies]
        self.keys = [[k.encode().split() for k in keys] for _, _, keys in self.templates]
        self.phrases = []
        for phrase, label in self.base.items():
            p = phrase.encode().split()
            anchor = max(range(len(p)), key=lambda i: self.idf.get(p[i], 9.0))
            self.phrases.append((p, anchor, label))
        self.looked = frozenset(self.postings) | {p[a] for p, a, _ in self.phrases}

    def scan(self, text: str):
        """(words, base places, first start, last start, base labels, labels, score)."""
        at = words(text)
        present = self.looked.intersection(at)
        if not present:
            return len(at), 0, None, None, "", "", 0.0
        places = defaultdict(list)
        for i, w in enumerate(at):
            if w in present:
                places[w].append(i)
        n_base, lowest, highest, base, labels, score = 0, None, None, set(), set(), 0.0
        for phrase, anchor, label in self.phrases:
            if found := _starts(at, phrase, places.get(phrase[anchor], ()), anchor):
                n_base += len(found)
                lowest = found[0] if lowest is None else min(lowest, found[0])
                highest = found[-1] if highest is None else max(highest, found[-1])
                base.add(label)
                score = 1.0
        votes: dict[tuple[int, int], float] = defaultdict(float)
        for w in sorted(present, key=lambda w: (-self.idf.get(w, 0.0), w)):
            for t, p in self.postings.get(w, ()):
                for i in places[w]:
                    votes[t, i - p] += self.idf[w]
        for (t, start), vote in votes.items():
            # What is missing of the rare words is missing of the whole: with more than that allows, no window can do.
            if self.rare_weight[t] - vote > (1 - self.least) * self.weight[t] + 1e-9:
                continue
            body = self.bodies[t]
            window = at[max(0, start) : max(0, start) + len(body) - max(0, -start)]
            share = sum(self.idf[b] for a, b in zip(window, body[max(0, -start) :], strict=False) if a == b) / self.weight[t]
            if share >= self.least and share > 0 and all(self._in(window, k) for k in self.keys[t]):
                labels.add(self.templates[t][0])
                score = max(score, min(1.0, share))
        return len(at), n_base, lowest, highest, ",".join(sorted(base)), ",".join(sorted(base | labels)), score

    @staticmethod
    def _in(window: list[bytes], key: list[bytes]) -> bool:
        return any(window[i : i + len(key)] == key for i in range(len(window) - len(key) + 1))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())


def license_scan(docs: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """All rows of ``docs`` plus word count, base places, labels and score (see ``Index.scan``).

    A null or empty text has no words, empty labels and score 0. Rows are independent;
    an empty table stays empty; columns that bear the names of the results are replaced."""
    index = index or Index()
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    docs = docs.drop(*names)
    own = fresh(docs, "__text")

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(own)
            found = [index.scan(t or "") for lo in range(0, batch.num_rows, 256) for t in batch.column(at).slice(lo, 256).to_pylist()]
            made = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), _TYPES, strict=True)] if found else [pa.array([], k) for k in _TYPES]
            kept = [i for i in range(len(batch.schema.names)) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *made], names=[*(batch.schema.names[i] for i in kept), *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return docs.withColumn(own, F.col(text)).mapInArrow(trimmed(run), fields + SCHEMA)
