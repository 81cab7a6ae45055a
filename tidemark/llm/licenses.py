"""License scans through a positional index of rare words.

The templates (license notices and the openings of license texts) are indexed by their rarest words, by document
frequency over the whole table: word -> places in templates. Each of these words that a text holds is looked up, however
many there are; each place in the text minus each place in a template is a shift, and shifts on which several words agree
are candidates. A candidate counts if the template's mandatory key phrases stand in its window and enough of the
template's words stand at their relative places. Fixed phrases are found the same way: their rarest word is looked up
at every place, and the words around it are verified.

Defined results: a null text is the empty text: no words, no labels, score 0. Labels are sorted and distinct; ties
between words of equal frequency go to the lesser word. Rows don't depend on each other but for the frequencies, which
count every row of the table. Rows of a null id or of a repeated one are ordinary rows. Texts may be of any length. An
empty table gives an empty table. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

# Fixed values: (label, notice or opening words of the license, key phrases that must be there).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "this software is released under the terms of the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache license version 2 0", "in compliance with the license"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee"]),
    ("gpl", "licensed under the gnu general public license", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "free software foundation"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released into the public domain"]),
    ("cc0", "this work is released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["provided as is", "held liable"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
]
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Rarest words by which a template is indexed.
ANCHORS = 8
#: Words by which a place may be off; words of a template that must stand at their places.
SLACK, COVERAGE = 2, 0.6
#: Words that are matched at once.
WINDOW = 200_000

_fold = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_fold).split()


VOCABULARY = sorted({w for _, t, keys in TEMPLATES for x in (t, *keys) for w in words(x)} | {w for p, _ in PHRASES for w in words(p)})
_number = {w: i + 1 for i, w in enumerate(VOCABULARY)}


def codes(ws: list[bytes]) -> np.ndarray:
    """The number of each word in the vocabulary, or 0."""
    return np.fromiter(map(_number.get, ws, repeat(0)), np.int64, len(ws))


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each word of the vocabulary: sums of one short vector per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(len(VOCABULARY) + 1, dtype=np.int64)
        for pdf in batches:
            n += len(pdf)
            for t in pdf["text"]:
                df[np.unique(codes(words(t or "")))] += 1
        df[0] = n
        yield pd.DataFrame({"word": np.arange(len(df)), "n": df})

    got = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(VOCABULARY) + 1, dtype=np.int64)
    df[got["word"].to_numpy()] = got["n"].to_numpy()
    return int(df[0]), df


def runs_of(phrase: np.ndarray, code: np.ndarray, lo: int, hi: int) -> bool:
    """Whether the words of ``phrase`` stand side by side in code[lo:hi]."""
    window = code[max(lo, 0) : max(hi, 0)]
    if len(window) < len(phrase):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(window, len(phrase)) == phrase).all(axis=1).any())


class Index:
    """Postings of the templates' rarest words, for one set of document frequencies."""

    def __init__(self, rows: int, df: np.ndarray):
        idf = np.log((rows + 1) / (df + 1.0))
        self.rarity = np.empty(len(df), dtype=np.int64)  # rank 0: the rarest; equal ones by the word
        self.rarity[np.lexsort((np.arange(len(df)), -idf))] = np.arange(len(df))
        self.templates = [(label, codes(words(t)), [codes(words(k)) for k in keys]) for label, t, keys in TEMPLATES]
        postings: dict[int, list[tuple[int, int]]] = {}
        self.need = []
        for k, (_, code, _) in enumerate(self.templates):
            own = sorted(set(code.tolist()), key=self.rarity.__getitem__)
            rare = own[: max(2, min(ANCHORS, (len(own) + 1) // 2))]
            self.need.append(min(2, len(rare)))
            for at, c in enumerate(code.tolist()):
                if c in rare:
                    postings.setdefault(c, []).append((k, at))
        self.postings = {c: np.array(p, dtype=np.int64) for c, p in postings.items()}
        self.indexed = np.zeros(len(df), dtype=bool)
        self.indexed[list(postings)] = True
        self.phrases = []
        for p, label in PHRASES:
            code = codes(words(p))
            self.phrases.append((label, code, int(np.argmin(self.rarity[code]))))

    def places(self, code: np.ndarray) -> list[tuple[str, int]]:
        """(label, start) of each place of a fixed phrase: its rarest word is looked up, its neighbours verified."""
        found = []
        for label, phrase, anchor in self.phrases:
            start = np.flatnonzero(code == phrase[anchor]) - anchor
            start = start[(start >= 0) & (start + len(phrase) <= len(code))]
            for k in range(len(phrase)):
                start = start[code[start + k] == phrase[k]]
            found += [(label, int(s)) for s in start]
        return found

    def matches(self, code: np.ndarray) -> list[tuple[str, int, float]]:
        """(label, shift, share of the template's words in place) of each verified candidate.

        Long texts are gone through in windows that overlap by more than a template, so memory follows the window.
        """
        over = 2 * max(len(t) for _, t, _ in self.templates) + 4 * SLACK
        found = set()
        for a in range(0, max(len(code), 1), WINDOW):
            first = max(0, a - over)
            found |= {(label, shift + first, share) for label, shift, share in self.near(code[first : a + WINDOW + over])}
        return sorted(found)

    def near(self, code: np.ndarray) -> list[tuple[str, int, float]]:
        """The candidates of one window."""
        at = np.flatnonzero(self.indexed[code])
        if not len(at):
            return []
        votes = []
        for c in np.unique(code[at]).tolist():
            place, post = at[code[at] == c], self.postings[c]
            votes.append(np.column_stack((np.tile(post[:, 0], len(place)), (place[:, None] - post[None, :, 1]).ravel(), np.full(len(place) * len(post), c))))
        v = np.unique(np.concatenate(votes), axis=0)
        found, seen = [], set()
        # Words that agree on a shift, give or take the slack: each shift is counted with its neighbours.
        v = v[np.lexsort((v[:, 1], v[:, 0]))]
        key = v[:, 0] * (1 << 40) + v[:, 1]
        lo, hi = np.searchsorted(key, key - SLACK), np.searchsorted(key, key + SLACK, side="right")
        for k, shift, a, b in zip(v[:, 0].tolist(), v[:, 1].tolist(), lo.tolist(), hi.tolist(), strict=True):
            if (k, shift) in seen or b - a < self.need[k] or len(set(v[a:b, 2].tolist())) < self.need[k]:
                continue
            seen.add((k, shift))
            label, template, keys = self.templates[k]
            if all(runs_of(p, code, shift - SLACK, shift + len(template) + SLACK) for p in keys):
                pad = np.zeros(len(template) + 2 * SLACK, dtype=np.int64)
                first, last = max(shift - SLACK, 0), min(shift + len(template) + SLACK, len(code))
                pad[first - shift + SLACK : last - shift + SLACK] = code[first:last]
                share = float(np.any([pad[d : d + len(template)] == template for d in range(2 * SLACK + 1)], axis=0).mean())
                if share >= COVERAGE:
                    found.append((label, shift, share))
        return found


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows, df = frequencies(docs, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(rows, df)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts, 8_000_000):
                out = []
                for t in texts[a:b]:
                    code = codes(words(t))
                    base, more = index.places(code), index.matches(code)
                    starts = [s for _, s in base]
                    own = {x for x, _ in base}
                    out.append((len(code), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for x, _, _ in more})), max([1.0] * bool(base) + [s for _, _, s in more], default=0.0)))
                frame = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]).astype({"first_word": "Int64", "last_word": "Int64"})
                frame.insert(0, "id", pdf["id"].iloc[a:b].array)
                yield frame

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double").withColumnRenamed("id", id_col)
