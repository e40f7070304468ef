"""License scan by a positional index of rare tokens.

Templates (licence notices and texts) are indexed as token -> (template, position).
A first pass counts, over all documents, how many hold each template word. Each
template's anchors are its words of highest inverse document frequency. In a second
pass every anchor occurrence at position p meets its postings at position q and votes
for the template starting at p - q; placements with enough distinct anchors are
verified: each mandatory phrase must stand consecutively within the placed window,
and the share of template words found near their places must reach ``least``.

Base phrases are found wherever their words stand consecutively, independently of
the index. No shuffle moves text. Null and empty texts give zero counts and no labels;
repeated rows are scanned alike; columns but doc_id and text don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"""
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"""
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} public license as published by the free software foundation either version {} of the license or at your option any later version"
_CC = "this work is licensed under a creative commons {} {} international license"

#: (label, text, mandatory phrases)
TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", _MIT, ["permission is hereby granted free of charge", "without restriction"]),
    ("isc", _ISC, ["with or without fee is hereby granted"]),
    ("bsd", _BSD, ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd"]),
    ("bsd", "licensed under the bsd 2 clause license", ["bsd"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", _GNU.format("general", 3), ["gnu general public license", "version 3"]),
    ("gpl-2", _GNU.format("general", 2), ["gnu general public license", "version 2"]),
    ("lgpl", _GNU.format("lesser general", 3), ["gnu lesser general public license"]),
    ("agpl-3", _GNU.format("affero general", 3), ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", _CC.format("attribution noncommercial", "4 0"), ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", _CC.format("attribution sharealike", "4 0"), ["creative commons attribution sharealike"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by", _CC.format("attribution", "4 0"), ["creative commons attribution 4"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0 1 0 universal", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("boost-1", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
]


@dataclass(frozen=True)
class LicenseConfig:
    anchors: int = 8
    least: float = 0.7
    slack: int = 4
    votes: float = 0.5


def words_of(phrase: str) -> np.ndarray:
    return scan.Words(pa.array([phrase]), scan.ALNUM).hashes(fold_case=True)


class Index:
    """The template index; ``df`` counts documents by vocabulary word."""

    def __init__(self, templates=TEMPLATES, base=BASE, cfg: LicenseConfig = LicenseConfig()) -> None:
        self.cfg = cfg
        self.labels = [t[0] for t in templates]
        self.tokens = [words_of(t[1]) for t in templates]
        self.mandatory = [[words_of(p) for p in t[2]] for t in templates]
        self.base = [(words_of(p), label) for p, label in base.items()]
        self.vocabulary = np.unique(np.concatenate(self.tokens))
        self.df = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.anchor()

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def anchor(self, df: np.ndarray | None = None) -> None:
        """Postings of each template's rarest words; ties by vocabulary order."""
        if df is not None:
            self.df = df
        word, template, place, self.need = [], [], [], []
        for t, tokens in enumerate(self.tokens):
            ids = self.ids(tokens)
            distinct = np.unique(ids)
            rare = distinct[np.lexsort((distinct, self.df[distinct]))][: self.cfg.anchors]
            self.need.append(max(1, int(np.ceil(self.cfg.votes * len(rare)))))
            at = np.flatnonzero(np.isin(ids, rare))
            word += ids[at].tolist()
            template += [t] * len(at)
            place += at.tolist()
        by = np.argsort(word, kind="stable")
        self.word, self.template, self.place = np.array(word)[by], np.array(template)[by], np.array(place)[by]
        self.from_ = np.searchsorted(self.word, np.arange(len(self.vocabulary) + 1))

    def scan(self, h: np.ndarray, ids: np.ndarray) -> dict[str, float]:
        """Label -> best score of one document."""
        p = np.flatnonzero(ids >= 0)
        count = self.from_[ids[p] + 1] - self.from_[ids[p]]
        posting = scan.ranges(self.from_[ids[p]], count)
        if not len(posting):
            return {}
        at = np.repeat(p, count)
        t, start = self.template[posting], at - self.place[posting]
        found: dict[str, float] = {}
        slack = self.cfg.slack
        by = np.lexsort((self.word[posting], start, t))
        t, start, word = t[by], start[by], self.word[posting][by]
        cuts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (start[1:] - start[:-1] > slack)]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(t))):
            k = int(t[lo])
            if len(np.unique(word[lo:hi])) < self.need[k] or found.get(self.labels[k], 0.0) == 1.0:
                continue
            tokens = self.tokens[k]
            # each placement that the votes name, commonest first
            places, votes = np.unique(start[lo:hi], return_counts=True)
            d = int(places[np.argmax(votes)])
            low = max(0, d - slack)
            window = h[low : d + len(tokens) + slack]
            if all(self._holds(window, m) for m in self.mandatory[k]):
                score = self._near(tokens, window, d - low)
                if score >= self.cfg.least:
                    found[self.labels[k]] = max(found.get(self.labels[k], 0.0), score)
        return found

    @staticmethod
    def _holds(window: np.ndarray, phrase: np.ndarray) -> bool:
        n = len(window) - len(phrase) + 1
        if n <= 0:
            return False
        ok = np.ones(n, dtype=bool)
        for i, x in enumerate(phrase):
            ok &= window[i : i + n] == x
        return bool(ok.any())

    def _near(self, tokens: np.ndarray, window: np.ndarray, at: int) -> float:
        hit = np.zeros(len(tokens), dtype=bool)
        for shift in range(-self.cfg.slack, self.cfg.slack + 1):
            q = np.arange(len(tokens)) + at + shift
            on = (q >= 0) & (q < len(window))
            hit[on] |= window[q[on]] == tokens[on]
        return float(hit.mean())


def document_frequency(docs: DataFrame, index: Index) -> np.ndarray:
    """How many documents hold each vocabulary word; one row a word and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        n = np.zeros(len(ix.vocabulary), dtype=np.int64)
        for c in scan.chunks(batches):
            w = scan.Words(scan.column(c, "text"), scan.ALNUM)
            ids = ix.ids(w.hashes(fold_case=True))
            on = ids >= 0
            pairs = np.unique(np.repeat(np.arange(w.n), w.counts)[on] * len(ix.vocabulary) + ids[on])
            n += np.bincount(pairs % len(ix.vocabulary), minlength=len(n))
        yield pa.RecordBatch.from_pydict({"word": np.flatnonzero(n), "n": n[n > 0]})

    df = np.zeros(len(index.vocabulary), dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[r.word] = r.n
    return df


def scan_documents(docs: DataFrame, templates=TEMPLATES, base=BASE, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = Index(templates, base, cfg)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index.anchor(document_frequency(docs, index))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        anchored = ix.from_[1:] > ix.from_[:-1]
        for c in scan.chunks(batches):
            w = scan.Words(scan.column(c, "text"), scan.ALNUM)
            h = w.hashes(fold_case=True)
            text = np.repeat(np.arange(w.n), w.counts)
            n_base = np.zeros(w.n, dtype=np.int64)
            first, last = np.full(w.n, np.iinfo(np.int64).max), np.full(w.n, -1)
            sets: list[set[str]] = [set() for _ in range(w.n)]
            for phrase, label in ix.base:
                k = len(phrase)
                at = np.flatnonzero(h[: max(0, len(h) - k + 1)] == phrase[0])
                for i in range(1, k):
                    at = at[h[at + i] == phrase[i]]
                at = at[text[at] == text[at + k - 1]]
                d = text[at]
                np.add.at(n_base, d, 1)
                np.minimum.at(first, d, at - w.first[d])
                np.maximum.at(last, d, at - w.first[d])
                for x in np.unique(d).tolist():
                    sets[x].add(label)
            ids = ix.ids(h)
            ids[(ids >= 0) & ~anchored[ids]] = -1
            touched = np.unique(text[ids >= 0])
            more: list[dict[str, float]] = [{}] * w.n
            for x in touched.tolist():
                more[x] = ix.scan(h[w.first[x] : w.first[x + 1]], ids[w.first[x] : w.first[x + 1]])
            some = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [
                    scan.column(c, "doc_id"),
                    pa.array(w.counts.astype(np.int64)),
                    pa.array(n_base),
                    pa.array(first, mask=~some),
                    pa.array(last, mask=~some),
                    pa.array([",".join(sorted(s)) for s in sets]),
                    pa.array([",".join(sorted(s | m.keys())) for s, m in zip(sets, more)]),
                    pa.array([1.0 if s else max(m.values(), default=0.0) for s, m in zip(sets, more)]),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
