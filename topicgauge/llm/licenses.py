"""License scans: matching statistics of texts against licence templates.

A generalised suffix automaton holds every run of words of all templates.
Streaming a text's words through it gives, at each place, the longest run that
ends there and lies in some template. Long runs that follow each other in one
template are chained into a span, with the share of the template it covers.
The words that tell licences apart (versions, "lesser", "sharealike") decide: a
span must hold all of its template's, and none may stand between its runs.
Phrases are templates too: a phrase ends where the run is at least as long as
it and the automaton's state has it as a suffix, so every place is found.

Defined results: a null text is an empty one; texts without words have no
places, no labels and score 0.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose every place counts, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wordings of licence notices, by label.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, "
        "including but not limited to the warranties of merchantability, fitness for a particular "
        "purpose and noninfringement.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "Creative Commons Attribution ShareAlike 4.0 International License",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ],
    "lgpl-2.1": [
        "under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "lgpl-3": [
        "under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "agpl-3": [
        "under the terms of the GNU Affero General Public License as published by the Free Software "
        "Foundation, either version 3 of the License, or (at your option) any later version",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "cc0": [
        "CC0 1.0 Universal Public Domain Dedication",
        "Creative Commons Zero v1.0 Universal",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "Creative Commons Attribution NoDerivatives 4.0 International License",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software",
    ],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software "
        "Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "bsd-3": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior "
        "written permission",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies"
    ],
}

# Shortest run that may enter a chain, and the words that may lie between two runs.
MIN_RUN = 4
MAX_GAP = 8
# Share of a template that a chain must cover to give its label.
MIN_COVER = 0.75

# Words that tell one licence from its kin; numbers do so too.
DECISIVE = frozenset(
    b"lesser library affero noncommercial nc nd sa sharealike noderivatives noderivs zero".split()
)


def is_decisive(word: bytes) -> bool:
    return word in DECISIVE or word.isdigit()


# Separators become blanks and A-Z lower case; other bytes belong to words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and non-ASCII characters."""
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over words, with phrase and template places."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.templates: list[tuple[str, int]] = []
        self.phrases = [(tokens(p), label) for p, label in phrases.items()]
        if any(not p for p, _ in self.phrases):
            raise ValueError("a phrase needs a word")
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        coded = [
            (label, [self._code(w) for w in tokens(text)])
            for label, texts in templates.items()
            for text in texts
        ]
        # Places of each template's decisive words.
        self.decisive: list[set[int]] = []
        for texts in templates.values():
            for text in texts:
                self.decisive.append({i for i, w in enumerate(tokens(text)) if is_decisive(w)})
        for number, (label, run) in enumerate(coded):
            self.templates.append((label, len(run)))
            self._add(run)
        phrase_codes = [[self._code(w) for w in p] for p, _ in self.phrases]
        for run in phrase_codes:
            self._add(run)
        # Places of a state: (template, last word); those of longer contexts count too.
        for number, (_, run) in enumerate(coded):
            state = 0
            for place, code in enumerate(run):
                state = self.next[state][code]
                ends[state].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.longest[s]):
            ends[self.link[state]] |= ends[state]
        self.ends = [sorted(ends[s]) for s in range(len(self.next))]
        # Phrases that are suffixes of what a state stands for.
        own: dict[int, list[int]] = defaultdict(list)
        for number, run in enumerate(phrase_codes):
            state = 0
            for code in run:
                state = self.next[state][code]
            own[state].append(number)
        self.suffix_phrases: list[list[int]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.longest[s]):
            self.suffix_phrases[state] = self.suffix_phrases[self.link[state]] + own[state]
        self.shortest = min([MIN_RUN, *map(len, phrase_codes)])

    def _code(self, word: bytes) -> int:
        return self.words.setdefault(word, len(self.words))

    def _state(self, longest: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.longest.append(longest)
        return len(self.next) - 1

    def _split(self, source: int, code: int) -> int:
        """The state of `source` followed by `code` alone, taken out of a longer one if needed."""
        target = self.next[source][code]
        if self.longest[target] == self.longest[source] + 1:
            return target
        part = self._state(self.longest[source] + 1)
        self.next[part] = dict(self.next[target])
        self.link[part], self.link[target] = self.link[target], part
        while source != -1 and self.next[source].get(code) == target:
            self.next[source][code] = part
            source = self.link[source]
        return part

    def _add(self, run: list[int]) -> None:
        last = 0
        for code in run:
            if code in self.next[last]:
                last = self._split(last, code)
                continue
            state = self._state(self.longest[last] + 1)
            source = last
            while source != -1 and code not in self.next[source]:
                self.next[source][code] = state
                source = self.link[source]
            self.link[state] = 0 if source == -1 else self._split(source, code)
            last = state

    def scan(self, text_words: list[bytes]):
        """Places of phrases, as (first word, phrase), and runs that nothing lengthens.

        A run is (first word, length, state). Words that no template has end
        every run, so only stretches of known words are streamed.
        """
        codes = list(map(self.words.get, text_words))
        places, runs, n, at = [], [], len(codes), 0
        while at < n:
            if codes[at] is None:
                at += 1
                continue
            end = at
            while end < n and codes[end] is not None:
                end += 1
            if end - at >= self.shortest:
                self._stream(codes, at, end, places, runs)
            at = end
        return places, runs

    def _stream(self, codes, start, end, places, runs) -> None:
        follow, link, longest = self.next, self.link, self.longest
        state = size = 0
        for at in range(start, end):
            code = codes[at]
            was, had = state, size
            while state and code not in follow[state]:
                state = link[state]
                size = longest[state]
            if code in follow[state]:
                state, size = follow[state][code], size + 1
            if size <= had and had >= MIN_RUN:
                runs.append((at - had, had, was))
            # A phrase is a suffix of the run only if the run is as long.
            for number in self._phrases_of(state, size):
                places.append((at + 1 - len(self.phrases[number][0]), number))
        if size >= MIN_RUN:
            runs.append((end - size, size, state))

    def _phrases_of(self, state: int, size: int) -> list[int]:
        found = self.suffix_phrases[state]
        return [p for p in found if len(self.phrases[p][0]) <= size] if found else found

    def chains(
        self, runs: list[tuple[int, int, int]], text_words: list[bytes] = ()
    ) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of all chained spans.

        Runs are met from left to right. A run goes on with the chain of its
        template that ends last, if it lies after it in the template and within
        MAX_GAP words in text and template, with no decisive word of
        `text_words` in the gap; else it starts a chain of its own. Chains
        without all decisive words of their template are none.
        """
        # By template: first word, end, last place in the template, words covered, decisive places.
        open_chains: dict[int, list] = {}
        done: list[tuple[str, int, int, float]] = []

        def close(number: int) -> None:
            first, end, _, covered, held = open_chains.pop(number)
            label, size = self.templates[number]
            if held == self.decisive[number]:
                done.append((label, first, end, covered / size))

        def decided(number: int, last: int, size: int) -> set[int]:
            return {x for x in self.decisive[number] if last - size < x <= last}

        for first, size, state in runs:
            last_of: dict[int, list[int]] = defaultdict(list)
            for number, last in self.ends[state]:
                last_of[number].append(last)
            for number, lasts in last_of.items():
                chain = open_chains.get(number)
                if chain:
                    # Words that both runs share count once.
                    fresh = min(size, first + size - chain[1])
                    fits = [x for x in lasts if chain[2] + fresh <= x <= chain[2] + fresh + MAX_GAP]
                    plain = not any(map(is_decisive, text_words[chain[1] : first]))
                    if fits and fresh > 0 and first - chain[1] <= MAX_GAP and plain:
                        chain[1], chain[2] = first + size, fits[0]
                        chain[3] += fresh
                        chain[4] |= decided(number, fits[0], size)
                        continue
                    if chain[3] > size and first - chain[1] <= MAX_GAP:
                        continue  # a shorter piece that does not follow
                    close(number)
                last = lasts[0]
                open_chains[number] = [first, first + size, last, size, decided(number, last, size)]
        for number in list(open_chains):
            close(number)
        return done


def scan_text(automaton: SuffixAutomaton, text: str | None) -> dict:
    found = tokens(text)
    places, runs = automaton.scan(found)
    base = {automaton.phrases[p][1] for _, p in places}
    spans = [s for s in automaton.chains(runs, found) if s[3] >= MIN_COVER]
    score = 1.0 if base else max((s[3] for s in spans), default=0.0)
    return {
        "n_words": len(found),
        "n_base": len(places),
        "first_word": min((x for x, _ in places), default=None),
        "last_word": max((x for x, _ in places), default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": min(score, 1.0),
        "spans": sorted(
            ({"label": a, "first": b, "end": c, "cover": d} for a, b, c, d in spans),
            key=lambda s: (s["first"], s["label"]),
        ),
    }


SCANNED = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, "
    "spans array<struct<label:string,first:long,end:long,cover:double>>"
)


def scan(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Licence places, labels and template spans of every whole text, one row per document.

    `templates` (label → wordings) and `phrases` (phrase → label) are of fixed
    size and travel with the function; rows are scanned where they lie.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = SuffixAutomaton(templates, phrases)
        names = [x.strip().split(" ")[0] for x in SCANNED.split("spans ")[0].split(",")[:-1]]
        for texts in batches:
            rows = [scan_text(automaton, x) for x in texts]
            out = pd.DataFrame(rows, columns=[*names, "spans"])
            for name in ("first_word", "last_word"):
                out[name] = out[name].astype("Int64")
            yield out

    kernel = F.pandas_udf(scanned, SCANNED)
    out = docs.select("doc_id", kernel("text").alias("_found"))
    return out.select("doc_id", "_found.*")
