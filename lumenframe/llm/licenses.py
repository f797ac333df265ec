"""License scans: fuzzy search for short notices.

A notice may be found with as many edits (insertions, deletions and
substitutions of characters) as ERROR_RATE of its length. Cut into one piece
more than edits, one piece is in every such match unchanged: an Aho-Corasick
automaton over all pieces finds these exact seeds in one pass, and the regex
library's bounded-error matching verifies the edits around each seed and gives
the span.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heappop, heappush

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import common as C

#: Edits that a match may have, as a part of the notice's length.
ERROR_RATE = 0.1
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2", "GNU General Public License as published by the Free Software Foundation, either version 2"],
    "LGPL": ["GNU Lesser General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification", "Licensed under the BSD License", "governed by a BSD-style license"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License", "Mozilla Public License, version 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0"],
    "EPL-2.0": ["under the terms of the Eclipse Public License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC0-1.0": ["CC0 1.0 Universal", "dedicated to the public domain"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "SPDX": ["SPDX-License-Identifier:"],
    "proprietary": ["All rights reserved."],
}


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Scanner:
    def __init__(self, notices: dict[str, list[str]], rate: float = ERROR_RATE):
        self.notices = [(name, folded(text)) for name, texts in sorted(notices.items()) for text in texts if text]
        self.edits = [int(len(text) * rate) for _, text in self.notices]
        self.compiled: dict[tuple[int, int], regex.Pattern] = {}
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, ((_, text), k) in enumerate(zip(self.notices, self.edits)):
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(text[a:b], []).append((i, a))
        # of the notice's grams, each edit spoils at most three: the others are in any text that matches
        self.grams = [frozenset(text[j : j + 3] for j in range(len(text) - 2)) for _, text in self.notices]
        self.least = [len(text) - 2 - 3 * k for (_, text), k in zip(self.notices, self.edits)]
        self.seeds = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def _match(self, i: int, edits: int) -> regex.Pattern:
        """A notice with so many edits at most."""
        if (i, edits) not in self.compiled:
            self.compiled[i, edits] = regex.compile(f"(?:{regex.escape(self.notices[i][1])}){{e<={edits}}}")
        return self.compiled[i, edits]

    def best(self, low: str, i: int, a: int, b: int) -> tuple[int, int, int] | None:
        """(edits, -length, start) of the best match of a notice in a span of a folded text: of fewest edits, then the longest, then the first."""
        notice, k = self.notices[i][1], self.edits[i]
        n = len(notice)
        if b - a < n - k:
            return None
        at = low.find(notice, a, b)
        if at >= 0:
            return 0, -n, at
        if not k or not self._match(i, k).search(low, a, b):
            return None
        for edits in range(1, k + 1):
            match, found = self._match(i, edits), None
            for m in match.finditer(low, a, b, overlapped=True):
                start, size = m.start(), n + edits
                while not match.fullmatch(low, start, min(start + size, b)):  # the longest that starts here; m itself is one
                    size -= 1
                size = min(size, b - start)
                if found is None or -size < found[1]:
                    found = edits, -size, start
            if found:
                return found
        return None

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(license, number of its notice, start, end, edits) of all matches, in order; of overlapping ones the one of fewest edits, then the longest, then the first."""
        low = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.seeds.iter(low):
            for i, at in where:
                k, n = self.edits[i], len(self.notices[i][1])
                start = end + 1 - size - at
                a, b = max(0, start - k), start + n + k
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        todo: list[tuple[int, int, int, int, int, int]] = []  # (edits, -length, start, notice, span) of each span's best match

        def look(i: int, a: int, b: int) -> None:
            if found := self.best(low, i, a, b):
                heappush(todo, (*found, i, a, b))

        for i, mine in windows.items():
            mine.sort()
            merged = [mine[0]]
            for a, b in mine[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            grams = self.grams[i]
            for a, b in merged:
                if sum(low[j : j + 3] in grams for j in range(a, min(b, len(low)) - 2)) >= self.least[i]:
                    look(i, a, min(b, len(low)))
        starts: list[int] = []  # of the matches taken, in order
        taken: dict[int, tuple[str, int, int, int, int]] = {}
        while todo:
            edits, size, start, i, a, b = heappop(todo)
            at = bisect_left(starts, a)
            if at and taken[starts[at - 1]][3] > a:
                at -= 1
            held = [taken[s] for s in starts[at : bisect_left(starts, b)]]
            end = start - size
            if all(x[3] <= start or end <= x[2] for x in held):
                insort(starts, start)
                taken[start] = self.notices[i][0], i, start, end, edits
                held = [taken[start]]
            for x in held:  # what is left of the span
                look(i, a, x[2])
                a = x[3]
            look(i, a, b)
        return [taken[s] for s in starts]


def scan(docs: DataFrame, notices: dict[str, list[str]] | None = None, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, license, notice, start, stop, edits, matched): every notice in every text, with its span in characters.

    Needs doc_id and text. Case is ignored; a line break counts as an edit of
    a space. Matches don't overlap: of all spans within the edits of some
    notice the one of fewest edits is given, then the longest, then the first,
    then that of the first notice; then again, of those that don't overlap it.
    A null or empty text has no matches; repeated rows have equal results; ids
    keep their type; long texts are taken whole; an empty table gives no rows;
    other columns are ignored.
    """
    C.arrow_batches(docs.sparkSession)
    given = NOTICES if notices is None else notices
    docs = docs.select(C.own(docs, "doc_id").alias("doc_id"), C.own(docs, "text").alias("text")).where("text is not null")

    def run(batches):
        scanner = Scanner(given, rate)
        names = [t for _, t in scanner.notices]
        for batch in batches:
            rows = [(d, name, names[i], a, b, e, text[a:b]) for d, text in enumerate(batch.column("text").to_pylist()) for name, i, a, b, e in scanner.scan(text)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            at, *cols = (pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), *cols], names=["doc_id", "license", "notice", "start", "stop", "edits", "matched"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, license string, notice string, start long, stop long, edits int, matched string")


def op3_fuzzy_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document."""
    return scan(C.table(spark, sf_dir, "documents"))
