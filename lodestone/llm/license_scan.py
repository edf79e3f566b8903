"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text and the text as a whole, so that a notice may be wrapped; a block of more than twice a template's
words is cut into overlapping windows of that many, so that any stretch as long as the template lies in one. A block meets a template if it holds THRESHOLD of the template's distinct
words. The template's words are ordered by how many documents hold them (counted over all documents), rarest first. A block that
holds none of a template's prefix can't meet it; nor can one with too few words; nor one whose words after
the first common one, in that order, are too few. What passes is counted exactly.

The templates are a short list of the caller's: they go to the tasks as they are, and no row of the table moves.

The join adds labels only where a block holds a notice, in full or in most of its words: texts with no more than a phrase of a license keep
the phrase's label alone.

Defined results: a null text counts as empty and has no words, labels or places and the score 0; places of phrases may overlap;
repeated rows are judged alike; an empty table gives an empty table; only doc_id and text are looked at;
texts of any length are scanned whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: What authors put into their works, by label. First notes of a sentence, then whole notices.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
        but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source
        code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
THRESHOLD = 0.8

#: Bytes of words as they are, A-Z in lower case, all others a space; line feeds stay in the second table.
_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
_LINES = bytes(10 if x == 10 else _WORDS[x] for x in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def lines(text: str | None) -> list[list[bytes]]:
    """The words of each line; side by side they are those of the text."""
    return [x.split() for x in (text or "").encode().translate(_LINES).split(b"\n")]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which a phrase stands in b" " + words + b" "."""
    out, word, last, at = [], 0, 0, joined.find(phrase)
    while at >= 0:
        word += joined.count(b" ", last, at)
        out.append(word)
        last, at = at, joined.find(phrase, at + 1)
    return out


class Templates:
    """Templates with their words in the global order, and the blocks' side of the join."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> None:
        self.rank = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in words(t)}, key=lambda w: (frequency.get(w, 0), w)))}
        self.items, self.prefix, self.place = [], {}, []
        for k, (label, text) in enumerate(templates):
            ranks = sorted({self.rank[w] for w in words(text)})
            need = max(1, math.ceil(threshold * len(ranks) - 1e-9))
            self.items.append((label, frozenset(ranks), ranks, need, len(words(text))))
            self.place.append({r: at for at, r in enumerate(ranks)})
            for position, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((k, position))

    def found(self, block: list[bytes], best: dict[int, float]) -> None:
        """Raise best, the largest containment of each template so far, by those that the block meets."""
        ranks = sorted({self.rank[w] for w in set(block) if w in self.rank})
        seen = set()
        for at, r in enumerate(ranks):
            for k, position in self.prefix.get(r, ()):
                if k in seen:
                    continue
                seen.add(k)  # the first common word of the two: what follows bounds the overlap
                _, own, order, need, length = self.items[k]
                if len(ranks) < need or 1 + min(len(order) - position - 1, len(ranks) - at - 1) < need:
                    continue
                size = 2 * length
                for begin in range(0, max(1, len(block) - length), length) if len(block) > size else (0,):
                    part = block[begin : begin + size] if len(block) > size else block
                    common = len(own & {self.rank[w] for w in part if w in self.rank})
                    if common >= need:
                        best[k] = max(best.get(k, 0.0), common / len(order))

    def windows(self, block: list[bytes], best: dict[int, float]) -> None:
        """found() for a whole text, by places: windows are two neighbouring parts of a template's length, and only those that hold a word of its prefix are looked at."""
        hits = [(i, self.rank[w]) for i, w in enumerate(block) if w in self.rank]
        parts: dict[int, dict[int, set[int]]] = {}  # by a template's length: the words of each part
        looked: set[tuple[int, int]] = set()
        for i, r in hits:
            for k, _ in self.prefix.get(r, ()):
                _, own, order, need, length = self.items[k]
                if length not in parts:
                    parts[length] = {}
                    for at, word in hits:
                        parts[length].setdefault(at // length, set()).add(word)
                for n in (i // length, i // length - 1):
                    # A window that begins with an empty part lies within the next.
                    if (k, n) in looked or n not in parts[length]:
                        continue
                    looked.add((k, n))
                    there = parts[length][n] | parts[length].get(n + 1, set())
                    if len(there) < need:
                        continue
                    ranks = sorted(there)
                    first = next(at for at, x in enumerate(ranks) if x in own)
                    if 1 + min(len(order) - self.place[k][ranks[first]] - 1, len(ranks) - first - 1) < need:
                        continue
                    common = len(own & there)
                    if common >= need:
                        best[k] = max(best.get(k, 0.0), common / len(order))

    def scan(self, text: str | None) -> dict[int, float]:
        return self.blocks(lines(text))

    def blocks(self, split: list[list[bytes]]) -> dict[int, float]:
        """The largest containment of each template that a line, or a window of the whole, meets."""
        best: dict[int, float] = {}
        held = [block for block in split if not self.prefix_words.isdisjoint(block)]
        for block in held:
            self.found(block, best)
        if held:
            self.windows([w for block in split for w in block], best)
        return best

    @property
    def prefix_words(self) -> frozenset:
        if not hasattr(self, "_prefix_words"):
            self._prefix_words = frozenset(w for w, r in self.rank.items() if r in self.prefix)
        return self._prefix_words


def template_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """How many documents hold each word of the templates: a row a word, whatever the number of documents."""
    wanted = frozenset(w for _, t in templates for w in words(t))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                total.update(wanted.intersection(words(text)))
        if total:
            yield pd.DataFrame({"word": [w.decode() for w in total], "n": list(total.values())})

    rows = docs.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {x["word"].encode(): x["n"] for x in rows}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and, of each text, its words, the places of phrases, their labels, all labels, and the score.

    The score is 1 where a phrase stands, else the largest containment of a template that a block meets, else 0.
    """
    join = Templates(templates, template_frequency(docs, templates), threshold)
    wanted = [(b" " + b" ".join(words(p)) + b" ", label) for p, label in phrases.items()]

    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            split = lines(text)
            ws = [w for line in split for w in line]
            joined = b" " + b" ".join(ws) + b" "
            base, labels = [], set()
            for phrase, label in wanted:
                if at := places(joined, phrase):
                    base += at
                    labels.add(label)
            best = join.blocks(split)
            every = labels | {join.items[k][0] for k in best}
            rows.append((len(ws), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), 1.0 if labels else max(best.values(), default=0.0)))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    found = F.pandas_udf(scan, SCHEMA)("text")
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")
