"""License scans by matching template markup.

A template is wording with two kinds of markup: <<optional>> ... <<end>> may be left out as a whole, and
<<var:LOW-HIGH>> stands for any LOW to HIGH words. Each template compiles to one automaton over words; a text carries
the template's label where a run of its words is accepted, that is where all mandatory words stand in order and exactly.
The base labels come from fixed phrases and are never taken away.

A template is tried only at places where its first mandatory word stands, so a text costs one pass over its words plus
the automaton's steps at such places. The step set has at most one entry per template position, which bounds time by
words times template length, without backtracking.

Defined edge cases: a null or empty text has no words, counts of 0, null positions, empty labels and a score of 0.
Repeated rows are scanned row by row. Ties (several labels) are listed in sorted order. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Phrases and labels of the base scan.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label and template of the notices that the method knows, in words as people write them. Punctuation is not compared.
TEMPLATES = (
    ("gpl-notice", "<<optional>>this <<var:1-2>><<end>> <<optional>>is<<end>> licensed under <<optional>>the<<end>> <<optional>>terms of the<<end>> gnu general public license <<optional>>version <<var:1-2>><<end>>"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <<var:1-2>> of the license or <<optional>>at your option<<end>> any later version"),
    ("apache-notice", "licensed under the apache license <<optional>>version 2 0<<end>>"),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:0-8>> unless required by applicable law or agreed to in writing"),
    ("mit-notice", "<<optional>>released<<end>> <<optional>>licensed<<end>> <<optional>>distributed<<end>> under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "<<optional>>licensed under<<end>> <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by nc <<optional>>4 0<<end>>"),
    ("cc-by-sa", "<<optional>>licensed under<<end>> <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by sa <<optional>>4 0<<end>>"),
    ("cc-by-plain", "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc by 4 0"),
    ("all-rights-reserved", "all rights reserved"),
    ("lgpl-header", "this <<var:1-2>> is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> <<optional>>library<<end>> general public license as published by the free software foundation either version <<var:1-3>> of the license or <<optional>>at your option<<end>> any later version"),
    ("agpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or <<optional>>at your option<<end>> any later version"),
    ("mpl-2.0-header", "this source code form is subject to the terms of the mozilla public license v 2 0 <<optional>>if a copy of the mpl was not distributed with this file you can obtain one at <<var:1-8>><<end>>"),
    ("epl-2.0-header", "this program and the accompanying materials are made available under the terms of the eclipse public license <<optional>>v<<end>> 2 0 which <<optional>>accompanies this distribution and<<end>> is available at"),
    ("cc0-notice", "to the extent possible under law <<var:1-12>> has waived all copyright and related or neighboring rights to"),
    ("mit-full", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-full", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:2-4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:2-4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-full", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>><<optional>>3<<end>> neither the name of <<var:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission<<end>> this software is provided by <<var:2-8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:2-8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib-full", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<optional>>3<<end>> this notice may not be removed or altered from any source distribution"),
    ("unlicense-full", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("boost-full", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
)

#: To a word's byte: itself, lower-cased if A-Z; all else becomes a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

MARKUP = re.compile(r"<<(optional|end|var:(\d+)-(\d+))>>|([^\s<>]+)")


def split_words(text: bytes) -> list[bytes]:
    """The lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of UTF-8 bytes."""
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """States 0 to len(steps); state i waits for steps[i], a word or None (any word). skips[i]: states that i reaches
    without a word. The last state accepts."""

    label: str
    steps: list[bytes | None]
    skips: list[list[int]]

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.skips[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    @property
    def first_words(self) -> set[bytes | None]:
        return {self.steps[s] for s in self.closure({0}) if s < len(self.steps)}

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from at on, or -1."""
        states, end, accept = self.closure({0}), -1, len(self.steps)
        while True:
            if accept in states:
                end = at
            if at == len(words):
                return end
            states = self.closure({s + 1 for s in states if s < accept and (self.steps[s] is None or self.steps[s] == words[at])})
            if not states:
                return end
            at += 1


def compile_template(label: str, markup: str) -> Automaton:
    steps: list[bytes | None] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in MARKUP.finditer(markup):
        if m[1] == "optional":
            opened.append(len(steps))
        elif m[1] == "end":
            jumps.append((opened.pop(), len(steps)))
        elif m[1]:
            low, high = int(m[2]), int(m[3])
            steps += [None] * high
            jumps += [(len(steps) - k, len(steps)) for k in range(1, high - low + 1)]
        else:
            steps += split_words(m[4].encode())
    if opened:
        raise ValueError(f"template {label}: an optional region has no end")
    if all(s is None for s in steps):
        raise ValueError(f"template {label} has no mandatory words")
    skips: list[list[int]] = [[] for _ in range(len(steps) + 1)]
    for a, b in jumps:
        skips[a].append(b)
    return Automaton(label, steps, skips)


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.starts: dict[bytes, list[Automaton]] = {}
        for label, markup in templates:
            one = compile_template(label, markup)
            for w in one.first_words:
                if w is None:
                    raise ValueError(f"template {label} starts with a replaceable region")
                self.starts.setdefault(w, []).append(one)
        heads = sorted({p[0] for p, _ in self.phrases} | set(self.starts), key=lambda w: (-len(w), w))
        self.heads = set(heads)

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(WORD_BYTES).split()
        places: list[int] = []
        base: set[str] = set()
        found: list[tuple[int, int]] = []
        labels: set[str] = set()
        for at, w in enumerate(words):
            if w in self.heads:
                for phrase, label in self.phrases:
                    if w == phrase[0] and words[at : at + len(phrase)] == phrase:
                        places.append(at)
                        base.add(label)
                        found.append((at, at + len(phrase)))
                for one in self.starts.get(w, ()):
                    if (end := one.longest(words, at)) >= 0:
                        labels.add(one.label)
                        found.append((at, end))
        covered, last = 0, 0
        for a, b in sorted(found):
            covered += max(0, b - max(a, last))
            last = max(last, b)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), covered / len(words) if words else 0.0


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each row of docs (doc_id, text); score is the share of the words that lie in a match."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        scanner = Scanner(templates)
        found = [scanner.scan(t or b"") for t in batch["text"]]
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        return {"doc_id": batch["doc_id"]} | dict(zip(names, map(list, zip(*found)), strict=True))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), rows, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
