"""License scans with a positional rare-token index.

The index maps each word of the license templates to its places in them. A template is looked at if its mandatory
phrases occur in the file. Its words in the file are ranked by inverse document frequency, counted over the whole corpus,
and the rarest are looked up, as many as it takes for the others to weigh less than LEAST of the template: so every offset
(file place minus template place, within SLACK words) that can reach LEAST holds one of them. Each of these offsets is
scored by the share of the template's weight that stands there, and the label is given if the best reaches LEAST. Nothing
is shared between templates: a file's labels do not depend on what other licenses it holds.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import documents

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SLACK, LEAST = 2, 0.6
#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {0} as published by the free software foundation either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {0} for more details you should have received a copy of the gnu {0} along with this program if not see"
#: Fixed values, public license texts: label, license or usual notice (whole, or a passage), phrases that must occur.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _NO_WARRANTY, ("to deal in the software without restriction",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache org licenses license 2 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software")),
    ("gpl-2", _GNU.format("general public license", 2), ("gnu general public license", "either version 2 of the license")),
    ("gpl-3", _GNU.format("general public license", 3), ("gnu general public license", "either version 3 of the license")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("lgpl-3", _GNU.format("lesser general public license", 3), ("gnu lesser general public license", "either version 3 of the license")),
    ("agpl-3", _GNU.format("affero general public license", 3), ("gnu affero general public license", "either version 3 of the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd-2", _BSD_2 + " " + _BSD_END, ("source and binary forms", "redistributions in binary form must reproduce")),
    ("bsd-3", _BSD_2 + " 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_END, ("source and binary forms", "endorse or promote products derived from this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", ("the author disclaims all warranties with regard to this software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", ("altered source versions must be plainly marked as such",)),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor", ("to any person or organization obtaining a copy of the software",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla org mpl 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law", ("dedicate any and all copyright interest",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.translate(_LOWER) if not text.islower() else text)


def phrase_places(words: list[str], places: dict[str, list[int]], phrase: list[str]) -> list[int]:
    first = places.get(phrase[0], ())
    return [i for i in first if words[i : i + len(phrase)] == phrase]


class Index:
    def __init__(self, frequency: dict[str, int], total: int) -> None:
        self.base = [(p.split(), label) for p, label in BASE]
        self.templates = [(label, t.split(), [p.split() for p in must]) for label, t, must in TEMPLATES]
        self.postings: dict[str, dict[int, list[int]]] = {}  # word -> template -> places
        for k, (_, t, _) in enumerate(self.templates):
            for i, w in enumerate(t):
                self.postings.setdefault(w, {}).setdefault(k, []).append(i)
        self.idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 1 for w in self.postings}
        self.weights = [sum(self.idf[w] for w in t) for _, t, _ in self.templates]
        self.vocabulary = frozenset(self.postings)

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        own = self.vocabulary.intersection(words)
        if not own:
            return len(words), 0, None, None, "", "", 0.0
        places: dict[str, list[int]] = {w: [] for w in own}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        hits = [(i, label) for phrase, label in self.base for i in phrase_places(words, places, phrase)]
        labels = {label for _, label in hits}
        base = ",".join(sorted(labels))
        score = 1.0 if hits else 0.0
        for label, share in self.matches(words, places):
            labels.add(label)
            score = max(score, share)
        starts = [i for i, _ in hits]
        return len(words), len(hits), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), score

    def matches(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[str, float]]:
        near: dict[str, np.ndarray] = {}  # word -> the places within SLACK of it, moved by the longest template
        pad = max(len(t) for _, t, _ in self.templates) + 2 * SLACK
        out = []
        for k, (label, template, must) in enumerate(self.templates):
            if not all(all(w in places for w in p) and phrase_places(words, places, p) for p in must):
                continue
            own = {w for w in template if w in places}
            rest = sum(self.idf[w] for w in template if w in own)
            offsets = []
            for w in sorted(own, key=lambda w: (-self.idf[w], w)):
                # the words not looked up yet do not reach LEAST by themselves
                if rest < LEAST * self.weights[k] - 1e-9:
                    break
                for i in self.postings[w].get(k, ()):
                    rest -= self.idf[w]
                    offsets.append(np.array(places[w]) - i)
            if not offsets:
                continue
            # offsets within SLACK count for the same place: a word may be missing or added
            tried = np.unique(np.concatenate(offsets)[:, None] + np.arange(-SLACK, SLACK + 1))
            held = np.zeros(len(tried))
            for i, w in enumerate(template):
                if w in own:
                    if w not in near:
                        near[w] = np.zeros(len(words) + 2 * pad, dtype=bool)
                        for d in range(-SLACK, SLACK + 1):
                            near[w][np.array(places[w]) + pad + d] = True
                    held += self.idf[w] * near[w][tried + pad + i]
            share = float(held.max()) / self.weights[k]
            if share >= LEAST:
                out.append((label, min(1.0, share)))
        return out


def fit(docs: DataFrame) -> Index:
    """Document frequencies of the templates' words over all documents; their number is fixed by the templates."""
    docs = documents(docs)
    vocabulary = Index({}, 0).vocabulary

    def count(batches):
        counts: dict[str, int] = defaultdict(int)
        total = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += 1
                for w in vocabulary.intersection(words_of(text or "")):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *counts]), pa.array([total, *counts.values()], pa.int64())], ["word", "n"])

    got = {r["word"]: r["n"] for r in docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Index(got, got.pop("", 0))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of docs.

    Words are runs of digits, a-z (after lowering A-Z) and characters beyond ASCII. Null text is empty. base_labels
    come from the base phrases, labels adds those of the templates; both are sorted and joined by commas. score is 1
    if a base phrase occurs, else the best template's share among the labels given, else 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        index = shared.value
        for batch in batches:
            rows = [index.scan(x or "") for x in batch.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
