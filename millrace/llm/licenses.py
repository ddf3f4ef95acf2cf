"""License scans with a positional index of rare template words.

1. Document frequencies of all template words are counted over the whole corpus.
2. Each template, a notice or a whole licence, is indexed by its rarest words (those of
   the highest IDF): word -> (template, position).
3. In a file every index word is looked up, whatever else the file holds. A posting gives
   the offset of the template's start, the difference of the two positions. Where enough
   different index words of a template give offsets that lie together is an alignment;
   words put in or left out move the offsets apart, and so many are tolerated.
4. An alignment counts only if the template's mandatory key phrases stand in it; its
   score is the share of the template's words that stand there in order.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, without
from .textkit import chunks, signed, span_hashes, text_hash, words

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence notices in common use: label, notice, mandatory key phrases.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ["permission is hereby granted", "without restriction"]),
    ("apache", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ["free software", "general public license"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
]

# Whole licences: label, text, mandatory key phrases.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES += [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge", "substantial portions of the software"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ["with or without fee is hereby granted", "appear in all copies"],
    ),
    ("bsd", _BSD_CONDITIONS + _BSD_DISCLAIMER, ["redistributions of source code must retain", "redistributions in binary form must reproduce"]),
    ("bsd", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER, ["redistributions of source code must retain", "endorse or promote products"]),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        ["must not be misrepresented", "altered source versions must be plainly marked"],
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
        "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        ["any person or organization obtaining a copy", "machine executable object code"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
        ["free and unencumbered software", "public domain"],
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["apache license version 2 0", "specific language governing permissions"],
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
        ["gnu general public license", "hope that it will be useful"],
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        ["gnu lesser general public license", "hope that it will be useful"],
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        ["gnu affero general public license", "hope that it will be useful"],
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["mozilla public license", "mozilla org mpl"],
    ),
]

#: Index words of a template are a share of its words, but not fewer than the least; share of them that must give offsets that lie together.
INDEXED, LEAST_INDEXED, AGREE = 1 / 6, 8, 0.6
#: Words by which the offsets of an alignment may differ, as a share of the template's words, but not fewer than the least.
DRIFT, LEAST_DRIFT = 1 / 4, 4

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def split_words(text: str) -> list[str]:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def _hash(word: str) -> int:
    return int(signed(np.array([text_hash(word)], np.uint64))[0])


class Index:
    """Template words, rarest first indexed; ``df``: documents that hold each word."""

    def __init__(self, templates, df: dict[str, int]):
        self.labels = [t[0] for t in templates]
        self.words = [np.array([_hash(w) for w in split_words(t[1])], np.int64) for t in templates]
        self.keys = [[np.array([_hash(w) for w in split_words(k)], np.int64) for k in t[2]] for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.need, self.drift, self.rare = [], [], []
        for t, (_, text, _) in enumerate(templates):
            w = split_words(text)
            rare = sorted(set(w), key=lambda x: (df.get(x, 0), x))[: max(LEAST_INDEXED, int(INDEXED * len(w)))]
            for p, x in enumerate(w):
                if x in rare:
                    self.postings[_hash(x)].append((t, p))
            self.rare.append(rare)
            self.need.append(max(2, math.ceil(AGREE * len(rare))))
            self.drift.append(max(LEAST_DRIFT, int(DRIFT * len(w))))
        self.sorted = np.array(sorted(self.postings), np.int64)

    def scan(self, h: np.ndarray, at: np.ndarray) -> dict[str, float]:
        """Labels and scores of a file with word hashes ``h``, of which those at ``at`` are indexed."""
        offsets: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, x in zip(at.tolist(), h[at].tolist(), strict=True):
            for t, q in self.postings[x]:
                offsets[t].append((p - q, x))
        found: dict[str, float] = {}
        for t, hits in offsets.items():
            if len(hits) < self.need[t]:
                continue
            hits.sort()
            inside: Counter = Counter()
            end = 0
            for k, (start, x) in enumerate(hits):
                while end < len(hits) and hits[end][0] <= start + self.drift[t]:
                    inside[hits[end][1]] += 1
                    end += 1
                if len(inside) >= self.need[t]:
                    region = h[max(0, start) : start + self.drift[t] + len(self.words[t])]
                    if all(len(consecutive(region, key)) for key in self.keys[t]):
                        share = in_order(self.words[t], region) / len(self.words[t])
                        found[self.labels[t]] = max(found.get(self.labels[t], 0.0), share)
                inside[x] -= 1
                if not inside[x]:
                    del inside[x]
        return found


def in_order(words_: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits: bit k of ``open_`` is 0 where the k-th word was matched."""
    places: dict[int, int] = defaultdict(int)
    for k, x in enumerate(words_.tolist()):
        places[x] |= 1 << k
    every = (1 << len(words_)) - 1
    open_ = every
    for x in region.tolist():
        hit = open_ & places.get(x, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return len(words_) - open_.bit_count()


def consecutive(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the words of ``phrase`` stand in a row."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = h[:n] == phrase[0]
    for k in range(1, len(phrase)):
        ok &= h[k : k + n] == phrase[k]
    return np.flatnonzero(ok)


def _hashed(b, off):
    b = LOWER[b]
    starts, ends, first = words(b, off, WORD_BYTES)
    return signed(span_hashes(b, starts, ends)), first


def _frequencies(vocabulary: list[str]):
    h = np.array([_hash(w) for w in vocabulary], np.int64)
    order = np.argsort(h)
    h, names = h[order], np.array(vocabulary, object)[order]

    def run(batches):
        total = np.zeros(len(h), np.int64)
        for batch in batches:
            for _, _, b, off in chunks(batch.column(0)):
                own, first = _hashed(b, off)
                at = np.minimum(np.searchsorted(h, own), len(h) - 1)
                hit = np.flatnonzero(h[at] == own)
                row = np.searchsorted(first, hit, "right") - 1
                pairs = np.unique(row * len(h) + at[hit])
                total += np.bincount(pairs % len(h), minlength=len(h))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total, pa.int64())], ["word", "n"])

    return run


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_chunk(b: np.ndarray, off: np.ndarray, index: Index, phrases: list[tuple[np.ndarray, str]]) -> list[tuple]:
    """One result a row of the chunk."""
    h, first = _hashed(b, off)
    spot = np.minimum(np.searchsorted(index.sorted, h), len(index.sorted) - 1)
    hits = np.flatnonzero(index.sorted[spot] == h) if len(h) else np.zeros(0, np.int64)
    hit_first = np.searchsorted(hits, first)
    places: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for phrase, label in phrases:
        at = consecutive(h, phrase)
        row = np.searchsorted(first, at, "right") - 1
        inside = at + len(phrase) <= first[row + 1] if len(at) else np.zeros(0, bool)
        for r, p in zip(row[inside].tolist(), (at - first[row])[inside].tolist(), strict=True):
            places[r].append((p, label))
    out = []
    for r in range(len(off) - 1):
        lo, hi = int(first[r]), int(first[r + 1])
        mine, base = hits[hit_first[r] : hit_first[r + 1]] - lo, places.get(r, [])
        found = index.scan(h[lo:hi], mine) if len(mine) > 1 else {}
        names = sorted({x for _, x in base})
        where = [p for p, _ in base]
        out.append((hi - lo, len(base), min(where, default=None), max(where, default=None), ",".join(names), ",".join(sorted({*names, *found})), max(found.values(), default=0.0)))
    return out


def scan(docs: DataFrame, text_col: str = "text", templates=None, phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    A null or empty text has no words, no labels ("") and score 0. Rows are scanned one
    by one, so repeated rows agree. A text is scanned whole, some 30 times its bytes of
    memory. ``templates``: (label, text, key phrases); ``phrases``: phrase -> label. Columns
    of the added names in ``docs`` are replaced; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = without(docs, *[x.split()[0] for x in RESULT.split(", ")], "__scan")
    text = F.col(text_col).cast("string")
    vocabulary = sorted({w for t in templates for w in split_words(t[1])})
    counted = docs.select(text.alias("t")).mapInArrow(_frequencies(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a template word
    index = Index(templates, {r["word"]: r["n"] for r in counted})
    hashed = [(np.array([_hash(w) for w in split_words(p)], np.int64), label) for p, label in phrases.items()]

    @F.pandas_udf(RESULT)
    def run(texts):
        import pandas as pd

        rows = [r for _, _, b, off in chunks(pa.array(texts, pa.string(), from_pandas=True)) for r in scan_chunk(b, off, index, hashed)]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.withColumn("__scan", run.asNondeterministic()(text)).select(*docs.columns, "__scan.*")
