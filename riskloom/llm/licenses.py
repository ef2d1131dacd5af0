"""License scan by an exact set-similarity join between text blocks and license templates.

A template is a whole license text, a notice, or a phrase. Its blocks in a text are all runs of `reach` consecutive
words, REACH times as many as the template has, one starting at every word. A template meets a block if the block
holds at least `threshold` of the template's distinct words. Words are ordered by their frequency in the whole corpus,
rare first. A block that meets a template shares one of the template's first |T| - need + 1 words (prefix filter), so
only the stretches of a text around such words are looked at; a stretch must have `need` words (length filter), and
from the first word that it shares on, the template must have `need` words left (positional filter). In what passes,
running counts over the places of the template's words give the shared words of every block, so that each block
that meets the threshold is found. Blocks that follow each other are one match: its span runs from the first to
the last of the template's words in them, its containment is that of the best block.

Ordered templates are phrases: their words must stand one after the other, and every place of theirs counts.

Only templates are sent to the executors, in batches of at most BATCH_WORDS words in the order given (a template with more words is a
batch of its own); each batch is a pass over the texts, so any number of templates is scanned for, with the same matches.

Defined results: null and empty texts have no words and no matches; a template without words matches nothing; matches
with equal bounds of several templates are all returned, in the order of templates, then places; rows that repeat a key
are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import Shared, kept_fields, map_slices, texts_of

#: Words of a block for each word of the template.
REACH = 1.25
#: Words of the templates that are sent to every executor at once; some ten MB.
BATCH_WORDS = 200_000
#: Upper-case ASCII letters become lower case; whatever else is ASCII and no letter or digit becomes a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 1.0
    ordered: bool = False  # a phrase


#: Phrases that name a license.
BASE = (Template("cc-by", "cc by", ordered=True), Template("gpl", "general public license", ordered=True), Template("reserved", "all rights reserved", ordered=True))
#: Sentences and notices of common public licenses.
SENTENCES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.85),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", 0.85),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.85),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.85),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", 0.85),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.85),
)
#: Whole texts of common public licenses, without names and years.
TEXTS = (
    Template(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        0.8,
    ),
    Template(
        "bsd-3-clause-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        0.8,
    ),
    Template(
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        0.8,
    ),
    Template(
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
        0.8,
    ),
    Template(
        "apache-notice-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        0.8,
    ),
    Template(
        "gpl-notice-text",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        0.8,
    ),
    Template(
        "unlicense-text",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
        0.8,
    ),
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def template_frequencies(df: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of the templates occurs in the whole corpus."""
    vocabulary = {w for t in templates for w in words_of(t.text)}
    shared = Shared(df.sparkSession, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[bytes, int] = {}
        for text in texts_of(batch, text_col):
            for w in filter(shared.value.__contains__, words_of(text)):
                counts[w] = counts.get(w, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = map_slices(df.select(text_col), run, T._parse_datatype_string("word binary, n long")).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocabulary, 0) | {bytes(r["word"]): r["n"] for r in found}


class Index:
    """Templates ready for the join."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int]):
        self.templates = templates
        words = [words_of(t.text) for t in templates]
        # a word's number is its place in the order of frequencies
        self.number = {w: r for r, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.words = [np.array([self.number[w] for w in x], np.int64) for x in words]
        self.ordered = [np.unique(x) for x in self.words]
        self.reach = [max(1, int(REACH * len(x))) for x in self.words]
        self.need = [max(1, -int(-len(o) * t.threshold // 1)) for o, t in zip(self.ordered, templates, strict=True)]
        self.prefix: dict[bytes, list[int]] = {}
        name = list(self.number)
        for k, (o, need) in enumerate(zip(self.ordered, self.need, strict=True)):
            for r in o[: max(0, len(o) - need + 1)].tolist():
                self.prefix.setdefault(name[r], []).append(k)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, containment) of each match, sorted."""
        held = self.prefix.keys() & set(words)
        if not held:
            return []
        number = self.number
        places, numbers = [], []
        for i, w in enumerate(words):
            r = number.get(w)
            if r is not None:
                places.append(i)
                numbers.append(r)
        at, of = np.array(places, np.int64), np.array(numbers, np.int64)
        out = []
        for k in sorted({k for w in held for k in self.prefix[w]}):
            out += self._phrase(k, at, of) if self.templates[k].ordered else self._blocks(k, at, of, len(words))
        return sorted(out)

    def _phrase(self, k: int, at: np.ndarray, of: np.ndarray) -> list[tuple[int, int, int, float]]:
        phrase, n = self.words[k], len(self.words[k])
        start = np.arange(max(0, len(at) - n + 1))
        good = at[start + n - 1] - at[start] == n - 1
        for j in range(n):
            good &= of[start + j] == phrase[j]
        return [(k, int(a), int(a) + n, 1.0) for a in at[start[good]]]

    def _blocks(self, k: int, at: np.ndarray, of: np.ndarray, n_words: int) -> list[tuple[int, int, int, float]]:
        words, need, reach = self.ordered[k], self.need[k], self.reach[k]
        own = np.isin(of, words)
        at, of = at[own], of[own]
        rare = at[of <= words[len(words) - need]]  # places of the template's prefix
        out = []
        # stretches that the blocks around these places cover, clipped to the text
        cuts = np.flatnonzero(np.diff(rare) >= 2 * reach - 1) + 1
        for part in np.split(rare, cuts):
            if not len(part):
                continue
            low, high = max(0, int(part[0]) - reach + 1), min(n_words, int(part[-1]) + reach)
            x, y = np.searchsorted(at, [low, high])
            here, what = at[x:y], of[x:y]
            first = int(np.searchsorted(words, what.min()))
            if high - low < need or len(words) - first < need:
                continue
            out += self._verified(k, here, what, low, high)
        return out

    def _verified(self, k: int, here: np.ndarray, what: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, float]]:
        """Matches within words low to high; here, what: places and numbers of the template's words there."""
        reach, need, size = self.reach[k], self.need[k], len(self.ordered[k])
        # the place before at which the same word stands; a place counts for blocks that start after that one
        by = np.argsort(what, kind="stable")
        before = np.full(len(here), low - 1, np.int64)
        same = what[by][1:] == what[by][:-1]
        before[by[1:][same]] = here[by[:-1][same]]
        change = np.zeros(high - low + 2, np.int64)
        np.add.at(change, np.maximum(before + 1, np.maximum(low, here - reach + 1)) - low, 1)
        np.add.at(change, here + 1 - low, -1)
        shared = np.cumsum(change)[: high - low]  # of the block from each start
        good = np.flatnonzero(shared >= need)
        out = []
        for run in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1):
            if len(run):
                x, y = np.searchsorted(here, [low + run[0], low + run[-1] + reach])
                out.append((k, int(here[x]), int(here[y - 1]) + 1, float(shared[run].max()) / size))
        return out


def batches_of(templates: tuple[Template, ...], words: int) -> list[tuple[Template, ...]]:
    """The templates in order, in batches of at most so many words, but one template at least; one batch if there is none."""
    out: list[list[Template]] = [[]]
    held = 0
    for t in templates:
        size = len(words_of(t.text))
        if out[-1] and held + size > words:
            out.append([])
            held = 0
        out[-1].append(t)
        held += size
    return [tuple(x) for x in out]


MATCHES = "array<struct<label:string,ordered:boolean,start:long,stop:long,containment:double>>"


def _scan_batch(df: DataFrame, templates: tuple[Template, ...], text_col: str, through: list[str], found: bool) -> DataFrame:
    """The columns in `through`, n_words and matches; found: df has both, and the matches of these templates come after those."""
    shared = Shared(df.sparkSession, Index(templates, template_frequencies(df, templates, text_col)))
    schema = T.StructType([*(df.schema[c] for c in through), T.StructField("n_words", T.LongType(), False), T.StructField("matches", T._parse_datatype_string(MATCHES), False)])
    arrow = pa.list_(pa.struct([("label", pa.string()), ("ordered", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index: Index = shared.value
        counts, matches = [], batch.column("matches").to_pylist() if found else [[] for _ in range(batch.num_rows)]
        for text, own in zip(texts_of(batch, text_col), matches, strict=True):
            words = words_of(text)
            counts.append(len(words))
            own += [{"label": index.templates[k].label, "ordered": index.templates[k].ordered, "start": a, "stop": b, "containment": c} for k, a, b, c in index.matches(words)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), pa.array(counts, pa.int64()), pa.array(matches, arrow)], [*through, "n_words", "matches"])

    return map_slices(df.select(*dict.fromkeys([*through, text_col, *(["matches"] if found else [])])), run, schema)


def scan(df: DataFrame, templates: tuple[Template, ...] = BASE + SENTENCES + TEXTS, text_col: str = "text", keep: list[str] | None = None, batch_words: int = BATCH_WORDS) -> DataFrame:
    """df with n_words long and matches array<struct<label,ordered,start,stop,containment>>; columns of these names are replaced."""
    passed = kept_fields(df, keep, ["n_words", "matches"])
    if text_col not in passed:
        # texts travel under a name that nothing else has
        own = "_text"
        while any(own == c.lower() for c in df.columns):
            own += "_"
        df, text_col = df.select(*passed, F.col(text_col).alias(own)), own
    batches = batches_of(templates, batch_words)
    for k, batch in enumerate(batches):
        through = passed if k == len(batches) - 1 else list(dict.fromkeys([*passed, text_col]))
        df = _scan_batch(df, batch, text_col, through, k > 0)
    return df
