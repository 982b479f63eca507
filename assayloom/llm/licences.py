"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and looked up in a table of
sentences that licences are known to consist of. What is found is a sequence of
sentence identifiers in the order of the text. A licence rule is an ordered list
of identifiers; it matches where the sequence holds them one after the other,
with no other known sentence between. Longer rules are tried first, and a
sentence counts for one match only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known sentences, by identifier. They are the wording of the licences and of the usual notices; fixed values.
SENTENCES: dict[str, tuple[str, ...]] = {
    "mit-title": ("The MIT License", "MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "mit-short": (
        "Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License",
        "Distributed under the MIT License", "This software is released under the MIT License", "Licensed under MIT",
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions",
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is-mit": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "liability-mit": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    "apache-2-short": (
        "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "This project is licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0",
        "Licensed under the Apache License 2.0", "Apache License, Version 2.0",
    ),
    "apache-2-compliance": ("you may not use this file except in compliance with the License",),
    "apache-2-copy": ("You may obtain a copy of the License at",),
    "apache-2-as-is": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "apache-2-see": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl-3-short": (
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0", "Released under the GNU General Public License, version 3", "Licensed under GPL-3.0",
    ),
    "gpl-2-short": ("Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "Licensed under GPL-2.0"),
    "gpl-3-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "gpl-2-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "gpl-no-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "gpl-see": ("See the GNU General Public License for more details",),
    "gpl-received": ("You should have received a copy of the GNU General Public License along with this program",),
    "lgpl-3-short": ("Licensed under the GNU Lesser General Public License, version 3", "Licensed under LGPL-3.0"),
    "agpl-3-short": ("Licensed under the GNU Affero General Public License, version 3", "Licensed under AGPL-3.0"),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission",
    ),
    "as-is-bsd": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
        "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    ),
    "bsd-3-short": ("Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License"),
    "bsd-2-short": ("Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies",
    ),
    "mpl-2-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"),
    "mpl-2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",),
    "cc0-1": ("Licensed under CC0 1.0", "Released under CC0 1.0"),
    "cc-by-4": (
        "Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "Released under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa-4": (
        "Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "Released under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc-4": (
        "Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "Released under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-nd-4": ("Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0", "Released under CC BY-ND 4.0"),
    "all-rights": ("All rights reserved",),
}

#: Ordered rules: licence and the identifiers that follow each other; fixed values.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "as-is-mit", "liability-mit")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit", "liability-mit")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-2-short", "apache-2-compliance", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("Apache-2.0", ("apache-2-short", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-short",)),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-no-warranty", "gpl-see", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-no-warranty", "gpl-see", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("GPL-3.0-only", ("gpl-3-short",)),
    ("GPL-2.0-only", ("gpl-2-short",)),
    ("LGPL-3.0-only", ("lgpl-3-short",)),
    ("AGPL-3.0-only", ("agpl-3-short",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is-bsd")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is-bsd")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-short",)),
    ("BSD-2-Clause", ("bsd-2-short",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-2-form", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-form",)),
    ("CC0-1.0", ("cc0-1",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    ("All-rights-reserved", ("all-rights",)),
)

#: A sentence ends at a mark before white space, at a colon before white space, or at an empty line.
_END = re.compile(r"[.!?;:](?=\s)|\n[^\S\n]*\n")
_LINE = re.compile(r"\n")
_NOISE = re.compile(r"(?:[^0-9a-z.+/-]|\.(?![0-9a-z]))+")
_DECORATION = re.compile(r"(?m)^[^\S\n]*(?:#+|//+|\*+|--+|;+|>+|(?:\d+|[a-z])[.)])(?=[^\S\n])")


#: Marks that don't count at either end.
_EDGE = " .+/-"


def _plain(words: str) -> str:
    return _NOISE.sub(" ", _DECORATION.sub(" ", words).lower().replace("licence", "license"))


def normalise(sentence: str) -> str:
    """Lower case, without comment marks or numbering at line starts, words parted by one space, no mark at the end."""
    return _plain(sentence).strip(_EDGE)


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, stop) of the sentences of a text."""
    text, start = text or "", 0
    for end in _END.finditer(text):
        if end.end() > start:
            yield start, end.end()
        start = end.end()
    if start < len(text):
        yield start, len(text)


@dataclass(frozen=True)
class Book:
    """Sentences by normalised wording, the word by word beginnings of all wordings, and rules from the longest on."""

    known: dict[str, str]
    rules: tuple[tuple[str, tuple[str, ...]], ...]
    longest: int
    beginnings: frozenset[str]

    @staticmethod
    def of(sentences=None, rules=RULES) -> Book:
        sentences = SENTENCES if sentences is None else sentences
        known = {}
        for name, wordings in sentences.items():
            for wording in wordings:
                known[normalise(wording)] = name
        beginnings = {k[:i] for k in known for i in range(len(k) + 1) if i == len(k) or k[i] == " "}
        return Book(known, tuple(sorted(rules, key=lambda r: -len(r[1]))), max(map(len, known), default=0), frozenset(beginnings))


def identify(text: str | None, book: Book) -> list[tuple[str, int, int]]:
    """(identifier, start, stop) of the known sentences, in the order of the text.

    Neighbouring sentences are joined as long as a known wording begins like that, for
    a wording may hold marks at which texts are cut; the longest known join counts. A
    sentence that isn't known is looked at from each of its line ends on, and line by
    line, for titles and notices often end without a mark. White space and decoration
    of any length are no part of a wording.
    """
    text = text or ""
    spans = list(sentences(text))
    found: list[tuple[str, int, int]] = []
    i = 0
    while i < len(spans):
        start, stop = spans[i]
        joined = normalise(text[start:stop])
        hit, last = (book.known[joined], start, stop) if joined in book.known else None, i
        j = i + 1
        while joined and joined in book.beginnings and j < len(spans):
            further = normalise(text[spans[j][0]:spans[j][1]])
            if further:
                joined = f"{joined} {further}"
                if joined in book.known:
                    hit, last = (book.known[joined], start, spans[j][1]), j
            j += 1
        if hit is not None:
            found.append(hit)
        elif "\n" in text[start:stop]:
            found += _by_line(text, start, stop, book)
        i = last + 1
    return found


def _by_line(text: str, start: int, stop: int, book: Book) -> list[tuple[str, int, int]]:
    """Known lines of a sentence, and its end from the first line on with which that is known.

    Each line is normalised once; what lines say together is joined from the last one
    up, as long as it isn't longer than any known wording.
    """
    lines, at = [], start
    while at < stop:
        end = text.find("\n", at, stop)
        end = stop if end < 0 else end
        lines.append((at, end, _plain(text[at:end])))
        at = end + 1
    # the last line alone is looked at as a line
    first, name, joined = len(lines), "", ""
    for k in range(len(lines) - 1, -1, -1):
        # lines of marks alone say nothing before a sentence; no wording holds very many of them
        if len(joined) <= 2 * book.longest or lines[k][2].strip(_EDGE):
            joined = " ".join(f"{lines[k][2]} {joined}".split())
        plain = joined.strip(_EDGE)
        if len(plain) > book.longest:
            break
        if lines[k][1] < stop and plain in book.known:
            first, name = k, book.known[plain]
    found = [(book.known[plain], at, end) for at, end, line in lines[:first] if (plain := line.strip(_EDGE)) in book.known]
    return [*found, (name, lines[first][0], stop)] if name else found


def match(found: list[tuple[str, int, int]], book: Book) -> list[tuple[str, int, int, int]]:
    """(licence, start, stop, sentences) of the rules that match; a sentence counts once, longer rules first."""
    names = [f[0] for f in found]
    taken = [False] * len(names)
    out = []
    for licence, rule in book.rules:
        n = len(rule)
        for i in range(len(names) - n + 1):
            if tuple(names[i:i + n]) == rule and not any(taken[i:i + n]):
                taken[i:i + n] = [True] * n
                out.append((licence, found[i][1], found[i + n - 1][2], n))
    return sorted(out, key=lambda m: m[1:])


def scan(documents: DataFrame, book: Book | None = None) -> DataFrame:
    """(doc_id, licences, matches, sentences) of every row.

    ``licences`` are distinct names in alphabetical order, ``matches`` structs
    (licence, start, stop, sentences) in the order of the text, ``sentences`` the
    identifiers of all known sentences. Texts that are null, empty or without a
    known sentence have empty lists. Repeated rows are scanned each; other columns
    are not read.
    """
    book = book or Book.of()

    @F.pandas_udf("matches array<struct<licence:string,start:int,stop:int,sentences:int>>, sentences array<string>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = identify(text, book)
            hits = [dict(zip(("licence", "start", "stop", "sentences"), m)) for m in match(found, book)]
            rows.append((hits, [f[0] for f in found]))
        return pd.DataFrame(rows, columns=["matches", "sentences"])

    names = F.array_sort(F.array_distinct(F.transform("found.matches", lambda m: m["licence"])))
    return documents.select("doc_id", scanned("text").alias("found")).select(
        "doc_id", names.alias("licences"), F.col("found.matches").alias("matches"), F.col("found.sentences").alias("sentences")
    )
