"""Licence scans by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, letters and digits only) and
looked up among known licence sentences. What was recognised is a sequence of identifiers with their
places; a rule is an ordered sequence of identifiers, and it matches where its sentences follow each
other in the text with at most ``MAX_GAP`` unknown sentences between two of them. Where rules overlap,
the one with more sentences wins, then the earlier one in the list.

Sentences and rules are a parameter (``Rules``). ``RULES`` has full texts and notices as published, and for
each licence of ``NAMES`` the notices that ``TEMPLATES`` make of its names. After the tag
``SPDX-License-Identifier:`` each identifier of the expression is a sentence of its own.

Defined cases: null and empty texts match nothing; a licence that occurs twice gives two rows; rows
with null or repeated ids are ordinary rows; a very long text is cut as a whole, a few bytes a sentence;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text

MAX_GAP = 2
_CUT = re.compile(r"[.;:!?](?=\s|$)|\n")
_WORD = re.compile(r"[^\W_]+")

#: Licence sentences as their authors published them, by identifier.
SENTENCES = {
    "mit-notice-released": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-notice-work": "This work is licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-the": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-program": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-damages": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc-damages": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-damages": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "zlib-notice": "This notice may not be removed or altered from any source distribution.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "lgpl21-library": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl3-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "unlicense-more": "For more information, please refer to <https://unlicense.org>",
    "reserved": "All rights reserved.",
}
#: Fixed values: (licence, sentence identifiers in order).
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice-released"]),
    ("MIT", ["mit-notice-licensed"]),
    ("MIT", ["mit-notice-work"]),
    ("Apache-2.0", ["apache-notice-the", "apache-comply", "apache-copy", "apache-basis", "apache-see"]),
    ("Apache-2.0", ["apache-notice-the", "apache-comply"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl3-program", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-program"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-or-later", ["gpl2-program", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-program"]),
    ("GPL-3.0-or-later", ["gpl3-program", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received"]),
    ("LGPL-2.1-or-later", ["lgpl21-library", "lgpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-library"]),
    ("LGPL-3.0-or-later", ["lgpl3-program", "gpl-hope", "gpl-implied", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-program"]),
    ("AGPL-3.0-or-later", ["agpl3-program", "gpl-hope", "gpl-implied", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-program"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-damages"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-damages"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-disclaimer", "isc-damages"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-damages", "zlib-grant", "zlib-origin", "zlib-altered", "zlib-notice"]),
    ("Zlib", ["zlib-warranty", "zlib-damages", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("EPL-2.0", ["epl-available"]),
    ("WTFPL", ["wtfpl-do"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone", "unlicense-more"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense-free"]),
    ("proprietary", ["reserved"]),
]


#: Licences by their SPDX identifier with the names that notices give them.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AFL-3.0": ["Academic Free License v3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AGPLv3", "AGPL v3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later", "GNU Affero General Public License, version 3 or any later version"],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL v1.2"],
    "GFDL-1.3-or-later": ["GNU Free Documentation License, Version 1.3 or any later version"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPLv2", "GPL v2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later", "GNU General Public License, version 2 or any later version"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPLv3", "GPL v3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later", "GNU General Public License, version 3 or any later version"],
    "ISC": ["ISC License"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later"],
    "MIT": ["MIT License", "MIT license", "X11 License", "Expat License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, Version 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License v1.0", "Open Data Commons Open Database License v1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "OSL-3.0": ["Open Software License 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License 2.0", "PSF License"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "UPL-1.0": ["Universal Permissive License v1.0"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}
#: Notices that a name makes; words before it that name the work are part of the sentence.
TEMPLATES = (
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "Published under {}.",
    "License: {}.", "{} applies.", "Licensed under the terms of the {}.", "Released under the terms of the {}.", "Distributed under the terms of the {}.",
)
WORKS = ("This work", "This project", "This software", "This program", "This library", "This file", "This document", "This code", "This text", "This dataset", "This content", "The code")
WORK_TEMPLATES = ("{} is licensed under {}.", "{} is licensed under the {}.", "{} is licensed under a {}.", "{} is released under the {}.", "{} is distributed under the {}.", "{} is available under the {}.", "{} is licensed under the terms of the {}.")
SPDX_TAG = "SPDX-License-Identifier:"
_EXPRESSION = re.compile(r"\s(?:OR|AND|WITH)\s|[()]")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def cut(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each sentence that isn't blank."""
    at = 0
    for mark in _CUT.finditer(text):
        if text[at : mark.end()].strip():
            yield at, mark.end()
        at = mark.end()
    if text[at:].strip():
        yield at, len(text)


@dataclass
class Rules:
    """Normalised sentence to the identifiers that it completes, and rules in order of preference.

    Sentences are cut as texts are: a published one may hold a mark that cuts, and its parts are then
    identifiers of their own.
    """

    ids: dict[str, list[str]] = field(default_factory=dict)
    rules: list[tuple[str, list[str]]] = field(default_factory=list)
    spdx: dict[str, str] = field(default_factory=dict)

    @classmethod
    def build(cls, sentences: dict[str, str], rules: list[tuple[str, list[str]]], names: dict[str, list[str]]) -> Rules:
        out, parts = cls(), {}

        def add(name: str, sentence: str) -> None:
            parts[name] = []
            for k, (a, b) in enumerate(cut(sentence)):
                out.ids.setdefault(normalised(sentence[a:b]), []).append(f"{name}.{k}")
                parts[name].append(f"{name}.{k}")

        for name, sentence in sentences.items():
            add(name, sentence)
        out.rules = [(licence, [p for s in order for p in parts[s]]) for licence, order in rules]
        seen = set(out.ids)
        for licence, called in names.items():
            notices = [t.format(n) for n in called for t in TEMPLATES] + [t.format(w, n) for n in called for w in WORKS for t in WORK_TEMPLATES]
            for k, notice in enumerate(notices):
                if normalised(notice) not in seen:
                    seen.add(normalised(notice))
                    add(f"{licence.lower()}-notice-{k}", notice)
                    out.rules.append((licence, parts[f"{licence.lower()}-notice-{k}"]))
            out.spdx[licence.lower()] = licence
            out.rules.append((licence, [f"spdx-{licence.lower()}"]))
        return out


def prefixes(ids: dict[str, list[str]]) -> set[str]:
    """The beginnings, by words, of all known sentences: a text's lines may break a sentence anywhere."""
    return {" ".join(words[:n]) for words in (s.split() for s in ids) for n in range(1, len(words) + 1)}


def recognised(text: str, ids: dict[str, list[str]], begun: set[str], spdx: dict[str, str] | None = None) -> list[tuple[int, list[str], int, int]]:
    """(sentence number, identifiers, start, end) of the known sentences of a text, wrapped over lines or not."""
    out, pieces, number, k = [], list(cut(text)), 0, 0
    while k < len(pieces):
        a, b = pieces[k]
        so_far, last, found = normalised(text[a:b]), k, None
        if spdx and so_far == "spdx license identifier" and k + 1 < len(pieces):
            k += 1
            start, expression = pieces[k][0], text[slice(*pieces[k])]
            for part, at in ((expression[x:y], start + x) for x, y in _between(_EXPRESSION, expression)):
                identifier = part.strip().split(" ")[0].rstrip(".;,")
                if identifier.lower().removesuffix("+") in spdx:
                    out.append((number, [f"spdx-{identifier.lower().removesuffix('+')}"], at + len(part) - len(part.lstrip()), at + len(part.rstrip())))
                    number += 1
            k += 1
            continue
        while so_far in begun:
            if so_far in ids:
                found = (last, ids[so_far])
            last += 1
            if last == len(pieces):
                break
            so_far = f"{so_far} {normalised(text[slice(*pieces[last])])}".strip()
        if found:
            k, names = found
            out.append((number, names, a + len(text[a:b]) - len(text[a:b].lstrip()), pieces[k][1]))
        number, k = number + 1, k + 1
    return out


def _between(mark: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in mark.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def first_sentences(rules: list[tuple[str, list[str]]]) -> dict[str, list[int]]:
    """Rules by the sentence that they begin with."""
    starts: dict[str, list[int]] = {}
    for r, (_, names) in enumerate(rules):
        starts.setdefault(names[0], []).append(r)
    return starts


def rule_matches(found: list[tuple[int, list[str], int, int]], rules: list[tuple[str, list[str]]], starts: dict[str, list[int]] | None = None, max_gap: int = MAX_GAP) -> Iterator[tuple[str, list[str], int, int]]:
    """(licence, identifiers, first, last index in ``found``) of the rules that match, none overlapping."""
    starts = first_sentences(rules) if starts is None else starts
    claims = []
    for first, (_, names, _, _) in enumerate(found):
        for r in (r for name in names for r in starts.get(name, ())):
            at, wanted = first, rules[r][1]
            for name in wanted[1:]:
                step = next((k for k in range(at + 1, len(found)) if found[k][0] - found[at][0] > max_gap + 1 or name in found[k][1]), None)
                if step is None or found[step][0] - found[at][0] > max_gap + 1:
                    break
                at = step
            else:
                claims.append((-len(wanted), r, first, at))
    taken: set[int] = set()
    for _, r, first, last in sorted(claims):
        if taken.isdisjoint(range(first, last + 1)):
            taken.update(range(first, last + 1))
            yield rules[r][0], rules[r][1], first, last


def scan(docs: DataFrame, known: Rules | None = None) -> DataFrame:
    """doc_id, license, n_sentences, sentences (identifiers), start, end (code points) of each licence found."""
    known = known or Rules.build(SENTENCES, RULES, NAMES)
    # plain tables alone: executors needn't have this module
    ids, rules, spdx = known.ids, known.rules, known.spdx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, starts = prefixes(ids), first_sentences(rules)
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(batch["text"]):
                found = recognised(text.as_py() or "", ids, begun, spdx)
                for licence, names, first, last in sorted(rule_matches(found, rules, starts), key=lambda m: m[2]) if found else ():
                    row.append(i)
                    out.append((licence, len(names), "|".join(names), found[first][2], found[last][3]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "license", "n_sentences", "sentences", "start", "end"],
            )

    docs = id_and_text(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, license string, n_sentences int, sentences string, start int, end int")


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """All licences that documents state."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
