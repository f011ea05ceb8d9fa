"""License scans by conditional compression.

Candidate blocks of a text speak of licensing: they begin at a line with a cue and go on while the next such line is no
farther away, in words, than cues lie apart in any wording. A block with the words around it, and each line with a cue, is
compressed with zstandard, once alone and once with each license wording as a raw dictionary. Wordings are ranked by the bytes they save, as a share of what the wording
itself takes; each that saves ``least_saving`` or more is compared with the block, and the words around it, word by word
wherever a few words running of it occur. A place whose words are all there but for at most ``tolerance`` of them, no
number or name among the differences, is confirmed. Of overlapping places the one with the most words stays, so a
block gives every license in it, each with its own span and word differences.

Defined results: null and empty texts have no blocks; lines with cues that no confirmed wording covers have license
``unknown`` where some wording saves at least ``least_saving`` of their size, else they are left out; ties go to the wording
listed first; very long texts are scanned whole, very long lines included; repeated rows give repeated results; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import difflib
import functools
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import id_and_text, map_batches, texts, with_id

# License identifiers and their usual wordings.
WORDINGS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0."),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or later."),
    ("GFDL-1.3", """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."""),
    ("ODbL-1.0", "This database is made available under the Open Database License."),
)
#: GNU licenses, whose identifiers also say whether later versions will do.
GNU = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.3")
#: A line for every license by its short identifier.
WORDINGS += tuple(
    (f"{name}{ending}", f"SPDX-License-Identifier: {name}{ending}")
    for name in dict.fromkeys(n for n, _ in WORDINGS) if name != "Proprietary" for ending in (("", "-only", "-or-later") if name in GNU else ("",))
)
CUE = re.compile(r"licen[sc]e|copyright|SPDX|warrant(?:y|ies)|redistribut|permission (?:is|to)|public domain|rights reserved|creative commons|liab(?:le|ility)", re.IGNORECASE)
HINTS = ("licen", "copyright", "spdx", "warrant", "redistribut", "permission ", "public domain", "rights reserved", "creative commons", "liab")
WORD = re.compile(r"\w+(?:[.-]\w+)*")
#: Words running that lead to a comparison.
ANCHOR = 3
#: Words that may not differ: they tell licenses apart.
DECISIVE = re.compile(r".*\d.*|.*-only|.*-later|mit|apache|gnu|lesser|affero|bsd|clause|isc|mozilla|cc|by|nc|sa|nd|by-\w+(-\w+)?|cc0|noncommercial.*|noderivatives|attribution.*|artistic|eclipse|not|no|without|unlicense")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Wording:
    license: str
    words: tuple[str, ...]
    compressor: zstandard.ZstdCompressor
    size: int  # bytes that the wording takes, compressed alone
    anchors: dict[tuple[str, ...], list[int]]  # words running, by where they begin in the wording


def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19, write_content_size=False)


@functools.cache
def _prepared(wordings: tuple[tuple[str, str], ...]) -> tuple[list[Wording], int]:
    """The wordings as dictionaries, and the most words between, before or after cues in any of them."""
    out, reach = [], 0
    frame = len(_plain().compress(b""))
    for name, text in wordings:
        words = tokens(text)
        made = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        n = min(ANCHOR, len(words))
        anchors: dict[tuple[str, ...], list[int]] = {}
        for i in range(len(words) - n + 1):
            anchors.setdefault(tuple(words[i : i + n]), []).append(i)
        out.append(Wording(name, tuple(words), zstandard.ZstdCompressor(level=19, dict_data=made, write_content_size=False), len(_plain().compress(text.encode())) - frame, anchors))
        reach = max([reach, *(len(tokens(part)) for part in CUE.split(text))])
    return out, reach


def blocks(text: str, reach: int) -> list[tuple[list[tuple[int, int]], int, int]]:
    """(lines with cues, start, end) of each block: cue lines up to ``reach`` words apart, with as many words on both sides.

    The words around belong to at most one block: they end half way to the next one, or at its first cue.
    """
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    groups: list[list[tuple[int, int]]] = []
    start, between = 0, reach + 1
    for line in text.split("\n"):
        end = start + len(line)
        if CUE.search(line):
            if between > reach:
                groups.append([])
            groups[-1].append((start, end))
            between = 0
        elif between <= reach:
            between += len(tokens(line))
        start = end + 1
    out = []
    for k, lines in enumerate(groups):
        begin, end = lines[0][0], lines[-1][1]
        left = groups[k - 1][-1][1] if k else 0
        right = groups[k + 1][0][0] if k + 1 < len(groups) else len(text)
        span = 16 * reach
        while len(before := [m.start() for m in WORD.finditer(text, max(left, begin - span), begin)]) <= reach and begin - span > left:
            span *= 4  # long words or blanks: look farther back
        before = before[-reach:]
        after = [m.end() for m in itertools.islice(WORD.finditer(text, end, right), reach)]
        out.append((lines, before[0] if before else begin, after[-1] if after else end))
    return out


def compare(wording: Wording, words: list[str], tolerance: float) -> list[tuple[int, int, list[str]]]:
    """(first word, end, differences) of the places in ``words`` that hold the wording, within the tolerance; they may overlap."""
    n = len(next(iter(wording.anchors), ()))
    size, slack = len(wording.words), int(tolerance * len(wording.words))
    starts = sorted({i - k for i in range(len(words) - n + 1) for k in wording.anchors.get(tuple(words[i : i + n]), ())})
    found, done = [], None
    for start in starts:
        if done is not None and start - done <= slack:
            continue  # the same place, seen from words after a difference
        lo = max(0, start - slack)
        piece = words[lo : max(0, start) + size + slack]
        codes = difflib.SequenceMatcher(None, wording.words, piece, autojunk=False).get_opcodes()
        # Words before and after the wording are not differences.
        if codes and codes[0][0] == "insert":
            lo, codes = lo + codes[0][4], codes[1:]
        if codes and codes[-1][0] == "insert":
            codes = codes[:-1]
        if not codes:
            continue
        changes = [(wording.words[a:b], piece[c:d]) for kind, a, b, c, d in codes if kind != "equal"]
        lost = sum(max(len(x), len(y)) for x, y in changes)
        if lost <= slack and not any(DECISIVE.fullmatch(w) for x, y in changes for w in (*x, *y)):
            first = codes[0][3]
            found.append((lo, lo + codes[-1][4] - first, [f"-{' '.join(x)}+{' '.join(y)}" for x, y in changes]))
            done = start
    return found


@functools.lru_cache(2048)
def saved(piece: str, wordings: tuple[tuple[str, str], ...]) -> tuple[tuple[float, ...], float]:
    """Bytes that each wording saves of a piece, as a share of its own size, and the most that one saves as a share of the piece."""
    data = piece.encode("utf-8", "replace")
    plain = len(_plain().compress(data))
    less = [plain - len(w.compressor.compress(data)) for w in _prepared(wordings)[0]]
    return tuple(n / w.size for n, w in zip(less, _prepared(wordings)[0], strict=True)), max(less) / plain


def ranked(text: str, block: tuple[list[tuple[int, int]], int, int], wordings: tuple[tuple[str, str], ...]) -> list[tuple[float, int]]:
    """(saving, number) of the wordings, best first: in the whole block or in one of its lines with cues, whichever is more."""
    lines, begin, end = block
    shares = [(saved if len(piece) < 2000 else saved.__wrapped__)(piece, wordings)[0] for piece in dict.fromkeys([text[begin:end], *(text[a:b] for a, b in lines)])]
    return sorted(((max(column), k) for k, column in enumerate(zip(*shares, strict=True))), key=lambda x: (-x[0], x[1]))


def judge(text: str, block: tuple[list[tuple[int, int]], int, int], wordings=WORDINGS, tolerance: float = 0.1, least_saving: float = 0.35) -> list[tuple[int, int, str, float, list[str]]]:
    """(start, end, license, saving, word differences) of one block, in text order."""
    wordings = tuple(wordings)
    lines, begin, end = block
    places = [m.span() for m in WORD.finditer(text, begin, end)]
    words = [text[a:b].lower() for a, b in places]
    met = []
    for saving, k in ranked(text, block, wordings):
        w = _prepared(wordings)[0][k]
        if saving >= least_saving:
            met += [(len(changes) - len(w.words), k, a, b, w.license, saving, changes) for a, b, changes in compare(w, words, tolerance)]
    out: list[tuple[int, int, str, float, list[str]]] = []
    taken = bytearray(len(words))
    for _, _, a, b, name, saving, changes in sorted(met, key=lambda x: x[:4]):
        if not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            start, stop = places[a][0], places[b - 1][1]
            while start > begin and not text[start - 1].isspace() and not (a and start <= places[a - 1][1]):
                start -= 1
            while stop < len(text) and not text[stop].isspace() and not (b < len(places) and stop >= places[b][0]):
                stop += 1
            out.append((start, stop, name, saving, changes))
    rest: list[tuple[int, int]] = []
    for a, b in lines:
        if not any(s < b and a < e for s, e, *_ in out):
            if rest and text.count("\n", rest[-1][1], a) <= 2:
                rest[-1] = rest[-1][0], b
            else:
                rest.append((a, b))
    for a, b in rest:
        if (saving := saved(text[a:b], wordings)[1]) >= least_saving:
            out.append((a, b, "unknown", saving, []))
    return sorted(out)


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", wordings=WORDINGS, tolerance: float = 0.1, least_saving: float = 0.35) -> DataFrame:
    """(id_col, found array<struct<start, end, license, saving, differences>>), one row per row of ``df``.

    Offsets are code points; ``differences`` lists "-wording+text" changes.
    """
    source = id_and_text(df, id_col, text_col)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("saving", pa.float64()), ("differences", pa.list_(pa.string()))]))

    def make():
        known: dict[tuple, list] = {}
        _, reach = _prepared(tuple(wordings))

        def found_in(text: str) -> list[dict]:
            out = []
            for block in blocks(text, reach):
                lines, begin, end = block
                key = text[begin:end], lines[0][0] - begin
                if (said := known.get(key)) is None:
                    said = [(a - begin, b - begin, *rest) for a, b, *rest in judge(text, block, wordings, tolerance, least_saving)]
                    if end - begin < 2000 and len(known) < 10_000:
                        known[key] = said
                out += [{"start": a + begin, "end": b + begin, "license": name, "saving": round(min(saving, 1.0), 4), "differences": changes} for a, b, name, saving, changes in said]
            return out

        def step(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found_in(t) for t in texts(batch)], kind)], ["id", "found"])

        return step

    schema = with_id(source, "found array<struct<start:int,end:int,license:string,saving:double,differences:array<string>>>")
    return map_batches(source, make, schema).withColumnRenamed("id", id_col)
