"""License scans by conditional compression, confirmed by exact wording differences."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import as_bytes, map_rows

#: Public notices and texts by SPDX name; "..." stands for names, years and titles.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}

#: Lines with one of these are reported even if no template is confirmed there.
TRIGGERS = ("licen", "permission", "redistribut", "public domain", "released under", "free software")
#: A block that is reported unconfirmed has up to so many times a template's words.
REACH = 1.5
#: Words of a template that may be missing or added, as a share, before a passage is not confirmed.
MISSING = 0.1

_TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def normal(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Scanner:
    """Templates as compressors, made once in each task."""

    def __init__(self, templates: dict[str, tuple[str, ...]], level: int = 9):
        self.level = level
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False).compress
        self.all = []
        for name, texts in templates.items():
            for text in texts:
                words = normal(text)
                raw = " ".join(words).encode()
                own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own.precompute_compress(level=level)
                compress = zstandard.ZstdCompressor(dict_data=own, level=level, write_content_size=False, write_dict_id=False).compress
                self.all.append((name, words, len(raw), compress))
        #: Word -> (template, where in it). Of the words of a template so many are seeds that a passage without
        #: all of them misses too many; words with a trigger come first, then long ones.
        self.seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.bags = [Counter(words) for _, words, _, _ in self.all]
        for n, (_, words, _, _) in enumerate(self.all):
            order = sorted(range(len(words)), key=lambda i: (not any(t in words[i] for t in TRIGGERS), -len(words[i]), i))
            for i in order[: int(MISSING * len(words)) + 1]:
                self.seeds[words[i]].append((n, i))

    def gain(self, n: int, own: list[str]) -> float:
        """Size reduction under a template, per byte of the larger of the two, so that a short notice isn't covered best by a long text."""
        _, _, size, compress = self.all[n]
        raw = " ".join(own).encode()
        return (len(self.plain(raw)) - len(compress(raw))) / max(len(raw), size)

    def reduction(self, n: int, block: bytes) -> int:
        """Bytes that a template saves of a block."""
        return len(self.plain(block)) - len(self.all[n][3](block))

    def passage(self, at: int, tokens: list[str], refused: set[tuple[int, int]]) -> tuple | None:
        """(reduction, template, start, end, wording, differences) of the confirmed passage that holds word ``at``.

        The templates of which enough words stand around it compress the block that all of them would span, and are ranked by
        what they save of it; the first whose wording is confirmed there is taken. ``refused`` keeps, for one
        text, where a template has been refused before: the same place is not compared again.
        """
        places: dict[int, list[int]] = {}
        first, last = at, at + 1
        for n, i in self.seeds[tokens[at]]:
            words = self.all[n][1]
            slack = int(MISSING * len(words))  # how far missing or added words can move the start or the end
            low, high = max(0, at - i - slack), at - i + len(words) + slack
            if (n, at - i) in refused:
                continue
            if sum((self.bags[n] - Counter(tokens[low:high])).values()) > slack:
                refused.add((n, at - i))
                continue
            places.setdefault(n, []).append(i)
            first, last = min(first, low), max(last, high)
        block = " ".join(tokens[first:last]).encode()
        for n in sorted(places, key=lambda n: (-self.reduction(n, block), n)) if len(places) > 1 else places:
            words, best = self.all[n][1], None
            slack = int(MISSING * len(words))
            for i in places[n]:
                low = max(0, at - i - slack)
                start, end, ops = differences(words, tokens[low : at - i + len(words) + slack])
                if not confirmed(words, ops):
                    refused.add((n, at - i))
                elif low + start <= at < low + end and (best is None or sum(counts(ops)) < best[0]):
                    best = sum(counts(ops)), low, start, end, ops
            if best:
                _, low, start, end, ops = best
                return self.gain(n, tokens[low + start : low + end]), n, low + start, low + end, worded(words, tokens[low:], ops), ops
        return None

    def scan(self, text: bytes) -> Iterator[tuple[int, str, float, int, int, bool, str]]:
        """(line, license, reduction, missing words, added words, confirmed, wording difference) per block."""
        low = text.decode("utf-8", "replace").lower()
        seeds = self.seeds
        tokens, begins, found = [], [], []
        for m in _TOKEN.finditer(low):
            if m[0] in seeds:
                found.append(len(tokens))
            tokens.append(m[0])
            begins.append(m.start())
        triggered = any(t in low for t in TRIGGERS)
        if not self.all or not (found or triggered):
            return
        out, covered = [], 0
        breaks = [m.start() for m in re.finditer("\n", low)]
        taken: set[int] = set()
        refused: set[tuple[int, int]] = set()
        for at in found:
            if at < covered or (best := self.passage(at, tokens, refused)) is None:
                continue
            gain, n, start, covered, wording, ops = best
            first, last = (bisect_left(breaks, begins[j]) for j in (start, covered - 1))
            taken.update(range(first, last + 1))
            out.append((first, self.all[n][0], gain, *counts(ops), True, wording))
        for line, words in enumerate(low.split("\n") if triggered else ()):
            if line not in taken and (places := [p for t in TRIGGERS if (p := words.find(t)) >= 0]):
                start = breaks[line - 1] + 1 if line else 0
                out.extend(self.unconfirmed(line, bisect_left(begins, start), max(0, bisect_right(begins, start + min(places)) - 1), tokens))
        yield from sorted(out, key=lambda r: r[0])

    def unconfirmed(self, line: int, first: int, at: int, tokens: list[str]) -> Iterator[tuple[int, str, float, int, int, bool, str]]:
        """The template that helps most from a line on (or, in a long line, from as far before the trigger as it can reach)."""
        ranked = []
        for n, (_, words, _, _) in enumerate(self.all):
            start = max(first, at - len(words))
            own = tokens[start : start + math.ceil(REACH * len(words))]
            if own:
                ranked.append((-self.gain(n, own), n, own))
        if ranked:
            gain, n, own = min(ranked)
            name, words, _, _ = self.all[n]
            _, _, ops = differences(words, own)
            yield line, name, -gain, *counts(ops), False, worded(words, own, ops)


def differences(words: list[str], own: list[str]) -> tuple[int, int, list[tuple[int, int, int, int]]]:
    """(start, end of the passage in ``own``, what differs); words before or after the passage are no part of it."""
    ops = []
    start, end = 0, len(own)
    for tag, a, b, c, d in SequenceMatcher(None, words, own, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        if a == 0:
            start = c = max(c, d - (b - a))
        if b == len(words):
            end = d = min(d, c + (b - a))
        if a < b or c < d:
            ops.append((a, b, c, d))
    return start, end, ops


def counts(ops: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """Missing and added words."""
    return sum(b - a for a, b, _, _ in ops), sum(d - c for _, _, c, d in ops)


def confirmed(words: list[str], ops: list[tuple[int, int, int, int]]) -> bool:
    numbers = any(c.isdigit() for a, b, _, _ in ops for w in words[a:b] for c in w)
    return max(counts(ops)) <= MISSING * len(words) and not numbers


def worded(words: list[str], own: list[str], ops: list[tuple[int, int, int, int]]) -> str:
    return "; ".join(f"-{' '.join(words[a:b])} +{' '.join(own[c:d])}" for a, b, c, d in ops)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(doc_id, line, license, reduction, n_missing, n_added, confirmed, wording) for every candidate block.

    Confirmed passages may run over lines and blank lines or lie within one long line; ``line`` (counted from 0)
    is where they start. ``confirmed`` says that at most a tenth of the template's words is missing, at most as
    many are added, and no number differs (a version, say); of templates that may stand in one block, that which
    compresses it best and is confirmed counts, of equals the one listed first. Other lines with a word that licenses have are reported unconfirmed, with the template under
    which the text from there compresses best. ``reduction`` is the saving, ``wording`` lists what differs from
    the template, word by word. Whole texts are searched; null and empty texts have no blocks; repeated rows are
    reported each; other columns are ignored; an empty table gives an empty result.
    """
    known = TEMPLATES if templates is None else templates
    columns = {"doc_id": F.col(id_col).cast("long"), "text": as_bytes(text_col)}
    schema = "doc_id long, line int, license string, reduction double, n_missing int, n_added int, confirmed boolean, wording string"
    return map_rows(docs, columns, lambda own, doc_id, text: ((doc_id, *x) for x in own.scan(text)), schema, lambda: Scanner(known))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """License statements of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
