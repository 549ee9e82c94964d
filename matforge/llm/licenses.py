"""Licence scans by sentence rules (operator 4).

Texts are normalised to words. A word trie maps runs of words, wherever they stand, to the identifiers of known licence
sentences, so wrapped lines are read as one sentence and one may stand inside a longer sentence; the sequence
of identifiers is then matched against ordered rules, each naming a licence, the longest and most specific first. Distances
between sentences are counted in fragments, cut at line ends and sentence punctuation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matforge.llm.common import read

# Names under which notices mention a licence, by SPDX identifier.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0"),
    "MIT": ("MIT License", "MIT", "Expat License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "ISC": ("ISC License", "ISC"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPLv2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal"),
    "Unlicense": ("Unlicense",),
    "BSD": ("BSD License", "BSD-style license", "BSD"),
}
# Endings of the identifiers of the licences that tell later versions apart, and exceptions to them.
VERSIONED, ENDINGS = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"), ("-only", "-or-later", "+")
EXCEPTIONS = ("Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "Font-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2")
# How notices mention a licence.
NOTICES = (
    "Licensed under the {}", "Licensed under {}", "Licensed under a {}", "Licensed under an {}", "Released under a {}", "Distributed under a {}", "Available under a {}", "Released under the {}", "Released under {}", "Distributed under the {}", "Available under the {}",
    "Published under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This work is licensed under {}",
    "This project is licensed under the {}", "This project is licensed under the terms of the {}", "This software is licensed under the {}",
    "This software is released under the {}", "This program is licensed under the {}", "This file is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}",
    "licenses this file to you under the {}",
)
# A notice that fills whole fragments or is none, as its words also meet by chance.
WHOLE = "License: {}"
# Names that are also words of other things; inside a fragment, only punctuation or one of these words may follow.
BARE = ("MIT", "ISC", "BSD")
AFTER = frozenset("license licence licenses licences and or by see with unless".split())
# How notices allow later versions, for the licences that speak of them.
LATER = ("or later", "or any later version", "or at your option any later version", "or newer")
# Words before a notice that deny it.
DENIED = frozenset("not never longer t".split())
# Sentences of licence texts, as published.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-named": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "apache-notice": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-library": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-only": "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl2-only-comma": "it under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation",
    "gpl2-only-after": "under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "gpl3-only": "it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl3-only-after": "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "agpl-only": "it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl-notice-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "epl-notice-v-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "bsl-copy": "See accompanying file LICENSE_1_0.txt or copy at",
    "cc0-waiver": "has waived all copyright and related or neighboring rights to this work",
    "cc0-waiver-plain": "has waived all copyright and related or neighboring rights to",
    "cc-by-url": "creativecommons.org/licenses/by/4.0",
    "cc-by-sa-url": "creativecommons.org/licenses/by-sa/4.0",
    "cc-by-nc-url": "creativecommons.org/licenses/by-nc/4.0",
    "cc-by-nd-url": "creativecommons.org/licenses/by-nd/4.0",
    "cc-by-nc-sa-url": "creativecommons.org/licenses/by-nc-sa/4.0",
    "cc0-url": "creativecommons.org/publicdomain/zero/1.0",
    "isc-grant-or": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "rights": "All rights reserved",
}
# Fixed values, in order: a rule is a sequence of sentences and the licence it tells; the first that fits is taken.
RULES = (
    (("mit-grant", "mit-notice", "mit-warranty", "mit-liability"), "MIT", "text"),
    (("mit-grant", "mit-notice"), "MIT", "text"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause", "text"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-named"), "BSD-3-Clause", "text"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause", "text"),
    (("isc-grant", "isc-warranty"), "ISC", "text"),
    (("isc-grant",), "ISC", "text"),
    (("notice:Apache-2.0", "apache-notice", "apache-copy", "apache-url", "apache-warranty"), "Apache-2.0", "header"),
    (("notice:Apache-2.0", "apache-notice", "apache-copy", "apache-warranty"), "Apache-2.0", "header"),
    (("apache-notice", "apache-copy", "apache-url", "apache-warranty"), "Apache-2.0", "header"),
    (("apache-notice", "apache-copy", "apache-url"), "Apache-2.0", "part"),
    (("apache-notice", "apache-copy", "apache-warranty"), "Apache-2.0", "part"),
    (("gpl-free", "gpl-warranty"), "GPL-3.0-or-later", "header"),
    (("gpl2-free", "gpl-warranty"), "GPL-2.0-or-later", "header"),
    (("gpl-free",), "GPL-3.0-or-later", "header"),
    (("gpl2-free",), "GPL-2.0-or-later", "header"),
    (("lgpl21-free", "lgpl-warranty"), "LGPL-2.1-or-later", "header"),
    (("lgpl21-free",), "LGPL-2.1-or-later", "header"),
    (("lgpl3-free", "gpl-warranty"), "LGPL-3.0-or-later", "header"),
    (("lgpl3-library", "lgpl-warranty"), "LGPL-3.0-or-later", "header"),
    (("lgpl3-free",), "LGPL-3.0-or-later", "header"),
    (("lgpl3-library",), "LGPL-3.0-or-later", "header"),
    (("agpl-free", "gpl-warranty"), "AGPL-3.0-or-later", "header"),
    (("agpl-free",), "AGPL-3.0-or-later", "header"),
    (("gpl2-only", "gpl-warranty"), "GPL-2.0-only", "header"),
    (("gpl2-only",), "GPL-2.0-only", "header"),
    (("gpl2-only-comma",), "GPL-2.0-only", "header"),
    (("gpl2-only-after",), "GPL-2.0-only", "header"),
    (("gpl3-only",), "GPL-3.0-only", "header"),
    (("gpl3-only-after",), "GPL-3.0-only", "header"),
    (("agpl-only",), "AGPL-3.0-only", "header"),
    (("mpl-notice", "mpl-copy"), "MPL-2.0", "header"),
    (("mpl-notice",), "MPL-2.0", "header"),
    (("epl-notice",), "EPL-2.0", "header"),
    (("epl-notice-v",), "EPL-2.0", "header"),
    (("epl-notice-v-2",), "EPL-2.0", "header"),
    (("notice:BSL-1.0", "bsl-copy"), "BSL-1.0", "header"),
    (("bsl-grant",), "BSL-1.0", "text"),
    (("notice:CC-BY-4.0", "cc-by-url"), "CC-BY-4.0", "header"),
    (("notice:CC-BY-SA-4.0", "cc-by-sa-url"), "CC-BY-SA-4.0", "header"),
    (("notice:CC-BY-NC-4.0", "cc-by-nc-url"), "CC-BY-NC-4.0", "header"),
    (("notice:CC-BY-ND-4.0", "cc-by-nd-url"), "CC-BY-ND-4.0", "header"),
    (("notice:CC-BY-NC-SA-4.0", "cc-by-nc-sa-url"), "CC-BY-NC-SA-4.0", "header"),
    (("cc0-waiver", "cc0-url"), "CC0-1.0", "header"),
    (("cc0-waiver",), "CC0-1.0", "header"),
    (("cc0-waiver-plain",), "CC0-1.0", "header"),
    (("isc-grant-or", "isc-warranty"), "ISC", "text"),
    (("isc-grant-or",), "ISC", "text"),
    (("unlicense", "unlicense-free"), "Unlicense", "text"),
    (("unlicense",), "Unlicense", "text"),
    (("unlicense-free",), "Unlicense", "part"),
    (("mit-grant",), "MIT", "part"),
    (("bsd-grant",), "BSD", "part"),
    (("rights",), "proprietary", "notice"),
)
#: Fragments without a known sentence that may stand between two sentences of a rule.
GAP = 3
#: Fragments around a licence in which reserved rights are part of its copyright line.
NEAR = 8
_WORD = re.compile(r"[^\W_]+")
_FRAGMENT = re.compile(r"(?:[^\n.!?;:]|[.!?;:](?!\s|$))+")
_ID = "\0"
#: What joins a second licence to a notice.
_JOINED = re.compile(r"(?:\s+licen[cs]es?)?\s*(?:,|/)?\s*(?:and/or|or|and|/)\s+(?:under\s+)?(?:either\s+)?(?:the\s+|an?\s+)?", re.I)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)", re.I)
_SPDX_TOKEN = re.compile(r"\s*(?:([()])|(AND|OR|WITH|and|or|with)(?![\w.+-])|([A-Za-z0-9][\w.-]*\+?))")


def _words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text.lower())]


class Scanner:
    """Trie of known sentences and ordered rules; notices of the named licences are generated."""

    def __init__(self, names: dict = NAMES, notices: tuple = NOTICES, sentences: dict = SENTENCES, rules: tuple = RULES, gap: int = GAP):
        known: dict[tuple, tuple] = {}
        later = []
        for spdx, aliases in names.items():
            for alias in aliases:
                for notice in notices:
                    ws = tuple(_words(notice.format(alias)))
                    known.setdefault(ws, (f"notice:{spdx}", notice == WHOLE, alias in BARE))
                    if "GPL" in spdx:
                        for more in LATER:
                            known.setdefault((*ws, *more.split()), (f"notice:{spdx}-or-later", notice == WHOLE, False))
                        known.setdefault((*ws, "only"), (f"notice:{spdx}-only", notice == WHOLE, False))
            if "GPL" in spdx:
                later += [f"{spdx}-or-later", f"{spdx}-only"]
        for name, text in sentences.items():
            known[tuple(_words(text))] = name, False, False
        self.trie: dict = {}
        for ws, use in known.items():
            node = self.trie
            for w in ws:
                node = node.setdefault(w, {})
            node[_ID] = use
        self.names: dict = {}
        for spdx, aliases in names.items():
            for alias in (*aliases, *(["Apache License"] if spdx == "Apache-2.0" else [])):
                node = self.names
                for w in _words(alias):
                    node = node.setdefault(w, {})
                node[_ID] = spdx
        self.ids = {**{k.lower(): k for k in names}, **{f"{k}{e}".lower(): f"{k}{e}" for k in VERSIONED for e in ENDINGS}}
        # Where a known sentence can start: its first two words.
        sep, heads = r"[\W_]+", {}
        for ws in known:
            heads.setdefault(ws[0], set()).add(ws[1])
        self.start = re.compile(r"(?<![^\W_])(?=(?:%s)(?![^\W_]))" % "|".join(f"{a}{sep}(?:{'|'.join(sorted(b))})" for a, b in sorted(heads.items())))
        self.rules = [*rules, *(((f"notice:{spdx}",), spdx, "notice") for spdx in (*names, *later))]
        self.gap = gap
        # Rare words of which every known sentence has one: a text without any of them holds no sentence.
        must = ("licensed", "license", "released", "distributed", "available", "published", "permission", "redistribut", "reserved", "warrant", "liable",
                "compliance", "mozilla", "unencumbered", "free software", "licenses", "publicdomain", "waived", "free to copy")
        self.hint = re.compile("|".join(must), re.IGNORECASE)
        assert all(self.hint.search(" ".join(ws)) for ws in known)

    def sentences(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, first fragment, last fragment, start, end) of known sentences, left to right, the longest from each start."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        out, done, parts, starts = [], 0, None, []
        for m in self.start.finditer(low):
            if m.start() < done:
                continue
            node, best = self.trie, None
            for w in _WORD.finditer(low, m.start()):
                node = node.get(w[0])
                if node is None:
                    break
                if _ID not in node:
                    continue
                if parts is None:
                    parts = [(f.start(), f.end()) for f in _FRAGMENT.finditer(text) if _WORD.search(f[0])]
                    starts = [p[0] for p in parts]
                name, whole, bare = node[_ID]
                i, j = bisect_right(starts, m.start()) - 1, bisect_right(starts, w.start()) - 1
                before = _WORD.search(low, parts[i][0], m.start())
                denied = before and _WORD.findall(low, max(parts[i][0], m.start() - 32), m.start())[-1:]
                after = _WORD.search(low, w.end(), parts[j][1])
                if whole and (before or after) or denied and denied[0] in DENIED and name.startswith("notice:"):
                    continue
                if bare and after and after[0] not in AFTER and not low[w.end():after.start()].strip(" \t-"):
                    continue
                start = m.start() if before else parts[i][0] + len(text[parts[i][0]:m.start()]) - len(text[parts[i][0]:m.start()].lstrip())
                best = name, i, j, start, w.end() if after else parts[j][1]
            if best:
                out.append(best)
                done = best[4]
        return out

    def joined(self, text: str, end: int) -> Iterator[tuple[str, int, int]]:
        """(licence, start, end) of the names that ``or`` and ``and`` join to a notice that ends at ``end``."""
        while m := _JOINED.match(text, end):
            node, best = self.names, None
            for w in _WORD.finditer(text, m.end()):
                node = node.get(w[0].lower())
                if node is None:
                    break
                if _ID in node:
                    best = node[_ID], m.end(), w.end()
            if best is None:
                return
            yield best
            end = best[2]

    def expressions(self, text: str) -> list[tuple[str, int, int]]:
        """(expression, start, end) of SPDX identifiers that join licences, written in one way."""
        out = []
        for m in _SPDX.finditer(text):
            at, end, depth, want, parts, licence = m.start(1), m.start(1), 0, True, [], ""
            while t := _SPDX_TOKEN.match(text, at, m.end()):
                bracket, joint, name = t.groups()
                if bracket == "(" and want or bracket == ")" and not want and depth:
                    depth += 1 if bracket == "(" else -1
                    parts.append(bracket)
                elif joint and not want:
                    parts.append(f" {joint.upper()} ")
                    want = True
                elif name and want:
                    licence = name if parts and parts[-1] == " WITH " and name in EXCEPTIONS else self.ids.get(name.lower())
                    if licence is None:
                        break
                    parts.append(licence)
                    want = False
                else:
                    break
                at = t.end()
                if not want and not depth:
                    end, whole = at, "".join(parts)
            if end > m.start(1) and (" " in whole or "(" in whole):
                out.append((whole[1:-1] if whole.startswith("(") and whole.find(")") == len(whole) - 1 else whole, m.start(), end))
        return out

    def scan(self, text: str | None) -> list[tuple[str, str, int, int, int]]:
        """(licence, kind, sentences, start, end) of the rules that fit, left to right, each sentence used once."""
        if not text or not self.hint.search(text):
            return []
        found, out, i = self.sentences(text), [], 0
        spdx = self.expressions(text)
        starts = [a for _, a, _ in spdx]
        inside = lambda at: (k := bisect_right(starts, at)) > 0 and at < spdx[k - 1][2]
        found = [f for f in found if not inside(f[3]) and not inside(f[4] - 1)] if spdx else found
        spots: list[tuple[int, int, bool]] = []  # fragments of the rules that fit, and whether they are of reserved rights
        while i < len(found):
            for ids, licence, kind in self.rules:
                run = found[i:i + len(ids)]
                if tuple(f[0] for f in run) == ids and all(b[1] - a[2] - 1 <= self.gap for a, b in zip(run, run[1:])):
                    out.append((licence, kind, len(ids), run[0][3], run[-1][4]))
                    spots.append((run[0][1], run[-1][2], licence == "proprietary"))
                    i += len(ids)
                    if kind == "notice":
                        for other, a, b in self.joined(text, run[-1][4]):
                            if other != licence:
                                out.append((other, kind, 1, a, b))
                                spots.append((run[0][1], run[-1][2], False))
                    break
            else:
                i += 1
        # Reserved rights beside a licence are its copyright line: the nearest licence before and after each is looked at.
        keep, before, after = [], -self.gap - NEAR, [0] * len(out)
        ahead = 1 << 60
        for k in range(len(out) - 1, -1, -1):
            after[k] = ahead
            if not spots[k][2]:
                ahead = spots[k][0]
        for k, row in enumerate(out):
            if not spots[k][2]:
                before = spots[k][1]
            elif spots[k][0] - before <= NEAR or after[k] - spots[k][1] <= NEAR:
                continue
            keep.append(row)
        return sorted([*keep, *((e, "expression", 1, a, b) for e, a, b in spdx)], key=lambda r: r[3:])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """Licences that whole texts state.

    Returns (doc_id, license, kind, n_sentences, start_char, end_char), one row per rule that fits: kind is text, header, notice, part or expression (an
    SPDX identifier that joins licences). Reserved rights are no licence of their own beside one. Texts without a
    known sentence, null and empty ones give no row; a repeated row gives its rows again; ids may be null; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    use = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *m) for i, t in enumerate(batch["text"]) for m in use.scan(t.as_py())]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()),
                                              *(pa.array(c, pa.int32()) for c in cols[3:])], ["doc_id", "license", "kind", "n_sentences", "start_char", "end_char"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, license string, kind string, n_sentences int, start_char int, end_char int")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan_licenses(read(spark, sf_dir, "documents"))
