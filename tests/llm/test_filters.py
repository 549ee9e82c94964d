"""Toxicity, decontamination, licence scans and HTML extraction against brute force, and their edge cases."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from matforge.llm import decontaminate as D
from matforge.llm import html_text as H
from matforge.llm import licenses as L
from matforge.llm import toxicity as X
from matforge.llm.common import id_remainder, read

SF = "/root/testdata/sf0.01"
EDGE = [(None, "x y"), (1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (4, "word " * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):
    """Null ids and texts, empty, repeated and very long texts, and columns named like those the operators add."""
    return spark.createDataFrame(EDGE, "doc_id long, text string").select(
        "*", *(F.lit(i).alias(c) for i, c in enumerate(("score", "item_id", "component_id", "fingerprint", "spans", "k", "length", "toxicity_score"))))


# ---- toxicity

def test_fold_reads_homoglyphs_and_substitutes():
    assert X.fold("ЅТUРІD") == " stupid "
    assert X.fold("1d10t, m0r0n! ｃｌｏｗｎ") == " idiot moron clown "
    assert X.fold("room 101, 5 km") == " room km "
    assert X.fold("idiot$$$ 50$") == " idiot "
    assert X.fold(None) == X.fold("") == X.fold("123") == " "


def test_exception_phrases_cancel_hits_and_length_normalises():
    a = X.Lexicon({" trash ": 2.0, " id": 1.0}, ("trash can",)).automaton()
    assert X.features(a, "a trash can")[1] == 0
    assert X.features(a, "trash can, trash")[1] == math.log1p(2.0)
    assert X.features(a, "idiot ideas")[2] == math.log1p(2)
    assert X.features(a, "trash " + "w " * 5)[0] > X.features(a, "trash " + "w " * 500)[0]
    assert X.features(a, "1oser")[1] == 0 and X.features(X.Lexicon({" loser ": 1.0}).automaton(), "1oser")[2] == math.log1p(1)


def test_features_equal_a_search_by_hand():
    """Every entry at every place of the folded text, without an automaton."""
    rng = random.Random(3)
    lexicon = X.Lexicon({" trash ": 2.0, " id": 1.0, " loser ": 3.0, " b": 0.5}, ("trash can", "b c d", "can trash"))
    auto = lexicon.automaton()
    words = ["trash", "can", "idiot", "l0ser", "b", "c", "d", "id", "tr@sh", "x"]
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(12)))
        t = X.fold(text)
        spans = [(i, i + len(X.fold(p))) for p in lexicon.exceptions for i in range(len(t)) if t.startswith(X.fold(p), i)]
        hits = [w for k, w in lexicon.entries.items() for v in {k, k.replace("l", "i")} for i in range(len(t))
                if t.startswith(v, i) and not any(a <= i and i + len(v) <= b for a, b in spans)]
        assert X.features(auto, text)[1:3] == pytest.approx((math.log1p(sum(hits)), math.log1p(len(hits)))), text


@pytest.mark.parametrize("unit", ["1", "a", "$", "a1", "1_", "a!", "_a", "é", "1a ", "!!a", "trash can ", "trash "])
def test_long_texts_fold_in_linear_time(unit):
    auto = X.Lexicon({" trash ": 2.0}).automaton()
    start = time.perf_counter()
    X.features(auto, unit * (200_000 // len(unit)) + "!x")
    assert time.perf_counter() - start < 1


def test_held_out_accuracy_and_no_label_leak(spark):
    from matforge.llm.toxicity import op2_toxicity

    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf).join(read(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 900 and (got.predicted == got.toxic).mean() >= 0.98
    assert got[got.toxic == 1].score.mean() > 0.8 and got[got.toxic == 0].score.mean() < 0.1


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = X.learn(edge, labels)
    out = X.score(edge, lexicon)
    assert out.count() == len(EDGE) and out.where("toxicity_score between 0 and 1").count() == len(EDGE)
    none = X.learn(edge.limit(0), labels.limit(0))
    assert none.entries == {} and X.score(edge.limit(0), none).count() == 0


# ---- decontamination

def _brute_pairs(docs, items):
    """Every passage against every item, by the definition of the score."""
    index = D.Index(*D.describe(items))
    weight = [dict() for _ in index.items]
    for t, i in index.term.items():
        for item, w in zip(index.ids[i], index.impacts[i]):
            weight[item][t] = w
    found = set()
    for doc, text in docs:
        ws = D.words(text)
        n, step, size = index.passages(len(ws))
        for p in range(n if ws else 0):
            passage = ws[p * step:p * step + size]
            for item, own in enumerate(weight):
                q, a = D.question_and_answer(index.items[item][1])
                if sum(w for t, w in own.items() if t in set(passage)) >= D.THRESHOLD - 1e-9 and min(D.overlap(q, passage), D.overlap(a, passage)) >= D.OVERLAP:
                    found.add((doc, index.items[item][0]))
    return found


def test_decontamination_equals_brute_force(spark):
    docs = [tuple(r) for r in read(spark, SF, "documents").where("doc_id < 250").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    want = _brute_pairs(docs, items)
    whole = []
    for per_index, per_task in ((2_000, 100_000), (15, 100_000), (7, 40)):
        got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items=per_index, per_task=per_task)
        whole.append(sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap, r.n_passages) for r in got.collect()))
        assert {x[:2] for x in whole[-1]} == want
    assert len(want) > 3 and whole[0] == whole[1] == whole[2]  # whatever shards the items are in


def test_search_finds_all_above_threshold():
    items = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(12))) for i in range(60)]
    index = D.Index(*D.describe(items), block=4)
    import numpy as np
    for q in range(0, 60, 7):
        ws = D.words(items[q][1]) + ["w1", "w2"]
        terms = sorted({index.term[w] for w in ws})
        full = {}
        for t in terms:
            for i, w in zip(index.ids[t], index.impacts[t]):
                full[i] = full.get(i, 0) + w
        for threshold in (0.3, 0.6, 0.9):
            got = dict(index.search(terms, index.block_max[terms].sum(axis=0) + np.float32(1e-5), threshold))
            assert set(got) == {i for i, s in full.items() if s >= threshold - 1e-6}


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "One two three four. Five six."), (4, "One two three four. Five six."), (None, "alpha beta gamma delta")],
                                  "item_id long, text string")
    leak = spark.createDataFrame([(None, "so ONE two three four, five six so"), (7, "alpha beta gamma delta"), (7, "alpha beta gamma delta")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(leak, items).collect()}
    assert got == {(None, 4), (7, None)}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(leak, items, items=1).collect()} == got
    assert D.contaminated(edge, items).count() == 0
    assert D.contaminated(edge, items.limit(0)).count() == 0 and D.contaminated(edge.limit(0), items).count() == 0


# ---- licences

def test_license_rules():
    s = L.Scanner()
    mit = L.SENTENCES["mit-grant"] + ":\n\n" + L.SENTENCES["mit-notice"] + ".\n\n" + L.SENTENCES["mit-warranty"] + ".\n" + L.SENTENCES["mit-liability"] + "."
    wrapped = "\n".join(re.findall(r".{1,60}(?:\s|$)", mit))
    for text in (mit, wrapped):
        assert [(m[0], m[1], m[2]) for m in s.scan("intro line\n" + text + "\nend")] == [("MIT", "text", 4)]
    bsd = ". ".join(L.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")) + "."
    assert [m[0] for m in s.scan(bsd)] == ["BSD-2-Clause"]
    assert [m[0] for m in s.scan(bsd + " " + L.SENTENCES["bsd-endorse"] + ".")] == ["BSD-3-Clause"]
    assert [m[0] for m in s.scan("x\nLicensed under the Apache License, Version 2.0.\ny\nReleased under the MIT License.")] == ["Apache-2.0", "MIT"]
    assert s.scan("a text on how to be licensed under the sea") == [] and s.scan(None) == s.scan("") == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
ASF = """Licensed to the Apache Software Foundation (ASF) under one or more
contributor license agreements.  See the NOTICE file distributed with
this work for additional information regarding copyright ownership.
The ASF licenses this file to You under the Apache License, Version 2.0
""" + APACHE.split("Version 2.0 ")[1]
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of %s nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


@pytest.mark.parametrize("text, found", [
    (APACHE, ("Apache-2.0", "header")), (ASF, ("Apache-2.0", "header")), (APACHE.split("\n", 1)[1], ("Apache-2.0", "header")),
    (BSD, ("BSD-2-Clause", "text")), (BSD + ENDORSE % "the copyright holder", ("BSD-3-Clause", "text")), (BSD + ENDORSE % "Example Inc.", ("BSD-3-Clause", "text")),
    (GPL, ("GPL-3.0-or-later", "header")), (GPL.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), ("GPL-2.0-or-later", "header")),
    (MPL, ("MPL-2.0", "header"))])
def test_published_headers(text, found):
    s = L.Scanner()
    for mark in ("", "# ", " * ", "// "):
        lines = "intro\n" + "\n".join(mark + line for line in text.split("\n")) + "\nend"
        assert [m[:2] for m in s.scan(lines)] == [found]


@pytest.mark.parametrize("text, found, span", [
    ("This file is part of X and is licensed under the MIT License.", "MIT", "licensed under the MIT License"),
    ("Copyright 2020 X, all rights reserved.", "proprietary", "all rights reserved"),
    ("Our code, released under MIT, is on the web.", "MIT", "released under MIT"),
    ("It is licensed under the GNU General Public License, version 3 or later, as are all parts.", "GPL-3.0-or-later", "licensed under the GNU General Public License, version 3 or later"),
    ("Code licensed under MIT 2 times.", None, None), ("Tapes released under the MIT program.", None, None), ("He lost his license. MIT helped.", None, None),
    ("X is not licensed under the MIT License.", None, None)])
def test_sentences_inside_a_fragment(text, found, span):
    got = L.Scanner().scan(text)
    assert [(m[0], text[m[3]:m[4]]) for m in got] == ([(found, span)] if found else [])


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
CC0 = "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work."
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BOOST = """Distributed under the Boost Software License, Version 1.0.
   (See accompanying file LICENSE_1_0.txt or copy at
         https://www.boost.org/LICENSE_1_0.txt)"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0"""


@pytest.mark.parametrize("text, found", [
    (LGPL, "LGPL-2.1-or-later"), (GPL.replace("GNU General Public License as", "GNU Lesser General Public License as"), "LGPL-3.0-or-later"),
    (GPL.replace("GNU General Public License as", "GNU Affero General Public License as"), "AGPL-3.0-or-later"),
    ("This file may be distributed and/or modified\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0-only"),
    (CC0, "CC0-1.0"), (ISC, "ISC"), (BOOST, "BSL-1.0"), (EPL, "EPL-2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\n"
     "binary, for any purpose, commercial or non-commercial, and by any\nmeans.", "Unlicense"),
    *((f"This work is licensed under a Creative Commons {name} 4.0 International License.\nhttp://creativecommons.org/licenses/{k}/4.0/", f"CC-{k.upper()}-4.0") for k, name in (
        ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
        ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"))),
    ("Copyright (c) 2020, Foo. All rights reserved.\n\n" + BSD, "BSD-2-Clause"), (BSD + "\nCopyright Foo, all rights reserved.", "BSD-2-Clause"),
    ("Released under a BSD-style license.", "BSD"), ("Licensed under the GPL-3.0 only.", "GPL-3.0-only"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"),
    ("SPDX-License-Identifier: Apache-2.0 AND (MIT or BSD-3-Clause)", "Apache-2.0 AND (MIT OR BSD-3-Clause)"), ("SPDX-License-Identifier: MIT AND", "MIT"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later")])
def test_more_published_notices(text, found):
    for mark in ("", "# ", " * "):
        got = L.Scanner().scan("\n".join(mark + line for line in text.split("\n")))
        assert [m[0] for m in got] == [found]


def test_joined_names_and_rights_far_away():
    s = L.Scanner()
    assert [m[0] for m in s.scan("Licensed under the MIT license or the Apache License, Version 2.0.")] == ["MIT", "Apache-2.0"]
    assert [m[0] for m in s.scan("Licensed under either MIT and/or ISC, as you like. " + "More text. " * 20 + "All rights reserved.")][-1] == "proprietary"
    assert [m[0] for m in s.scan("Released under the MIT License and enjoyed by many.")] == ["MIT"]


def test_every_known_sentence_is_found_by_trying_all_places():
    """All sentences at all words of made-up texts, without a trie."""
    s, rng = L.Scanner(), random.Random(11)
    known = {}

    def collect(node, path):
        for w, rest in node.items():
            if w == L._ID:
                known[tuple(path)] = rest
            else:
                collect(rest, [*path, w])
    collect(s.trie, [])
    plain = {k: v for k, v in known.items() if not v[1] and not v[2] and len(k) < 40}
    pool = list(plain)
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 8)):
            k = rng.choice(pool)
            words += rng.choice([k, k[:-1], k[1:], ("some", "words"), ()])
        text, want, i = " ".join(words), [], 0
        while i < len(words):
            fits = [k for k in known if tuple(words[i:i + len(k)]) == k and not known[k][1] and not (known[k][2] and i + len(k) < len(words) and words[i + len(k)] not in L.AFTER)]
            deny = i and words[i - 1] in L.DENIED
            fits = [k for k in fits if not (deny and known[k][0].startswith("notice:"))]
            if fits:
                k = max(fits, key=len)
                want.append(known[k][0])
                i += len(k)
            else:
                i += 1
        assert [f[0] for f in s.sentences(text)] == want, text


@pytest.mark.parametrize("unit", ["all rights reserved. ", "Licensed under ", "SPDX-License-Identifier: (MIT OR ", "SPDX-License-Identifier: MIT OR ISC\n", "released under MIT and ", "license ", "("])
def test_long_license_texts_take_linear_time(unit):
    s = L.Scanner()
    start = time.perf_counter()
    s.scan(unit * (100_000 // len(unit)) + " license")
    assert time.perf_counter() - start < 3


@pytest.mark.parametrize("unit", ["what is the ", "a", "1", "é", "w1 "])
def test_long_texts_against_the_index_take_linear_time(unit):
    index = D.Index(*D.describe([(1, "what is the capital of france paris"), (2, "how many legs has a spider eight")]), 4)
    start = time.perf_counter()
    list(index.query(D.words(unit * (200_000 // len(unit))), 0.5))
    assert time.perf_counter() - start < 5


def test_license_scan_covers_all_lines(spark, edge):
    got = L.scan_licenses(read(spark, SF, "documents"))
    line = r"(?m)^(Licensed under the Apache License, Version 2\.0|Released under the MIT License|Licensed under CC BY-NC 4\.0|This work is licensed under the GNU General Public License, version 3)\.$"
    want = read(spark, SF, "documents").where(F.col("text").rlike(line)).select("doc_id")
    assert want.count() > 20 and want.join(got.where("kind = 'notice' AND license != 'proprietary'"), "doc_id", "left_anti").count() == 0
    spans = got.join(read(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect()
    assert all(r.text[r.start_char:r.end_char].strip() for r in spans)
    assert L.scan_licenses(edge).count() == 0 and L.scan_licenses(edge.limit(0)).count() == 0


# ---- HTML

def test_html_of_the_given_pages(spark):
    """Against a plain reading of the article element, which all of them have."""
    import html

    def plain(page):
        article = page.split("<article>")[1].rsplit("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        return "\n".join(p for p in parts if p)

    rows = read(spark, SF, "pages").select("page_id", "html").collect()
    got = {r.page_id: r for r in H.op3_html_extraction(spark, SF).collect()}
    assert len(got) == len(rows) and all(got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) for r in rows)


def test_html_without_article_element():
    page = """<html><body class="has-sidebar"><div id="header"><a href="/">Site</a></div><ul class="nav"><li><a href="/a">A</a><li><a href="/b">B</a></ul>
    <div class="cookie-notice">We use cookies, yes, and more.</div><div class="wrap"><div class="sidebar"><p>Side text, with, commas, and things to read, many of them.</p></div>
    <div id="content"><h1>Title &amp; more</h1><p>First paragraph, with commas, and words that are long enough to count, as text does.</p><p>Short.</p>
    <ul><li>one<li>two</ul><p>Second&nbsp;paragraph <a href=x>link</a> here,\n more   words follow.<form><p>mail?</p></form></div>
    <div class="comments"><p>I am a reader, and, I comment, a lot, at great length, as readers do.</p></div></div><footer>bye</footer><script>var a="</p><p>no";</script></body></html>"""
    assert H.main_text(page).split("\n") == ["Title & more", "First paragraph, with commas, and words that are long enough to count, as text does.", "Short.", "one", "two",
                                             "Second paragraph link here, more words follow."]


PROSE = "A first paragraph, with commas, and words that are long enough to count, as the text of an article does, line by line."
READERS = "".join(f"<li class='comment'><article class='comment-body'><p>I am reader {i}, and, I comment, a lot, at great length, as readers do.</p></article></li>" for i in range(9))
NAV = "<nav>" + "<a href=/>A long entry of the menu</a> " * 20 + "</nav>"


@pytest.mark.parametrize("page", [
    f"<form id=aspnetForm method=post action=x><input type=hidden name=__VIEWSTATE value=x>{NAV}<div id=content><p>%s</p></div><input type=submit></form>",
    f"{NAV}<form role=form><div><p>%s</p></div><select>{'<option>Some country' * 90}</select></form>",
    "<form><article><p>%s</p></article></form>", "<fieldset><legend></legend><div><p>%s</p></div></fieldset>", "<label><div><p>%s</p></div></label>",
    "<article class='post comments-open'><p>%s</p></article>", f"{NAV}<article class='post comments-open'><p>%s</p></article><div id=comments><ol>{READERS}</ol></div>",
    f"<div class='wrap has-comments'><div class=entry><p>%s</p></div></div>", f"<div class=page-with-comments><article><p>%s</p></article><div class=comments><ol>{READERS}</ol></div></div>",
    "<div class='comments'><div class=entry><p>%s</p></div></div>", "<div class=commentable><article><p>%s</p></article></div>",
    # Forms and reader comments beside the article go as before, long ones too.
    f"<div class=entry><p>%s</p></div><form><p>Your mail?</p><select>{'<option>Some country' * 90}</select></form><p class=no-comments>Comments are closed.</p>",
    f"<div class=entry><p>%s</p></div><div id=comments><ol>{READERS}</ol></div>", f"<article><p>%s</p></article><div id=comments><ol>{READERS.replace(' class=', ' title=')}</ol></div>"])
def test_html_forms_and_comment_words_around_the_article(page):
    assert H.main_text(f"<html><body>{page % PROSE}</body></html>") == PROSE


def test_html_of_the_given_pages_without_article_elements(spark):
    """The same text must come out where the article has another element, or none."""
    for r in read(spark, SF, "pages").select("html").collect():
        want = H.main_text(r.html)
        assert H.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>")) == want
        assert H.main_text(r.html.replace("<article>", "").replace("</article>", "")) == want


@pytest.mark.parametrize("extra", ["<div class=sec><p>Short end.</p></div>", "<h4>Head</h4>", "<ul><li>one<li>two</ul>", "<p class='related-work'>Others.</p>", "<div class='share-of-market'>Half.</div>",
                                   "<div class='elementor-widget'><p>More here.</p></div>", "<table><tr><td>1<td>2</table>", "<blockquote>Quote.</blockquote>"])
def test_html_parts_beside_the_best_container_stay(extra):
    import html

    plain = re.sub(r"\s*\n\s*", "\n", re.sub(r"<(?:li|p|/div|h4|div|ul|/ul)[^>]*>", "\n", extra).replace("<td>", " ")).strip()
    text = " ".join(re.sub(r"<[^>]*>", "", html.unescape(plain)).split(" "))
    page = f"<html><body>{NAV}<div class=wrap><div class=entry><p>{PROSE}</p><p>{PROSE}</p></div>{extra}<div class=last><p>{PROSE}</p></div></div><div class='site-footer'>Foot.</div></body></html>"
    got = H.main_text(page).split("\n")
    assert got == [PROSE, PROSE, *(x.strip() for x in text.split("\n") if x.strip()), PROSE]


@pytest.mark.parametrize("name", ["site-footer", "ad-slot-2", "mainNav", "sidebar", "cookie-banner", "related-posts", "social-share-buttons", "newsletter-signup-form"])
def test_html_names_of_other_parts(name):
    assert H.main_text(f"<body><div class=x><p>{PROSE}</p></div><div class='{name}'><p>Not this, nor that.</p></div></body>") == PROSE


@pytest.mark.parametrize("unit, close", [("<b>", "</i>"), ("<i>", "<p>x"), ("<i>", "<h1>"), ("<b><div>", "</b>"), ("<li>", "</ul>"), ("<tr>", "</td>"), ("<textarea>", ""), ("<div><p>", "</p></div>"), ("<title", "<"), ("<a x='", "'>")])
def test_long_pages_take_linear_time(unit, close):
    start = time.perf_counter()
    H.main_text(unit * 20_000 + "text" + close * 20_000)
    assert time.perf_counter() - start < 6


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), (" ", ""), ("<p>a<p>b", "a\nb"), ("plain", "plain"), ("<div>" * 20_000 + "deep", "deep"), ("<!-- open", ""),
                                        ("<p>&lt;b&gt; &#65; &amp", "<b> A &"), ("<p>x</p><script>alert(1)", "x"), ("<article><header><h1>T</h1><p>by me</p></header><p>x</article>", "T\nx")])
def test_html_edges(page, text):
    assert H.main_text(page) == text


def test_html_frame_edges(spark):
    pages = spark.createDataFrame([(None, None, None, "t", 5), (1, None, "<p>a", "t", 5), (1, None, "<p>a", "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in H.extract(pages).collect()) == [("", 0), ("a", 1), ("a", 1)]
    assert H.extract(pages.limit(0)).count() == 0


def test_folds(spark):
    import zlib
    got = spark.range(50).select("id", id_remainder(F.col("id"), 4).alias("r"), id_remainder(F.lit(None).cast("long"), 4).alias("none")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 and r.none == -1 for r in got)
