"""Result blocks (X1): balanced elements against a stack, and what a block owns."""

import random
import re

from pyspark.sql import functions as F

from matforge.operators import pages as pg


def _by_stack(html, classes):
    """Ranges of the elements of the first class that the page has, by an explicit stack."""
    tags = list(re.finditer(r"(?i)<(/?)div\b([^>]*)>", html))
    stack, out = [], []
    for m in tags:
        if m[1]:
            if stack:
                start, cls = stack.pop()
                out.append((start, m.start(), cls))
        else:
            c = re.search(r"(?i)\sclass\s*=\s*[\"']([^\"']*)", m[2])
            stack.append((m.start(), c[1].split() if c else []))
    out += [(s, len(html), c) for s, c in stack]
    for c in classes:
        if found := sorted((s, e) for s, e, cls in out if c in cls):
            return found
    return []


def test_element_ranges_equal_a_stack(spark):
    rng = random.Random(2)
    parts = ["<div>", '<div class="row">', "<DIV class='a row b'>", "</div>", "</div >", "text", "<p>x</p>", '<div class="box" id=x>', "</div>", "<divx>"]
    pages = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(300)] + [(300, "<div class=row>" * 3000 + "x"), (301, None)]
    got = {r.key: [tuple(x) for x in r.ranges] for r in pg.element_ranges(spark.createDataFrame(pages, "page_id long, html string"), classes=("row", "box")).collect()}
    for i, html in pages[:300]:
        assert got.get(i, []) == _by_stack(html, ("row", "box")), html
    assert len(got[300]) == 3000 and 301 not in got


def test_blocks_own_their_parts(spark):
    html = """<!-- <div class="row"> --><script>var x = '<div class="row">';</script><div class="list">
    <div class="x row"><div><h2><a class=z href="/a">Alpha &amp; Co</a></h2></div><div class="city">Pune</div> Call +91 9876543210, mail a.b@c.example</div>
    <div class="row"><a href="">  </a><h3><a href="http://b.example/b">Beta</a></h3></div>
    <div class="row"><b>Gamma Works</b> - steel and more, 98765 43210 <div class="row">inner <a href='/in'>Inner</a></div></div>
    <div class="row"><a href="/a">Alpha &amp; Co</a></div><div class="row">  </div></div>"""
    pages = spark.createDataFrame([(1, "https://s.example/q?x", html), (2, "https://t.example", "<div class='comp_name'>Delta - x</div><div data-comp=1>Eps</div>"),
                                   (3, "https://u.example", "<p>none</p>"), (4, None, None)], "page_id long, url string, html string")
    got = [tuple(r) for r in pg.result_blocks(pages).orderBy("page_id", "rank").collect()]
    assert got == [
        (1, 1, "Alpha & Co", "https://s.example/a", "+91 9876543210; a.b@c.example", "Pune", "s.example"),
        (1, 2, "Beta", "http://b.example/b", None, None, "s.example"),
        (1, 3, "Inner", "https://s.example/in", None, None, "s.example"),
        (2, 1, "Delta", None, None, None, "t.example")]
    assert pg.result_blocks(pages, max_per_page=1).where(F.col("rank") > 1).count() == 0
    assert pg.result_blocks(pages.limit(0)).count() == 0
