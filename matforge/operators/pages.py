"""Vendor extraction from stored result pages.

A page is one row, so every step up to the per-page cap works inside that row with
array expressions (extract, de-duplicate by first occurrence, cap) — no shuffle at all;
only the final explode multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
ANCHOR_RE = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)[^>]*>(.*?)</a>"""
LOOSE_LINK_WORDS = ("detail", "company", "supplier")
# The JVM's \d and \w are ASCII only, so the classes that they stand for are spelled out; the white space is ASCII.
PHONE_RE = r"(\+?\p{Nd}{2,4}[-\t\n\f\r ]?)?(\p{Nd}{6,12})"
EMAIL_RE = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
DEFAULT_COMPANY = "Vendor"


def html_text(c: Column) -> Column:
    """Tags removed, common entities decoded, blanks collapsed and trimmed."""
    s = F.regexp_replace(c, r"<[^>]*>", "")
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def page_origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def _anchors(html: Column) -> Column:
    """array<struct<href, text>> of every anchor of the page, in page order, in any case and quoting."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR_RE), 1), lambda h: F.regexp_replace(h, r"""^["']|["']$""", ""))
    texts = F.regexp_extract_all(html, F.lit(ANCHOR_RE), 2)
    return F.arrays_zip(hrefs.alias("href"), texts.alias("text"))


def page_vendors(pages: DataFrame, max_per_page: int | None = None, base: str | None = None,
                 keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """X1 + V2: anchors -> (company, absolute url, source); distinct by company+href, all of them or the first
    ``max_per_page`` per page, ``rank`` = position among the kept vendors of the page."""
    origin = F.lit(base) if base else page_origin(F.col("url"))
    # company and href as one text, so that the distinct ones are found by hash, first occurrence first
    keys = F.transform(_anchors(F.col("html")), lambda x: F.concat(html_text(x["text"]), F.lit("\u0001"), x["href"]))
    firsts = F.array_distinct(F.filter(keys, lambda k: ~k.startswith("\u0001")))
    capped = firsts if max_per_page is None else F.slice(firsts, 1, max_per_page)
    capped = F.transform(capped, lambda k: F.struct(F.split_part(k, F.lit("\u0001"), F.lit(1)).alias("company"),
                                                    F.split_part(k, F.lit("\u0001"), F.lit(2)).alias("href")))
    out = pages.select(*keep, F.col("url").alias("page_url"), origin.alias("_origin"),
                       F.posexplode(capped).alias("rank", "v"))
    href = F.col("v.href")
    return out.select(*keep, (F.col("rank") + 1).alias("rank"), F.col("v.company").alias("company"),
                      F.when(href.startswith("http"), href).otherwise(F.concat(F.col("_origin"), href)).alias("url"),
                      F.regexp_extract(F.col("page_url"), r"^https?://([^/?#]+)", 1).alias("source"))


def loose_links(pages: DataFrame, words=LOOSE_LINK_WORDS, max_per_page: int | None = None,
                base: str | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Anchors whose href names a detail/company/supplier page and whose text is not empty."""
    origin = F.lit(base) if base else page_origin(F.col("url"))

    def wanted(x):
        cond = F.lit(False)
        for w in words:
            cond = cond | x["href"].contains(w)
        return cond & (html_text(x["text"]) != "")

    a = F.filter(_anchors(F.col("html")), wanted)
    a = a if max_per_page is None else F.slice(a, 1, max_per_page)
    out = pages.select(*keep, origin.alias("_origin"), F.posexplode(a).alias("rank", "v"))
    href = F.col("v.href")
    return out.select(*keep, (F.col("rank") + 1).alias("rank"), html_text(F.col("v.text")).alias("company"),
                      F.when(href.startswith("http"), href).otherwise(F.concat(F.col("_origin"), href)).alias("url"))


# Classes of result blocks, best first ([x]: an attribute), and of a block's place.
BLOCK_CLASSES = ("srchHdng", "listingBox", "row", "comp_name", "[data-comp]")
LOCATION_CLASSES = ("loc", "location", "city", "address")
_CLASSED = r"""(?is)<{tag}\b[^>]*?\sclass\s*=\s*["'][^"']*?\b(?:{names})\b[^"']*["'][^>]*>"""


def _clean(html: Column) -> Column:
    """Without comments, scripts and styles, whose text may look like tags."""
    return F.translate(F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " "), "\u0001", " ")


def element_ranges(pages: DataFrame, tag: str = "div", classes: tuple[str, ...] = BLOCK_CLASSES, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ranges): where in the cleaned page the elements of the first of ``classes`` that it has begin and end.

    Every start and end tag is one small row without text. The depth is a prefix sum over them (an end tag without a start is passed over, as
    a parser does), and the end of an element is the next tag at its own depth, so nested elements are told apart in linear time.
    An element that is never closed reaches to the end of the page. The windows hold one page each; ``key`` names a page.
    """
    name = F.col("p")
    cls = F.regexp_replace(F.regexp_extract(name, rf"(?is)^<{tag}\b[^>]*?\sclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1), "[\"']", "")
    words = F.split(cls, r"\s+")
    has = [F.regexp_like(name, F.lit(rf"(?is)^<{tag}\b[^>]*?\s{c[1:-1]}\b")) if c.startswith("[") else F.array_contains(words, c) for c in classes]
    kinds = F.filter(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(has))), lambda x: x.isNotNull())
    cut = F.split(F.regexp_replace(_clean(F.col(html)), rf"(?i)(</?{tag}\b)", "\u0001$1"), "\u0001")
    tags = pages.select(F.col(key).alias("key"), F.posexplode(cut).alias("i", "p"))
    delta = F.when(F.col("i") == 0, 0).when(name.startswith("</"), -1).otherwise(1)
    tags = tags.select("key", "i", F.length("p").alias("size"), delta.alias("delta"), F.when(delta == 1, kinds).otherwise(F.array().cast("array<int>")).alias("kinds"))
    page = Window.partitionBy("key")
    upto = page.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    tags = tags.withColumns({"start": F.sum("size").over(upto) - F.col("size"), "sum": F.sum("delta").over(upto), "total": F.sum("size").over(page),
                             "best": F.min(F.array_min("kinds")).over(page)})
    tags = tags.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(upto)))
    before = F.coalesce(F.lag("depth").over(page.orderBy("i")), F.lit(0))
    tags = tags.withColumn("level", F.when(F.col("delta") == 1, F.col("depth")).when((F.col("delta") == -1) & (before > 0), before)).where("level IS NOT NULL")
    tags = tags.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy("key", "level").orderBy("i")), F.col("total")))
    blocks = tags.where((F.col("delta") == 1) & F.array_contains("kinds", F.col("best")))
    return blocks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def block_text(html: Column) -> Column:
    """The texts of a block, joined by one space."""
    s = F.regexp_replace(html, r"<[^>]*>", " ")
    for a, b in ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def result_blocks(pages: DataFrame, classes: tuple[str, ...] = BLOCK_CLASSES, tag: str = "div", max_per_page: int | None = None,
                  base: str | None = None, default: str = DEFAULT_COMPANY, key: str = "page_id") -> DataFrame:
    """X1 by blocks: (key, rank, company, url, contact, location, source), one row per result block of a page.

    The company is the first anchor of a heading (h2, then h3), of class ``compName``, or of the block, or of a ``company-name`` box,
    whichever first has a text; else the block's text up to `` - `` (X4). Contact by X3 over the block's text; location from an element of
    ``LOCATION_CLASSES``. Blocks of one company and link count once; pages without blocks, and null pages, give no rows.
    """
    ranges = element_ranges(pages, tag, classes, key)
    own = pages.select(F.col(key).alias("key"), F.col("url").alias("page_url"), _clean(F.col("html")).alias("html")).join(ranges, "key")
    cut = F.transform("ranges", lambda r: F.substring("html", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))
    b = own.select("key", "page_url", F.posexplode(cut).alias("at", "b"))
    inside = lambda pattern, group=1: F.concat_ws(" ", F.regexp_extract_all("b", F.lit(pattern), F.lit(group)))
    box = _CLASSED.format(tag="div", names="company-name") + "(.*?)</div>"
    comp = F.filter(F.regexp_extract_all("b", F.lit(ANCHOR_RE), 0), lambda a: F.regexp_like(a, F.lit("^" + _CLASSED.format(tag="a", names="compName"))))
    spots = [inside(r"(?is)<h2\b[^>]*>(.*?)</h2>"), inside(r"(?is)<h3\b[^>]*>(.*?)</h3>"), F.concat_ws(" ", comp), F.col("b"), inside(box)]
    firsts = F.filter(F.array(*(F.get(_anchors(s), F.lit(0)) for s in spots)), lambda a: a.isNotNull() & (html_text(a["text"]) != ""))
    b = b.withColumn("a", F.get(firsts, F.lit(0))).withColumn("text", block_text(F.col("b")))
    place = F.regexp_extract("b", _CLASSED.format(tag=r"\w+", names="|".join(LOCATION_CLASSES)) + "(.*?)</", 1)
    short = F.substring(F.split_part(F.col("text"), F.lit(" - "), F.lit(1)), 1, 100)
    b = b.select("key", "page_url", "at", F.when(F.col("a").isNotNull(), html_text(F.col("a.text"))).otherwise(F.when(short != "", short)).alias("name"), F.col("a.href").alias("href"),
                 contact_of(F.col("text")).alias("contact"), F.nullif(html_text(place), F.lit("")).alias("location"))
    named = b.withColumn("same", F.concat(F.coalesce("name", F.lit("")), F.coalesce("href", F.lit("")))).where(F.col("same") != "")
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("key", "same").orderBy("at"))).where("n = 1")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("at")))
    out = out if max_per_page is None else out.where(F.col("rank") <= max_per_page)
    origin = F.lit(base) if base else page_origin(F.col("page_url"))
    link = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(origin, F.col("href")))
    return out.select(F.col("key").alias(key), "rank", F.coalesce("name", F.lit(default)).alias("company"), link.alias("url"), "contact", "location",
                      F.regexp_extract("page_url", r"^https?://([^/?#]+)", 1).alias("source"))


def contact_of(text: Column) -> Column:
    """First phone-like and first e-mail-like match, joined by '; ' (null when neither)."""
    phone = F.regexp_extract(text, PHONE_RE, 0)
    email = F.regexp_extract(text, EMAIL_RE, 0)
    p = F.when(phone != "", phone)
    e = F.when(email != "", email)
    return F.when(p.isNotNull() & e.isNotNull(), F.concat(p, F.lit("; "), e)).otherwise(F.coalesce(p, e))


def company_fallback(text: Column, default: str = DEFAULT_COMPANY) -> Column:
    """Block text before the first ' - ', at most 100 characters; empty -> default name."""
    name = F.substring(F.split_part(text, F.lit(" - "), F.lit(1)), 1, 100)
    return F.coalesce(F.when(name != "", name), F.lit(default))
