"""Text expressions: whitespace, HTML, hashes, amounts, blurbs, page text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsgraph import constants as K
from newsgraph.functions import maps


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def opening(text: Column, size: int | None) -> Column:
    """The first ``size`` characters, which many rules are confined to; the whole text for None."""
    return text if size is None else F.substring(text, 1, size)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search."""
    return text.rlike("(?i)" + pattern)


def any_match(text: Column, patterns: list[str]) -> Column:
    return matches(text, "(?:" + "|".join(patterns) + ")")


def count_matching(text: Column, patterns: list[str]) -> Column:
    """Number of patterns that occur at least once."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + matches(text, pattern).cast("int")
    return total


def strip_html(html: Column) -> Column:
    """Text of the page: text nodes trimmed and joined by one space; scripts, styles and comments dropped."""
    gone = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "\u0001")
    gone = F.regexp_replace(gone, r"(?is)<(script|style|template)\b.*?</\1\s*>", "\u0001")
    gone = F.regexp_replace(gone, r"(?s)</?[A-Za-z!][^>]*>", "\u0001")
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&nbsp;", " "), ("&amp;", "&"),
    ):
        gone = F.replace(gone, F.lit(entity), F.lit(char))
    gone = F.regexp_replace(gone, "[\\s ]*\u0001[\\s \u0001]*", "\u0001")
    gone = F.regexp_replace(gone, "^[\\s \u0001]+|[\\s \u0001]+$", "")
    return F.replace(gone, F.lit("\u0001"), F.lit(" "))


def canonical_hash(title: Column, url: Column) -> Column:
    strip = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.sha2(F.concat(strip(title), F.lit("\n"), strip(url)), 256)


def funding_amount(text: Column) -> Column:
    """Largest dollar amount, truncated to whole dollars; null when there is none."""
    numbers = F.regexp_extract_all(text, F.lit(K.AMOUNT_PATTERN), 1)
    units = F.regexp_extract_all(text, F.lit(K.AMOUNT_PATTERN), 2)
    dollars = F.zip_with(
        numbers,
        units,
        lambda n, u: (
            F.replace(n, F.lit(","), F.lit("")).cast("double")
            * F.when(F.lower(u) == "b", 1e9).when(F.lower(u) == "m", 1e6).when(F.lower(u) == "k", 1e3).otherwise(1.0)
        ).cast("long"),
    )
    return F.array_max(dollars)


def last_index(text: Column, piece: str) -> Column:
    """Zero-based start of the last occurrence, -1 if absent."""
    at = F.instr(F.reverse(text), piece[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(piece) + 1)


def clip_blurb(text: Column, limit: int = 240) -> Column:
    """Shorten at a sentence break in the second half, else at a word break, else hard."""
    return maps.let(collapse_ws(text), lambda whole: _clipped(whole, limit))


def _clipped(whole: Column, limit: int) -> Column:
    """``clip_blurb`` of a collapsed text."""
    def cut(head: Column) -> Column:
        sentence = F.greatest(*[last_index(head, p) for p in (". ", "! ", "? ", "; ", ": ")])
        at = maps.let(F.struct(sentence.alias("s"), last_index(head, " ").alias("w")), lambda x: (
            F.when(x["s"] >= limit // 2, x["s"] + 1)
            .when(x["w"] >= limit // 2, x["w"])
            .otherwise(F.lit(limit))
        ))
        short = F.regexp_replace(head.substr(F.lit(1), at), r"[ ,;:\-]+$", "")
        return F.concat(short, F.lit("..."))

    return F.when(F.length(whole) <= limit, whole).otherwise(maps.let(F.substring(whole, 1, limit), cut))


def _odd_share(sample: Column) -> Column:
    odd = F.length(sample) - F.length(F.regexp_replace(sample, r"[_|\\/<>`{}\[\]]", ""))
    return odd / F.greatest(F.length(sample), F.lit(1))


def article_blurb(title: Column, summary: Column, snippet: Column, text: Column, limit: int = 240) -> Column:
    """First presentable of summary and snippet, else readable body text, else the title.

    A text is collapsed once, and only if the ones before it do not serve.
    """

    def if_presentable(c: Column) -> Column:
        good = lambda sample: (sample != "") & (_odd_share(sample) <= 0.03)
        return maps.let(collapse_ws(c), lambda whole: F.when(maps.let(F.substring(whole, 1, 240), good), _clipped(whole, limit)))

    def readable(sample: Column) -> Column:
        size = F.length(sample)
        letters = size - F.length(F.regexp_replace(sample, r"\p{L}", ""))
        spaces = size - F.length(F.replace(sample, F.lit(" "), F.lit("")))
        return (
            (size >= 40)
            & (letters / F.greatest(size, F.lit(1)) >= 0.55)
            & (_odd_share(sample) <= 0.03)
            & (spaces >= 5)
        )

    def after_title(both: Column) -> Column:
        body, head = both["body"], both["head"]
        rest = F.regexp_replace(body.substr(F.length(head) + 1, F.length(body)), r"^[ :\-|.,]+", "")
        starts = (head != "") & (body != "") & F.startswith(F.lower(body), F.lower(head))
        return F.when(starts, maps.let(rest, lambda r: F.when(r != "", r).otherwise(body))).otherwise(body)

    body = maps.let(F.struct(collapse_ws(text).alias("body"), collapse_ws(title).alias("head")), after_title)
    from_body = maps.let(body, lambda b: F.when(maps.let(F.substring(b, 1, 240), readable), _clipped(b, limit)))
    return F.coalesce(if_presentable(summary), if_presentable(snippet), from_body, clip_blurb(F.coalesce(title, F.lit("")), limit))


def extraction_quality(text: Column, html: Column) -> Column:
    """.70 for length up to 5,000 characters, .30 for a low share of links."""
    links = F.regexp_count(F.coalesce(html, F.lit("")), F.lit(r"<a[\s>]"))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    length_part = F.least(F.length(F.coalesce(text, F.lit(""))) / 5000.0, F.lit(1.0))
    link_part = F.lit(1.0) - F.least(links / F.greatest(words, F.lit(1)) / 0.20, F.lit(1.0))
    return F.lit(0.70) * length_part + F.lit(0.30) * link_part


def page_text(html: Column) -> Column:
    """Paragraph text of the article block, else of all paragraphs, else of the whole page."""
    block = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    scope = F.when(block != "", block).otherwise(html)
    # Cut at the tags of paragraphs: what follows an opening one, up to the next tag of either kind, is a paragraph.
    parts = F.split(F.regexp_replace(scope, r"(?i)<(/?)(p|h1|h2|h3|li)\b[^>]*>", "\u0001$1\u0002"), "\u0001")
    opened = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.startswith(x, F.lit("\u0002")))
    paragraphs = F.transform(opened, lambda x: F.substr(x, F.lit(2)))
    joined = collapse_ws(strip_html(F.array_join(paragraphs, "\n<br>\n")))
    return F.when(joined != "", joined).otherwise(collapse_ws(strip_html(html)))


def publication_time(html: Column) -> Column:
    """Publication day (midnight) from meta or time tags."""
    meta = F.regexp_extract(
        html,
        r"(?is)<meta[^>]+(?:article:published_time|datePublished|pubdate|date)[\"'][^>]*content=[\"']([^\"']+)[\"']",
        1,
    )
    tag = F.regexp_extract(html, r"(?is)<time[^>]+datetime=[\"']([^\"']+)[\"']", 1)
    raw = F.when(meta != "", meta).when(tag != "", tag)
    return F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd"))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere."""
    return F.array_join(
        F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1), lambda w: F.initcap(w)), ""
    )
