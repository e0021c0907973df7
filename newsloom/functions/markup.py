"""Reading HTML held in a column, with native expressions only.

Comments, scripts and style sheets are cut out first, as their text may look like
tags. An element is found by tag and class: one class name matches any of the
names in the attribute, several names in one string match the whole attribute.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import bind, squeeze_ws, strip_ws, unescape_html

# What is never closed runs to the end of the page; that also keeps a page with many
# openings and no end from being read once for each of them.
_NOISE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
_LD_TAG = r"<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>"
# Comments and whole scripts in the order of the page: neither is looked for inside
# the other.
_SCRIPTS = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)"
# Rest of a tag after its name; a quoted value may hold the sign that ends a tag.
_TAIL = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>"
# A sign that no name follows is text.
_TAG = r"<(?:/?[A-Za-z]|[!?])" + _TAIL


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_noise(html: Column | str) -> Column:
    """The page without comments, scripts and style sheets."""
    return F.regexp_replace(_col(html), _NOISE, "")


def open_tag(tag: str, cls: str | tuple[str, ...] | None = None, **attrs: str) -> str:
    """Pattern of a start tag with the given class and attribute values."""
    wanted = ""
    if isinstance(cls, tuple):
        wanted = "|".join(_class_value(c) for c in cls)
    elif cls is not None:
        wanted = _class_value(cls)
    pattern = rf"<{tag}\b"
    if wanted:
        pattern += rf"(?=[^>]*\sclass\s*=\s*(?:{wanted}))"
    for name, value in attrs.items():
        pattern += rf"(?=[^>]*\s{name}\s*=\s*[\"']?{re.escape(value)}[\"'\s>])"
    return pattern + _TAIL


def _class_value(cls: str) -> str:
    name = re.escape(cls)
    if " " in cls:
        return rf"\"{name}\"|'{name}'"
    in_quotes = r"{q}(?:[^{q}>]*\s)?{name}(?:\s[^{q}>]*)?{q}"
    return "|".join(
        [
            in_quotes.format(q='"', name=name),
            in_quotes.format(q="'", name=name),
            rf"{name}(?=[\s>])",
        ]
    )


def attribute(markup: Column, name: str) -> Column:
    """Decoded value of an attribute of the first tag in ``markup``, else null."""
    pattern = rf"(?is)\A\s*<[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"

    def value(raw: Column) -> Column:
        quoted = raw.startswith('"') | raw.startswith("'")
        bare = F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", unescape_html(bare))

    return bind(F.regexp_extract(markup, pattern, 1), value)


def text_of(markup: Column, strip_each: bool = False) -> Column:
    """Text between the tags, entities decoded; ``strip_each`` trims every piece."""
    if not strip_each:
        return unescape_html(F.regexp_replace(markup, _TAG, ""))
    pieces = F.transform(
        F.split(markup, _TAG), lambda piece: strip_ws(unescape_html(piece))
    )
    return F.array_join(pieces, "")


def flat_blocks(markup: Column, tag: str, cls=None, **attrs: str) -> Column:
    """All elements that do not hold another one of the same tag, start tag first."""
    pattern = rf"(?is){open_tag(tag, cls, **attrs)}.*?(?=</{tag}\s*>|\z)"
    return F.regexp_extract_all(markup, F.lit(pattern), F.lit(0))


def _close(marks: Column) -> Column:
    """How many pieces between ``marks`` lie inside the element; 0 if all do."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("kept"))

    def step(state: Column, mark: Column) -> Column:
        moved = F.struct(
            (state["depth"] + F.when(mark.startswith("</"), -1).otherwise(1)).alias(
                "depth"
            ),
            (state["kept"] + 1).alias("kept"),
        )
        return F.when(state["depth"] > 0, moved).otherwise(state)

    return F.aggregate(
        marks,
        start,
        step,
        lambda state: F.when(state["depth"] > 0, 0).otherwise(state["kept"]),
    )


def _balanced(rest: Column, tag: str, whole: bool = True) -> Column:
    """``rest`` up to the end tag that closes the element it starts in.

    An element that is never closed runs to the end of the page, or is null without
    ``whole``.
    """
    pattern = rf"(?i)</?{tag}\b" + _TAIL

    def cut(marks: Column) -> Column:
        pieces = F.split(rest, pattern)

        def join(kept: Column) -> Column:
            text = F.array_join(
                F.zip_with(
                    F.slice(pieces, 1, F.when(kept > 0, kept).otherwise(F.size(pieces))),
                    F.slice(marks, 1, F.when(kept > 0, kept - 1).otherwise(F.size(marks))),
                    lambda piece, mark: F.concat(piece, F.coalesce(mark, F.lit(""))),
                ),
                "",
            )
            return text if whole else F.when(kept > 0, text)

        return bind(_close(marks), join)

    return bind(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), cut)


def nested_blocks(markup: Column, tag: str, cls=None, **attrs: str) -> Column:
    """All elements of a tag, each whole with what it holds, start tag first.

    An element inside another one of the same class is in the outer one and an element
    of its own.
    """
    opening = rf"(?is){open_tag(tag, cls, **attrs)}"

    def blocks(page: Column) -> Column:
        def cut_all(starts: Column, rests: Column) -> Column:
            def cut(start: Column, i: Column) -> Column:
                # Most elements end before the next one of their class begins.
                near = _balanced(F.get(rests, i + 1), tag, whole=False)
                following = F.zip_with(
                    F.slice(rests, i + 2, F.size(rests)),
                    F.slice(starts, i + 2, F.size(rests)),
                    lambda rest, later: F.concat(rest, F.coalesce(later, F.lit(""))),
                )
                far = bind(F.array_join(following, ""), lambda rest: _balanced(rest, tag))
                return F.concat(start, F.coalesce(near, far))

            return F.transform(starts, cut)

        starts = F.regexp_extract_all(page, F.lit(opening), F.lit(0))
        return bind(starts, lambda s: bind(F.split(page, opening), lambda r: cut_all(s, r)))

    return bind(markup, blocks)


def whole_blocks(markup: Column, tag: str, cls=None, **attrs: str) -> Column:
    """``nested_blocks``, by one pattern where no element of the tag holds another."""
    def choose(page: Column) -> Column:
        def pick(flat: Column) -> Column:
            # A plain search: it may also meet a longer name, and then the longer way is
            # taken for nothing.
            nested = F.exists(flat, lambda b: F.locate(f"<{tag}", F.lower(b), 2) > 0)
            return F.when(nested, nested_blocks(page, tag, cls, **attrs)).otherwise(flat)

        return bind(flat_blocks(page, tag, cls, **attrs), pick)

    return bind(markup, choose)


def first_block(
    markup: Column, tag: str, cls=None, nested: bool = False, **attrs: str
) -> Column:
    """First matching element, start tag first; null if there is none."""
    opening = rf"(?is){open_tag(tag, cls, **attrs)}"
    if not nested:
        whole = rf"{opening}.*?(?=</{tag}\s*>|\z)"
        found = F.regexp_extract(markup, whole, 0)
        return bind(found, lambda block: F.when(block != "", block))

    def element(page: Column) -> Column:
        def cut(parts: Column) -> Column:
            before, rest = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
            length = F.length(page) - F.length(before) - F.length(rest)
            start = F.substr(page, F.length(before) + 1, length)
            return F.when(rest.isNotNull(), F.concat(start, _balanced(rest, tag)))

        # Limit 2 keeps later elements of the same class inside the first one.
        return bind(F.split(page, opening, 2), cut)

    return bind(markup, element)


def paragraphs(markup: Column) -> Column:
    """Inner markup of each ``<p>`` in order; a new ``<p>`` closes an open one."""
    pieces = F.split(markup, r"(?i)<p(?=[\s>])" + _TAIL)
    return F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p: F.get(F.split(p, r"(?i)</p\s*>", 2), F.lit(0)),
    )


def paragraph_text(
    markup: Column,
    sep: str = "\n",
    strip_each: bool = False,
    squeeze: bool = True,
    drop_last: int = 0,
) -> Column:
    """Text of the paragraphs joined by ``sep``; null for null markup."""
    paras = paragraphs(markup)
    if drop_last:
        kept = F.greatest(F.size(paras) - drop_last, F.lit(0))
        paras = F.slice(paras, 1, kept)
    texts = F.transform(paras, lambda p: text_of(p, strip_each))
    body = F.array_join(texts, sep)
    return squeeze_ws(body) if squeeze else body


def jsonld_block(html: Column | str, n: int = 1, drop_breaks: bool = False) -> Column:
    """Text of the JSON-LD block at index ``n``; null if the page has fewer."""
    found = F.regexp_extract_all(_col(html), F.lit(_SCRIPTS), F.lit(0))
    closed = F.filter(found, lambda m: m.rlike(r"(?is)\A" + _LD_TAG + r".*</script\s*>\z"))
    block = F.regexp_extract(F.get(closed, F.lit(n)), r"(?is)\A" + _LD_TAG + r"(.*)</script\s*>\z", 1)
    return F.translate(block, "\n\t", "") if drop_breaks else block
