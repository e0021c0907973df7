"""String, URL, identifier and keyword expressions."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The DNS namespace of RFC 4122 and the markers of a redirect link.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"
REDIRECT_START = "?url="
REDIRECT_END = "&mailer_id"
CATEGORY_PREFIX = "news%2F"

# Unicode white space plus the four ASCII separators that count as blank too.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# The same characters one by one, for trimming without a pattern.
_BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A reference as HTML 5 reads it, without its ampersand; the closing sign may lack.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that need no closing sign, longest first.
_SHORT_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Numbers of C1 controls stand for the characters of Windows-1252.
_C1 = {b: bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0xA0)}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze_ws(c: Column | str) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE, " "))


def strip_breaks(c: Column | str) -> Column:
    """Delete line feeds and tabs."""
    return F.translate(_col(c), "\n\t", "")


def strip_ordinal(c: Column | str) -> Column:
    """``Aug 1st`` becomes ``Aug 1``."""
    return F.regexp_replace(_col(c), r"(\d+)(st|nd|rd|th)", "$1")


def article_id(url: Column | str, cut: str | None = None) -> Column:
    """Last path segment of a URL, ended at the first ``cut`` when one is given."""
    last = F.substring_index(_col(url), "/", -1)
    return last if cut is None else F.substring_index(last, cut, 1)


def unwrap_redirect(href: Column | str) -> Column:
    """Target of a redirect link, still percent-encoded; empty without a target."""
    href = _col(href)
    start = F.instr(href, REDIRECT_START)
    target = F.substr(href, start + F.lit(len(REDIRECT_START)))
    return F.when(start > 0, F.substring_index(target, REDIRECT_END, 1)).when(
        href.isNotNull(), F.lit("")
    )


def unquote(c: Column | str) -> Column:
    """Percent-decode; ``+`` and a ``%`` without two hex digits stay as they are."""
    kept_plus = F.replace(_col(c), F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(kept_plus, "%(?![0-9A-Fa-f]{2})", "%25"))


def absolutize(href: Column | str, base: str, add_slash: bool = True) -> Column:
    """Prefix ``base``; with ``add_slash`` a path without a leading slash gets one."""
    href = _col(href)
    if add_slash:
        href = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
    return F.concat(F.lit(base), href)


def uuid5_dns(c: Column | str) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    digest = F.sha1(
        F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(_col(c), "UTF-8"))
    )
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def category_label(c: Column | str) -> Column:
    """Category without its seven-character path prefix."""
    return F.substring(_col(c), len(CATEGORY_PREFIX) + 1, 2**31 - 1)


def ensure_list(raw: Column | str) -> Column:
    """Keywords as a list, from the raw JSON text of the field.

    A JSON array gives its elements, any other value one element, null none. A
    comma-separated string stays one element.
    """
    raw = _col(raw)
    single = F.array(raw)
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(
            raw.startswith("["),
            F.coalesce(F.from_json(raw, "array<string>"), single),
        )
        .otherwise(single)
    )


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used in several places of another one is computed in each of
    them when some lie in a branch; a one-element list holds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quoted(text: str) -> str:
    """A text as SQL writes it."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _names() -> str:
    """The characters of each name, by its first two letters and then the whole: a map is
    searched from end to end. One literal, parsed while the query is planned."""
    groups: dict[str, dict[str, str]] = {}
    for key, chars in html5.items():
        groups.setdefault(key[:2], {})[key] = chars
    return f"from_json({_quoted(json.dumps(groups))}, 'map<string,map<string,string>>')"


def _numbered(name: str) -> str:
    """Character of ``#123``, ``#123;`` or ``#x7b;``."""
    hexadecimal = f"lower(substring({name}, 1, 2)) = '#x'"
    digits = f"ltrim('0', rtrim(';', substr({name}, if({hexadecimal}, 3, 2))))"
    c1 = ", ".join(f"{code}, {_quoted(char)}" for code, char in _C1.items())
    # More digits than any character has: no number is made of them.
    return f"""transform(transform(array({digits}), d -> CASE
          WHEN d = '' THEN 0
          WHEN length(d) > 7 THEN {0x110000}
          ELSE try_cast(if({hexadecimal}, conv(d, 16, 10), d) AS BIGINT) END), code -> CASE
        WHEN code = 0 OR code > {0x10FFFF} OR code BETWEEN {0xD800} AND {0xDFFF} THEN '\ufffd'
        WHEN code BETWEEN {0x80} AND {0x9F} THEN map({c1})[CAST(code AS INT)]
        WHEN code BETWEEN {0x1} AND {0x8} OR code BETWEEN {0xE} AND {0x1F} OR code IN ({0xB}, {0x7F})
          OR code BETWEEN {0xFDD0} AND {0xFDEF} OR code % {0x10000} >= {0xFFFE} THEN ''
        ELSE decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') END)[0]"""


@cache
def _decoder() -> str:
    """The decoding of one text, as a lambda in SQL.

    Column by column it would be some hundred calls into the JVM wherever a plan decodes
    a text; so it is one.
    """
    short = "^(" + "|".join(_SHORT_NAMES) + ")"
    start = f"regexp_extract(name, {_quoted(short)}, 1)"
    return f"""whole -> CASE WHEN contains(whole, '&') THEN
      transform(array({_names()}), names -> transform(array(split(whole, '&')), pieces ->
        concat(pieces[0], array_join(transform(slice(pieces, 2, size(pieces)), piece ->
          transform(array(regexp_extract(piece, {_quoted(_REFERENCE)}, 1)), name -> coalesce(
            CASE WHEN name <> '' THEN coalesce(
              concat(
                CASE WHEN startswith(name, '#') THEN {_numbered("name")}
                  ELSE try_element_at(try_element_at(names, substring(name, 1, 2)), name) END,
                substr(piece, length(name) + 1)),
              CASE WHEN {start} <> '' THEN concat(
                try_element_at(try_element_at(names, substring(name, 1, 2)), {start}),
                substr(piece, length({start}) + 1)) END) END,
            concat('&', piece)))[0]), '')))[0])[0]
      ELSE whole END"""


def unescape_html(c: Column | str) -> Column:
    """Decode named and numeric references in one pass; unknown ones stay."""
    held = F.call_function("transform", F.array(_col(c)), F.expr(_decoder()))
    return F.get(held, F.lit(0))


def join_text(parts: Column | str, sep: str, strip_each: bool = False) -> Column:
    """Join an array of texts, each one stripped first if asked for."""
    parts = _col(parts)
    if strip_each:
        parts = F.transform(parts, strip_ws)
    return F.array_join(parts, sep)


def strip_ws(c: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(_col(c), F.lit(_BLANKS))


def truncate_tokens(tokens: Column | str, n: int) -> Column:
    """The first ``n`` tokens."""
    return F.slice(_col(tokens), 1, n)


def or_default(c: Column | str, default: str) -> Column:
    """The value, or a fixed text where the field is absent."""
    return F.coalesce(_col(c), F.lit(default))


def json_kind(raw: Column | str) -> Column:
    """What a raw JSON field holds: ``absent``, ``list``, ``object`` or ``text``."""
    raw = F.ltrim(_col(raw))
    return (
        F.when(raw.isNull(), "absent")
        .when(raw.startswith("["), "list")
        .when(raw.startswith("{"), "object")
        .otherwise("text")
    )
