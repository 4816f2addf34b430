"""Expressions on raw HTML."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Blocks dropped with their content, by extraction policy.
DROPPED = {
    "lenient": ("script", "style", "noscript", "template", "head"),
    "balanced": ("script", "style", "noscript", "template", "head", "nav", "footer"),
    "strict": ("script", "style", "noscript", "template", "head", "nav", "footer", "header", "aside", "form", "ul"),
}
#: The entities of the stored test pages, for the SQL of the check.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&"))

#: (pattern, replacement) pairs applied in order; the same list makes the SQL of the check.
def steps(policy: str) -> list[tuple[str, str]]:
    out = [(r"(?is)<!--.*?-->", " ")]
    out += [(rf"(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>", "\n") for tag in DROPPED[policy]]
    out += [(r"(?is)</?(strong|b|em|i)(\s[^>]*)?>", ""),
            (r"(?is)<h[1-6](\s[^>]*)?>", "\n# "),
            (r"(?is)<li(\s[^>]*)?>", "\n- "),
            (r"(?is)<(br|hr)\s*/?>", "\n"),
            (r"(?is)</?(p|div|h[1-6]|ul|ol|li|table|tr|article|section|blockquote|pre)(\s[^>]*)?>", "\n"),
            (r"(?s)<[^>]*>", "")]
    return out


TIDY = ((r"[ \t\r\f\x0b]+", " "), (r" ?\n ?", "\n"), (r"\n\n+", "\n"), (r"^[\n ]+|[\n ]+$", ""))


#: Every named entity; a non-breaking space becomes a plain one.
_NAMED = {name: char.replace("\xa0", " ") for name, char in html5.items() if name.endswith(";")}
#: Numbers that pages use for Windows characters.
_WINDOWS = {str(n): bytes([n]).decode("cp1252", "replace") for n in range(128, 160)} | {"160": " "}
_REFERENCE = r"(?s)&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def _character(code: Column) -> Column:
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    own = F.try_element_at(F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>"), code.cast("string"))
    return F.coalesce(own, F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit("\ufffd"))


def _piece(piece: Column) -> Column:
    """A character reference decoded, any other piece as it is."""
    named = F.try_element_at(F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>"), F.substr(piece, F.lit(2)))
    number = F.when(piece.rlike("^&#[xX].+;$"), F.conv(F.regexp_extract(piece, "^&#[xX](.*);$", 1), 16, 10)).when(
        piece.rlike("^&#[0-9]+;$"), F.regexp_extract(piece, "^&#(.*);$", 1)).cast("bigint")
    return F.when(~piece.startswith("&") | ~piece.endswith(";"), piece).when(
        number.isNotNull(), _character(number)).otherwise(F.coalesce(named, piece))


def unescape(text: Column) -> Column:
    """Named and numeric character references decoded, once and in one pass; texts without an ampersand are not cut."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(
        F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), _piece), "")).otherwise(t))


def html_to_text(html: Column, policy: str = "lenient") -> Column:
    """Main text of a page with headings and list items marked; tags for emphasis only vanish."""
    text = html
    for pattern, replacement in steps(policy):
        text = F.regexp_replace(text, pattern, replacement)
    text = unescape(text)
    for pattern, replacement in TIDY:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def page_title(html: Column, fallback: Column) -> Column:
    """``og:title``, else ``<title>``, else the fallback."""
    meta = F.regexp_extract(html, r"""(?is)<meta[^>]*property=["']og:title["'][^>]*>""", 0)
    og = unescape(F.regexp_extract(meta, r"""(?is)\bcontent=["']([^"']*)["']""", 1))
    tag = unescape(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1))
    return let(og, lambda o: F.when(o != "", F.trim(o)).otherwise(let(tag, lambda t: F.when(t != "", F.trim(t)).otherwise(fallback))))


def links(html: Column) -> Column:
    """Values of href of all anchors, trimmed, without empty ones and fragments."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.trim(unescape(h))), lambda h: (h != "") & ~h.startswith("#"))


def content_version(etag: Column, text: Column, html: Column) -> Column:
    """The server's tag, else a hash of the extracted text, else of the page.

    The text is the result of many expressions; it is bound, so that they run once and only where there is no tag.
    """
    own = F.nullif(F.regexp_replace(F.coalesce(etag, F.lit("")), '^"+|"+$', ""), F.lit(""))
    return F.coalesce(own, let(text, lambda t: F.md5(F.when(t != "", t).otherwise(html))))
