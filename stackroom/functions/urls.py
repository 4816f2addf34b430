"""URL expressions: parts, canonical forms, pagination, scope, links."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

# Query parameters that only track the visitor.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else [unicodedata.normalize("NFC", x) for x in v])


def nfc_each(texts: Column) -> Column:
    """:func:`nfc` of every entry of an array."""
    def foreign(a: Column) -> Column:
        return F.when(F.exists(a, lambda t: t.rlike(r"[^\x00-\x7F]")), a)

    return F.coalesce(_nfc_each(let(texts, foreign)), texts)


def nfc(text: Column) -> Column:
    """Unicode composition; ASCII values are sent to Python as nulls and kept as they are."""
    return F.coalesce(_nfc(let(text, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), t))), text)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without the parameters after a semicolon of the last segment."""
    full = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(full, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def percent_decode(text: Column, plus: bool) -> Column:
    """Decode %XX; stray percent signs stay, a plus sign is a blank only where asked."""
    safe = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(safe if plus else F.replace(safe, F.lit("+"), F.lit("%2B")))


def percent_encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded_query(raw: Column) -> Column:
    """Decoded parameters without tracking as one array: name, value, name, value, ..."""
    parts = F.filter(F.split(raw, "&"), lambda p: p != "")
    decoded = F.transform(parts, lambda p: F.struct(
        percent_decode(F.regexp_extract(p, r"^([^=]*)", 1), True).alias("k"),
        percent_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1), True).alias("v")).cast("struct<k:string,v:string>"))
    kept = F.filter(decoded, lambda p: ~p["k"].isin(*TRACKING))
    return F.flatten(F.transform(kept, lambda p: F.array(p["k"], p["v"])))


def _encoded_query(flat: Column) -> Column:
    """Parameters sorted by name; values of one name keep their order."""
    names = F.filter(F.sequence(F.lit(0), F.size(flat)), lambda i: (i % 2 == 0) & (i < F.size(flat)))
    pairs = F.array_sort(F.transform(names, lambda i: F.struct(
        F.get(flat, i).alias("k"), i.alias("i"), F.get(flat, i + 1).alias("v")).cast("struct<k:string,i:int,v:string>")))
    return F.array_join(F.transform(
        pairs, lambda p: F.concat(percent_encode(p["k"]), F.lit("="), percent_encode(p["v"]))), "&")


def normalize_web_uri(url: Column) -> Column:
    """Canonical form of a page address. The two calls to Python stay outside the bound expressions."""
    clean = F.regexp_replace(url, r"[\t\r\n]", "")
    decoded = nfc(let(clean, lambda c: F.regexp_replace(percent_decode(path(c), False), "/+$", "")))
    params = nfc_each(let(clean, lambda c: _decoded_query(query(c))))
    return F.concat(
        F.lit("https://"), F.lower(netloc(clean)), let(decoded, lambda d: F.when(d == "", "/").otherwise(d)),
        let(let(params, _encoded_query), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))


def normalize_repo_uri(url: Column) -> Column:
    """Owner and repository lower-cased, file path kept, query and fragment dropped."""
    parts = F.split(F.regexp_replace(path(url), "^/+", ""), "/", 3)
    rest = F.when(F.size(parts) > 2, F.concat(F.lit("/"), F.get(parts, F.lit(2)))).otherwise("")
    return F.when(F.size(parts) >= 2, F.concat(
        F.lit("https://"), F.lower(netloc(url)), F.lit("/"), F.lower(F.get(parts, F.lit(0))), F.lit("/"),
        F.lower(F.get(parts, F.lit(1))), rest)).otherwise(url)


def normalize_source_uri(kind: Column, url: Column) -> Column:
    return F.when(kind.isin("web", "confluence"), normalize_web_uri(url)).when(
        kind == "github", normalize_repo_uri(url)).otherwise(url)


def is_pagination(url: Column) -> Column:
    return path(url).rlike(r"(?i)/page/\d+(/|$)") | query(url).rlike(r"(^|&)(page|p)=\d+")


def last_segment(url: Column) -> Column:
    segment = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    return F.when(segment != "", segment).when(netloc(url) != "", netloc(url)).otherwise(url)


def glob_regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[..]``) as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append("\\" + ch if not (ch.isalnum() or ch in "_/") else ch)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def in_scope(url: Column, seeds: list[str], include: list[str] = (), exclude: list[str] = (),
             unrestricted: bool = False) -> Column:
    """Crawl scope of canonical URLs: exclude wins, then the seeds' hosts or paths, then include.

    ``seeds`` are canonical. Rules belong to a connector's configuration, not to the data.
    """
    def any_glob(patterns) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | url.rlike(glob_regex(p))
        return hit

    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    inside = F.lit(False)
    for seed in seeds:
        if unrestricted:
            inside = inside | (netloc(url) == netloc(F.lit(seed)))
        else:
            prefix = F.regexp_replace(F.regexp_extract(F.lit(seed), r"^([^?#]*)", 1), "/+$", "")
            inside = inside | (base == prefix) | base.startswith(F.concat(prefix, F.lit("/")))
    wanted = any_glob(include) if include else F.lit(True)
    return ~any_glob(exclude) & inside & wanted


def _walk(segments: Column) -> Column:
    """Path segments with ``.`` and ``..`` resolved."""
    return F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    here = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)

    def root() -> Column:
        return F.concat(scheme(base), F.lit("://"), netloc(base))

    def rendered(joined: Column) -> Column:
        return let(F.split(F.regexp_extract(joined, r"^([^?#]*)", 1), "/"), lambda segs: let(_walk(segs), lambda w: F.concat(
            root(), F.lit("/"), F.array_join(w, "/"),
            F.when(F.element_at(segs, -1).isin(".", "..") & (F.size(w) > 0), "/").otherwise(""),
            F.regexp_extract(joined, r"^[^?#]*(.*)$", 1))))

    def relative(h: Column) -> Column:
        folder = let(here, lambda p: F.regexp_replace(F.when(p == "", "/").otherwise(p), r"[^/]*$", ""))
        return let(F.when(h.startswith("/"), h).otherwise(F.concat(folder, h)), rendered)

    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(
        href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(
        href.startswith("?"), F.concat(root(), here, href)).otherwise(let(href, relative))
