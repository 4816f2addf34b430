"""Text expressions: tokens, trigrams, hashes of titles, names, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a word character, an alphanumeric run and white space.
WORD = r"[\p{L}\p{N}_]+"
ALNUM = r"[\p{L}\p{N}]+"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

ERROR_CHARS = 500


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def ws_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda w: w != "")


def words(text: Column) -> Column:
    """White-space separated words with their case kept."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def dictionary_tokens(text: Column, entries: Column) -> Column:
    """White-space tokens, where a listed expression of several words stays one token.

    ``entries`` is an array of lower-cased expressions; blanks inside a listed expression are
    bound with ``_`` before splitting. Longer expressions bind first.
    """
    padded = F.concat(F.lit(" "), F.array_join(ws_tokens(text), "  "), F.lit(" "))
    ordered = F.reverse(F.array_sort(F.transform(
        F.filter(entries, lambda e: F.instr(e, " ") > 0),
        lambda e: F.struct(F.length(e).alias("n"), e.alias("e")))))
    bound = F.aggregate(
        ordered, padded,
        lambda acc, e: F.replace(
            acc, F.concat(F.lit(" "), F.replace(e["e"], F.lit(" "), F.lit("  ")), F.lit(" ")),
            F.concat(F.lit(" "), F.replace(e["e"], F.lit(" "), F.lit("_")), F.lit(" "))))
    return F.filter(F.split(bound, " +"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also when body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ngrams(text: Column, n: int) -> Column:
    """All substrings of length ``n``, empty when the text is shorter.

    Works on an array of characters: taking substrings of the text itself would walk it from the
    start for every position.
    """
    def shingles(chars: Column) -> Column:
        return F.transform(
            F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0))),
            lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))

    return let(F.split(text, ""), shingles)


def token_counts(tokens: Column) -> Column:
    """Distinct tokens of one row with their counts, without leaving the row.

    Sorts the tokens and measures the runs, so building term frequencies needs no shuffle.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda b: F.transform(
            b, lambda i, p: F.struct(
                F.element_at(s, i).alias("token"),
                (F.coalesce(F.get(b, p + 1), F.size(s) + 1) - i).cast("long").alias("tf"))))

    empty = F.array().cast("array<struct<token:string,tf:bigint>>")
    return let(F.array_sort(tokens), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def trigram_set(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks and one blank."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(ALNUM), F.lit(0))
    padded = F.transform(runs, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: ngrams(w, 3))))


def title_hash(title: Column) -> Column:
    return F.sha2(strip(title), 256)


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def truncate_error(message: Column) -> Column:
    return F.substring(message, 1, ERROR_CHARS)


def suffix(name: Column) -> Column:
    """File extension with its dot, lower-cased; empty for none, for dot-files and a bare dot."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"[^.].*?(\.[^.]+)$", 1))


# File naming of downloads.
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
NAME_BOUNDARY = r"[^0-9A-Za-z가-힣]"
NAME_CHARS = 30


def _clean_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, ILLEGAL_NAME_CHARS, "_"), r"^[ ._]+|[ ._]+$", "")


def download_filename(title: Column, doc_type: Column, doc_id: Column) -> Column:
    """Readable file name from the title, cut at a word boundary, with the type as extension."""
    doc_id = doc_id.cast("string")
    trimmed = strip(F.coalesce(title, F.lit("")))
    base = F.when(trimmed == "", doc_id).otherwise(trimmed)
    own_ext = F.regexp_extract(F.regexp_extract(base, r"([^/]*)$", 1), r"(?s)[^.].*?\.([^.]+)$", 1)
    stem = F.when(own_ext == "", base).otherwise(
        F.substring(base, F.lit(1), F.length(base) - F.length(own_ext) - 1))
    ext = F.when(own_ext != "", own_ext).otherwise(F.coalesce(doc_type, F.lit("")))
    clean = _clean_name(stem)
    window = F.substring(clean, 1, NAME_CHARS)
    at_boundary = F.regexp_extract(window, rf"(?s)^(.+){NAME_BOUNDARY}", 1)
    cut = F.when(F.length(clean) <= NAME_CHARS, clean).otherwise(
        F.when(at_boundary != "", at_boundary).otherwise(window))
    final = _clean_name(F.regexp_replace(cut, f"{NAME_BOUNDARY}+$", ""))
    final = F.when(final == "", doc_id).otherwise(final)
    return F.when(ext == "", final).otherwise(F.concat(final, F.lit("."), ext))


def download_url(kb_id: Column, doc_id: Column, source_type: Column, base_url: str | None = None) -> Column:
    path = F.concat(F.lit("/api/kb/"), kb_id, F.lit("/docs/"), doc_id.cast("string"), F.lit("/download"))
    full = F.concat(F.lit(base_url.rstrip("/")), path) if base_url else path
    return F.when(source_type == "s3", full)


def ilike_any(term: str, *columns: Column) -> Column:
    """True where any column contains the term; ``%`` and ``_`` in the term stay wildcards."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(column.cast("string").ilike(f"%{term}%"), F.lit(False))
    return hit
