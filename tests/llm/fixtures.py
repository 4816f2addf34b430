"""Rows and helpers of these tests."""

from __future__ import annotations

import random
import re

FOLDER = "/root/testdata/sf0.001"
BLANK_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Columns that clash with names the operators use inside.
EXTRA = ("size", "row_id", "text_hash", "bucket", "node", "fp", "segment", "token", "word", "n", "first", "key",
         "label", "toxic", "root", "block", "host", "lines", "hashes", "score", "window", "known")


def low(text: str | None) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


PROSE = ("the quiet river ran past old mills and over stones that nobody had moved since spring while children "
         "counted boats from a wooden bridge and argued about names for every single one of them until dinner "
         "called each voice home along narrow lanes lit by lamps of yellow glass and a tired dog followed last").split()


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", "s", "ing"]) for _ in range(n))


#: (doc_id, text, lang, source): nulls in every column, empty and blank texts, a long text, repeated rows, copies.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "b"), (4, "word", "en", None), (5, "12 34 !!", "en", "b"),
    (None, prose(1), None, None), (6, prose(2), "en", "a"), (6, prose(2), "en", "a"), (7, prose(2), "en", "b"),
    (8, prose(3, 30_000), "en", "a"), (9, "é" * 3000, "fr", "c"), (10, "same " * 500, "en", "c"), (11, prose(4), "en", "a"),
    (12, prose(4) + " extra", "en", "a"), (13, "\x00\x01 nul \x7f", "en", "c"), (14, "日本語 の 文", "ja", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
