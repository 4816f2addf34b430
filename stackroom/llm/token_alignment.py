"""Alignment of two tokenizers over the same texts.

A text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B); both are made to cover the bytes of a blank and
the text. Every token points to the farthest-right token that overlaps it (the token of the other kind that holds its last byte,
itself if none ends later; of two that end together, A's). Doubling the pointers (``to = to[to]``) until nothing
changes leaves each token at the last token of its connected component, which is the label of its group. A token of A and
one of B that end together are a link; over the corpus each pair of ids gets the number of its links.

Neither vocabulary joins a blank to the character before it, so a text may be cut before any single blank that stands between
other characters, and the stretches encode alike wherever they stand. A task encodes and aligns each different
stretch once and keeps it (up to ``KEPT_CHARS``); a text is the sequence of its stretches, whose groups and links add up. Long
texts are taken in parts of about ``PART_CHARS``. Without that property of the vocabularies (it is tested) texts stay whole.

Pair counts: pairs with more than 1 / ``HOT`` of all links, which are fewer than ``HOT``, are sent to all tasks; the links of
all other pairs move to their counts. The vocabulary files are read on the driver and sent to the tasks.

Defined results: a null or empty text, and one whose tokens don't give back its bytes in both vocabularies, has no tokens: zeros
and an empty ``groups``. Repeated rows count each time and get equal results; null ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Largest vocabulary file that is sent to the tasks.
FILE_BYTES = 64 << 20
HOT = 1 << 20
PART_CHARS = 1 << 20
KEPT_CHARS = 8 << 20
KEPT_STRETCHES = 1 << 19
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Coders:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, a_json: bytes, b_model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        spec = json.loads(a_json)
        split = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not split.get("add_prefix_space") and not any(re.search("[^▁]▁", p) for p in pieces))

    def stretches(self, text: str) -> list[str]:
        """The text in pieces, each encoded with a blank before it."""
        return _CUT.split(text) if self.cuts else [text]

    def parts(self, text: str, size: int) -> Iterator[str]:
        low = 0
        while self.cuts and len(text) - low > size and (cut := _CUT.search(text, low + size)):
            yield text[low:cut.start()]
            low = cut.end()
        yield text[low:]

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B for each stretch, and whether both give back its bytes."""
        a = [e.ids for e in self.a.encode_batch([" " + s for s in stretches], add_special_tokens=False)]
        b = self.b.encode(stretches, num_threads=1)
        right = np.zeros(len(stretches), bool)
        for i, s in enumerate(stretches):
            whole = (" " + s).encode()
            right[i] = (b"".join(map(self.a_bytes.__getitem__, a[i])) == whole
                        and b"".join(map(self.b_bytes.__getitem__, b[i])) == whole)
            if not right[i]:
                a[i], b[i] = [], []
        return a, b, right


@lru_cache(maxsize=2)
def coders(a_json: bytes, b_model: bytes) -> Coders:
    return Coders(a_json, b_model)


def group_labels(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the last token of its component, by pointer jumping.

    Tokens are given by their ends, rising, over the same bytes. Numbers of B's tokens follow those of A's.
    """
    n = len(a_end)
    in_b, in_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    own = np.arange(n + len(b_end))
    to = np.concatenate([np.where(b_end[in_b] > a_end, n + in_b, own[:n]), np.where(a_end[in_a] >= b_end, in_a, own[n:])])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:n], to[n:]
        to = further


class Kept:
    """Aligned stretches of a task: sizes, written groups, links."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.chars = 0
        # Tokens of A and of B, groups, links, and whether the stretch has its bytes; links behind one another.
        self.sizes = np.zeros((1024, 5), np.int64)
        self.links = np.zeros(4096, np.int64)
        self.first = np.zeros(1025, np.int64)

    def full(self) -> bool:
        return self.chars > KEPT_CHARS or len(self.written) > KEPT_STRETCHES

    def add(self, new: list[str], by: Coders) -> None:
        a, b, right = by.encode(new)
        a_n, b_n = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        a_ids = np.fromiter((i for x in a for i in x), np.int64, a_n.sum())
        b_ids = np.fromiter((i for x in b for i in x), np.int64, b_n.sum())
        a_end, b_end = np.cumsum(by.a_size[a_ids]), np.cumsum(by.b_size[b_ids])
        a_label, b_label = group_labels(a_end, b_end)
        # Written in order of group, A before B; a stretch is written without its last separator.
        ids, label = np.concatenate([a_ids, b_ids]), np.concatenate([a_label, b_label])
        kind = np.repeat([0, 1], [len(a_ids), len(b_ids)])
        order = np.lexsort((kind, label))
        label, kind = label[order], kind[order]
        ends = np.ones(len(order), bool)
        ends[:-1] = (label[1:] != label[:-1]) | (kind[1:] != kind[:-1])
        signs: list[str] = [""] * (2 * len(order))
        signs[0::2] = map(by.names.__getitem__, ids[order].tolist())
        signs[1::2] = np.where(ends, np.where(kind == 0, "|", ";"), ",").tolist()
        edge = [0, *np.cumsum(a_n + b_n).tolist()]
        text_of = ["".join(signs[2 * s:max(2 * e - 1, 0)]) for s, e in zip(edge, edge[1:])]
        # Links: a token of A and one of B with the same end.
        at = np.searchsorted(b_end, a_end)
        linked = np.flatnonzero(b_end[at] == a_end) if len(a_end) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(new)), a_n)[linked]
        n_links = np.bincount(of, minlength=len(new))
        n_groups = np.bincount(np.repeat(np.arange(len(new)), a_n)[np.unique(a_label)], minlength=len(new))
        low, links = len(self.written), int(self.first[len(self.written)])
        while len(self.sizes) < low + len(new):
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.first = np.concatenate([self.first, np.zeros(len(self.sizes) + 1 - len(self.first), np.int64)])
        while len(self.links) < links + len(linked):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.sizes[low:low + len(new)] = np.column_stack([a_n, b_n, n_groups, n_links, right])
        self.first[low + 1:low + 1 + len(new)] = links + np.cumsum(n_links)
        self.links[links:links + len(linked)] = b_ids[at[linked]] << 32 | a_ids[linked]
        self.written += text_of
        self.number.update(zip(new, range(low, low + len(new))))
        self.chars += sum(map(len, new))

    def pairs(self, row: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, links of it), rows rising, from the stretches of each row."""
        n = len(self.written)
        key, times = np.unique(row * n + stretch, return_counts=True)
        row, stretch = key // n, key % n
        many = self.first[stretch + 1] - self.first[stretch]
        at = np.repeat(self.first[stretch] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return _merged(np.repeat(row, many), self.links[at], np.repeat(times, many))


def _merged(row: np.ndarray, pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((pair, row))
    row, pair, n = row[order], pair[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return row[at], pair[at], np.add.reduceat(n, at) if len(at) else n


def _aligned(texts: list[str], kept: Kept, by: Coders) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
    """Sizes, written groups and pairs of each text; texts that don't keep their bytes are marked in the sizes."""
    stretches = [by.stretches(t) for t in texts]
    flat = [s for x in stretches for s in x]
    new = [s for s in dict.fromkeys(flat) if s not in kept.number]
    if new:
        kept.add(new, by)
    at = np.fromiter(map(kept.number.__getitem__, flat), np.int64, len(flat))
    n = np.array([len(x) for x in stretches])
    sizes = np.add.reduceat(kept.sizes[at], np.cumsum(n) - n, axis=0)
    sizes[:, 4] = sizes[:, 4] == n
    numbers, edge = at.tolist(), [0, *np.cumsum(n).tolist()]
    written = [";".join(map(kept.written.__getitem__, numbers[s:e])) for s, e in zip(edge, edge[1:])]
    right = np.repeat(sizes[:, 4] == 1, n)
    return sizes, written, kept.pairs(np.repeat(np.arange(len(texts)), n)[right], at[right])


def _long(text: str, kept: Kept, by: Coders) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...]]:
    """The same for one long text, part by part."""
    sizes, written, pairs, right = np.zeros(5, np.int64), [], [np.zeros(0, np.int64)] * 3, True
    for part in by.parts(text, PART_CHARS):
        s, w, p = _aligned([part], kept, by)
        sizes, right = sizes + s[0], right and s[0, 4] == 1
        written += w
        pairs = list(_merged(*(np.concatenate([x, y]) for x, y in zip(pairs, p))))
        if not right:
            break
        if kept.full():
            kept.__init__()
    sizes[4] = right
    return sizes[None], [";".join(written)], tuple(pairs)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART_CHARS; a longer one is alone."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > PART_CHARS:
            yield low, i
            low, size = i, 0
        size += len(t)
    if texts:
        yield low, len(texts)


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links): groups are written `a1,a2|b1;a3|b2,b3`, links are the different
    pairs of ids (B's id << 32 | A's id) with the number of times they are linked in the text."""
    sources = []
    for name in (a_file, b_file):
        with open(name, "rb") as f:
            sources.append(f.read(FILE_BYTES + 1))
        if len(sources[-1]) > FILE_BYTES:
            raise ValueError(f"{name} is larger than {FILE_BYTES} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sources))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, kept = coders(*sent.value), Kept()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in _groups(texts):
                if kept.full():
                    kept = Kept()
                part = texts[low:high]
                one = high - low == 1 and len(part[0]) > PART_CHARS
                sizes, written, (row, pair, n) = _long(part[0], kept, by) if one else _aligned(part, kept, by)
                some = (sizes[:, 4] == 1) & np.array([bool(t) for t in part])
                sizes = sizes * some[:, None]
                keep = some[row] if len(row) else np.zeros(0, bool)
                row, pair, n = row[keep], pair[keep], n[keep]
                edges = pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32))
                link = pa.StructArray.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], ["pair", "times"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), *(pa.array(sizes[:, k]) for k in range(4)),
                     pa.array([w if s else "" for w, s in zip(written, some)], pa.string()),
                     pa.ListArray.from_arrays(edges, link)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "links array<struct<pair: long, times: long>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of a pair in all rows, and whether no pair with the same id of B has more."""
    counted = aligned.selectExpr("inline(links)").groupBy("pair").agg(F.sum("times").alias("n"))
    # A window holds the pairs of one id of B: as many as the vocabulary of A at most.
    own = Window.partitionBy(F.shiftright("pair", 32))
    return counted.withColumn("best", (F.col("n") == F.max("n").over(own)).cast("long"))


def score(aligned: DataFrame, hot: int = HOT) -> DataFrame:
    """Adds to aligned rows n_best, the links whose pair is the best of its id of B, and count_sum, over all links.

    The rows are written first: their texts are encoded once, and each has a number of its own.
    """
    rows = staged(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = staged(pair_counts(rows))
    often = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // hot
    links = rows.selectExpr("row", "inline(links)")
    # Fewer than `hot` pairs can have more than 1 / hot of all links each.
    known = links.join(F.broadcast(counts.where(F.col("n") > often)), "pair", "left")
    rare = known.where("n IS NULL").select("pair", "row", "times").join(counts.where(F.col("n") <= often), "pair")
    sums = known.where("n IS NOT NULL").select("row", "times", "n", "best").unionByName(
        rare.select("row", "times", "n", "best")).groupBy("row").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("links").join(sums, "row", "left").drop("row").fillna(0, ["n_best", "count_sum"])
