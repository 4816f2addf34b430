"""SimHash near-duplicates with tables of distances to reference fingerprints.

1. A fingerprint per document: XXH64 of its word shingles, majority per bit. Equal fingerprints collapse to one
   row at once, so a group of copies is one row from here on.
2. Two fingerprints within ``max_bits`` (2) differing bits agree on at least four of six blocks of bits. Each
   fingerprint is therefore filed under 15 keys of about 42 bits; only fingerprints filed together are compared.
   A bucket holds at most 2^22 different fingerprints, whatever the number of documents.
3. Within a bucket the distances to the reference fingerprints (pivots) are computed once. By the triangle
   inequality a pair whose distances to any pivot differ by more than ``max_bits`` can't be linked: the bucket
   is ordered by the first pivot's distance, rows outside the window are never met, the other coordinates
   discard further pairs, and survivors are verified on the fingerprints themselves.
4. A bucket gives a spanning set of its links (at most one per member), never all pairs, and components
   of the links are found by label propagation.

For near copies with more changes (a Jaccard similarity of 0.8 on five-word shingles moves about 15 % of the bits) there
is a wide form: 256 bits, filed under a fixed number of keys, the same pivot test in large buckets, and every proposed pair
verified on its sets of shingles; see :func:`similar_groups`.

Defined results: a null text, an empty text and a text without words have fingerprint zero and are linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows get equal results; rows with a null id
get the component of the other members, null if there is none; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.banding import bucket_join
from ..session import staged
from .components import components
from .textarrays import BLANK, lowered, mixed, prefix_sums, slices, span_hashes, spans, text_bytes, windows

SHINGLE_WORDS = 3
MAX_BITS = 2
#: Bit ranges of the six blocks, low bit first.
BLOCKS = ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))
#: Reference fingerprints: successive powers of an odd constant.
N_PIVOTS = 16
#: Members of a bucket that are compared with all the rest of it in one numpy call.
TILE = 512


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit value for each text, the majority of the shingles' XXH64."""
    starts, ends, counts = spans(~BLANK[data], offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.uint64)
    # All words joined by single blanks: word k begins at at[k].
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = lowered(data[~BLANK[data]])
    text = memoryview(joined.tobytes())
    first_word = np.cumsum(counts) - counts
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    row = np.repeat(np.arange(len(counts)), n_shingles)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first_word[row]
    last = np.minimum(k + shingle, (first_word + counts)[row])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(at[k].tolist(), (at[last] - 1).tolist())),
                         np.uint64, len(k))
    # Bits are counted in pieces, so one long text needs no more memory than a short one.
    ones = np.zeros((len(counts), 64), np.int64)
    step = 1 << 16
    for low in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[low:low + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[low:low + step]
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        ones[rows[begins]] += np.add.reduceat(bits, begins, axis=0, dtype=np.int32)
    major = (2 * ones > n_shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                fp = _fingerprints(data, offsets, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, fp long")


def _bucket_links(fp: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links in one bucket: every member is reached once, from a linked member."""
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    first = table[:, 0]
    open_ = np.ones(len(fp), bool)
    left, right = [], []
    for seed in range(len(fp)):
        if not open_[seed]:
            continue
        open_[seed] = False
        front = np.array([seed])
        while len(front):
            fresh = []
            for low in range(0, len(front), TILE):
                members = front[low:low + TILE]
                a, b = np.searchsorted(first, [first[members].min() - max_bits, first[members].max() + max_bits + 1])
                rest = a + np.flatnonzero(open_[a:b])
                if not len(rest):
                    continue
                near = np.ones((len(members), len(rest)), bool)
                for c in range(table.shape[1]):
                    near &= np.abs(table[members, c][:, None] - table[rest, c][None]) <= max_bits
                who, whom = np.nonzero(near)
                linked = np.bitwise_count(fp[members[who]] ^ fp[rest[whom]]) <= max_bits
                who, whom = who[linked], whom[linked]
                reached, at = np.unique(whom, return_index=True)
                left.append(fp[members[who[at]]])
                right.append(fp[rest[reached]])
                open_[rest[reached]] = False
                fresh.append(rest[reached])
            front = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
    empty = np.zeros(0, np.uint64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _links(fp: np.ndarray, key: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys."""
    table = np.bitwise_count(fp[:, None] ^ pivots()[None]).astype(np.int8)
    begins = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    sizes = np.diff(np.append(begins, len(key)))
    # Buckets of two, by far the most, are judged together.
    pair = begins[sizes == 2]
    keep = (np.abs(table[pair] - table[pair + 1]).max(axis=1, initial=0) <= max_bits)
    pair = pair[keep]
    pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= max_bits]
    left, right = [fp[pair]], [fp[pair + 1]]
    for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        x, y = _bucket_links(fp[begin:begin + size], table[begin:begin + size], max_bits)
        left.append(x)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that join every group of different fingerprints within ``max_bits`` of each other.

    ``prints`` has one row per fingerprint, in column fp.
    """
    if max_bits > 2:
        raise ValueError("six blocks with two left out find at most two differing bits")
    keep = list(combinations(range(len(BLOCKS)), len(BLOCKS) - 2))

    def masked(blocks: tuple[int, ...]) -> int:
        mask = 0
        for b in blocks:
            low, high = BLOCKS[b]
            mask |= (1 << high) - (1 << low)
        return mask - (1 << 64) if mask >> 63 else mask

    filed = prints.select("fp", F.posexplode(F.array(
        *[F.col("fp").bitwiseAND(F.lit(masked(k))) for k in keep])).alias("way", "bits")).select(
        F.xxhash64("bits", "way").alias("key"), "fp")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            # Keys met once have nothing to compare.
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            if same.any():
                a, b = _links(fp[same], key[same], max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                                 names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([held_key, batch.column("key").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(key, key[-1]))
            yield from out(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        yield from out(held_key, held_fp)

    found = filed.repartition("key").sortWithinPartitions("key").mapInArrow(judge, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest id reachable over links, own id included."""
    rows = staged(fingerprints(docs, shingle))
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(prints, max_bits))
    grouped = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", "fp", "component_id")


#: The wide form: 64-bit parts of a fingerprint, words of a shingle, least Jaccard similarity of a link.
PARTS = 4
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits up to which a pair is proposed. Sets at 0.8 differ in 39 of 256 bits on average, 6 more or less.
WIDE_BITS = 56
#: Sets of so few shingles are proposed whatever their fingerprints say.
FEW = 32
#: Bands and their rows: a pair at 0.8 shares a band with a chance of 0.99.
BANDS, ROWS = 16, 6
#: Members of a bucket whose pairs are all proposed, and that are judged at once.
SMALL_BUCKET = 6
WINDOW = 2048
#: 64-bit words of a set's parities.
PARITIES = 8
#: Bits of the filter for the sets that some pair asks for.
FILTER_BITS = 1 << 24


def _shingle_sets(part: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each row as 64-bit hashes, and their numbers; rows with fewer words have one shingle."""
    data, offsets = text_bytes(part.column("text"))
    data = lowered(data)
    starts, ends, counts = spans(~BLANK[data], offsets)
    words = span_hashes(prefix_sums(data), starts, ends)
    of_word = np.repeat(np.arange(len(counts)), counts)
    hashes, at = windows(words, counts, shingle)
    row = of_word[at]
    for few in range(1, shingle):
        mine = np.where(counts == few, counts, 0)
        some, _ = windows(words[mine[of_word] > 0], mine, few)
        hashes, row = np.concatenate([hashes, some]), np.concatenate([row, np.flatnonzero(mine)])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def _digests(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """16 bytes that name a set of shingles; all sets without shingles have the same name."""
    out = np.zeros((len(n), 2), np.uint64)
    some = np.flatnonzero(n)
    begins = (np.cumsum(n) - n)[some]
    for k in range(2):
        spread = mixed(hashes * np.uint64(2 * k + 3) + np.uint64(0xD1B54A32D192ED03))
        if len(some):
            out[some, k] = mixed(np.add.reduceat(spread, begins) + n[some].astype(np.uint64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _wide_sketch(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: PARTS 64-bit parts of a fingerprint, a key for each band, and the first smallest value of the next band."""
    fp, least = np.zeros((len(n), PARTS), np.uint64), np.zeros((len(n), BANDS * ROWS), np.uint64)
    keys, some = np.zeros((len(n), BANDS), np.uint64), np.flatnonzero(n)
    if not len(some):
        return fp, keys, keys
    begins = (np.cumsum(n) - n)[some]
    factors = np.random.default_rng(96).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    for k, factor in enumerate(factors):
        least[some, k] = np.minimum.reduceat(hashes * factor, begins)
    least = least.reshape(len(n), BANDS, ROWS)
    keys += np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
    row = np.repeat(np.arange(len(n)), n)
    for k in range(PARTS):
        own, ones = mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 2**64 - 1)), np.zeros((len(n), 64), np.int64)
        for low in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[low:low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = row[low:low + (1 << 16)]
            edges = np.flatnonzero(np.diff(rows, prepend=-1))
            ones[rows[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        fp[:, k] = np.packbits((2 * ones > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()
    return fp, keys, np.roll(least[:, :, 0], -1, axis=1)


def _parities(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each set, PARITIES words in which every shingle flips one bit: two sets differ in at least as many shingles as bits."""
    spread = mixed(hashes + np.uint64(0x9FB21C651E98DF25))
    maps = np.zeros((len(n), PARITIES), np.uint64)
    np.bitwise_xor.at(maps, (np.repeat(np.arange(len(n)), n), (spread >> np.uint64(6)).astype(np.int64) % PARITIES),
                      np.uint64(1) << (spread & np.uint64(63)))
    return maps


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, node, n, w0 ... w3, p0 ... p7, keys, next): node names the set of shingles, n is its size."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    words = [f"w{k}" for k in range(PARTS)] + [f"p{k}" for k in range(PARITIES)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, n = _shingle_sets(part, shingle)
                fp, *lists = _wide_sketch(hashes, n)
                fp = np.concatenate([fp, _parities(hashes, n)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _digests(hashes, n), pa.array(n.astype(np.int64)),
                     *[pa.array(np.ascontiguousarray(fp[:, k]).view(np.int64)) for k in range(len(words))],
                     *[pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel().view(np.int64)), BANDS).cast(
                         pa.list_(pa.int64())) for x in lists]],
                    names=["doc_id", "node", "n", *words, "keys", "next"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, node binary, n long, " + ", ".join(f"{w} long" for w in words) + ", keys array<long>, next array<long>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _alike(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return np.minimum(n, other) >= SIMILARITY * np.maximum(n, other)


def spanning_links(fp: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest-neighbour tree of each group of a bucket: every member is linked to the nearest one reached before.

    A pair counts if its sizes can be similar and its fingerprints differ in at most ``limit`` bits (or are made of few
    shingles). The tables of distances to the pivots discard pairs before their fingerprints meet.
    """
    m = len(fp)
    table = np.stack([_distance(fp, np.roll(pivots(PARTS), k)[None]) for k in range(PARTS)], axis=1)
    far = 64 * PARTS + 1
    dist, parent, open_ = np.full(m, far), np.full(m, -1), np.ones(m, bool)
    few = n <= FEW
    one, two = [], []
    at = 0
    for _ in range(m - 1):
        open_[at] = False
        rest = np.flatnonzero(open_ & _alike(n, n[at]))
        rest = rest[few[rest] | (np.abs(table[rest] - table[at]).max(axis=1, initial=0) <= limit)]
        d = _distance(fp[rest], fp[at])
        nearer = (d < dist[rest]) & (few[rest] | (d <= limit))
        dist[rest[nearer]], parent[rest[nearer]] = d[nearer], at
        waiting = np.flatnonzero(open_)
        at = int(waiting[dist[waiting].argmin()])
        if dist[at] < far:
            one.append(int(parent[at]))
            two.append(at)
    return np.array(one, np.int64), np.array(two, np.int64)


def proposed_links(prints: DataFrame, limit: int = WIDE_BITS) -> DataFrame:
    """(a, b) pairs of different sets that may be similar, a < b; ``prints`` has one row per set.

    Every set is filed under BANDS keys, whatever their number. Buckets of up to SMALL_BUCKET propose all their pairs, larger
    ones a tree. Within a key sets are ordered by the first rows of the next band, so members of a hot key that agree
    in more rows stand together; they are judged in overlapping windows, and ranges of them go to different tasks.
    Trees, windows and ``limit`` leave pairs out: those are looked for by :func:`remaining_links`.
    """
    words = [f"w{k}" for k in range(PARTS)]
    filed = prints.where("n > 0").select("node", "n", *words, F.inline(F.arrays_zip(
        F.col("keys").alias("key"), F.col("next").alias("next")))).toDF("node", "n", *words, "key", "next")

    def near(key: np.ndarray, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
        sizes = np.diff(np.append(begins, len(key)))
        after = np.repeat(sizes, sizes) - (np.arange(len(key)) - np.repeat(begins, sizes)) - 1
        after[np.repeat(sizes > SMALL_BUCKET, sizes)] = 0
        one, two = [], []
        for step in range(1, int(after.max(initial=0)) + 1):
            at = np.flatnonzero(after >= step)
            at = at[_alike(n[at], n[at + step])]
            at = at[(n[at] <= FEW) | (_distance(fp[at], fp[at + step]) <= limit)]
            one.append(at)
            two.append(at + step)
        for begin, size in zip(begins[sizes > SMALL_BUCKET].tolist(), sizes[sizes > SMALL_BUCKET].tolist()):
            for low in range(begin, begin + size, WINDOW // 2):
                high = min(low + WINDOW, begin + size)
                a, b = spanning_links(fp[low:high], n[low:high], limit)
                one.append(a + low)
                two.append(b + low)
                if high == begin + size:
                    break
        none = [np.zeros(0, np.int64)]
        return np.concatenate(one or none), np.concatenate(two or none)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.stack([rows.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            a, b = near(rows.column("key").to_numpy(), fp, rows.column("n").to_numpy())
            node = rows.column("node")
            return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not rows.num_rows:
                continue
            keys = rows.column("key").to_numpy()
            # The last key may go on; of a long one only the last window is held back.
            cut = int(np.searchsorted(keys, keys[-1]))
            if rows.num_rows - cut > 2 * WINDOW:
                yield out(rows)
                held = rows.slice(rows.num_rows - WINDOW)
            else:
                yield out(rows.slice(0, cut))
                held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield out(held)

    dealt = filed.repartitionByRange("key", "next").sortWithinPartitions("key", "next", "node")
    found = dealt.select("key", "node", "n", *words).mapInArrow(judge, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def remaining_links(prints: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): every pair of sets that share a key, can be similar and are not in one group of ``roots`` (node, root) yet.

    Nothing is judged by chance here: sizes and parities bound the similarity from above. Keys whose sets are all in one group
    have nothing left, so of a large group of near copies no pair is met; any other bucket is met whole, as a grid of blocks.
    """
    maps = [f"p{k}" for k in range(PARITIES)]
    found = roots.select(F.col("node").alias("of"), "root")
    filed = staged(prints.where("n > 0").join(found, F.col("node") == F.col("of"), "left").select(
        F.explode("keys").alias("key"), "node", F.coalesce("root", "node").alias("root")))
    mixed_keys = filed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = staged(filed.join(mixed_keys, "key").join(prints.select("node", "n", *maps), "node"))
    right = left.select("key", F.col("node").alias("other"), F.col("root").alias("theirs"), F.col("n").alias("k"),
                        *[F.col(m).alias(f"o{m}") for m in maps])
    differ = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"o{m}"))) for m in maps), F.lit(0))
    may = (F.col("node") < F.col("other")) & (F.col("root") != F.col("theirs")) & (
        F.least("n", "k") >= F.greatest("n", "k") * similarity - 1e-9) & (
        differ <= (F.col("n") + F.col("k")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    return bucket_join(left, right, ["key"], "node", "other", may).select(
        F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def verified_links(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Sets are made again from the texts. A filter of fixed size lets only those out of the tasks that some pair (or, rarely,
    a pair of the same bit) asks for.
    """
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).select(
        F.conv(F.hex(F.substring("node", 1, 3)), 16, 10).cast("int").alias("bit"))
    words = asked.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.expr("1L"), F.col("bit").bitwiseAND(F.lit(63)))).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, n = _shingle_sets(part, shingle)
                node = _digests(hashes, n)
                name = np.frombuffer(b"".join(node.to_pylist()), np.uint8).reshape(-1, 16).astype(np.int64)
                bit = name[:, 0] << 16 | name[:, 1] << 8 | name[:, 2]
                asked = sent.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)
                some = np.flatnonzero(asked)
                edges = np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(edges), pa.array(
                        hashes[np.repeat(asked == 1, n)].view(np.int64)))], names=["node", "hashes"])

    sets = staged(docs.select("text").mapInArrow(scan, "node binary, hashes array<long>").dropDuplicates(["node"]))
    mine, theirs = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_set")) for c in ("a", "b"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(mine, "a").join(theirs, "b").select(
        "a", "b", common.alias("common"), (F.size("a_set") + F.size("b_set")).alias("total")).where(
        F.col("common") >= F.lit(similarity) * (F.col("total") - F.col("common"))).select("a", "b")


def similar_groups(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """(doc_id, component_id): near copies, at a Jaccard similarity of 0.8 or more on sets of five-word shingles.

    Equal sets are one row from the start. Others are proposed by bands of smallest values, fingerprints of 256 bits and the
    tables of distances to the pivots; a proposed pair is a link only if its sets are that similar. What a large bucket leaves
    out is looked for afterwards, between the groups found so far, so every pair of similar sets that share a band ends in one
    group. Of the pairs at 0.8, 99 of 100 share a band, and more above.
    """
    rows = staged(_sketches(docs, shingle))
    prints = staged(rows.drop("doc_id").dropDuplicates(["node"]))
    links = staged(verified_links(staged(proposed_links(prints)), docs, shingle))
    roots = staged(components(links))
    rest = staged(remaining_links(prints, roots))
    if not rest.isEmpty():
        roots = components(links.unionByName(verified_links(rest, docs, shingle)))
    roots = roots.withColumnRenamed("node", "of")
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    grouped = firsts.join(roots, F.col("node") == F.col("of"), "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "node").join(grouped.join(smallest, "root").select("node", "component_id"), "node").select(
        "doc_id", "component_id")


def _new_name(columns: list[str], name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def distinct_documents(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """The documents with one of each group of near copies kept: the one with the smallest id.

    Texts without words are copies of each other. Of rows repeated under one id with one text one stays. Rows without an id
    can't lead or leave a group; of equal texts among them one stays.
    """
    columns = docs.columns
    lead_id, lead_rows, digest = (_new_name(columns, c) for c in ("lead_id", "lead_rows", "text_digest"))
    lead = similar_groups(docs, shingle).where("doc_id = component_id").groupBy(
        F.col("doc_id").alias(lead_id)).agg(F.count("*").alias(lead_rows))
    kept = docs.join(lead, docs["doc_id"] == lead[lead_id])
    once = kept.where(lead[lead_rows] == 1).select(docs["*"])
    doubtful = kept.where(lead[lead_rows] > 1).select(docs["*"]).unionByName(docs.where("doc_id IS NULL"))
    return once.unionByName(doubtful.withColumn(digest, F.sha2(F.col("text"), 256)).dropDuplicates(
        ["doc_id", digest]).select(columns))
