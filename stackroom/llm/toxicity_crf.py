"""Toxic spans and document scores from a linear-chain conditional random field.

Features of a token are the token and its first 4, 6 and 8 bytes, lower-cased. Over all labelled rows, features are
counted per document; those in at least ``share`` of the toxic texts and with high log-odds against the clean ones
form the vocabulary (at most features-per-toxic-text / share entries). A token of a toxic text that carries such
a feature is labelled toxic, every other token of every text is labelled clean.

The field has two states, weights for features and a bias in the toxic state, and four transition weights. It is
fitted on a sample of at most ``sample_rows`` different texts of each label with at most ``SAMPLE_BYTES`` bytes, each
weighted by its copies; counts, vocabulary and scores cover all rows.
Tokens without a feature all look the same, so a stretch of them is a power of one 2 x 2 matrix: forward-backward
visits only tokens with features and is still exact over the whole text.

The marginals give spans (tokens at 0.5 or more) and a document score: a logistic function, fitted on the same sample
weighted to the true label counts, of the largest marginal and of the logarithm of their noisy-or.

Defined results: null and empty texts have no tokens and get the score of a text without toxic tokens; without labelled
rows of both kinds every score is the share of toxic labels (0 if there are none); repeated labels count once,
toxic if any says so; repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .textarrays import NOT_ALNUM, lowered, prefix_sums, slices, span_hashes, spans, text_bytes

PREFIXES = (4, 6, 8)
WIDTH = 1 + len(PREFIXES)
SHARE = 0.005
LEAST_TEXTS = 3
LEAST_LOG_ODDS = 2.0
SAMPLE_ROWS = 2000
#: Bytes of text that the sample of a label has at most, but for its first text.
SAMPLE_BYTES = 16 << 20
#: Tokens of a training sequence.
SEQUENCE = 64
STEPS = 120
#: Features that a task counts before it sends them on.
HELD = 1 << 19


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used; a row without id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature hashes of each token, one column per kind; 0 where a token is too short for a prefix."""
    sums = prefix_sums(data)
    out = np.zeros((len(starts), WIDTH), np.uint64)
    out[:, 0] = span_hashes(sums, starts, ends)
    for k, n in enumerate(PREFIXES, 1):
        long = ends - starts > n
        out[long, k] = span_hashes(sums, starts[long], starts[long] + n) ^ np.uint64(0xA5A5A5A5 * k)
    return out


class Vocabulary:
    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if unknown."""
        out = np.full(hashes.shape, -1, np.int64)
        if len(self.hashes):
            some = self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]
            at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
            out[some] = np.where(self.hashes[at] == hashes[some], at, -1)
        return out


def _texts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(part.column("text"))
    data = lowered(data)
    starts, ends, counts = spans(~NOT_ALNUM[data], offsets)
    return data, offsets, starts, ends, counts


def _document_counts(rows: DataFrame, vocabulary: Vocabulary | None) -> DataFrame:
    """(feature, n): in how many rows a feature occurs."""

    def told(counts: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.uint64()).view(pa.int64()),
                                           pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, _, starts, ends, counts = _texts(part)
                found = _features(data, starts, ends)
                use = found != 0 if vocabulary is None else vocabulary.ids(found) >= 0
                row, kind = np.repeat(np.arange(len(counts)), counts)[np.nonzero(use)[0]], found[use]
                order = np.lexsort((row, kind))
                row, kind = row[order], kind[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])
                feature, n = np.unique(kind[new], return_counts=True)
                for f, k in zip(feature.tolist(), n.tolist()):
                    held[f] = held.get(f, 0) + k
                if len(held) > HELD:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    return rows.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def choose_features(rows: DataFrame, share: float = SHARE, least: int = LEAST_TEXTS,
                    log_odds: float = LEAST_LOG_ODDS) -> tuple[Vocabulary, int, int]:
    """The vocabulary and the numbers of toxic and clean rows; ``rows`` has (text, toxic)."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Vocabulary(np.zeros(0, np.uint64)), toxic, clean
    often = _document_counts(rows.where("toxic = 1"), None).where(F.col("n") >= max(least, share * toxic)).toArrow()
    hashes, n_toxic = often["feature"].to_numpy().view(np.uint64), often["n"].to_numpy()
    candidates = Vocabulary(hashes)
    seen = _document_counts(rows.where("toxic = 0"), candidates).toArrow()
    n_clean = np.zeros(len(hashes))
    at = candidates.ids(seen["feature"].to_numpy().view(np.uint64))
    n_clean[at] = seen["n"].to_numpy()
    odds = np.log((n_toxic + 0.5) / (toxic + 1)) - np.log((n_clean[candidates.ids(hashes)] + 0.5) / (clean + 1))
    return Vocabulary(hashes[odds >= log_odds]), toxic, clean


@dataclass
class Crf:
    """Weights: features (and a last 0 for none), bias, transitions, and the logistic document score."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    logistic: np.ndarray

    def marginals(self, n_tokens: np.ndarray, counts: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for every token with features. ``counts`` of them belong to each text, at
        token ``place``; forward-backward over all texts at once, one step per token."""
        move = np.exp(self.moves)
        plain = move * np.array([1.0, np.exp(self.bias)])
        half, root = (plain[0, 0] + plain[1, 1]) / 2, np.sqrt((plain[0, 0] - plain[1, 1]) ** 2 / 4 + plain[0, 1] * plain[1, 0])
        big, small = half + root, half - root
        eye = np.eye(2)

        def stretch(gap: np.ndarray) -> np.ndarray:
            # plain ** gap, divided by its largest eigenvalue ** gap.
            fade = ((small / big) ** gap)[:, None, None]
            return ((plain - small * eye) - fade * (plain - big * eye)) / (2 * root)

        emit = np.ones((len(place), 2))
        emit[:, 1] = np.exp(np.clip(self.bias + self.weights[ids].sum(axis=1), -30, 30))
        first = np.cumsum(counts) - counts
        before = np.diff(place, prepend=0) - 1
        before[first[counts > 0]] = place[first[counts > 0]]
        ahead, back = np.empty((len(place), 2)), np.empty((len(place), 2))
        order = np.argsort(-counts, kind="stable")
        alive = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")
        state = np.tile([1.0, 0.0], (len(counts), 1))
        for k, m in enumerate(alive.tolist()):
            at = first[order[:m]] + k
            state = np.einsum("ni,nij,jk->nk", state[:m], stretch(before[at]), move) * emit[at]
            state /= state.sum(axis=1, keepdims=True)
            ahead[at] = state
        tail = np.where(counts > 0, n_tokens - 1 - place[np.maximum(first + counts - 1, 0)] if len(place) else 0, 0)
        state = np.ones((len(counts), 2))
        for k in range(len(alive)):
            # The k-th token from the end of each text that has so many.
            at = (first + counts - 1)[order[:alive[k]]] - k
            texts = order[:alive[k]]
            if k == 0:
                state[texts] = stretch(tail[texts]).sum(axis=2)
            else:
                later = emit[at + 1] * back[at + 1]
                state[texts] = np.einsum("nij,jk,nk->ni", stretch(before[at + 1]), move, later)
            back[at] = state[texts] / state[texts].sum(axis=1, keepdims=True)
        both = ahead * back
        return both[:, 1] / both.sum(axis=1) if len(place) else np.zeros(0)

    def score(self, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = evidence(counts, p)
        return 1 / (1 + np.exp(-np.clip(self.logistic[0] + x @ self.logistic[1:], -30, 30)))


def evidence(counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal, and log(1 + noisy-or exponent)."""
    row = np.repeat(np.arange(len(counts)), counts)
    top = np.zeros(len(counts))
    np.maximum.at(top, row, p)
    weight = np.bincount(row, -np.log1p(-np.minimum(p, 1 - 1e-6)), len(counts))
    return np.stack([top, np.log1p(weight)], axis=1)


def _encoded(part: pa.RecordBatch, vocabulary: Vocabulary):
    """n_tokens, counts of tokens with features, their places, feature ids (last id: none), byte spans."""
    data, offsets, starts, ends, n_tokens = _texts(part)
    ids = vocabulary.ids(_features(data, starts, ends))
    some = np.flatnonzero((ids >= 0).any(axis=1))
    row = np.repeat(np.arange(len(n_tokens)), n_tokens)[some]
    counts = np.bincount(row, minlength=len(n_tokens))
    place = some - (np.cumsum(n_tokens) - n_tokens)[row]
    found = ids[some]
    found[found < 0] = len(vocabulary.hashes)
    return n_tokens, counts, place, found, starts[some] - offsets[row], ends[some] - offsets[row]


def _chosen(rows: DataFrame, label: int, n: int) -> list[int]:
    """Hashes of the texts of the sample of a label: the smallest ones, as far as number and bytes allow. Only hashes and sizes
    meet in one task."""
    texts = rows.where(F.col("toxic") == label).groupBy(F.xxhash64("text").alias("hash")).agg(
        F.max(F.octet_length("text")).alias("size")).orderBy("hash").limit(n).collect()
    chosen, size = [], 0
    for r in texts:
        size += r["size"]
        if chosen and size > SAMPLE_BYTES:
            break
        chosen.append(r["hash"])
    return chosen


def _sample(rows: DataFrame, vocabulary: Vocabulary, n: int) -> pa.Table:
    """At most n different texts of each label, by hash, as token numbers and feature ids, with the number of their copies."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_tokens, counts, place, ids, _, _ = _encoded(part, vocabulary)
                edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), part.column("copies"), pa.array(n_tokens),
                     pa.ListArray.from_arrays(pa.array(edges), pa.array(place)),
                     pa.ListArray.from_arrays(pa.array(edges * WIDTH), pa.array(ids.ravel()))],
                    names=["toxic", "copies", "n_tokens", "place", "ids"])

    # Hashes are uniform, so the texts of the sample are those up to a bound.
    last = [max(_chosen(rows, k, n), default=-1 << 63) for k in (0, 1)]
    mine = rows.withColumn("hash", F.xxhash64("text")).where(
        F.col("hash") <= F.when(F.col("toxic") == 1, F.lit(last[1])).otherwise(F.lit(last[0])))
    once = mine.groupBy("toxic", "hash").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return once.orderBy("toxic", "hash").select("toxic", "copies", "text").mapInArrow(
        encode, "toxic long, copies long, n_tokens long, place array<long>, ids array<long>").toArrow()


def _fit_chain(toxic, copies, n_tokens, counts, place, ids, n_features: int, steps: int = STEPS):
    """Weights by Adam on the log-likelihood of sequences of 64 tokens, each weighted by the copies of its text; sequences
    without features, which are all alike, enter once with their number as weight."""
    text = np.repeat(np.arange(len(counts)), counts)
    piece = place // SEQUENCE
    key = text * (int(n_tokens.max(initial=0)) // SEQUENCE + 1) + piece
    seqs, first, seq = np.unique(key, return_index=True, return_inverse=True)
    n_seq = len(seqs) + 1
    mine = copies[text[first]]
    empty = max(int((copies * (n_tokens // SEQUENCE)).sum() - mine.sum()), 1)
    weight = np.append(mine, empty).astype(np.float64)[:, None]
    grid = np.full((n_seq, SEQUENCE, WIDTH), n_features)
    grid[seq, place % SEQUENCE] = ids
    gold = np.zeros((n_seq, SEQUENCE), np.int64)
    gold[seq, place % SEQUENCE] = toxic[text]
    before = np.concatenate([np.zeros((n_seq, 1), np.int64), gold[:, :-1]], axis=1)
    seen = np.array([[((before == a) & (gold == b)).sum(axis=1) @ weight[:, 0] for b in (0, 1)] for a in (0, 1)])
    theta = np.zeros(n_features + 5)
    theta[n_features] = -2.0
    mean, var, scale = np.zeros_like(theta), np.zeros_like(theta), weight.sum()
    for step in range(1, steps + 1):
        w, bias, moves = np.append(theta[:n_features], 0.0), theta[n_features], theta[n_features + 1:].reshape(2, 2)
        emit = np.ones((n_seq, SEQUENCE, 2))
        emit[..., 1] = np.exp(np.clip(bias + w[grid].sum(axis=2), -30, 30))
        move = np.exp(moves)
        ahead, back = np.empty_like(emit), np.empty_like(emit)
        state = np.tile([1.0, 0.0], (n_seq, 1))
        for t in range(SEQUENCE):
            state = (state @ move) * emit[:, t]
            state /= state.sum(axis=1, keepdims=True)
            ahead[:, t] = state
        state = np.ones((n_seq, 2))
        for t in range(SEQUENCE - 1, -1, -1):
            back[:, t] = state
            state = (emit[:, t] * state) @ move.T
            state /= state.sum(axis=1, keepdims=True)
        p = ahead * back
        p = p[..., 1] / p.sum(axis=2)
        prior = np.concatenate([np.tile([1.0, 0.0], (n_seq, 1, 1)), ahead[:, :-1]], axis=1)
        pairs = prior[..., :, None] * move * (emit * back)[..., None, :]
        pairs *= (weight / pairs.sum(axis=(2, 3)))[..., None, None]
        error = (gold - p) * weight
        grad = np.zeros_like(theta)
        np.add.at(grad, np.where(grid < n_features, grid, n_features + 4).ravel(), np.repeat(error.ravel(), WIDTH))
        grad[n_features] = error.sum()
        grad[n_features + 1:] = (seen - pairs.sum(axis=(0, 1))).ravel()
        grad = grad / scale - 1e-4 * theta
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        theta += 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    return np.append(theta[:n_features], 0.0), float(theta[n_features]), theta[n_features + 1:].reshape(2, 2)


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-3 * len(x) * np.array([0, 1, 1]) * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * len(x) * np.eye(x.shape[1])
        beta += np.linalg.solve(curve, grad)
    return beta


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Vocabulary, Crf]:
    """Learn from the labelled rows that aren't held out."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("labelled")).agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    rows = staged(docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text").join(
        known.hint("merge"), F.col("doc_id") == F.col("labelled")).select("text", "toxic"))
    vocabulary, n_toxic, n_clean = choose_features(rows)
    n = len(vocabulary.hashes)
    if not n_toxic or not n_clean:
        rate = n_toxic / max(n_toxic + n_clean, 1)
        flat = np.array([np.log((rate + 1e-9) / (1 - rate + 1e-9)), 0, 0])
        return vocabulary, Crf(np.zeros(n + 1), 0.0, np.zeros((2, 2)), flat)
    sample = _sample(rows, vocabulary, sample_rows)
    toxic, copies, n_tokens = (sample[c].to_numpy() for c in ("toxic", "copies", "n_tokens"))
    places = sample["place"].combine_chunks()
    counts = places.value_lengths().to_numpy().astype(np.int64)
    place, ids = places.flatten().to_numpy(), sample["ids"].combine_chunks().flatten().to_numpy().reshape(-1, WIDTH)
    model = Crf(*_fit_chain(toxic, copies, n_tokens, counts, place, ids, n), np.zeros(3))
    p = model.marginals(n_tokens, counts, place, ids)
    drawn = [max(copies[toxic == k].sum(), 1) for k in (0, 1)]
    share = copies * np.where(toxic == 1, n_toxic / drawn[1], n_clean / drawn[0])
    model.logistic = _fit_logistic(evidence(counts, p), toxic, share * len(toxic) / (n_toxic + n_clean))
    return vocabulary, model


def score(docs: DataFrame, vocabulary: Vocabulary, model: Crf) -> DataFrame:
    """(doc_id, score, spans): spans are [start, end) byte offsets of the toxic tokens, neighbours joined."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_tokens, counts, place, ids, begin, end = _encoded(part, vocabulary)
                p = model.marginals(n_tokens, counts, place, ids)
                toxic = p >= 0.5
                row, place, begin, end = (v[toxic] for v in (np.repeat(np.arange(len(counts)), counts), place, begin, end))
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
                last = np.append(new[1:], True) if len(new) else new
                edges = pa.array(np.searchsorted(row[new], np.arange(len(counts) + 1)).astype(np.int32))
                span = pa.StructArray.from_arrays([pa.array(begin[new]), pa.array(end[last])], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(model.score(counts, p)), pa.ListArray.from_arrays(edges, span)],
                    names=["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {id_type}, score double, spans array<struct<start: long, end: long>>")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score, spans, held_out, predicted)."""
    return score(docs, *train(docs, labels, sample_rows)).withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def mild_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents not predicted toxic. Every row is judged where it is read, by its own text; nothing is joined."""
    vocabulary, model = train(docs, labels, sample_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_tokens, counts, place, ids, _, _ = _encoded(part, vocabulary)
                scores = model.score(counts, model.marginals(n_tokens, counts, place, ids))
                yield part.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(keep, docs.schema)
