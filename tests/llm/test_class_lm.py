from __future__ import annotations

import binascii
import math
from collections import Counter

import numpy as np
import pytest
from fixtures import BLANK_WORD, ODD, low, prose

from stackroom.llm import class_lm as lm
from stackroom.llm.queries import QUERIES


def held(doc_id) -> bool:
    return doc_id is not None and binascii.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text: str | None) -> list[bytes | None]:
    return [*BLANK_WORD.findall(low(text)), None]


def name(word: bytes) -> bytes:
    import hashlib
    return word if len(word) <= lm.NAMED else hashlib.sha256(word).digest()[:30] + word[-2:]


def brute_base(rows: list[tuple]) -> list[tuple]:
    """(held_out, n_tokens, n_known, train_tokens, base_score) of (id, text) rows."""
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, kinds = sum(counts.values()), len(counts)
    return [(held(i), len(own := tokens(text)), sum(counts[t] > 0 for t in own), total,
             sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in own)) for i, text in rows]


def brute_score(rows: list[tuple], model: lm.Model) -> list[float]:
    """The model's formula by plain loops, from the words' classes alone."""
    cls = {bytes(r["word"]): r["cls"] for r in lm.word_classes(model).collect()}
    end, n_units = lm.CLASSES, len(model.units.hashes)
    counts, transitions = Counter(), Counter()

    def class_of(word):
        if word is None:
            return end
        code = int.from_bytes(word[-2:], "big")
        return cls.get(name(word), int(model.classes[n_units + code]))

    for i, text in rows:
        if not held(i):
            own = tokens(text)
            counts.update(own)
            transitions.update(zip([end, *map(class_of, own)], map(class_of, own)))
    size, kinds = Counter(), Counter()
    for t, n in counts.items():
        size[class_of(t)] += n
        kinds[class_of(t)] += t is not None
    once, twice = (sum(n == k and t is not None for t, n in counts.items()) for k in (1, 2))
    discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)
    into, out = Counter(), Counter()
    for (a, b), n in transitions.items():
        out[a] += n
        into[b] += n
    total = sum(transitions.values())
    scores = []
    for _, text in rows:
        before, s = end, 0.0
        for t in tokens(text):
            c = class_of(t)
            s += math.log10((transitions[before, c] + lm.STRENGTH * (into[c] + 1) / (total + end + 1)) / (out[before] + lm.STRENGTH))
            if t is not None and counts[t]:
                s += math.log10((counts[t] - discount) / size[c])
            elif t is not None and size[c]:
                s += math.log10(discount * kinds[c] / size[c])
            before = c
        scores.append(s)
    return scores


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(a))


def test_query_equals_plain_loops(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    frame = QUERIES["op12_class_lm"].run(spark, "/root/testdata/sf0.001")
    assert frame.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = {r["doc_id"]: r for r in frame.collect()}
    assert len(got) == len(rows)
    model = lm.fit(documents, share=2000)
    other = {r["doc_id"]: r["score"] for r in lm.score(documents, model).collect()}
    for (i, _), base, s in zip(rows, brute_base(rows), brute_score(rows, model)):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == base[:4]
        assert close(base[4], r["base_score"]) and close(s, other[i])
    assert all(b > a for a, b in zip(model.history, model.history[1:])) and len(model.history) > 1


def test_probabilities_add_up_to_one(documents):
    model = lm.fit(documents, rounds=2, share=500)
    moves = 10 ** model.log_moves()
    assert np.allclose(moves.sum(axis=1), 1)
    mass = np.zeros(lm.CLASSES + 1)
    for r in lm.word_classes(model).collect():
        mass[r["cls"]] += (r["n"] - model.discount) / model.class_tokens[r["cls"]]
    some = model.class_tokens[:-1] > 0
    left = 10 ** (model.log_unknown() - model.log_class_tokens())
    assert np.allclose((mass + left)[:-1][some], 1) and np.allclose(left[:-1][~some], 1)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lm.fit(docs)
    held_rows = lm.score(docs, model).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    none = lm.score(docs, lm.fit(docs, rounds=0)).where("held_out").selectExpr("sum(score) s").first()
    assert held_rows["s"] > held_rows["b"] and held_rows["s"] > none["s"]
    assert model.history[-1] > model.history[0]


def test_gains_equal_the_change_of_likelihood():
    rng = np.random.default_rng(3)
    n, k = 14, 5
    pairs = rng.integers(0, 6, (n, n)).astype(float)
    classes = rng.integers(0, k, n)

    def table(of):
        out = np.zeros((k, k))
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    member = np.eye(k)[classes]
    own = pairs.diagonal().copy()
    alone = pairs - np.diag(own)
    gains = lm.exchange_gains(table(classes), classes, alone @ member, alone.T @ member, own)
    for u in range(n):
        exact = []
        for c in range(k):
            moved = classes.copy()
            moved[u] = c
            exact.append(lm.likelihood(table(moved)))
        assert np.allclose(gains[u] - gains[u, 0], np.array(exact) - exact[0])


def test_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1]) for r in ODD]
    model = lm.fit(odd, rounds=2)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
                 for r in lm.score(odd, model).collect())
    want = sorted((i or 0, *b[1:], s) for (i, _), b, s in zip(rows, brute_base(rows), brute_score(rows, model)))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and close(a[4], b[4]) and close(a[5], b[5])
    assert lm.score(empty, lm.fit(empty, rounds=1)).count() == 0
    # Nothing to learn from: every token is unknown.
    blank = [r for r in lm.score(odd, lm.fit(empty, rounds=1)).collect()]
    assert all(r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in blank)


def test_long_texts_in_parts(spark, monkeypatch):
    texts = [prose(9, 4000), "x" * 3000 + " tail", " " * 2500 + "w", prose(8, 30), "Ünïcode " * 400 + "y" * 40 + " end"]
    import pyarrow as pa
    batch = pa.record_batch({"text": texts})
    whole, cut = list(lm.parts(batch)), list(lm.parts(batch, 500))
    assert len(cut) > len(whole) + 20

    def words(found):
        return [p.data[s:e].tobytes() for p in found for s, e in zip(p.starts, p.ends)]

    assert words(whole) == words(cut) and [w for t in texts for w in tokens(t)[:-1]] == words(cut)
    units, seen = lm.Units.of(np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
    for found in (whole, cut):
        last, out = units.end, []
        for p in found:
            before, here, _, last = lm.neighbours(p, units.ids(p, p.hashes()), units.end, last)
            out += list(zip(before.tolist(), here.tolist()))
        seen.append(out)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("word", [b"a", b"ab", b"x" * 32, b"x" * 33])
def test_names(word):
    data = np.frombuffer(b"zz " + word, np.uint8)
    got = lm.names(data, np.array([0, 3]), np.array([2, 3 + len(word)])).to_pylist()
    assert got == [b"zz", name(word)]
