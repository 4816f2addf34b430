from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from fixtures import ODD

from stackroom.llm import suffix_dedup as sd


def brute(texts: list[bytes], length: int = 200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone) if not x)).hexdigest()


def got(df):
    return sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_equals_brute_force(documents, rows):
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"].encode() for r in rows])))
    result = sd.remove_repeats(documents).collect()
    assert len(result) == len(rows)
    for r in result:
        assert want[r["doc_id"]] == (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])


def test_odd_rows_and_kept_bytes(odd):
    df = sd.remove_repeats(odd, keep=True)
    texts = [(t or "").encode() for _, t, *_ in ODD]
    assert got(df) == sorted(brute(texts))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in df.collect())


def test_many_small_ranges_and_buckets(spark, monkeypatch):
    """Passages in the middle, at either end, overlapping, periodic, and within one text."""
    monkeypatch.setattr(sd, "RANGE_ENTRIES", 20)
    monkeypatch.setattr(sd, "BUCKET_HASHES", 50)
    monkeypatch.setattr(sd, "SEGMENT_BYTES", 3000)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage = text(420)
    docs = [text(300) + passage + text(100), passage[100:] + text(50), text(90) + passage[:250], passage[60:260],
            passage[60:259], "ab" * 400, "ab" * 150, text(900), passage + "x" + passage, "a" * 199, "a" * 200, "a" * 201]
    docs += [text(150) + passage[i:i + 210] + text(30) for i in range(0, 200, 13)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    assert got(sd.remove_repeats(df)) == sorted(brute([d.encode() for d in docs]))


def test_empty(empty):
    assert sd.remove_repeats(empty).count() == 0


def test_merge_keeps_order_and_prefixes():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30)))
            for _ in range(7)]
    coded = [sd.decoded(sd.front_coded([(r, b"", [0]) for r in run])) for run in runs]
    of_run, of_index, common = sd.merge([c[0] for c in coded], [c[1] for c in coded])
    merged = [runs[r][i] for r, i in zip(of_run, of_index)]
    assert merged == sorted(x for run in runs for x in run)
    assert common[1:] == [sd._common(a, b, 0) for a, b in zip(merged, merged[1:])]


def test_anchors_stand_alike_in_equal_windows():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 3000, np.uint8)
    data[2000:2400] = data[500:900]
    at, _ = sd.anchors(data, np.array([0, 1500, 3000]))
    inside = lambda lo: {a - lo for a in at.tolist() if lo + 161 <= a < lo + 200}
    assert inside(500) == inside(2000)
