from __future__ import annotations

import random

import numpy as np
from fixtures import ODD

from stackroom.llm import chunk_dedup as cd


def chunks(data: bytes) -> list[tuple[int, int]]:
    out, begin = [], 0
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - cd.REACH + 1):i + 1]:
            h = (h << 1) + int(cd.GEAR[b]) & 0xFFFFFFFF
        if h & int(cd.END_BITS) == 0 or i == len(data) - 1:
            out.append((begin, i + 1))
            begin = i + 1
    return out


def brute(texts: list[bytes]):
    seen, out = set(), []
    for data in texts:
        cuts, again = chunks(data), []
        for a, b in cuts:
            again.append(data[a:b] in seen)
            seen.add(data[a:b])
        spans, i = [], 0
        while i < len(cuts):
            j = i
            while j < len(cuts) and again[j]:
                j += 1
            if j > i and cuts[j - 1][1] - cuts[i][0] >= cd.MIN_SPAN:
                spans.append((cuts[i][0], cuts[j - 1][1]))
            i = max(j, i + 1)
        out.append((len(data), len(cuts), sum(again), spans))
    return out


def columns(r):
    return r["n_bytes"], r["n_chunks"], r["n_repeats"], [(s["start"], s["end"]) for s in r["spans"]]


def test_equals_brute_force(documents, rows):
    got = {r["doc_id"]: columns(r) for r in cd.remove_repeats(documents).collect()}
    assert got == dict(zip([r["doc_id"] for r in rows], brute([r["text"].encode() for r in rows])))


def test_odd_rows(odd):
    short = odd.where("doc_id IS NULL OR doc_id <> 8").orderBy("doc_id").coalesce(1)
    order = [r["text"] for r in short.collect()]
    got = cd.remove_repeats(short, keep_text=True).collect()
    assert sorted(map(columns, got)) == sorted(brute([(t or "").encode() for t in order]))
    assert all(len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in got)
    assert cd.remove_repeats(odd).count() == len(ODD)


def test_insertions_move_only_near_ends():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(4000))
    moved = data[:1000] + b"xyz" + data[1000:]
    ends = [set(cd.chunk_ends(np.frombuffer(d, np.uint8), np.array([0, len(d)])).tolist()) for d in (data, moved)]
    assert {e for e in ends[0] if e > 1016} == {e - 3 for e in ends[1] if e > 1019}


def test_repeated_passages_go_and_other_text_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(20)]
    docs = [text(80) + " " + passages[i % 20] + " " + text(80) for i in range(40)] + [text(200) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in cd.remove_repeats(df).collect()}
    assert all(got[i] == 0 for i in [*range(20), *range(40, 60)])
    assert sum(got[i] > 0 for i in range(20, 40)) >= 19


def test_empty(empty):
    assert cd.remove_repeats(empty).count() == 0
