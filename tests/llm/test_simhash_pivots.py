from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import xxhash
from fixtures import BLANK_WORD, ODD, low, prose

from stackroom.llm import simhash_pivots as sp
from stackroom.llm.components import components


def fingerprint(text: str | None) -> int:
    words = BLANK_WORD.findall(low(text))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints: list[tuple]) -> dict:
    """Smallest id reachable for each fingerprint; prints holds (id, fingerprint)."""
    values = sorted({f for _, f in prints})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for doc, f in prints:
        if doc is not None:
            least[find(f)].append(doc)
    return {v: min(least[find(v)], default=None) for v in values}


def check(df, texts):
    got = sp.near_duplicates(df).collect()
    prints = [(i, fingerprint(t)) for i, t in texts]
    want = brute(prints)
    assert sorted(((i is None, i or 0, f, want[f]) for i, f in prints), key=str) == sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % 2**64, r["component_id"]) for r in got), key=str)


def test_equals_brute_force(documents, rows):
    check(documents, [(r["doc_id"], r["text"]) for r in rows])


def test_odd_rows(odd):
    check(odd, [(i, t) for i, t, *_ in ODD])


def test_empty(empty):
    assert sp.near_duplicates(empty).count() == 0 and sp.distinct_documents(empty).count() == 0


def test_links_join_all_that_brute_force_joins(spark):
    """Chains, stars and large buckets: the links span what all pairs would."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):
        v = rng.getrandbits(64)
        for _ in range(60):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.add(v)
    centre = rng.getrandbits(64)
    values |= {centre ^ 1 << i ^ 1 << j for i in range(0, 64, 3) for j in range(i + 1, 64, 5)}
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long").repartition(3)
    got = {r["node"] % 2**64: r["root"] for r in components(sp.links(frame)).collect()}
    want = brute([(v, v) for v in values])
    groups, mine = defaultdict(set), defaultdict(set)
    for v in values:
        groups[want[v]].add(v)
        mine[got.get(v, ("alone", v))].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def shingles(text: str | None) -> frozenset:
    words = BLANK_WORD.findall(low(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a: str, b: str) -> float:
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def changed(words: list[str], n: int, rng: random.Random) -> str:
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_collapse_and_others_stay(spark):
    """A large group of near copies, its chains included, leaves one document; unlike texts stay."""
    rng = random.Random(9)
    base = prose(77, 300).split()
    texts = [changed(base, 3, rng) for _ in range(150)]
    for _ in range(100):
        texts.append(changed(texts[-1].split(), 3, rng))
    others = [prose(1000 + i, 200) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + others)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in sp.distinct_documents(df).collect()}
    assert kept & set(range(250)) == {0} and kept >= set(range(250, 290))


def test_pairs_are_linked_from_four_fifths_up(spark):
    """Pairs of texts of 200 words with 1 to 12 changed: none below 0.8 loses a document, nine of ten from 0.8 up do."""
    rng = random.Random(21)
    texts, above, below = [], [], []
    for i in range(800):
        words = prose(5000 + i, 200 if i % 4 else 40).split()
        one, two = " ".join(words), changed(words, rng.randrange(1, 13 if i % 4 else 4), rng)
        (above if jaccard(one, two) >= 0.8 else below).append(len(texts))
        texts += [one, two]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in sp.distinct_documents(df).collect()}
    assert len(above) > 150 and len(below) > 150
    assert all(i in kept and i + 1 in kept for i in below)
    close = [i for i in above if jaccard(texts[i], texts[i + 1]) < 0.85]
    for some in (above, close):
        assert sum(i + 1 not in kept for i in some) >= 0.9 * len(some)


def test_a_large_bucket_gives_a_tree():
    """Chains, each step near the last one only, among unlike members, in an order that breaks the chains."""
    rng, limit = random.Random(3), 48
    values = [rng.getrandbits(256) for _ in range(100)]
    for _ in range(4):
        v = rng.getrandbits(256)
        for _ in range(150):
            for bit in rng.sample(range(256), 30):
                v ^= 1 << bit
            values.append(v)
    rng.shuffle(values)
    fp = np.array([[v >> 64 * k & 2**64 - 1 for k in range(sp.PARTS)] for v in values], np.uint64)

    def groups(pairs):
        parent = list(range(len(values)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in pairs:
            x, y = sorted((find(i), find(j)))
            parent[y] = x
        return [find(i) for i in range(len(values))]

    one, two = sp.spanning_links(fp, np.full(len(values), 100), limit)
    found = list(zip(one.tolist(), two.tolist()))
    assert all((values[i] ^ values[j]).bit_count() <= limit for i, j in found) and len(found) > 500
    want = groups((i, j) for i, a in enumerate(values) for j in range(i) if (a ^ values[j]).bit_count() <= limit)
    assert groups(found) == want and len(found) == len(values) - len(set(want))


def test_a_hot_key_over_several_windows(spark, monkeypatch):
    monkeypatch.setattr(sp, "WINDOW", 16)
    rng = random.Random(4)
    base = prose(78, 60).split()
    texts = [changed(base, 1, rng) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    roots = {r["component_id"] for r in sp.similar_groups(df).collect()}
    linked = {i for i in range(200) if any(jaccard(texts[i], t) >= 0.8 for j, t in enumerate(texts) if j != i)}
    assert len(linked) > 150 and len(roots) <= 200 - 0.9 * len(linked) + 1


def test_no_similar_pair_of_a_bucket_is_left_out(spark, monkeypatch):
    """Proposals that leave nearly all pairs out; all sets that share a key and are similar end in one group still."""
    proposed = sp.proposed_links
    monkeypatch.setattr(sp, "proposed_links", lambda prints: proposed(prints, limit=0))
    rng = random.Random(5)
    base = prose(79, 60).split()
    texts = [changed(base, 2, rng) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    keys = {r["doc_id"]: set(r["keys"]) for r in sp._sketches(df, sp.WIDE_SHINGLE).collect()}
    least = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(least)
        for i, a in enumerate(texts):
            for j in range(i):
                if least[i] != least[j] and keys[i] & keys[j] and jaccard(a, texts[j]) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    assert len(set(least)) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in sp.similar_groups(df).collect()} == dict(enumerate(least))


def test_clashing_columns_stay(spark):
    texts = [prose(1, 50), prose(1, 50), prose(2, 50)]
    df = spark.createDataFrame([(i, t, -i, "x", "y") for i, t in enumerate(texts)],
                               "doc_id long, text string, lead_rows int, lead_id string, text_digest string")
    kept = sp.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(0, texts[0], 0, "x", "y"), (2, texts[2], -2, "x", "y")]


def test_distinct_odd_rows(odd):
    kept = sp.distinct_documents(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # 1, 2 and 3 have no words; 6 occurs twice and in 7; the row without id stays.
    assert ids == sorted([1, 4, 5, None, 6, 8, 9, 10, 11, 13, 14], key=str)


def test_components(spark):
    links = spark.createDataFrame([(5, 3), (3, 4), (9, 8), (8, 7), (7, 6), (2, 2), (None, 1), (4, 5), (4, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 6, 9: 6}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["root"] for r in components(chain).collect()} == {0}
