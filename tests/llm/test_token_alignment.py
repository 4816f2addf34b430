from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import ODD

from stackroom.llm import token_alignment as ta
from stackroom.llm.queries import QUERIES

HARD = ["  two  blanks ", "a  b", "x\n y\t z", "\n\n after", "a ▁ b", "▁", "don't we'll I'm 's", "日本語 の　文", "é é", "<|endoftext|> x <s>",
        "\x00 \x01\x7f", "1234 56,78 ...!? #", "a" * 5000, " ", "tab\tand\r\nline", "end ", " wide  space", "👩‍👩‍👧 zwj", "a  b   c\n  d"]


@pytest.fixture(scope="module")
def by():
    return ta.Coders(open(ta.A_FILE, "rb").read(), open(ta.B_FILE, "rb").read())


def brute(texts: list[str | None], by):
    """Per text: ids of A and B encoded whole, groups by comparing sets of ends, links by walking both lists."""
    out, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = by.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = by.b.encode(text or "")
        if not text or b"".join(by.a_bytes[i] for i in a) != whole or b"".join(by.b_bytes[i] for i in b) != whole:
            out.append(None)
            continue
        ends = []
        for ids, table in ((a, by.a_bytes), (b, by.b_bytes)):
            at, own = 0, []
            for i in ids:
                at += len(table[i])
                own.append(at)
            ends.append(own)
        groups, low, high = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0].index(cut, low) + 1, ends[1].index(cut, high) + 1
            groups.append(",".join(map(str, a[low:i])) + "|" + ",".join(map(str, b[high:j])))
            low, high = i, j
        where = dict(zip(ends[1], b))
        links = [(i, where[e]) for i, e in zip(a, ends[0]) if e in where]
        counts.update(links)
        out.append((len(a), len(b), groups, links))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for got in out:
        if got is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = got
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows


def noise(seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "the", " ", "  ", "\n", ".", "é", "▁" if rng.random() < 0.02 else "z", "日", "'s", "9", " ", "\t", "Word", "ing"])
                   for _ in range(rng.randrange(60)))


def test_cut_texts_encode_like_whole_ones(by):
    assert by.cuts
    for text in HARD + [noise(s) for s in range(3000)]:
        stretches = by.stretches(text)
        assert " ".join(stretches) == text
        a = [i for s in stretches for i in by.a.encode(" " + s, add_special_tokens=False).ids]
        assert a == by.a.encode(" " + text, add_special_tokens=False).ids
        # The sign that stands for a blank in B doesn't give back its bytes, such texts have no tokens either way.
        assert "▁" in text or [i for s in stretches for i in by.b.encode(s)] == by.b.encode(text)
        assert " ".join(by.parts(text, 7)) == text


def test_pointer_jumping_labels_components():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        a, b = (np.array(sorted({*rng.integers(1, size + 1, rng.integers(1, 30)).tolist(), size})) for _ in range(2))
        a_label, b_label = ta.group_labels(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert [int(a[k]) for k in a_label] == [next(c for c in both if c >= e) for e in a]
        assert [int(a[k]) for k in b_label] == [next(c for c in both if c >= e) for e in b]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_brute_force(spark, documents, by):
    rows = documents.collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([r["text"] for r in rows], by)))
    frame = QUERIES["op11_token_alignment"].run(spark, "/root/testdata/sf0.001")
    assert frame.columns == ["doc_id", *FIELDS]
    assert {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in frame.collect()} == want


def test_odd_rows_and_rare_pairs(spark, by, odd, empty, monkeypatch):
    texts = [r[1] for r in ODD]
    want = sorted(w[:6] for w in brute(texts, by))
    for hot in (ta.HOT, 50, 1):
        got = ta.score(ta.align(odd), hot).collect()
        assert sorted(tuple(r[f] for f in FIELDS[:6]) for r in got) == want
    assert ta.score(ta.align(empty)).count() == 0
    hard = spark.createDataFrame([(str(i), t) for i, t in enumerate(HARD)], "doc_id string, text string").repartition(3)
    want = {str(i): w for i, w in enumerate(brute(HARD, by))}
    got = {r["doc_id"]: r for r in ta.score(ta.align(hard)).collect()}
    for i, w in want.items():
        assert tuple(got[i][f] for f in FIELDS[:6]) == w[:6], HARD[int(i)]
        assert (hashlib.sha256(got[i]["groups"].encode()).hexdigest() if got[i]["groups"] else "") == w[6]


def test_long_texts_in_parts(by, monkeypatch):
    monkeypatch.setattr(ta, "PART_CHARS", 100)
    monkeypatch.setattr(ta, "KEPT_CHARS", 300)
    text = " ".join(noise(s) for s in range(60)).replace("▁", "")
    whole, parts = ta._aligned([text], ta.Kept(), by), ta._long(text, ta.Kept(), by)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]
    assert all((x == y).all() for x, y in zip(whole[2], parts[2]))
    bad = ta._long(text + " ▁ " + text, ta.Kept(), by)
    assert bad[0][0, 4] == 0
