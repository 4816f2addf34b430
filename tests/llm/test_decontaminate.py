from __future__ import annotations

from fixtures import ALNUM_WORD, FOLDER, ODD, low, prose

from stackroom.llm import decontaminate as dc

ITEMS = [("x1", prose(2, 40)), ("x2", "the quiet river"), ("x2", "the quiet river"), (None, "past old mills"), ("x3", ""),
         ("x4", None), ("x5", "..."), ("x6", "same same"), ("x7", "neverseenword here")]


def brute(text: str | None, items: list[tuple], size: int = 13):
    words = ALNUM_WORD.findall(low(text))
    hit, found = set(), set()
    for item, own in items:
        w = ALNUM_WORD.findall(low(own))
        wins = [w[i:i + size] for i in range(max(1, len(w) - size + 1))] if w else []
        for win in wins:
            for i in range(len(words) - len(win) + 1):
                if words[i:i + len(win)] == win:
                    hit.update(range(i, i + len(win)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


def columns(r):
    return r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]


def test_equals_brute_force(spark, documents, rows):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {r["doc_id"]: columns(r) for r in dc.contamination(documents, items).collect()}
    assert got == {r["doc_id"]: brute(r["text"], pairs) for r in rows}
    assert any(c[3] for c in got.values())


def test_odd_rows_and_items(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id string, text string").repartition(2)
    short = [o for o in ODD if o[0] != 8]
    got = sorted(map(columns, dc.contamination(odd.where("doc_id IS NULL OR doc_id <> 8"), items).collect()))
    assert got == sorted(brute(t, ITEMS) for _, t, *_ in short)
    kept = dc.clean_documents(odd, items)
    assert kept.columns == odd.columns
    bad = {i for i, t, *_ in short if i is not None and brute(t, ITEMS)[3]}
    assert bad and {r["doc_id"] for r in kept.collect()} == {o[0] for o in ODD} - bad - {8} | (
        {8} if not brute(ODD[9][1], ITEMS)[3] else set())


def test_segments_and_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT_BYTES", 2000)
    items = [(i, prose(50 + i, 30)) for i in range(6)]
    docs = [prose(100 + i, 150) for i in range(30)]
    docs += [prose(200 + i, 60) + " " + " ".join(items[i % 6][1].split()[5:5 + 11 + i % 4]).upper() + ". " + prose(300 + i, 60)
             for i in range(24)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: columns(r) for r in dc.contamination(d, b).collect()}
    assert got == {i: brute(t, items) for i, t in enumerate(docs)}
    assert sum(c[3] for c in got.values()) >= 12


def test_matches_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c x d e"), (2, "a b c d e"), (3, "e d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    exact = {r["doc_id"]: [m["start"] for m in r["matches"]] for r in dc.find(docs, items).collect()}
    assert exact == {1: [], 2: [0], 3: []}
    near = {r["doc_id"]: bool(r["matches"]) for r in dc.find(docs, items, slop=1).collect()}
    assert near == {1: True, 2: True, 3: False}


def test_empty(spark, empty, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(empty, none).count() == 0
    got = dc.contamination(documents, none).collect()
    assert len(got) == documents.count() and not any(r["contaminated"] for r in got)
