from __future__ import annotations

import numpy as np
from fixtures import ODD

from stackroom.llm import mixing


def water_fill(sizes: dict) -> dict:
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target


def judge(frame):
    sizes = frame.groupby("source", dropna=False)["size"].sum().to_dict()
    sizes = {None if s is None or s != s else s: int(n) for s, n in sizes.items()}
    want = water_fill(sizes)
    for source, own in frame.groupby("source", dropna=False):
        source = None if source is None or source != source else source
        assert (own.source_size == sizes[source]).all()
        assert np.allclose(own.target, want[source])
        assert abs(own.taken.sum() - want[source]) <= 128
    assert (frame.taken <= 2 * frame["size"]).all()


def test_targets_and_taken(documents):
    got = mixing.Mix(documents).taken().toPandas()
    judge(got)
    again = mixing.Mix(documents.repartition(5)).taken().toPandas()
    pair = got.merge(again, on="doc_id")
    assert len(pair) == len(got) and (pair.taken_x == pair.taken_y).all()


def test_odd_rows(odd):
    got = mixing.Mix(odd).taken().toPandas()
    assert len(got) == len(ODD)
    judge(got)


def test_source_without_words(spark, odd):
    void = spark.createDataFrame([(50, None, "en", "void", 0), (51, "", "en", "void", 0), (52, " \n", "en", "void", 2)],
                                 odd.schema.fieldNames()[:5])
    for table in (odd.select(void.columns).union(void), void):
        mix = mixing.Mix(table, keep_text=True)
        got = mix.taken().toPandas()
        judge(got)
        own = got[got.source == "void"]
        assert len(own) == 3 and (own.taken == 0).all() and (own.target == 0).all()
        assert mix.blocks().where("source = 'void'").count() == 0


def test_empty(empty):
    mix = mixing.Mix(empty, keep_text=True)
    assert mix.taken().count() == 0 and mix.blocks().count() == 0


def test_blocks_hold_what_taken_counts(odd):
    mix = mixing.Mix(odd, block_words=50, slots_per_shard=16, keep_text=True)
    blocks = mix.blocks().toPandas()
    assert blocks.n_words.sum() == mix.taken().toPandas().taken.sum()
    assert (blocks.n_words <= 50).all() and blocks.shard.nunique() > 1
    assert (blocks.text.str.split(" ").str.len() == blocks.n_words).all()
    assert not blocks.duplicated(["sid", "slot"]).any()


def test_permutation_is_one():
    for size in (1, 2, 3, 17, 1000):
        assert sorted(mixing._permuted(np.arange(size), size, 5).tolist()) == list(range(size))


def test_blocks_keep_no_second_copy_of_the_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mixing, "staged", lambda df, *how, inner=mixing.staged: (written.append(df.columns), inner(df, *how))[1])
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (1, "d e", "x"), (None, "f g", "y"), (None, "f g", None), (2, None, "y")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=2, slots_per_shard=4, keep_text=True)
    blocks = mix.blocks().collect()
    assert written and not any("text" in columns for columns in written)
    assert sum(r["n_words"] for r in blocks) == sum(r["taken"] for r in mix.taken().collect()) > 0
    streams = {r["source"]: {} for r in blocks}
    for r in blocks:
        streams[r["source"]][r["block"]] = r["text"].split(" ")
    whole = {s: sorted(w for ws in own.values() for w in ws) for s, own in streams.items()}
    assert whole == {"x": sorted("abcabcde"), "y": sorted("abcfg"), None: ["f", "g"]}
