from __future__ import annotations

import re
from collections import Counter

import numpy as np
from fixtures import FOLDER, ODD
from pyspark.sql import DataFrame

from stackroom.llm import quality


def base(text: str | None):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, repeated = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            repeated.update((i, i + 1, i + 2))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated))


def columns(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_base_columns_and_labels(spark, documents, rows):
    want = {r["doc_id"]: base(r["text"]) for r in rows}
    got = quality.judge(documents).collect()
    assert len(got) == len(rows)
    for r in got:
        assert columns(r) == want[r["doc_id"]]
        n = r["n_words"]
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    judged = [r for r in got if r["doc_id"] in label and not r["base_failed"]]
    assert np.mean([r["kept"] == (label[r["doc_id"]] == 1) for r in judged]) > 0.95


def test_odd_rows(odd):
    got = quality.judge(odd).collect()
    assert sorted(map(columns, got)) == sorted(base(t) for _, t, *_ in ODD)
    assert [r["kept"] for r in got if r["n_words"] == 0] == [False] * 3


def test_no_reference_judges_by_the_base_rule(odd, empty):
    from pyspark.sql import functions as F

    got = quality.judge(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert quality.judge(empty).count() == 0


def test_rare_languages_are_judged_alike_in_any_corpus(spark, documents):
    """Languages under a thousandth of the words: one with a reference of its own, one with too few words for it."""
    from pyspark.sql import functions as F

    low, text = "abcdefghijklmnopqrstuvwxyz", F.lower("text")

    def turned(lang: str, by: int, name: str | None, n: int) -> DataFrame:
        return documents.where(F.col("lang") == lang).orderBy("doc_id").limit(n).select(
            "doc_id", F.translate(text, low, low[by:] + low[:by]).alias("text"), F.lit(name).cast("string").alias("lang"))

    own = turned("fr", 5, "rare", 100).union(turned("es", 9, "tiny", 4)).union(turned("de", 13, None, 1))
    strange = turned("de", 13, None, 1).first()["doc_id"]
    rest = documents.where("lang = 'en'").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang")
    for corpus in (own, own.union(rest.crossJoin(spark.range(250).select()))):
        got = {r["doc_id"]: r for r in quality.judge(corpus).where("doc_id < 1000").collect()}
        got = {i: r for i, r in got.items() if not r["base_failed"]}
        assert len(got) > 20
        # Without a language it is judged by all references, and far from them.
        assert [i for i, r in got.items() if not r["kept"]] == [strange]


def test_common_words_are_complete(documents, rows):
    """Every word with the share of its language is found, and at most 2 / share are."""
    from stackroom.llm.textarrays import prefix_sums, span_hashes

    found = {(r["lang"], r["word"]) for r in quality.common_words(documents).collect()}
    counts, totals = Counter(), Counter()
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), r["text"].encode()))
        counts.update((r["lang"], w) for w in words)
        totals[r["lang"]] += len(words)
    for (lang, word), n in counts.items():
        if n >= quality.SHARE * totals[lang]:
            data = np.frombuffer(word, np.uint8)
            h = span_hashes(prefix_sums(data), np.array([0]), np.array([len(data)])).view(np.int64)[0]
            assert (lang, int(h)) in found
    assert max(Counter(lang for lang, _ in found).values()) <= 2 / quality.SHARE


def test_common_words_do_not_depend_on_the_layout(documents, rows):
    """Exactly the words with the share, however the rows are cut."""
    counts, totals = Counter(), Counter()
    for r in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), r["text"].encode()))
        counts.update((r["lang"], w) for w in words)
        totals[r["lang"]] += len(words)
    want = Counter(lang for (lang, _), n in counts.items() if n >= quality.SHARE * totals[lang])
    sets = [{(r["lang"], r["word"]) for r in quality.common_words(d).collect()}
            for d in (documents.coalesce(1), documents.repartition(40, "doc_id"))]
    assert sets[0] == sets[1] and Counter(lang for lang, _ in sets[0]) == want


def test_distance_by_hand():
    d = quality.js_distance(np.array([[1.0, 1.0], [2.0, 0.0]]), np.array([5.0, 5.0]))
    m = (np.array([1.0, 0.0]) + 0.5) / 2
    want = np.sqrt((np.log2(1 / m[0]) + 0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2)
    assert np.allclose(d, [0, want])
