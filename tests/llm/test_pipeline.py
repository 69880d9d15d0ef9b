"""The pipeline's stages on the smallest tables, each held against its input."""

import re

import corpus_pipeline
from skilltrend.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark):
    docs, left = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()} if name != "best_fit_packing" else None
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            left[name] = (before, {r["doc_id"] for r in out.collect()})
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    before, kept = left["toxicity"]
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect() if r["doc_id"] in before}
    marked = {k for k, y in toxic.items() if y == 1}
    # Ten toxic rows teach little, so some go unnoticed; clean rows stay.
    assert marked and len(marked & kept) <= 0.5 * len(marked)
    assert not {k for k, y in toxic.items() if y == 0} - kept
    before, kept = left["exact_dedup"]
    content = lambda t: re.sub(r"[ \t-\r]", "", t or "")
    assert len(kept) == len({content(t) for t in before.values()}) == len({content(before[k]) for k in kept})
    before, kept = left["minhash_near_dedup"]
    sets = {k: shingles(t) for k, t in before.items()}
    for gone in set(before) - kept:
        assert any(5 * len(sets[gone] & sets[k]) >= 4 * len(sets[gone] | sets[k]) for k in before if k != gone)
    for a in kept:
        for b in kept:
            assert a == b or not sets[a] or 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])
    before, kept = left["benchmark_decontamination"]
    items = [" ".join(re.findall(r"[^\W_]+", r["text"].lower())) for r in table(spark, SF, "benchmark").collect()]
    for k, text in before.items():
        whole = " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
        assert not (k in kept and any(item in whole for item in items))
    assert corpus_pipeline.ORACLE_SQL is None


EXTRA = "body string, node int, _kept int, score double, label string, part int, number int, bin int, item_id long, n int"


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, clashing names, and no rows at all."""
    texts = [(1, None), (2, ""), (3, " \n"), (4, "word " * 20_000), (5, "a b c"), (5, "a b c"), (5, "a b c"), (None, "some words of a text"), (None, None)]
    texts += [(6, "one two three four five six"), (7, "one two three four five  six"), (8, "é" * 3000)]
    extra = ("b", 1, 2, 0.5, "l", 3, 4, 5, 6, 7)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
    rows = [(i, t, "en", "s", len(t or ""), *extra) for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    expected = {
        "toxicity": 12,
        # All texts without words are equal, and two that differ in blanks; rows that repeat an id stay together.
        "exact_dedup": 8,
        "minhash_near_dedup": None,
        "benchmark_decontamination": 12,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0 and nothing.columns == out.columns
        if name == "best_fit_packing":
            assert sum(r["piece"] == 0 for r in found) == 12 and sum(r["doc_id"] is None for r in found) == 2
            continue
        assert out.columns == docs.columns and all(tuple(r)[5:] == extra for r in found)
        if expected[name] is not None:
            assert len(found) == expected[name], name
    kept = dict(corpus_pipeline.STAGES)["minhash_near_dedup"](spark, docs, SF).collect()
    ids = [r["doc_id"] for r in kept]
    assert {1, 2, 3, 4, 8} <= set(ids) and ids.count(5) in (1, 3) and (6 in ids) != (7 in ids) and None in ids
