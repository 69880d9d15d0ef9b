"""Collocations against counters over all runs of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from skilltrend.llm import collocations as module
from skilltrend.llm.collocations import Trie, Words, collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, idx int, f string, count int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "p", 1, "f", 2) for k, (t, lang) in enumerate(rows)], SCHEMA)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least, longest, top, cover):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = [p for p, number in f.items() if number >= least and len(p) > 1]
        found = []
        for p in candidates:
            a = f[p]
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            inside = any(
                len(q) > len(p) and 100 * f[q] >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in candidates
            )
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, count):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "of", "É\x00", "a", "b", "été", " x", "is", "onhe"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.5:
            text = "New York  city the " * rng.randint(1, 3) + text
        rows.append((text, rng.choice(["en", "fr", None, "und", "e\nn", ""])))
    edge = [(None, "en"), ("", None), (" \t\n", "fr"), ("of the " * 30_000, "en"), ("x" * 50_000 + " y", "en"), ("new york", "only")]
    return rows + edge + [("same text again", "fr")] * 40


@pytest.mark.parametrize("small", [False, True])
def test_equals_counters(spark, monkeypatch, small):
    rows = corpus(1, 400)
    options = {}
    if small:
        for name, value in (("BUFFER", 300), ("HELD", 200), ("SLOTS", 3)):
            monkeypatch.setattr(module, name, value)
        options = {"trie_bytes": 400}
    got = collocations(table(spark, rows).repartition(3), least=12, top=25, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 12, 4, 25, 80)


def test_counts_above_a_byte(spark):
    rows = [("a b c. " * 150, "en"), ("a b " * 160, "en"), ("c d", "en")]
    got = collocations(table(spark, rows), least=300, longest=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 300, 3, 2000, 80)


def test_one_pass_whatever_the_number_of_tries(spark, monkeypatch):
    rows = corpus(2, 200)
    written = []
    write = module.staged_at
    monkeypatch.setattr(module, "staged_at", lambda df, name: written.append(name) or write(df, name))
    found, words = module.frequent_phrases(table(spark, rows), least=8, trie_bytes=50)
    assert written == ["candidates", "phrase-counts"]
    want, totals = {}, Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            own = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or ("und" if lang is None else "")] += len(own)
            for size in range(1, 5):
                for k in range(len(own) - size + 1):
                    key = ("und" if lang is None else lang, " ".join(own[k : k + size]))
                    want[key] = want.get(key, 0) + 1
    got = found.collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in got} == {key: f for key, f in want.items() if f >= 8} and len(got) > 50
    assert {r["lang"]: r["n"] for r in words.collect()} == {lang: n for lang, n in totals.items() if n}


def test_folds_of_any_size(spark, monkeypatch):
    # Runs are folded, cut out and counted a few at a time; tasks have several languages.
    rows = corpus(3, 120)
    for name, value in (("BUFFER", 60), ("FOLDED", 500), ("SLOTS", 2)):
        monkeypatch.setattr(module, name, value)
    data = np.frombuffer(b"a bc d\nxyz " * 40, np.uint8)
    starts, sizes = np.arange(0, 400, 11), np.full(37, 7)
    parts = list(module._cut_out(data, starts, sizes))
    assert len(parts) > 1 and [part.start for _, part in parts][1:] == [part.stop for _, part in parts][:-1]
    assert b"".join(flat.tobytes() for flat, _ in parts) == b"a bc d\n" * 37
    got = collocations(table(spark, rows).repartition(2), least=6, longest=5, top=40)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 6, 5, 40, 80)


def test_empty_table(spark):
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [("a b", "en")])).count() == 0


def test_trie():
    rng = random.Random(4)
    keys = sorted({bytes(rng.choices([0, 10, 97, 98, 255], k=rng.randint(1, 6))) for _ in range(300)})
    trie = Trie.of(keys)
    for k, key in enumerate(keys):
        assert trie.accept[trie.state(key)] == k
    for _ in range(2000):
        text = bytes(rng.choices([0, 10, 97, 98, 99, 255], k=rng.randint(1, 7)))
        at = trie.state(text)
        assert (at >= 0) == any(key.startswith(text) for key in keys)
        assert (at >= 0 and trie.accept[at] >= 0) == (text in keys)


def test_words():
    words = Words([b"A b,C", b"", b"  d\te"], ["x", "y", "x"])
    assert words.bytes.tobytes() == b"a b\nc\nd e\n"
    assert words.langs[words.lang].tolist() == ["x"] * 5
    assert len(np.unique(words.hashes())) == 5
    assert not len(Words([b""], ["x"]).hashes())
