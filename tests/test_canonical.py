"""Similarity pairs and spelling groups against plain restatements."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.functions.similarity import common_subsequence, common_subsequences, comparison_key, similarity
from skilltrend.operators import canonical
from skilltrend.operators import components as component_rounds
from skilltrend.operators.canonical import apply_spelling_map, merge_spellings, similar_keys, spelling_map
from skilltrend.plans import checkpoints, stages
from skilltrend.plans.checkpoints import BROADCAST_CONF, MEASURED_BROADCAST_CONF, shared_folder


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for i, y in enumerate(b):
            last, row[i + 1] = row[i + 1], last + 1 if x == y else max(row[i], row[i + 1])
    return row[-1]


def plain_key(word, processor):
    return word if processor == "none" else re.sub(r"[^a-z0-9]", " ", word.lower()).strip()


def plain_score(a, b):
    return 200.0 * plain_lcs(a, b) / (len(a) + len(b))


def plain_map(words, processor, threshold=92):
    """One spelling after the other, each looking at all later free ones."""
    keys = {word: plain_key(word, processor) for word in words}
    order = sorted((w for w in set(words) if keys[w]), key=lambda w: (len(w), w))
    taken, merged = set(), {}
    for place, word in enumerate(order):
        if word in taken:
            continue
        taken.add(word)
        best = None
        for other in order[place + 1 :]:
            if other not in taken:
                score = plain_score(keys[word], keys[other])
                if best is None or score > best[0]:
                    best = (score, other)
        if best and round(best[0]) >= threshold:
            merged[best[1]] = word
            taken.add(best[1])
    return merged


def near_words(seed, count, length, alphabet="ab c+."):
    """Words that crowd around a few stems."""
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcdefgh", k=rng.randint(*length))) for _ in range(max(2, count // 12))]
    words = set()
    while len(words) < count:
        chars = list(rng.choice(stems))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars) + 1)
            if rng.random() < 0.5:
                chars.insert(at, rng.choice(alphabet))
            elif len(chars) > 3:
                chars.pop(min(at, len(chars) - 1))
        word = " ".join("".join(chars).split())
        if word:
            words.add(word)
    return sorted(words)


def as_column(spark, words, name="skill"):
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def computed_map(spark, words, **options):
    rows = spelling_map(as_column(spark, words), **options).collect()
    assert len({r["skill"] for r in rows}) == len(rows)
    return {r["skill"]: r["canonical"] for r in rows}


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 90))) for _ in range(2))
        assert common_subsequence(a, b) == plain_lcs(a, b)


def test_common_subsequences_of_many_pairs():
    rng = random.Random(4)
    lengths = [0, 1, 7, 8, 9, 16, 17, 32, 33, 63, 64, 65, 128, 130, 192, 200, 256, 257, 300]
    for letters in ("abcd", "aé€", "a€😀"):
        left, right = (["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(300)] for _ in range(2))
        assert common_subsequences(left, right).tolist() == [common_subsequence(a, b) for a, b in zip(left, right)]
    assert common_subsequences([], []).tolist() == [] and common_subsequences([""], ["a"]).tolist() == [0]


def test_similarity_and_key(spark):
    df = spark.createDataFrame(
        [("reactjs", "react js"), ("communication", "communications"), ("", "")], "a string, b string"
    )
    got = [round(r[0], 1) for r in df.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [93.3, 96.3, 100.0]
    df = spark.createDataFrame([("C++",), ("c#",), ("node.js",)], "w string")
    assert [r[0] for r in df.select(comparison_key(F.col("w"))).collect()] == ["c", "c", "node js"]
    with pytest.raises(ValueError):
        comparison_key(F.col("w"), "other")


@pytest.mark.parametrize(
    "threshold, pair_limit, length",
    [(92, 10**9, (20, 45)), (92, 0, (14, 20)), (91, 10, (5, 16)), (80, 2, (5, 14))],
)
def test_pairs_equal_brute_force(spark, threshold, pair_limit, length):
    words = near_words(1, 50, (5, 12)) + near_words(2, 70, length)
    got = {
        (r["key_a"], r["key_b"]): r["score"]
        for r in similar_keys(as_column(spark, words, "key"), threshold, pair_limit).collect()
    }
    want = {}
    for a, b in itertools.combinations(sorted(set(words), key=lambda w: (len(w), w)), 2):
        score = plain_score(a, b)
        if round(score) >= threshold:
            want[(a, b)] = score
    assert got == want and want


@pytest.mark.parametrize("threshold", [92, 80])
def test_long_keys_equal_brute_force(spark, threshold):
    # Lengths on both sides of the limit, runs that repeat, and keys that share most runs.
    words = near_words(7, 60, (20, 40)) + near_words(8, 12, (90, 120)) + ["ab" * k for k in (10, 12, 13, 30, 31, 40)]
    got = {(r["key_a"], r["key_b"]): r["score"] for r in similar_keys(as_column(spark, words, "key"), threshold, longest=25).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(set(words), key=lambda w: (len(w), w)), 2):
        score = plain_score(a, b)
        if round(score) >= threshold:
            want[(a, b)] = score
    assert got == want and any(len(b) > 25 >= len(a) for a, b in want) and any(len(a) > 60 for a, _ in want)


def test_short_keys_meet_only_where_similar(spark):
    # All share syllables, and so pieces; few are similar.
    rng = random.Random(8)
    keys = sorted({"".join(rng.choices(["an", "er", "ing", "tion", "é"], k=rng.randrange(2, 7))) for _ in range(400)})
    keys = [key for key in keys if len(key) <= 17]
    df = as_column(spark, keys, "key")
    assert not canonical._first_blocks(df, 92, 60)[0].where("distance <= 2").count()
    got = {(r[0], r[1]) for r in canonical._short_pairs(df, 92).collect()}
    ordered = sorted(keys, key=lambda key: (len(key), key))
    want = {(a, b) for a, b in itertools.combinations(ordered, 2) if 200 * common_subsequence(a, b) >= 91.5 * (len(a) + len(b))}
    assert got == want and want


def test_rows_of_a_very_long_key(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefghij ", k=5000))
    with canonical.Stages(spark) as stages:
        pairs = canonical._long_pairs(as_column(spark, [long, long[:-20], "x" * 70], "key"), 92, 60, 3, stages)
        assert [(len(r[0]), len(r[1])) for r in pairs.collect()] == [(4980, 5000)]
        kept = next(path for path in stages.open_folders() if "rarest-runs" in path)
        assert 0 < spark.read.parquet(kept).count() < 10_000
    assert not canonical._first_blocks(as_column(spark, [long], "key"), 92, 60)[0].count()


@pytest.mark.parametrize(
    "processor, task_rows", [("alnum", 0), ("none", 40)]
)
def test_map_equals_brute_force(spark, processor, task_rows):
    words = near_words(5, 120, (4, 14)) + near_words(50, 50, (18, 30))
    got = computed_map(spark, words, processor=processor, task_rows=task_rows)
    assert got == plain_map(words, processor) and got
    assert not set(got) & set(got.values()), "depth one"
    assert len(set(got.values())) == len(got), "each absorbs at most one"
    assert all(len(canonical) <= len(word) for word, canonical in got.items())


def test_crowded_group_of_one_key(spark):
    # Every word has the key "ab cd"; linked words come before and after it.
    marks = ["+", "#", ".", "++", "+#", "#+", "..", "##", ".+", "+.", "#.", ".#"]
    words = [f"abcdefg{a}hijkl{b}" for a in marks[:3] for b in marks] + ["abcdefg hijkl", "abcdefg hijk", "abcdefgh ijkl", "abcdefg hijklm"]
    want = plain_map(words, "alnum")
    assert len(want) > 15
    assert computed_map(spark, words, task_rows=0) == want
    assert computed_map(spark, words) == want


def plain_merges(names, scores):
    """The same order of events on given scores, one spelling after the other."""
    taken, merged = set(), {}
    for place, name in enumerate(names):
        if name in taken:
            continue
        near = [(-scores[name, other], at, other) for at, other in enumerate(names) if at > place and other not in taken and (name, other) in scores]
        if near:
            other = min(near)[2]
            taken.add(other)
            merged[other] = name
    return merged


@pytest.mark.parametrize("task_rows, round_rows, levels", [(100_000, 1, [95.0]), (0, 30, [95.0]), (0, 25, [93.0, 94.0, 95.0, 96.0]), (0, 1, [93.0, 95.0])])
def test_dense_family(spark, monkeypatch, task_rows, round_rows, levels):
    # All of a family are alike, so each spelling waits for those before it.
    size = 400 if round_rows > 1 or task_rows else 24
    rng = random.Random(6)
    names = [f"n{k:05d}" for k in range(size)]
    words = spark.createDataFrame([(n, n) for n in names], "skill string, key string")
    scores = {pair: rng.choice(levels) for pair in itertools.combinations(names, 2)}
    links = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "key_a string, key_b string, score double")
    rounds = []
    settle = canonical._settle_round
    monkeypatch.setattr(canonical, "_settle_round", lambda rows: rounds.append(1) or settle(rows))
    got = dict(tuple(r) for r in merge_spellings(words, links, task_rows, round_rows).collect())
    assert got == plain_merges(names, scores)
    # Whatever depends on what, a round settles as many spellings as it may.
    assert len(rounds) <= (0 if task_rows else -(-size // round_rows))


def test_sparse_component_settles_all_over(spark, monkeypatch):
    # One component with few links a spelling, some of one key: most turns wait for few others.
    rng = random.Random(12)
    names = [f"n{k:05d}" for k in range(300)]
    key = {name: name if k % 10 else names[k // 20 * 20] for k, name in enumerate(names)}
    keys = sorted(set(key.values()))
    pairs = {tuple(sorted((keys[k], keys[rng.randrange(k)]))) for k in range(1, len(keys))}
    pairs |= {tuple(sorted(rng.sample(keys, 2))) for _ in range(150)}
    links = {pair: rng.choice([93.0, 95.0]) for pair in pairs}
    scores = {(a, b): 100.0 if key[a] == key[b] else links.get(tuple(sorted((key[a], key[b])))) for a, b in itertools.combinations(names, 2)}
    scores = {pair: score for pair, score in scores.items() if score}
    blocks = []
    settle = canonical._settle_round
    monkeypatch.setattr(canonical, "_settle_round", lambda rows: blocks.append(1) or settle(rows))
    words = spark.createDataFrame([(n, key[n]) for n in names], "skill string, key string")
    table = spark.createDataFrame([(a, b, s) for (a, b), s in links.items()], "key_a string, key_b string, score double")
    got = dict(tuple(r) for r in merge_spellings(words, table, 40, 2).collect())
    assert got == plain_merges(names, scores)
    # Blocks of two spellings alone would take over fifty rounds.
    assert len(blocks) <= 3


def test_nothing_is_left_but_the_map(spark):
    folder = spark._jvm.java.io.File(shared_folder(spark).removeprefix("file:"))
    before = set(folder.list())
    computed_map(spark, near_words(5, 60, (4, 14)))
    assert [name.split("-")[0] for name in set(folder.list()) - before] == ["spelling"]


def planned(monkeypatch):
    """The plans, before they run, of whatever is staged from now on."""
    plans = []
    for module in (stages, component_rounds):
        write = module.staged_at
        monkeypatch.setattr(module, "staged_at", lambda df, name, write=write: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    return plans


def broadcast_settings(spark):
    return spark.conf.get(BROADCAST_CONF), spark.conf.get(MEASURED_BROADCAST_CONF, None)


def test_pairs_are_not_broadcast_by_bytes_of_files(spark, monkeypatch):
    # Some rows of a key on disk are hundreds once it is taken apart; the planner does not count them.
    before = broadcast_settings(spark)
    assert before[0] == "10485760b", "small files are broadcast if the planner may"
    plans = planned(monkeypatch)
    assert similar_keys(as_column(spark, near_words(11, 60, (14, 22)), "key")).count()
    pairs = next(plan for name, plan in plans if name == "pairs")
    assert pairs.count("SortMergeJoin") >= 4 and "Broadcast" not in pairs
    assert broadcast_settings(spark) == before
    with pytest.raises(Exception):
        similar_keys(as_column(spark, ["a"], "other"))
    assert broadcast_settings(spark) == before


def test_merging_is_not_broadcast_by_bytes_of_files(spark, monkeypatch):
    before = broadcast_settings(spark)
    plans = planned(monkeypatch)
    words = near_words(5, 60, (4, 14))
    assert computed_map(spark, words, task_rows=0) == plain_map(words, "alnum")
    assert {"links", "components", "settled", "spelling-map"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]
    assert broadcast_settings(spark) == before


def test_large_maps_are_not_broadcast(spark, monkeypatch):
    names = as_column(spark, ["a", "b", "c", None], C.raw_skills)
    mapping = spark.createDataFrame([("b", "a"), (None, "x")], "skill string, canonical string")
    # As read from a small file.
    mapping = checkpoints.staged(mapping, "map")
    for limit, kind in ((canonical.MAP_BYTES, "Broadcast"), (40, "SortMergeJoin")):
        monkeypatch.setattr(canonical, "MAP_BYTES", limit)
        named = apply_spelling_map(names, mapping)
        assert kind in named._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, named.collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    nothing = apply_spelling_map(names, mapping.limit(0))
    assert sorted(r[1] for r in nothing.collect()) == ["a", "b", "c"]


def test_stated_cases(spark):
    words = [
        "reactjs", "react js", "abcdefghijkl", "abcdefghijkx", "mnopqrstuvw", "mnopqrstuvx",
        "c#", "c++", "+", "#", "++",
        # Two match the first; the better one is absorbed, the other stays.
        "communication", "communications", "communicationxy",
        # A chain: the absorbed one absorbs nothing.
        "123456789012", "1234567890123", "123456789012345",
    ]
    want = {
        "react js": "reactjs",
        "abcdefghijkx": "abcdefghijkl",
        "communications": "communication",
        "1234567890123": "123456789012",
    }
    assert computed_map(spark, words, processor="none") == want
    assert computed_map(spark, words, processor="alnum") == {**want, "c++": "c#"}
