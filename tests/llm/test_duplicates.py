"""Exact, near, byte-string and paragraph duplicates against plain restatements."""

import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltrend.llm import common, exact_dedup, minhash, suffix_dedup
from skilltrend.llm.exact_dedup import exact_duplicates, grace, without_exact_duplicates
from skilltrend.llm.minhash import near_duplicates, similar, without_near_duplicates
from skilltrend.llm.paragraph_dedup import document_digest, paragraph_duplicates, tuned_bands, without_paragraphs
from skilltrend.llm.suffix_dedup import SuffixOrder, longest_factors, without_repeats
from skilltrend.plans.checkpoints import shared_folder, staged

# Names that the operators use inside, too.
CLASHING = "body string, node int, kept string, label string, key int, spans string, _kept int"
SCHEMA = f"doc_id long, text string, {CLASHING}"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "k", "l", 2, "s", 3) for i, t in rows], SCHEMA)


def edge_rows():
    long = "word " * 30_000
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (5, "a"), (None, "a b"), (None, None), (7, long), (8, long + "x"), (9, "ÀÉ   ß")]


class Roots(dict):
    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self[max(a, b)] = min(a, b)


# --- Exact -------------------------------------------------------------------


def plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        content = (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")
        groups[content].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for content, own in groups.items():
        best = min(own)
        out += [(o[3], best[3], len(own), o == best, hashlib.sha256(content).hexdigest()) for o in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes", [64 << 20, 300])
def test_exact_equals_brute_force(spark, table_bytes):
    rng = random.Random(1)
    rows = edge_rows() + [(100 + k, rng.choice(["ab", "a b", "a\tb ", "abc", "x" * rng.randint(1, 40)])) for k in range(200)]
    got = [tuple(r) for r in exact_duplicates(table(spark, rows), table_bytes=table_bytes).collect()]
    assert sorted(got, key=str) == plain_exact(rows)


def test_grace_spills_and_ends():
    # Equal hashes, unequal contents: only complete contents tell them apart.
    entries = [(b"\0" * 32, b"c%d" % (k % 50), k, 1, 1) for k in range(500)]
    found = list(grace(entries, max_bytes=700))
    assert sorted(f[1] for f in found) == sorted({e[1] for e in entries}) and all(f[4] == 10 for f in found)
    assert {f[2] for f in found} == set(range(50))


def test_exact_filter_keeps_columns(spark):
    df = table(spark, edge_rows())
    left = without_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [3, 4, 7, 8, 9]
    assert without_exact_duplicates(df.limit(0)).count() == 0


# --- Near --------------------------------------------------------------------


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))


def plain_near(rows, size, percent):
    sets, roots = [shingles(t, size) for _, t in rows], Roots()
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                roots.join(a, b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[roots.top(k)] = min(doc_id, least.get(roots.top(k), doc_id))
    return sorted(((d, len(sets[k]), least.get(roots.top(k)) if sets[k] else d) for k, (d, _) in enumerate(rows)), key=str)


def copies(seed, families, each, words):
    rng, rows = random.Random(seed), []
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(each):
            own = list(base)
            for _ in range(rng.randint(0, words // 16)):
                own[rng.randrange(words)] = f"e{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("size, percent, small", [(3, 85, False), (5, 80, True)])
def test_near_equals_brute_force(spark, monkeypatch, size, percent, small):
    if small:  # several blocks, and buckets beyond one task
        monkeypatch.setattr(minhash, "BLOCK", 8)
        monkeypatch.setattr(minhash, "BUCKET", 4)
        monkeypatch.setattr(minhash, "LEADER_SHARE", 5)
    rows = copies(3, 3, 40, 90) + copies(4, 20, 2, 60)
    rows = [(1000 + k, t) for k, (_, t) in enumerate(rows)] + edge_rows()
    want = plain_near(rows, size, percent)
    got = [tuple(r)[:3] for r in near_duplicates(table(spark, rows), size, percent).collect()]
    assert sorted(got, key=str) == want
    assert len({w[2] for w in want}) < len(want) - 40


def test_near_filter(spark):
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (3, ""), (4, None), (5, "x")]
    left = without_near_duplicates(table(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5]
    assert without_near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 40, rng.integers(0, 40)).astype(np.uint64)) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        assert similar(a, b, 50) == bool(x and y and 2 * len(x & y) >= len(x | y))


# --- Byte strings ------------------------------------------------------------


def plain_repeats(texts, length, keep_first):
    places = defaultdict(list)
    for t, text in enumerate(texts):
        for k in range(len(text) - length + 1):
            places[text[k : k + length]].append((t, k))
    covered = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for t, k in sorted(found)[1:] if keep_first else found:
                covered[t][k : k + length] = True
    return covered


def test_longest_previous_factors():
    rng = random.Random(5)
    for _ in range(60):
        line = np.array([rng.randint(0, 1) for _ in range(rng.randint(1, 50))])
        got = longest_factors(SuffixOrder(line, 64))
        for k in range(len(line)):
            best = 0
            for j in range(k):
                n = 0
                while k + n < len(line) and line[j + n] == line[k + n]:
                    n += 1
                best = max(best, n)
            assert got[k] == best


@pytest.mark.parametrize("keep_first, crowded", [(False, 40_000), (True, 40_000), (False, 1), (True, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, keep_first, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng, length = random.Random(7), 60
    base = ["".join(rng.choices("abcdé", k=rng.randint(60, 300))) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "q" * 500), (4, "q" * 59)]
    for k in range(24):
        text = ""
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(base)
            a = rng.randint(0, len(part))
            text += part[a : rng.randint(a, len(part))] + "".join(rng.choices("xyz", k=rng.randint(0, 9)))
        rows.append((10 + k, text))
    data = [(t or "").encode() for _, t in rows]
    found = {r["doc_id"]: r for r in without_repeats(table(spark, rows), length, keep_first).collect()}
    for (doc_id, _), text, covered in zip(rows, data, plain_repeats(data, length, keep_first)):
        row = found[doc_id]
        assert bytes(row["kept"]) == np.frombuffer(text, np.uint8)[~covered].tobytes()
        runs = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(text), int(covered.sum()), runs)


def test_anchors_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(8)
    data = ["".join(rng.choices("ab", k=rng.choice([0, 3, 59, 60, 61, 700]))).encode() for _ in range(40)] + [b"q" * 300]
    want, begin = [], 0
    for text in data:
        places, hashes = suffix_dedup.anchors([text], 60)
        want += zip((places + begin).tolist(), hashes.tolist())
        begin += len(text)
    for stride in (100, 1 << 16):
        monkeypatch.setattr(suffix_dedup, "STRIDE", stride)
        suffix_dedup._powers.cache_clear()
        places, hashes = suffix_dedup.anchors(data, 60)
        assert list(zip(places.tolist(), hashes.tolist())) == want
    suffix_dedup._powers.cache_clear()


def test_repeats_leave_only_their_spans(spark):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = [(k, f"{'abcdefghij' * 30} {k} {'x' * k}") for k in range(20)]
    assert all(r["n_removed"] >= 300 for r in without_repeats(table(spark, rows)).collect())
    assert {name.split("-")[0] for name in set(os.listdir(folder)) - before} == {"spans"}


def test_repeats_on_edge_rows(spark):
    found = without_repeats(table(spark, edge_rows()))
    assert found.count() == len(edge_rows())
    assert without_repeats(table(spark, edge_rows()).limit(0)).count() == 0


# --- Paragraphs --------------------------------------------------------------


def test_paragraphs_equal_brute_force(spark):
    rows = copies(9, 12, 6, 40)
    rows = [(k // 2, None) for k in ()] + [(k, f"{rows[k][1]}\nshort line\n\n{rows[(k * 7) % 72][1]}\n") for k in range(72)] + [(100, None), (101, "")]
    places, sets = [], []
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if len(line.split()) >= 8:
                places.append((doc_id, k, len(line.split())))
                sets.append(shingles(line, 5))
    roots = Roots()
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                roots.join(a, b)
    want = {d: [0, 0, 0, set()] for d, _ in rows}
    for k, (doc_id, _, words) in enumerate(places):
        want[doc_id][0] += 1
        if roots.top(k) != k:
            want[doc_id][1] += 1
            want[doc_id][2] += words
            want[doc_id][3].add(places[roots.top(k)][0])
    df = table(spark, rows)
    found = paragraph_duplicates(df).persist()
    got = {r[0]: [r[1], r[2], r[3], set(r[4])] for r in document_digest(found).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 50
    cut = {r["doc_id"]: r["text"] for r in without_paragraphs(df, found).collect()}
    assert cut[100] is None and cut[101] == ""
    assert all("short line" in cut[k] for k in range(72)) and len(cut[0].split("\n")) == 5 - want[0][1]
    assert paragraph_duplicates(df.limit(0)).count() == 0


def plain_passages(rows, length=51):
    """Source of each word that lies in a later copy of ``length`` words."""
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        words = text.lower().split()
        own = out[doc_id] = [None] * len(words)
        for k in range(len(words) - length + 1):
            source = first.setdefault(tuple(words[k : k + length]), (doc_id, k))
            for w in range(k, k + length) if source != (doc_id, k) else ():
                own[w] = source[0] if own[w] is None else own[w]
    return out


def test_passages_inside_and_over_lines(spark):
    rng = random.Random(12)
    filler = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    passage = filler(54).split()
    rows = [
        (1, f"{filler(40)} {' '.join(passage)} {filler(30)}"),
        (2, f"{filler(30)} {' '.join(passage).upper()} {filler(60)}\n{filler(9)}"),
        (3, f"{filler(20)}\n{filler(3)} {' '.join(passage[:20])}\n{' '.join(passage[20:26])}\n\n{' '.join(passage[26:])} é {filler(20)}"),
        (4, f"{filler(40)} {' '.join(passage[:50])} {filler(40)}"),
        (5, f"{filler(70)} {' '.join(passage[3:])}"),
    ]
    base = [filler(rng.randint(60, 150)).split() for _ in range(4)]
    for k in range(40):
        text = ""
        for _ in range(rng.randint(1, 3)):
            part = rng.choice(base)
            a = rng.randint(0, 40)
            text += f"{' '.join(part[a : rng.randint(a, len(part))])} {filler(40)} "
        rows.append((10 + k, text))
    rows += [(90, "again " * 70 + filler(60))]
    want = plain_passages(rows)
    found = paragraph_duplicates(table(spark, rows)).persist()
    lines = found.where("paragraph >= 0 and removed").count()
    assert lines == 0
    got = {r[0]: (r[3], set(r[4])) for r in document_digest(found).collect()}
    assert got == {d: (sum(s is not None for s in own), {s for s in own if s is not None}) for d, own in want.items()}
    assert [got[k] for k in (1, 2, 3, 4, 5)] == [(0, set()), (54, {1}), (54, {1}), (0, set()), (51, {1})]
    cut = {r["doc_id"]: r["text"] for r in without_paragraphs(table(spark, rows), found).collect()}
    for doc_id, text in rows:
        assert cut[doc_id].split() == [w for w, s in zip(text.split(), want[doc_id]) if s is None]
        assert cut[doc_id].count("\n") == text.count("\n")


def test_staged_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {os.path.basename(f) for f in manager.getAllFiles().mkString("\n").split("\n")}
    made = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    before = files()
    counts = staged(made, "counts")
    assert not {name for name in files() - before if name.startswith("shuffle_")}
    assert counts.count() == 10


def test_words_of_many_texts_at_once(monkeypatch):
    monkeypatch.setattr(common, "BUNDLE", 100)
    rng = random.Random(6)
    parts = ["a", "A", "b\0", "é", "É", " ", "\n", "\t\r\x0b\x0c", "long" * 20, "Long" * 20 + "x", "\x1c", "\x85"]
    data = ["".join(rng.choices(parts, k=rng.randint(0, 60))).encode() for _ in range(60)] + [b""]
    words, by_word = common.words_of(data), {}
    for k, text in enumerate(data):
        own = slice(words.bounds[k], words.bounds[k + 1])
        found = [text[a - words.offsets[k] : b - words.offsets[k]].lower() for a, b in zip(words.starts[own], words.ends[own])]
        assert found == text.lower().split()
        for word, value in zip(found, words.hashes[own].tolist()):
            assert by_word.setdefault(word, value) == value
    assert len(set(by_word.values())) == len(by_word) > 30
    assert not len(common.words_of([]).hashes)


def test_bands_reach_the_recall():
    for percent in (50, 80, 95):
        bands, rows = tuned_bands(percent, most_slots=200)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-4


def test_fold_survives_a_full_table():
    rows = [(k, b"x %d" % (k % 7), 3) for k in range(70)]
    parts = list(exact_dedup._fold(1)(iter(rows)))
    assert sum(p[4] for p in parts) == 70
