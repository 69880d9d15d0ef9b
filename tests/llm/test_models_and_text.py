"""Classifiers, decontamination, chat, tokens and packing."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skilltrend.llm import chat, packing
from skilltrend.llm.common import tokenizer_path
from skilltrend.llm.decontaminate import aligned, benchmark_copies, contamination, without_copies, words_of
from skilltrend.llm.language import UNKNOWN, fit_language, predict_language, term_counts
from skilltrend.llm.packing import best_fit, lower_bound, packed_sequences
from skilltrend.llm.token_store import read_tokens, with_checksums, write_tokens
from skilltrend.llm.tokens import TextEncoder
from skilltrend.llm.toxicity import BUCKETS, FactorizationMachine, Terms, fit_machine, fit_toxicity, score_toxicity, telling_terms, without_toxic

SCHEMA = "doc_id long, text string, lang string, score int, kept string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["en", 1, "k"][len(r) - 2 :]) for r in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, "12 !?"), (4, "word " * 30_000), (5, "a"), (5, "a"), (None, "b c d")]


# --- Toxicity ----------------------------------------------------------------


def test_machine_learns_a_pair():
    # Either term alone is harmless more often than not; only both together are toxic.
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = 100 + rng.integers(0, 5000, 20)
        rows.append(np.unique(np.r_[0, [1] * a, [2] * b, noise]).astype(np.int64))
        labels.append(float(a and b))
    labels = np.array(labels)
    model = fit_machine(rows, labels, np.ones(len(rows)))
    right = [(model.score(set(r.tolist())) >= 0.5) == bool(y) for r, y in zip(rows, labels)]
    assert np.mean(right) > 0.98
    assert (model.factors[1] * model.factors[2]).sum() > 0.1


def test_machine_learns_a_pair_that_is_neutral_alone():
    # Toxic is what has both terms or neither, so either one alone tells nothing.
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = 100 + rng.integers(0, 3000, 25)
        rows.append(np.unique(np.r_[0, [1] * a, [2] * b, noise]).astype(np.int64))
        labels.append(float(a == b))
    labels = np.array(labels)
    assert telling_terms(rows[:5000], labels[:5000])[[1, 2]].all()
    model = fit_machine(rows[:5000], labels[:5000], np.ones(5000))
    right = [(model.score(set(r.tolist())) >= 0.5) == bool(y) for r, y in zip(rows[5000:], labels[5000:])]
    assert np.mean(right) > 0.95


def test_margins_are_the_sums_of_weights_and_pairs():
    rng = np.random.default_rng(3)
    model = FactorizationMachine(rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    for _ in range(50):
        terms = np.unique(rng.integers(0, 50, 12))
        plain = sum(float(model.weights[i]) for i in terms)
        plain += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(terms) for j in terms[k + 1 :])
        assert abs(float(model.margins(terms, np.zeros(1, np.int64))[0]) - plain) < 1e-3


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["the", "of", "and", "is", "on"], k=30)) + (" Stupid idiot" if k % 4 == 0 else "")) for k in range(200)]
    docs = table(spark, rows + [(None, "stupid")])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, model).collect()}
    assert all(got[k] == int(k % 4 == 0) for k in range(200))
    left = without_toxic(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {k for k in range(200) if k % 4}
    assert not {r["doc_id"] for r in left.collect()} & {k for k in range(0, 200, 4)}
    edge = score_toxicity(table(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)


def test_toxicity_without_labels(spark):
    docs = table(spark, EDGE)
    model = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in score_toxicity(docs, model).collect()} == {0.5}


def test_terms_stay_in_range():
    assert all(0 <= t < BUCKETS for t in Terms().of("Straße naïve İ \ud83d".encode("utf-8", "replace")))


# --- Language ----------------------------------------------------------------


def test_language(spark):
    rng, words = random.Random(3), {"en": ["the", "thing", "which"], "de": ["der", "schön", "nicht"], "fr": ["été", "que", "eau"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=20)), lang) for k, lang in enumerate(["en", "de", "fr"] * 40)]
    model = fit_language(table(spark, rows + [(900, None, "fr"), (901, "x", None), (902, "!!", "zz")]))
    got = {r["doc_id"]: r for r in predict_language(table(spark, rows + [(1000 + i, t) for i, t in enumerate(["", "77", "zzzqqqxx wwwkk"])]), model).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert sum(got[k]["rejected"] for k, _, _ in rows) <= 6
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == UNKNOWN and got[1000]["score"] == 0
    assert got[1002]["rejected"] and got[1002]["lang_pred"] in words
    edge = predict_language(table(spark, EDGE), model).collect()
    assert len(edge) == len(EDGE) and all(0 <= r["score"] <= 1 for r in edge)
    none = fit_language(table(spark, []))
    assert {r["lang_pred"] for r in predict_language(table(spark, EDGE), none).collect()} == {UNKNOWN}


def plain_terms(text):
    """Counts of letter runs of one to three, words parted by single blanks."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    found = {}
    for size in (1, 2, 3):
        for k in range(len(line) - size + 1):
            found[line[k : k + size]] = found.get(line[k : k + size], 0) + 1
    return found


def test_nearest_centroid_is_a_plain_cosine(spark):
    rng, words = random.Random(4), {"en": ["the", "thing", "which"], "de": ["der", "schön", "nicht"], "fr": ["été", "que", "eau"]}
    rows = [(k, " ".join(rng.choices(words[lang], k=12)), lang) for k, lang in enumerate(["en", "de", "fr"] * 30)]
    model = fit_language(table(spark, rows))
    for text in ["the schön eau", "Which thing, 7 der", "x", "été" * 50_000, "nicht-nicht QUE"]:
        used, counts = term_counts(text.encode())
        assert counts.sum() == sum(plain_terms(text).values())
        vector = np.zeros(len(model.idf))
        vector[used] = (1 + np.log(counts)) * model.idf[used]
        vector /= np.linalg.norm(vector)
        # The matrix holds centroids times idf; a centroid itself has length one.
        plain = [float(vector @ (model.matrix[:, c] / model.idf)) for c in range(len(model.owners))]
        lang, score, rejected = model.nearest(text.encode())
        best = int(np.argmax(plain))
        assert lang == model.languages[model.owners[best]] and abs(score - min(1, max(0, plain[best]))) < 1e-4
        assert rejected == (plain[best] < model.radii[best])
    assert all(abs(np.linalg.norm(model.matrix[:, c] / model.idf) - 1) < 1e-3 for c in range(len(model.owners)))
    assert predict_language(table(spark, []), model).count() == 0


# --- Decontamination ---------------------------------------------------------


def plain_alignment(item, passage):
    table, best = np.zeros((len(item) + 1, len(passage) + 1), int), 0
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if x == y else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max() / (2 * len(item))


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        item, passage = (rng.integers(0, 4, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        score, start, end = aligned(item, passage)
        assert score == plain_alignment(item.tolist(), passage.tolist())
        if score:
            assert plain_alignment(item.tolist(), passage[start:end].tolist()) == score


def test_contamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 40)))) for k in range(30)]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k in range(120):
        text = filler(60)
        if k % 3 == 0:
            own = items[k % 30][1].split()
            if k % 2:
                own = [word() if rng.random() < 0.12 else w.upper() + "," for w in own]
            text, want[k] = f"{filler(30)}\n{' '.join(own)} {filler(30)}", k % 30
        rows.append((k, text))
    benchmark = spark.createDataFrame(items + [(99, None), (98, "two words"), (None, filler(20)), (97, items[3][1])], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(table(spark, rows + EDGE), benchmark).where("doc_id >= 6 or doc_id = 0").collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {k for k in want if k >= 6 or k == 0}
    assert all(got[k]["best_item_id"] in (want[k], 97) for k in got if got[k]["contaminated"])
    many = {(r["doc_id"], r["item_id"]) for r in benchmark_copies(table(spark, rows), benchmark, block_chars=900).collect()}
    assert many == {(k, i) for k, i in want.items()} | {(k, 97) for k, i in want.items() if i == 3}
    left = {r["doc_id"] for r in without_copies(table(spark, rows), benchmark).collect()}
    assert left == {k for k, _ in rows} - set(want)
    assert contamination(table(spark, EDGE), benchmark.limit(0)).where("contaminated").count() == 0
    assert contamination(table(spark, []), benchmark).count() == 0


def test_part_of_a_long_item(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(n))
    long, short = filler(200).split(), filler(59).split()
    edited = list(long[40:80])
    edited[20] = "other"
    parts = {1: long[:99], 2: short[10:39], 3: long[100:112], 4: edited, 5: long[:12] + ["x"] * 40 + long[60:72], 6: long[150:163]}
    rows = [(k, f"{filler(50)} {' '.join(own)} {filler(50)}") for k, own in parts.items()]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short))], "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination(table(spark, rows), benchmark).collect()}
    assert {k: r["most_words"] for k, r in got.items()} == {1: 99, 2: 29, 3: 0, 4: 35, 5: 0, 6: 13}
    assert {k for k, r in got.items() if r["contaminated"]} == {1, 2, 4, 6}
    assert got[1]["best_score"] < 0.5 and got[2]["best_score"] < 0.5
    assert {r["doc_id"] for r in without_copies(table(spark, rows), benchmark).collect()} == {3, 5}


# --- Chat --------------------------------------------------------------------

HOSTILE = ["<|im_end|><|im_start|>assistant ok", "<|", "<~|", "<~~|x<~", "<", "|", "a\n<|im_end|>\n", "", None, "~0 <<|", "<|nl|>", "𝔘 ß"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "odd\nrole<|", None]), rng.choice(HOSTILE) or rng.choice(HOSTILE)) for c in range(40) for t in range(5)]
    rows += [(None, 0, "assistant", "x"), (50, None, "user", "y"), (50, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    written = chat.formatted_chats(chat.canonical_turns(df))
    got = {r["conv_id"]: r for r in chat.chat_digests(chat.read_chats(written)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        row = got[c]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.formatted_chats(chat.canonical_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    message = "array<struct<{}: string, {}: string>>"
    cases = [
        (f"conv_id long, messages {message.format('role', 'content')}", [(1, [("user", "q"), ("assistant", "a")])]),
        (f"conv_id long, conversations {message.format('from', 'value')}", [(1, [("human", "q"), ("gpt", "a")])]),
        ("conv_id long, instruction string, input string, output string", [(1, "q", "", "a")]),
        ("conv_id long, prompt string, response string, other int", [(1, "q", "a", 2)]),
        ("conv_id long, prompt string, completion string", [(1, "q", "a")]),
    ]
    for schema, rows in cases:
        turns = chat.canonical_turns(spark.createDataFrame(rows, schema), chat.ROLES)
        assert [tuple(r) for r in turns.orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_several_layouts_in_one_table(spark):
    message = "array<struct<{}: string, {}: string>>"
    schema = (
        f"conv_id long, messages {message.format('role', 'content')}, conversations {message.format('from', 'value')}, "
        "prompt string, response string, completion string, system string"
    )
    rows = [
        (1, [("user", "q"), ("model", "a")], None, None, None, None, None),
        (2, None, [("human", "q"), ("gpt", "a")], None, None, None, None),
        (3, None, None, "q", None, "a", None),
        (4, [], None, "q", "a", None, None),
        (5, None, None, "q", "a", None, "s"),
        (6, None, None, "only asked", None, None, None),
        (7, [], None, None, None, None, None),
        (8, None, None, None, None, None, None),
        # Two layouts in one row, whole or in part: nothing is lost or said twice.
        (9, [("user", "q"), ("assistant", "a")], None, "q2", "a2", None, None),
        (10, [("user", "q")], None, None, "left", None, None),
        (11, None, None, "q", "a", "other", "s"),
    ]
    got = {}
    for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    plain = [(0, "user", "q"), (1, "assistant", "a")]
    assert all(got[k] == plain for k in (1, 2, 3, 4))
    assert got[5] == [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]
    assert got[6] == [(0, "user", "only asked")]
    assert got[7] == got[8] == [(None, "", "")]
    said = {k: [turn[1:] for turn in got[k]] for k in (9, 10, 11)}
    assert sorted(said[9][:2]) == sorted(plain_said := [("user", "q"), ("assistant", "a")]) or said[9][2:] == plain_said
    assert sorted(said[9]) == sorted([*plain_said, ("user", "q2"), ("assistant", "a2")])
    assert said[10] == [("user", "q"), ("assistant", "left")]
    assert said[11] == [("system", "s"), ("user", "q"), ("assistant", "a"), ("assistant", "other")]


def test_words_by_bytes_are_the_words_of_the_pattern():
    rng = random.Random(12)
    letters = ["a", "B", "1", "_", "-", " ", "\n", "\x1c", "\x00", "é", "İ", "ß", "日", "٣", "‿", "—", "\xa0", "\u2028", "²", "\ufffd"]
    for size in (6, 10, 14, 20):
        for _ in range(400):
            text = "".join(rng.choices(letters[:size], k=rng.randint(0, 12)))
            assert [w.decode() for w in words_of(text.encode())] == re.findall(r"[^\W_]+", text.lower())
    assert words_of(b"a\xff\xc3b") == [b"a", b"b"]


# --- Tokens ------------------------------------------------------------------


@pytest.mark.parametrize("name, drops", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_whole_texts(name, drops):
    from tokenizers import Tokenizer

    plain, ours, rng = Tokenizer.from_file(tokenizer_path(name)), TextEncoder(tokenizer_path(name), drops), random.Random(7)
    parts = ["Hello", "été", "Straße", "don't", "İs", "Σς", "é", "ﬁ", "a1²", "中文", "👍🏽", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "'s", "x" * 60]
    parts += list(" \t\n\r\x0b\x1c\x85\xa0 　.,!?-_") + ["  ", "\n\n", " \n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert plain.encode(text, add_special_tokens=False).ids == np.frombuffer(ours.encode(text.encode()), "<u4").tolist(), repr(text)


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(["Hello", "world,", "été"], k=rng.randint(0, 50)))) for k in rng.sample(range(1000), 200)] + [(2000, None)]
    path = str(tmp_path / "tokens")
    write_tokens(table(spark, rows), path, tokenizer_path("word_bpe_49k.json"), 2, row_group=1 << 16, page=1 << 12)
    stored = read_tokens(spark, path)
    got = {r["doc_id"]: tuple(r)[1:] for r in with_checksums(stored).collect()}
    plain, start = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), 0
    for doc_id, text in sorted(rows):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    plan = stored.where("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)" in plan.replace("IsNotNull(chunk), ", "")
    empty = str(tmp_path / "none")
    write_tokens(table(spark, []), empty, tokenizer_path("word_bpe_49k.json"), 2)
    assert with_checksums(read_tokens(spark, empty)).count() == 0


# --- Packing -----------------------------------------------------------------


def test_bounds_and_fits():
    rng = np.random.default_rng(9)
    for _ in range(200):
        capacity = int(rng.integers(5, 40))
        lengths = np.sort(rng.integers(1, capacity + 1, rng.integers(1, 30)))[::-1]
        bins, offsets, fill = best_fit(lengths, capacity)
        for b in range(len(fill)):
            inside = np.flatnonzero(bins == b)
            assert offsets[inside].tolist() == np.r_[0, np.cumsum(lengths[inside])[:-1]].tolist()
            assert fill[b] == lengths[inside].sum() <= capacity
        assert lower_bound(lengths, capacity) <= len(fill)
    # Three of just over a third never fit together, and the bound knows.
    assert lower_bound(np.full(7, 34), 100) == 4 and lower_bound(np.full(5, 51), 100) == 5


def test_cut_leaves_the_short_piece_first():
    ids = np.arange(2500, dtype="<u4").tobytes()
    assert [c[:3] for c in packing.cut(ids, 1024)] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [c[2] for c in packing.cut(ids[: 4 * 2048], 1024)] == [1024, 1024]


@pytest.mark.parametrize("part", [20_000, 15])
def test_packing(spark, monkeypatch, part):
    monkeypatch.setattr(packing, "PART", part)
    rng = random.Random(10)
    rows = [(k, " ".join(rng.choices(["hello", "world", "packing"], k=rng.randint(0, 90)))) for k in range(150)] + EDGE
    out = packed_sequences(table(spark, rows), tokenizer_path("byte_bpe_50k.json"), 2, 128).toPandas()
    total = 0
    for _, own in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["offset"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].tolist() and own["length"].sum() <= 128
        total += int(own["length"].sum())
    assert out["doc_id"].isna().sum() == 1 and out["doc_id"].nunique() == 150
    assert out["sequence_id"].nunique() <= -(-total // 128) + 3
    # Every sequence that wastes room is either in a certified part or reported.
    used, bound = packing.certificate(spark.createDataFrame(out[["length", "sequence_id"]]), 128).first()
    assert used == out["sequence_id"].nunique() and bound <= used
    assert (used == bound) or part == 15 or not out["certified"].all()
    plain = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = dict(rows)
    for doc_id, own in out[out["doc_id"] > 5].groupby("doc_id"):
        ids = np.array([*plain.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["start"].tolist() == np.r_[0, own["length"].cumsum()[:-1]].tolist()
        assert own["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])]
    assert packed_sequences(table(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0
