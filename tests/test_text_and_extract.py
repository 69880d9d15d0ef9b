"""HTML, tokens, chunks and extraction."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skilltrend.columns import DEFAULT_COLUMNS as C
from skilltrend.functions.text import clean_token, decode_entities, entity_table, html_to_text, normal_word, normal_words, split_words, word_chunks, word_ngrams
from skilltrend.operators.extract import (
    DictionaryExtractor,
    ModelExtractor,
    add_text_id,
    attach_skills,
    distinct_texts,
    explode_skills,
    extract_skills,
    text_chunks,
)


def evaluate(spark, expression, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


@pytest.mark.parametrize("collapse", [False, True])
def test_html(spark, collapse):
    cases = {
        None: None,
        "": "",
        "a<b></b>c": "a c",
        'x<script>var t="</p>";</script>y': "x y",
        "<style>p{}</style>z<br>": "z",
        "<!-- n -->z": "z",
        "<!DOCTYPE html><p>q</p>": "q",
        "R&amp;D &copy;": "R&D ©",
        "R&amp D": "R& D",
        "&amp;lt;": "&lt;",
        "&#65;&#x42;&eacute;": "ABé",
        "a &unknown b && c": "a &unknown b && c",
        '<a title="1 > 2">t</a>': "t",
        "1 < 2 > 0": "1 < 2 > 0",
        "<p></p>": "",
    }
    got = evaluate(spark, lambda c: html_to_text(c, collapse), cases)
    assert got == list(cases.values())


def test_references(spark):
    cases = {
        "&#128;&#x80;&#129;&#0;&#xD800;&#x110000;&#12345678;": "€€\x81\ufffd\ufffd\ufffd\ufffd",
        "&CounterClockwiseContourIntegral;&NotEqualTilde;&copysr;": "∳≂̸℗",
        "&in &in; &copy &copyx; &apos &Copy;": "&in ∈ © &copyx; ' &Copy;",
        "&": "&", "&;": "&;", "&&amp;&": "&&&", "& amp;": "& amp;",
    }
    assert evaluate(spark, decode_entities, cases) == list(cases.values())


def test_every_name_is_found_and_the_table_is_one_literal(spark):
    names = sorted(entity_table())
    got = evaluate(spark, decode_entities, [f"<&{name};>" for name in names])
    assert got == [f"<{entity_table()[name]}>" for name in names]
    plans = spark.createDataFrame([("a",)], "x string").select(decode_entities(F.col("x")))._jdf.queryExecution()
    cut = [plan.toString().count("str_to_map(split(") for plan in (plans.analyzed(), plans.optimizedPlan())]
    assert cut[1] < cut[0]


def test_html_long_tags_do_not_overflow(spark):
    page = "<p " + "a='b' " * 20000 + ">x</p>" + "<br>" * 20000 + "y"
    assert evaluate(spark, html_to_text, [page]) == ["x y"]


def test_tokens(spark):
    cases = {
        "##Java": "java", "C++": "c++", "C#": "c#", "node.js": "node.js", "c": None, "42": None,
        "-a": None, "": None, None: None, "1 2": "1 2", "bachelor ' s degree": "bachelor s degree",
        "- a": "a", "- 42": "42", "4 2": "4 2", "é": None, " x\ty ": "x y", "42\n-": "42",
    }
    assert evaluate(spark, clean_token, cases) == list(cases.values())


def test_chunks(spark):
    for count, want in [(0, 0), (1, 1), (300, 1), (301, 2), (601, 3)]:
        words = [f"w{i}" for i in range(count)]
        (chunks,) = evaluate(spark, word_chunks, ["  ".join(words)])
        assert len(chunks) == want
        assert " ".join(chunks).split() == words
    assert evaluate(spark, word_chunks, [None]) in ([None], [[]])


def test_ngrams(spark):
    (got,) = evaluate(spark, lambda c: word_ngrams(split_words(c), 3), ["a b c a b"])
    assert sorted(got) == sorted({"a", "b", "c", "a b", "b c", "c a", "a b c", "b c a", "c a b"})
    (got,) = evaluate(spark, lambda c: word_ngrams(split_words(c), 4), ["a"])
    assert got == ["a"]


def texts(spark, values):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], f"{C.serial} string, {C.text} string")
    return add_text_id(df)


def load_model():
    def model(chunk):
        return [{"entity_group": "HSKILL" if w.lstrip("#")[0].isupper() else "LOC", "word": w} for w in chunk.split(" ")]

    return model


def by_serial(df):
    return {r[C.serial]: r[C.raw_skills] for r in df.collect()}


def test_model_extraction_joins_back(spark):
    values = ["Java and Sql", "Java and Sql", "none here", None, "Go ##Rust Java " + "x " * 700 + "Scala"]
    postings = texts(spark, values)
    assert distinct_texts(postings).count() == 3
    assert text_chunks(distinct_texts(postings)).count() == 1 + 1 + 3
    for partitions in (None, 3):
        found = extract_skills(distinct_texts(postings), ModelExtractor(load_model, partitions))
        tagged = attach_skills(postings, found)
        assert by_serial(tagged) == {
            "0": ["java", "sql"], "1": ["java", "sql"], "2": [], "3": None,
            "4": ["go", "java", "rust", "scala"],
        }
    assert explode_skills(tagged).groupBy(C.serial).count().count() == 3


def load_counting_model():
    import os
    import uuid

    name = f"HSKILL {os.getpid()} {uuid.uuid4().hex}"
    return lambda chunk: [{"entity_group": name, "word": chunk}]


def test_model_is_loaded_once_per_worker(spark):
    chunks = text_chunks(distinct_texts(texts(spark, [f"text {i}" for i in range(40)])))
    extractor, seen = ModelExtractor(load_counting_model, 6), set()
    for _ in range(2):
        seen |= {r["entity_group"] for r in extractor(chunks).collect()}
    assert len(seen) == len({name.split()[1] for name in seen})


@pytest.mark.parametrize("max_words", [None, 2])
def test_dictionary_extraction(spark, max_words):
    phrases = spark.createDataFrame(
        [("java", "HSKILL"), ("(Machine  Learning)", "HSKILL"), ("c++", "HSKILL"), ("oslo", "LOC"), ("node.js", "HSKILL")],
        "phrase string, entity_group string",
    )
    rng = random.Random(1)
    filler = [rng.choice(["the", "oslo", "work"]) for _ in range(299)]
    values = [
        "Java, (Machine Learning) in Oslo.", "C++; node.js. javascript", "nothing",
        # The phrase lies across the border of two chunks and is missed.
        " ".join([*filler, "machine", "learning"]),
    ]
    postings = texts(spark, values)
    extractor = DictionaryExtractor(phrases, max_words=max_words)
    got = by_serial(attach_skills(postings, extract_skills(distinct_texts(postings), extractor)))
    assert got == {"0": ["java", "machine learning"], "1": ["c++", "node.js"], "2": [], "3": []}


def test_long_phrases_are_found_or_refused(spark):
    phrases = spark.createDataFrame([("natural language processing tools", "HSKILL")], "phrase string, entity_group string")
    postings = texts(spark, ["Knows natural language processing tools."])
    found = attach_skills(postings, extract_skills(distinct_texts(postings), DictionaryExtractor(phrases)))
    assert by_serial(found) == {"0": ["natural language processing tools"]}
    with pytest.raises(ValueError):
        DictionaryExtractor(phrases, max_words=3)(text_chunks(distinct_texts(postings)))


def _says(chunk):
    return [{"entity_group": "HSKILL", "word": word} for word in chunk.split()]


def test_model_takes_chunks_at_once(spark):
    postings = texts(spark, ["java sql", "oslo", "rust"])
    sizes = [None, 1, 2, 50]
    results = [
        by_serial(attach_skills(postings, extract_skills(distinct_texts(postings), ModelExtractor(
            (lambda: lambda chunks: [_says(c) for c in chunks]) if size else (lambda: _says), batch_size=size))))
        for size in sizes
    ]
    assert all(r == {"0": ["java", "sql"], "1": ["oslo"], "2": ["rust"]} for r in results)


def test_references(spark):
    cases = {
        "don&#146;t &#150; &#x80;": "don\u2019t \u2013 \u20ac",
        "C&num; &plus; node&period;js": "C# + node.js",
        "&#00000000000000000065;&#x0041;": "AA",
        "&#0;&#x110000;&#99999999999999999999;": "\ufffd\ufffd\ufffd",
        "&notit; &in x &amp x &nosuch;": "&notit &in x & x &nosuch",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", html_to_text(F.col("x"))).collect()}
    assert got == cases


def test_text_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("<p>a b</p>",)], "x string")
    plan = df.select(clean_token(F.col("x")), word_chunks(html_to_text(F.col("x"))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text


def test_long_phrases_by_their_rarest_pair(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(60)]
    long = " ".join(rng.choices(vocabulary, k=200))
    texts += [f"x {long} y", long, long[:-3], ""]
    found = {" ".join(t.split()[k : k + n]) for t in texts[:40] for n in (1, 2, 3, 5, 9) for k in range(0, max(0, len(t.split()) - n), 11)}
    phrases = sorted(found | {long, "w1 w1 w1", "w2, W3 w4!"}) + [long]
    table = spark.createDataFrame([(p, g) for p in phrases for g in ("HSKILL", "SSKILL")[: 1 + len(p) % 2]], "phrase string, entity_group string")
    df = add_text_id(spark.createDataFrame([(t,) for t in texts], f"{C.text} string"))
    chunks = text_chunks(distinct_texts(df), 300)
    extractor = DictionaryExtractor(table)
    plain = [re.sub(r"[,!]", "", p.lower()) for p in phrases]
    ids = {r[C.text]: r[C.text_id] for r in df.collect()}
    want = {(ids[t], p) for t in set(texts) for p in set(plain) if f" {p} " in f" {t} "}
    got = {(r[C.text_id], r["word"]) for r in extractor(chunks).collect()}
    assert got == want and (ids[long], long) in want
    # The rows that chunks are broken into do not depend on the longest phrase.
    assert "200" not in str(extractor(chunks)._jdf.queryExecution().optimizedPlan()).split("Generate")[1][:2000]
    with pytest.raises(ValueError, match="200 words"):
        DictionaryExtractor(table, max_words=10)(chunks)


def test_words_of_a_text_at_once(spark):
    rng = random.Random(3)
    signs = "aB.,-+#!(ΣσİéЖ9_ \t\n\u2003\x1c\x85'\U0001d538"
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)] + [None, "", " . ", "(.)a", "-.+#."]
    df = spark.createDataFrame([(text,) for text in texts], "t string")
    one_by_one = F.array_remove(F.transform(split_words(F.col("t")), normal_word), "")
    assert not df.where(~one_by_one.eqNullSafe(normal_words(F.col("t")))).count()
