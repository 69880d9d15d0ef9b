"""Fill-in-middle forms against the rule restated text by text."""

import hashlib
import random

import numpy as np
import pytest

from skilltrend.llm import fim
from skilltrend.llm.fim import fill_in_middle, restored

SCHEMA = "doc_id long, text string, output string, form int, drawn string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "o", 1, "d") for i, t in rows], SCHEMA)


def plain_form(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(seed, count):
    rng = random.Random(seed)
    letters = ["a", "é", "€", "😀", "<", ">", "P", "S", "<P", "M>", "\n", "<S>"]
    rows = [(k, "".join(rng.choices(letters[: rng.choice([6, 11, 12])], k=rng.randint(0, 30)))) for k in range(count)]
    edge = [(None, None), (None, "abc"), (-5, "neg"), (7, "again"), (7, "again"), (10**15, "<M>"), (901, ""), (902, None)]
    return rows + edge + [(1000 + k, "long é " * 30_000) for k in range(3)]


@pytest.mark.parametrize("size", [4 << 20, 64])
def test_forms_and_way_back(spark, monkeypatch, size):
    monkeypatch.setattr(fim, "BUFFER", size)
    rows = rows_of(1, 400)
    formed = fill_in_middle(table(spark, rows))
    got = [tuple(r) for r in restored(formed).collect()]
    expected = [(*plain_form(*row), row[1] or "") for row in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_buffers_equal_the_rule_text_by_text():
    rng = np.random.default_rng(3)
    for _ in range(200):
        texts = ["".join(rng.choice(list("aé<>PSM€"), rng.integers(0, 9))) for _ in range(rng.integers(1, 8))]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        drawn = rng.integers(0, 1 << 32, (len(texts), 4))
        out, out_bounds, form, points, _, _ = fim.scatter(data, bounds, drawn, 90, 20)
        assert points.tolist() == [len(t) for t in texts]
        back, back_bounds = fim.gather(out, out_bounds, form)
        assert back.tobytes() == data.tobytes() and back_bounds.tolist() == bounds.tolist()


def test_empty_table(spark):
    assert restored(fill_in_middle(table(spark, []))).count() == 0
