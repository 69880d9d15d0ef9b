"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: each word in lower case and its first
four and five letters, so that inflected forms share a term. The machine adds a
weight for each term and, for each pair of terms, the product of their factor
vectors; a pair such as an insult with a group can so weigh more than its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import WORD_MEMORY, map_rows, texts

#: Term buckets; bucket 0 is the constant term.
BUCKETS = 1 << 18
FACTORS = 4
#: Labelled rows that a fit may use, of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Terms get weights if so many rows of the sample hold them, and if their shares
#: of toxic and other rows differ by so many standard errors.
LEAST_ROWS, TELLING = 3, 3.5
#: Of terms that tell nothing alone, the most frequent ones whose pairs are looked
#: at, and by how many standard errors a pair's shares must differ; there are half
#: a million pairs, so chance alone reaches five.
PAIRED, PAIR_TELLING = 1000, 7.0
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 1e-4

_WORD = re.compile(r"[^\W\d_]+")


class Terms(dict):
    """The buckets of a word, remembered up to a bound; with ``kept``, only those that it marks."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORD_MEMORY:
            self.clear()
        raw = [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]
        found = tuple(1 + xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in raw)
        if self.kept is not None:
            found = tuple(k for k in found if self.kept[k])
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: bytes) -> set[int]:
        words = set(_WORD.findall(text.decode("utf-8", "replace").lower()))
        return {0}.union(*map(self.__getitem__, words))


@dataclass
class FactorizationMachine:
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The raw score of each row; row k has ``terms[starts[k]:starts[k + 1]]``, of which there is at least one."""
        linear = np.add.reduceat(self.weights[terms], starts)
        own = self.factors[terms]
        sums, squares = np.add.reduceat(own, starts), np.add.reduceat(own * own, starts)
        return linear + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, terms: set[int]) -> float:
        at = np.fromiter(terms, np.int64, len(terms))
        return float(_logistic(self.margins(at, np.zeros(1, np.int64)))[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def telling_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which buckets get weights: those whose share of toxic rows differs from that of the others.

    So do terms that tell nothing alone but in company: two that stand together
    in another share of toxic rows than of others. All other terms are noise, of
    which a long text holds thousands. The constant term stays.
    """
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    toxic = np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y] or [np.zeros(0, int)]), minlength=BUCKETS)
    clean = np.bincount(np.concatenate([r for r, y in zip(rows, labels) if not y] or [np.zeros(0, int)]), minlength=BUCKETS)
    overall = (toxic + clean) / (n1 + n0)
    error = np.sqrt(np.maximum(overall * (1 - overall), 1e-12) * (1 / n1 + 1 / n0))
    kept = (toxic + clean >= LEAST_ROWS) & (np.abs(toxic / n1 - clean / n0) >= TELLING * error)
    kept[0] = True
    kept[_telling_pairs(rows, labels, np.where(kept, 0, toxic + clean))] = True
    return kept


def _telling_pairs(rows: list[np.ndarray], labels: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Terms, of the ``PAIRED`` ones with most ``uses``, that have a telling partner among them."""
    terms = np.argsort(-uses, kind="stable")[:PAIRED]
    terms = np.sort(terms[uses[terms] >= LEAST_ROWS])
    place = np.full(BUCKETS, -1)
    place[terms] = np.arange(len(terms))
    shares, sizes = [], []
    for label in (1, 0):
        own = [place[r] for r, y in zip(rows, labels) if y == label]
        both = np.zeros((len(terms), len(terms)), np.float32)
        for start in range(0, len(own), 1000):
            part = own[start : start + 1000]
            holds = np.zeros((len(part), len(terms) + 1), np.float32)
            holds[np.repeat(np.arange(len(part)), [len(r) for r in part]), np.concatenate(part)] = 1  # the last column takes all others
            both += holds[:, :-1].T @ holds[:, :-1]
        sizes.append(max(1, len(own)))
        shares.append(both / sizes[-1])
    overall = (shares[0] * sizes[0] + shares[1] * sizes[1]) / sum(sizes)
    error = np.sqrt(np.maximum(overall * (1 - overall), 1e-12) * (1 / sizes[0] + 1 / sizes[1]))
    telling = np.abs(shares[0] - shares[1]) >= PAIR_TELLING * error
    telling &= overall * sum(sizes) >= LEAST_ROWS
    np.fill_diagonal(telling, False)
    return terms[telling.any(axis=1)]


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, row_weights: np.ndarray, seed: int = 7) -> FactorizationMachine:
    """Logistic loss with weight decay, by AdaGrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    kept = telling_terms(rows, labels)
    rows = [r[kept[r]] for r in rows]
    model = FactorizationMachine(np.zeros(BUCKETS, np.float32), rng.normal(0, 0.01, (BUCKETS, FACTORS)).astype(np.float32))
    model.factors[~kept] = 0
    model.factors[0] = 0
    seen_w, seen_f = np.full(BUCKETS, 1.0, np.float32), np.full((BUCKETS, FACTORS), 1.0, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            own = [rows[k] for k in pick]
            sizes = np.array([len(r) for r in own])
            terms, starts = np.concatenate(own), np.r_[0, np.cumsum(sizes)[:-1]]
            error = (_logistic(model.margins(terms, starts)) - labels[pick]) * row_weights[pick]
            per = np.repeat(error, sizes).astype(np.float32)
            used, place = np.unique(terms, return_inverse=True)
            step = np.bincount(place, per) / len(pick) + DECAY * model.weights[used] * (used > 0)
            seen_w[used] += (step * len(pick)) ** 2
            model.weights[used] -= (RATE * step * len(pick) / np.sqrt(seen_w[used])).astype(np.float32)
            sums = np.repeat(np.add.reduceat(model.factors[terms], starts), sizes, axis=0)
            pull = per[:, None] * (sums - model.factors[terms])
            for k in range(FACTORS):
                step = np.bincount(place, pull[:, k]) + 0.1 * model.factors[used, k]
                seen_f[used, k] += step**2
                model.factors[used, k] -= (0.02 * step / np.sqrt(seen_f[used, k])).astype(np.float32) * (used > 0)
    return model


def _term_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    terms = Terms()
    for doc_id, text, toxic in rows:
        yield toxic, sorted(terms.of(text))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> FactorizationMachine:
    """A machine fitted on the labelled rows of ``docs``.

    At most about ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` rows are used, chosen by a hash of their
    id and weighted back to the share of their label (an id that repeats brings all its rows). Null labels are ignored;
    an id with several labels counts as toxic if one says so. With no labels
    every text scores 0.5.
    """
    marked = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
    marked = marked.groupBy(F.col(id_column).cast("long").alias("doc_id")).agg(F.max((F.col(label_column) == 1).cast("int")).alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limits = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    share = {k: min(1.0, limits[k] / total[k]) for k in total}
    cut = F.when(F.col("toxic") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0)))
    sample = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut * 1_000_000)
    # The sample is bounded by its construction, and so is what it is joined to.
    rows = texts(docs, id_column, text_column).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    out = pa.schema([("toxic", pa.int32()), ("terms", pa.list_(pa.int32()))])
    found = map_rows(rows, _term_rows, "toxic int, terms array<int>", out, 500).toArrow()
    if not found.num_rows:
        return FactorizationMachine(np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    y = found["toxic"].to_numpy()
    lists = found["terms"].combine_chunks()
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows_ = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    order = np.lexsort((np.array([len(r) for r in rows_]), np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows_], np.uint64)))
    prior = {k: total[k] / sum(total.values()) for k in total}
    here = {k: max(1, int((y == k).sum())) / len(y) for k in total}
    per_row = np.array([prior[int(k)] / here[int(k)] for k in y])
    return fit_machine([rows_[k] for k in order], y[order].astype(float), per_row[order])


def score_toxicity(docs: DataFrame, model: FactorizationMachine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) for each row.

    Null and empty texts hold the constant term only. Repeated rows score alike,
    further columns are ignored, and an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(rows: Iterator[tuple]) -> Iterator[tuple]:
        machine = held.value
        terms = Terms((machine.weights != 0) | machine.factors.any(axis=1))
        for doc_id, text in rows:
            value = machine.score(terms.of(text))
            yield doc_id, value, int(value >= 0.5)

    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    return map_rows(texts(docs, id_column, text_column), score, "doc_id long, score double, predicted int", out)


def without_toxic(docs: DataFrame, model: FactorizationMachine, limit: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are; null texts score as empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = held.value
        terms = Terms((machine.weights != 0) | machine.factors.any(axis=1))
        for batch in batches:
            yield pd.Series([machine.score(terms.of(text)) < limit for text in batch], dtype=bool)

    return docs.where(clean(F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))))
