"""Benchmark passages in documents: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark comes in blocks of bounded size, each sent to all tasks, and every
block is held against all documents. A first pass counts in how many documents
each three-word run of the items occurs. A run is a seed unless it is in many
more documents than the rarest of the runs around it: turns of phrase drop out,
but an item keeps its seeds however often it was copied. A second pass finds the
seeds in each text and aligns the item with the words around. A passage counts
by its share of the item, or by its own length if it is copied closely.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import map_rows, mixed, texts
from skilltrend.plans.checkpoints import staged

#: Words of a run, runs that are compared with each other, and how many times
#: as many documents as the rarest of them a seed may be in.
GRAM, WINDOW, COMMON = 3, 6, 4
#: Benchmark characters of one block.
BLOCK_CHARS = 2_000_000
#: Share of an item's highest alignment score from which a passage counts as a copy.
COPIED = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words from which a close copy counts whatever its share of the item, and what
#: an edited, added or left out word takes off them.
COPIED_WORDS, EDITED = 13, 4

_WORD = re.compile(r"[^\W_]+")
# What ends a word and is not ASCII; without any, bytes tell the words.
_ODD_BREAK = re.compile(r"[^\x00-\x7f\w]")
_BREAKS = bytes(b if b > 127 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: runs of letters and digits in lower case."""
    if text.isascii():
        return text.lower().translate(_BREAKS).split()
    lowered = text.decode("utf-8", "replace").lower()
    if _ODD_BREAK.search(lowered):
        return [word.encode() for word in _WORD.findall(lowered)]
    return lowered.encode().translate(_BREAKS).split()


class Vocabulary(dict):
    """Hashes of the words of one block of items; every other word is 0."""

    def add(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        for word in words:
            if word not in self:
                self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return np.array([self[word] for word in words], np.uint64)

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.get, words, repeat(0)), np.uint64, len(words))


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of ``GRAM`` words that are all in the vocabulary."""
    number = max(0, len(words) - GRAM + 1)
    known = np.ones(number, bool)
    for k in range(GRAM):
        known &= words[k : k + number] != 0
    places = np.flatnonzero(known)
    total = np.zeros(len(places), np.uint64)
    for k in range(GRAM):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[places + k])
    return places, total


def _ends(item: np.ndarray, passage: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[int, int]:
    """The best local alignment's score and the place after its last word in ``passage``."""
    slope = -gap * np.arange(len(passage), dtype=np.int64)
    row, best, end = np.zeros(len(passage), np.int64), 0, 0
    for word in item:
        diagonal = np.r_[0, row[:-1]] + np.where(passage == word, match, mismatch)
        row = np.maximum(np.maximum(diagonal, row + gap), 0)
        # Gaps along the passage: the best cell to the left, less its distance.
        row = np.maximum.accumulate(row + slope) - slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at + 1
    return best, end


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: share of the highest score, first word and the one after the last."""
    best, end = _ends(item, passage)
    if not best:
        return 0.0, 0, 0
    _, back = _ends(item[::-1], passage[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def close_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Words of the closest copy of a part of the item: at most over all alignments, equal words less ``EDITED`` for each other one."""
    return _ends(item, passage, 1, -EDITED, -EDITED)[0]


class Seeds:
    """The seeds of one block of items, each with the places where items hold it."""

    def __init__(self, vocabulary: Vocabulary, item_ids: list[int], items: list[np.ndarray], counts: dict[int, int]) -> None:
        self.vocabulary, self.item_ids, self.items = vocabulary, item_ids, items
        found: list[tuple[int, int, int]] = []
        own = [runs(item)[1].tolist() for item in items]
        shared: dict[int, int] = {}
        for listed in own:
            for run in set(listed):
                shared[run] = shared.get(run, 0) + 1
        for k, listed in enumerate(own):
            rank = np.array([counts.get(r, 0) + shared[r] for r in listed], np.int64)
            around = [int(rank[max(0, at - WINDOW // 2) : at + WINDOW // 2 + 1].min()) for at in range(len(rank))]
            found += [(listed[at], k, at) for at in range(len(rank)) if rank[at] <= COMMON * around[at]]
        found.sort()
        self.keys, starts = np.unique(np.array([f[0] for f in found], np.uint64), return_index=True)
        self.bounds = np.r_[starts, len(found)].astype(np.int64)
        self.places = np.array([f[1:] for f in found], np.int64).reshape(-1, 2)

    def copies(self, text: bytes, least: float, least_words: int = COPIED_WORDS) -> Iterator[tuple[int, float, int, int, int]]:
        """Item id, score, close words, first word and the one after the last, for each item that the text copies: its best copy."""
        words = self.vocabulary.of(text)
        hits, found = runs(words)
        if not len(found) or not len(self.keys):
            return
        at = np.searchsorted(self.keys, found)
        at[at == len(self.keys)] = 0
        same = self.keys[at] == found
        hits, at = hits[same], at[same]
        if not len(hits):
            return
        first, last = self.bounds[at], self.bounds[at + 1]
        sizes = last - first
        spread = np.repeat(first - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
        item, offset = self.places[spread, 0], self.places[spread, 1]
        begin = np.repeat(hits, sizes) - offset
        order = np.lexsort((begin, item))
        item, begin = item[order], begin[order]
        # A passage ends where the next seed lies more than an item's length on.
        lengths = np.array([len(i) for i in self.items], np.int64)[item]
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(begin) > lengths[:-1])) + 1
        best: dict[int, tuple[float, int, int, int]] = {}
        for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(item)].tolist()):
            k, length = int(item[a]), int(lengths[a])
            low, high = max(0, int(begin[a]) - length // 2 - 2), int(begin[b - 1]) + length + length // 2 + 2
            score, start, end = aligned(self.items[k], words[low:high])
            # A score below that of so many equal words leaves no room for a close copy of as many.
            if score < least and score * MATCH * length < MATCH * least_words - 1e-6:
                continue
            close = close_words(self.items[k], words[low:high])
            if (score >= least or close >= least_words) and (score, close) > best.get(k, (0.0, 0))[:2]:
                best[k] = score, close, low + start, low + end
        for k, (score, close, start, end) in sorted(best.items()):
            yield self.item_ids[k], score, close, start, end


def _char_span(text: bytes, start: int, end: int) -> tuple[int, int]:
    spans = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace").lower())]
    return spans[start][0], spans[end - 1][1]


def benchmark_copies(
    docs: DataFrame,
    benchmark: DataFrame,
    least: float = COPIED,
    block_chars: int = BLOCK_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_words: int = COPIED_WORDS,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``score``, ``start_char``, ``end_char``, ``words``: the best passage of each document and item it copies.

    Words are runs of letters and digits in lower case. A passage is a copy if
    its alignment has at least ``least`` of the score that the whole item would
    have, so edited words and gaps lower the score, or if some part of it is a
    close copy: ``words``, its equal words less ``EDITED`` for each other one,
    are at least ``least_words``, however long the item. Items with a null id or
    fewer than three words match nothing; null and empty texts hold nothing;
    repeated items are each reported. ``start_char`` and ``end_char`` are places
    in the text in lower case. No item or no document gives no row.
    """
    rows = texts(docs, id_column, text_column)
    out = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("words", pa.int64())]
    )
    schema = "doc_id long, item_id long, score double, start_char long, end_char long, words long"
    found = docs.sparkSession.createDataFrame([], schema)
    for seeds in seed_blocks(rows, benchmark, block_chars):

        def match(rows: Iterator[tuple], seeds=seeds) -> Iterator[tuple]:
            for doc_id, text in rows:
                for item_id, score, close, start, end in seeds.value.copies(text, least, least_words):
                    yield doc_id, item_id, score, *_char_span(text, start, end), close

        found = found.union(map_rows(rows, match, schema, out))
    return found


def seed_blocks(rows: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Broadcast]:
    """The seeds of each block of the benchmark, sent to all tasks; ``rows`` are those whose runs are counted."""
    spark = rows.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        words = Vocabulary()
        held = [(r["item_id"], words.add(bytes(r["text"]))) for r in part]
        held = [h for h in held if len(h[1]) >= GRAM]
        if held:
            counts = document_counts(rows, words, np.unique(np.concatenate([runs(h[1])[1] for h in held])))
            yield spark.sparkContext.broadcast(Seeds(words, [h[0] for h in held], [h[1] for h in held], counts))


def _copies_nothing(seeds: Broadcast, least: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([not any(seeds.value.copies(text, least)) for text in batch], dtype=bool)

    return clean


def without_copies(docs: DataFrame, benchmark: DataFrame, least: float = COPIED, block_chars: int = BLOCK_CHARS, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts copy no item, all columns as they are; null texts copy nothing."""
    plain = docs.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"))
    for seeds in seed_blocks(plain, benchmark, block_chars):
        clean = _copies_nothing(seeds, least)
        docs = docs.where(clean(F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))))
    return docs


def document_counts(rows: DataFrame, vocabulary: Vocabulary, wanted: np.ndarray) -> dict[int, int]:
    """In how many texts each of the ``wanted`` runs (sorted hashes of one block of items) occurs; others are absent."""
    held = rows.sparkSession.sparkContext.broadcast((vocabulary, wanted))

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        words, known = held.value
        total = np.zeros(len(known), np.int64)
        for _, text in rows:
            own = np.unique(runs(words.of(text))[1])
            if len(own):
                at = np.searchsorted(known, own)
                at[at == len(known)] = 0
                total[at[known[at] == own]] += 1
        for k in np.flatnonzero(total).tolist():
            yield k, int(total[k])

    out = pa.schema([("run", pa.int64()), ("n", pa.int64())])
    counted = map_rows(rows, count, "run long, n long", out).groupBy("run").agg(F.sum("n").alias("n"))
    return {int(wanted[r["run"]]): r["n"] for r in counted.collect()}


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = COPIED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``contaminated``, ``n_items``, ``best_item_id``, ``best_score``, ``most_words``.

    ``most_words`` is the largest ``words`` of any item. A document without
    copies has no items, a null best item, score 0 and no words. Rows
    that repeat an id share the findings of that id; a null id is one such id.
    """
    # Copies are few and narrow; written once, they are joined without searching again.
    copies = staged(benchmark_copies(docs, benchmark, least, id_column=id_column, text_column=text_column), "copies")
    best = copies.groupBy(F.col("doc_id").alias("own_id")).agg(
        F.countDistinct("item_id").alias("n_items"),
        F.max(F.struct("score", (-F.col("item_id")).alias("item"))).alias("best"),
        F.max("words").alias("words"),
    )
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"))
    return ids.join(best, F.col("doc_id").eqNullSafe(F.col("own_id")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        (-F.col("best.item")).alias("best_item_id"),
        F.coalesce("best.score", F.lit(0.0)).alias("best_score"),
        F.coalesce("words", F.lit(0).cast("long")).alias("most_words"),
    )
