"""Repeated byte strings, found with longest-previous-factor arrays.

A corpus-wide suffix array would need every byte in one place. Here, each window
of ``length`` bytes picks the half as long run of bytes in it with the smallest
hash. Equal windows pick equal runs at equal places, so all copies of a window
meet at the hash of its run, its anchor, and only anchors that occur twice
matter. What surrounds an anchor on either side, as far as a window can reach,
is its context. Equal contexts are all copies of each other; the distinct ones
of an anchor are aligned, and a suffix array over them gives for each place the
longest match with an earlier and with a later context.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import bitmap_of, in_bitmap, likely, map_bundles, map_rows, mixed, repeated_hashes, texts
from skilltrend.plans.stages import Stages

LENGTH = 200
#: Bytes of texts whose windows are looked at at once.
STRIDE = 1 << 16
#: Contexts that one suffix array holds, and contexts of an anchor from which its
#: windows are counted one by one instead, over all tasks.
TOGETHER, CROWDED = 1000, 8000

_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values."""
    pick = np.minimum if least else np.maximum
    size = 1
    while 2 * size <= width:
        values = pick(values[: len(values) - size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


@functools.lru_cache(2)
def _powers(size: int) -> list[np.ndarray]:
    """Powers, from 0 on, of an odd number and of its inverse."""
    odd = 0x9E3779B97F4A7C15
    return [np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)]) for base in (odd, pow(odd, -1, 1 << 64))]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash, never 0, of each run of ``gram`` bytes, from the sums of all bytes before its ends."""
    powers, inverses = _powers(STRIDE + 2 * gram)
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * inverses[: len(data)])]
    runs = mixed((total[gram:] - total[: len(total) - gram]) * powers[: len(data) - gram + 1])
    return np.maximum(runs, np.uint64(1))


def anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that windows of the texts pick; all of equal least hashes are picked.

    Places count the bytes of all texts, one after the other; no window reaches over the end of its text.
    """
    data, width = np.frombuffer(b"".join(texts), np.uint8), length - gram_size(length) + 1
    ends = np.cumsum([len(t) for t in texts])
    places, hashes = [], []
    windows = len(data) - length + 1
    for start in range(0, max(0, windows), STRIDE):
        many = min(STRIDE, windows - start)
        grams = _gram_hashes(data[start : start + many + length - 1], length - width + 1)
        # A run is picked if it is the least of some window over it: of those, the greatest least.
        around = np.zeros(many + 2 * (width - 1), np.uint64)
        low = around[width - 1 : width - 1 + many]
        low[:] = _sliding(grams, width, least=True)
        for end in ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, start + many + length)].tolist():
            low[max(0, end - length + 1 - start) : max(0, end - start)] = 0
        picked = np.flatnonzero(_sliding(around, width, least=False) == grams)
        places.append(picked + start)
        hashes.append(grams[picked])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def gram_size(length: int) -> int:
    """Bytes of an anchor: half a window. Shorter ones would meet in lines that are too short to matter, longer ones be too many."""
    return length // 2


def reach(place: int, size: int, length: int = LENGTH) -> tuple[int, int]:
    """First byte and byte after the last that windows over the anchor at ``place`` can reach."""
    return max(0, place - (length - gram_size(length))), min(size, place + length)


class SuffixOrder:
    """Suffix order of ``symbols`` up to ``depth`` of them, by doubling; ties stay in text order.

    ``packed``, if given, orders runs of ``width`` symbols from the start and
    saves the first turns; places with no whole run must have a value of their own.
    """

    def __init__(self, symbols: np.ndarray, depth: int, packed: np.ndarray | None = None, width: int = 1) -> None:
        self.symbols, self.size, self.widths = symbols, len(symbols), [width]
        _, rank = np.unique(symbols if packed is None else packed, return_inverse=True)
        self.ranks = [rank.astype(np.int32) + 1]
        while 2 * width <= depth:
            _, rank = np.unique(self._joined(width), return_inverse=True)
            self.ranks.append(rank.astype(np.int32) + 1)
            width *= 2
            self.widths.append(width)
        self.order = np.argsort(self._joined(depth - width), kind="stable")

    def _joined(self, shift: int) -> np.ndarray:
        """The last rank of each place and of the one ``shift`` further, as one number."""
        after = np.zeros(self.size, np.int64)
        if shift < self.size:
            after[: self.size - shift] = self.ranks[-1][shift:]
        return self.ranks[-1].astype(np.int64) * (self.size + 2) + after

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` have in common, told apart up to the depth."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        steps = [*zip(self.widths[::-1], self.ranks[::-1]), *[(1, self.symbols)] * (self.widths[0] - 1)]
        for width, values in steps:
            inside = (a < self.size) & (b < self.size)
            same = np.zeros(len(a), bool)
            same[inside] = values[a[inside]] == values[b[inside]]
            step = same * width
            total, a, b = total + step, a + step, b + step
        return total


def _nearest_smaller(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each in its group (a run), -1 if none, by pointer jumping."""
    before = np.arange(-1, len(values) - 1)
    before[np.r_[True, groups[1:] != groups[:-1]]] = -1
    open_ = np.flatnonzero(before >= 0)
    while True:
        at = before[open_]
        open_ = open_[(at >= 0) & (values[at] > values[open_])]
        if not len(open_):
            return before
        before[open_] = before[before[open_]]


def longest_factors(suffixes: SuffixOrder, previous: bool = True, among: np.ndarray | None = None) -> np.ndarray:
    """For each place, the longest match with a suffix that starts before it (or after it).

    It is the longer of the matches with the nearest suffixes on either side in
    suffix order that start before (or after) the place; those with another
    first symbol match in nothing. ``among`` marks the places that count.
    """
    order, best = suffixes.order, np.zeros(suffixes.size, np.int64)
    if among is not None:
        order = order[among[order]]
    for way in (1, -1):
        line = order[::way]
        near = _nearest_smaller(line if previous else -line, suffixes.symbols[line])
        has = near >= 0
        best[line[has]] = np.maximum(best[line[has]], suffixes.common(line[has], line[near[has]]))
    return best


def repeated(contexts: list[tuple[int, int, bytes]], length: int = LENGTH) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Spans of each context that windows shared with any other, and with an earlier one, cover.

    A context is its anchor's number, the anchor's place in it, and its bytes.
    Symbols tell anchor and place apart, so only windows that lie alike around
    equal anchors match: a window never matches itself by way of another anchor.
    """
    sizes = np.array([len(c[2]) for c in contexts], np.int64) + 1
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    # A stop after each context; it, and runs that reach it, equal nothing.
    data = np.frombuffer(b"".join(c[2] + b"\0" for c in contexts), np.uint8).astype(np.int64)
    place = np.arange(len(data))
    column = place - np.repeat(starts, sizes) - np.repeat(np.array([c[1] for c in contexts], np.int64), sizes) + length
    lane = np.repeat(np.array([c[0] for c in contexts], np.int64), sizes) * (2 * length) + column
    to_stop = np.repeat(starts + sizes - 1, sizes) - place
    symbols = np.where(to_stop > 0, lane * 256 + data, -1 - place)
    ahead = np.r_[data, np.zeros(3, np.int64)]
    word = (ahead[:-3] << 24) | (ahead[1:-2] << 16) | (ahead[2:-1] << 8) | ahead[3:]
    packed = np.where(to_stop >= 4, (lane << 32) | word, -1 - place)

    suffixes = SuffixOrder(symbols, length, packed, 4)
    roomy = to_stop >= length
    previous = longest_factors(suffixes, True, roomy) >= length
    either = previous | (longest_factors(suffixes, False, roomy) >= length)
    return _spans(either, starts, length), _spans(previous, starts, length)


def _spans(found: np.ndarray, starts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each context, from its start on, the union of the windows that begin at marked places."""
    out: list[list[tuple[int, int]]] = [[] for _ in starts]
    places = np.flatnonzero(found)
    if len(places):
        owner = np.searchsorted(starts, places, "right") - 1
        new = np.r_[True, (np.diff(places) > length) | (np.diff(owner) != 0)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, len(places) - 1]
        own = owner[first]
        for k, low, high in zip(own.tolist(), (places[first] - starts[own]).tolist(), (places[last] - starts[own] + length).tolist()):
            out[k].append((low, high))
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal runs of a set of spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], ends[np.r_[np.flatnonzero(new)[1:] - 1, len(ends) - 1]]


# A document is known by its id and a checksum of its text, so rows may repeat an
# id. An occurrence packs the checksum and the place into one number.
_LOW = (1 << 32) - 1


def _checksum(text: bytes) -> int:
    return zlib.crc32(text) >> 1


def _occurrences(length: int, sent: Broadcast):
    """The occurrences of all anchors that come twice, and of few others."""

    def occurrences(bundle: list[tuple]) -> list[np.ndarray]:
        bundle = [row for row in bundle if len(row[1]) >= length]
        places, hashes = anchors([text for _, text in bundle], length)
        several = in_bitmap(sent.value, hashes)
        places, hashes = places[several], hashes[several]
        sizes = np.array([len(text) for _, text in bundle], np.int64)
        ends = np.cumsum(sizes)
        owner = np.searchsorted(ends, places, "right")
        place, size = places - (ends - sizes)[owner], sizes[owner]
        starts, ends = np.maximum(0, place - (length - gram_size(length))), np.minimum(size, place + length)
        contexts = [
            xxhash.xxh3_64_intdigest(bundle[k][1][a:b], left) for k, a, b, left in zip(owner.tolist(), starts.tolist(), ends.tolist(), (place - starts).tolist())
        ]
        high = np.array([_checksum(text) << 32 for _, text in bundle], np.int64)[owner]
        doc_ids = pa.array([doc_id for doc_id, _ in bundle], pa.int64()).take(pa.array(owner))
        context = (np.array(contexts, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        return [hashes.view(np.int64), context, doc_ids, high | place, ends - place]

    return occurrences


def _contexts(length: int):
    def contexts(rows: Iterator[tuple]) -> Iterator[tuple]:
        for text, checksum, wanted in rows:
            if _checksum(text) == checksum:
                for w in wanted:
                    start, end = reach(w["place"], len(text), length)
                    yield w["anchor"], w["context"], w["n"], w["place"] - start, text[start:end], w["doc_id"], w["place"], w["contexts"]

    return contexts


def _compared(length: int):
    """Spans of the contexts of whole anchors, a bounded number of contexts at a time."""

    def settle(held: list[list[tuple]]) -> Iterator[tuple]:
        flat = [(number, row) for number, group in enumerate(held) for row in group]
        if flat:
            any_spans, first_spans = repeated([(number, row[3], row[4]) for number, row in flat], length)
            for (_, row), own, first in zip(flat, any_spans, first_spans):
                whole = [(0, len(row[4]))] if row[2] > 1 and len(row[4]) >= length else own
                for kind, spans in ((0, whole), (1, first)):
                    for a, b in spans:
                        yield row[0], row[1], kind, a - row[3], b - row[3]

    def compared(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[list[tuple]] = []
        number, last = 0, None
        for row in rows:
            if row[0] != last:
                if number >= TOGETHER:
                    yield from settle(held)
                    held, number = [], 0
                held.append([])
                last = row[0]
            held[-1].append(row)
            number += 1
        yield from settle(held)

    return compared


def _windows(length: int):
    """Each window of the contexts of a crowded anchor."""

    def windows(rows: Iterator[tuple]) -> Iterator[tuple]:
        for anchor, context, _, place, data, doc_id, at, _ in rows:
            for start in range(len(data) - length + 1):
                key = xxhash.xxh3_128_digest(data[start : start + length])
                yield anchor, context, start - place, key, doc_id, at

    return windows


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``checksum`` and ``spans`` (each ``start`` * 2**32 + ``end``, in bytes; they may overlap) of the documents that have repeats.

    With ``keep_first`` the first copy of each string, by id and place, has no span.
    """
    with Stages(docs.sparkSession) as stages:
        return _repeated_spans(docs, length, keep_first, id_column, text_column, stages)


def _repeated_spans(docs: DataFrame, length: int, keep_first: bool, id_column: str, text_column: str, stages: Stages) -> DataFrame:
    rows = texts(docs, id_column, text_column)
    long, name = pa.int64(), "anchor long, context long"
    out = pa.schema([("anchor", long), ("context", long), ("doc_id", long), ("at", long), ("right", pa.int32())])
    twice = repeated_hashes(rows, lambda texts: anchors(texts, length)[1])
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(twice, "hash"))
    # An anchor without company that shares its bits with another one does no harm below.
    hits = stages.put(map_bundles(rows, _occurrences(length, sent), 1, f"{name}, doc_id long, at long, right int", out), "anchors", readers=2)
    sent.destroy()

    place = F.col("at").bitwiseAND(_LOW)
    # By id, place and checksum; place and checksum as one number.
    turned = F.shiftleft(place, 32) + F.shiftright("at", 32)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", turned.alias("turned")))
    contexts = hits.groupBy("anchor", "context").agg(F.count("*").alias("n"), least.alias("least"))
    turned = F.col("least.turned")
    first_place, checksum = F.shiftright(turned, 32), turned.bitwiseAND(_LOW)
    first = F.struct("least.doc_id", first_place.alias("place"), (F.shiftleft(checksum, 32) + first_place).alias("at"))
    contexts = contexts.select("anchor", "context", "n", first.alias("first"))
    contexts = stages.put(contexts, "contexts", readers=2, after=[hits])
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    unlike = contexts.join(several, "anchor")
    wanted = unlike.groupBy(F.col("first.doc_id").alias("own_id"), F.shiftright("first.at", 32).alias("checksum")).agg(
        F.collect_list(F.struct("anchor", "context", "n", "contexts", "first.doc_id", "first.place")).alias("wanted")
    )
    wanted = stages.put(wanted, "wanted", readers=1, after=[contexts])
    needed = likely(rows, F.col("doc_id"), wanted, "own_id").join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id"))).select("text", "checksum", "wanted")
    columns = ("anchor", "context", "n", "left")
    out = pa.schema([*((c, long) for c in columns), ("data", pa.binary()), ("doc_id", long), ("place", long), ("contexts", long)])
    schema = f"{name}, n long, left long, data binary, doc_id long, place long, contexts long"
    bodies = stages.put(map_rows(needed, _contexts(length), schema, out, 2000), "bodies", readers=1, after=[wanted])

    # Earlier contexts come first, so that the copy that stays is the first of all.
    some = bodies.where(F.col("contexts") <= CROWDED).repartition("anchor")
    some = some.sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_last(), "place")
    out = pa.schema([(c, long) for c in ("anchor", "context", "kind", "start", "end")])
    spans = map_rows(some, _compared(length), f"{name}, kind long, start long, end long", out)

    many = bodies.where(F.col("contexts") > CROWDED)
    out = pa.schema([("anchor", long), ("context", long), ("start", long), ("key", pa.binary()), ("doc_id", long), ("place", long)])
    windows = map_rows(many, _windows(length), f"{name}, start long, key binary, doc_id long, place long", out)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place", "context")
    shared = windows.groupBy("anchor", "key", "start").agg(F.count("*").alias("n"), F.min(order).alias("least")).where("n > 1")
    each = windows.join(shared, ["anchor", "key", "start"]).withColumn("end", F.col("start") + length)
    later = each.where(F.col("context") != F.col("least.context"))
    for kind, crowd in ((0, each), (1, later)):
        spans = spans.union(crowd.select("anchor", "context", F.lit(kind).cast("long"), "start", "end"))

    kind = F.col("kind") == int(keep_first)
    own = spans.where(kind).groupBy("anchor", "context").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    own = stages.put(own, "context-spans", readers=1, after=[bodies])
    known = contexts.join(own, ["anchor", "context"], "left").where("n > 1 or own is not null")
    # Only with ``keep_first`` does it matter which copy is the first.
    known = known.select("anchor", "context", *(["first"] if keep_first else []), (F.col("n") > 1).alias("several"), "own")
    known = stages.put(known, "known", readers=1, after=[contexts, own])
    each = hits.join(known, ["anchor", "context"])
    left = F.least(place, F.lit(length - gram_size(length)).cast("long"))
    whole = F.when(left + F.col("right") >= length, F.array(F.struct((-left).alias("start"), F.col("right").cast("long").alias("end"))))
    copied = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("at") != F.col("first.at")) if keep_first else F.col("several")
    each = each.select("doc_id", "at", F.explode(F.when(copied, whole).otherwise(F.col("own"))).alias("span"))
    packed = F.shiftleft(place + F.col("span.start"), 32) + place + F.col("span.end")
    each = each.groupBy("doc_id", F.shiftright("at", 32).alias("checksum")).agg(F.collect_list(packed).alias("spans"))
    return stages.keep(each, "spans", after=[hits, known])


def _cut(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text, spans in rows:
        if not spans:
            yield doc_id, text, len(text), 0, 0, []
            continue
        packed = np.array(spans, np.int64)
        starts, ends = merged(packed >> 32, packed & _LOW)
        bounds = np.r_[0, np.stack([starts, ends], axis=1).ravel(), len(text)].tolist()
        kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
        runs = np.stack([starts, ends], axis=1).tolist()
        yield doc_id, kept, len(text), len(text) - len(kept), len(runs), runs


def without_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``kept`` (remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (maximal removed runs).

    A byte goes if a ``length``-byte string over it also starts anywhere else, in
    the same text or another; overlaps count, and strings are judged on the
    input. With ``keep_first`` the first copy of each string stays. Texts are
    UTF-8 bytes, null is empty, and texts shorter than ``length`` stay whole.
    Rows that repeat id and text are copies of each other; rows that repeat an
    id with other texts are told apart. Further columns are ignored and an empty
    table gives no rows.
    """
    spans = repeated_spans(docs, length, keep_first, id_column, text_column).withColumnRenamed("doc_id", "own_id")
    rows = texts(docs, id_column, text_column).withColumn("sum", F.shiftright(F.crc32("text"), 1))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("sum") == F.col("checksum")), "left")
    out = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("spans", pa.list_(pa.list_(pa.int64())))])
    schema = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, spans array<array<long>>"
    return map_rows(joined.select("doc_id", "text", "spans"), _cut, schema, out, 500)
