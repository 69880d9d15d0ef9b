"""Packing token pieces into sequences, with a certificate of how good it is.

Pieces are dealt into parts of bounded size, and each part is packed by best-fit
decreasing. Dual-feasible functions give a lower bound of the sequences that a
part needs; a part that meets its bound is certified. Parts that do not meet it
put the pieces of their unfilled sequences into a pool, certified parts those of
their emptiest one; the pool is dealt anew and packed again. A deal that saves
nothing is followed by another one with more of the emptiest sequences, until
several deals in a row save nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skilltrend.llm.common import map_rows, texts
from skilltrend.llm.tokens import worker_encoder
from skilltrend.plans.checkpoints import discard, staged, staged_at

#: Pieces of one part, on average, and how many times as many of one that is packed from a pool.
PART, POOLED = 20_000, 4
#: Exchanges at most, and those in a row that may save nothing.
EXCHANGES, PATIENCE = 16, 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PACKED = f"{_PIECES}, number long, part long, bin long, offset long, fill long, bins long, bound long"
_PACKED_ARROW = pa.schema([*_PIECES_ARROW, *((n, pa.int64()) for n in ("number", "part", "bin", "offset", "fill", "bins", "bound"))])


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """Piece, start, length and crc32 of each piece: whole if it fits, else full pieces after a first shorter one."""
    total = len(ids) // 4
    first = total if total <= capacity else total % capacity or capacity
    start, end, piece = 0, first, 0
    while start < total:
        yield piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])
        start, end, piece = end, end + capacity, piece + 1


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of each text's ids and one ``end_id``; a null or empty text is the end id alone."""

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        encoder, end = worker_encoder(tokenizer, drops_space=False), np.array([end_id], "<u4").tobytes()
        for doc_id, text in rows:
            for piece in cut(encoder.encode(text) + end, capacity):
                yield doc_id, *piece

    return map_rows(texts(docs, id_column, text_column), pieces, _PIECES, _PIECES_ARROW)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by dual-feasible functions.

    One family keeps pieces from some threshold on, counts those above half a
    sequence whole and sets the rest against the room beside them; the other
    rounds each piece down to a multiple of a k-th sequence, for several k.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of pieces given by how many there are of each length from 0 to ``capacity``."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    best, half = -(-int(total[-1]) // capacity), capacity // 2
    for least in range(1, half + 1):
        large = number[capacity] - number[capacity - least]
        middle = number[capacity - least] - number[half]
        room = middle * capacity - (total[capacity - least] - total[half])
        small = total[half] - total[least - 1]
        best = max(best, int(large + middle + max(0, -(-(small - room) // capacity))))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # In units of 1 / (k * capacity) of a sequence.
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the order given (decreasing), and the fill of each bin."""
    bins, offsets, left = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if some bin has room r
    for k, length in enumerate(lengths.tolist()):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, at = capacity, len(left)
            left.append(capacity)
        bins[k], offsets[k] = at, capacity - room
        left[at] = room = room - length
        if room:
            by_room[room].append(at)
            open_rooms |= 1 << room
    return bins, offsets, capacity - np.array(left, np.int64)


def _pack(capacity: int):
    def pack(rows: Iterator[tuple]) -> Iterator[tuple]:
        def packed(part: list[tuple]) -> Iterator[tuple]:
            lengths = np.array([r[3] for r in part], np.int64)
            bins, offsets, fill = best_fit(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            for row, at, offset in zip(part, bins.tolist(), offsets.tolist()):
                yield *row, at, offset, int(fill[at]), len(fill), bound

        held: list[tuple] = []
        for row in rows:
            if held and held[0][6] != row[6]:
                yield from packed(held)
                held = []
            held.append(row)
        if held:
            yield from packed(held)

    return pack


def _packed(pieces: DataFrame, count: int, turn: int, capacity: int) -> DataFrame:
    """``pieces`` dealt into parts by a hash of their number and the turn, each packed by itself."""
    parts = max(1, -(-count // (PART * POOLED if turn else PART)))
    # Parts of different turns have different numbers.
    dealt = pieces.withColumn("part", F.lit(turn << 28) + F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(parts)))
    dealt = dealt.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "piece", "number")
    return map_rows(dealt, _pack(capacity), _PACKED, _PACKED_ARROW)


def _with_pool(unfilled: DataFrame, emptiest: int) -> DataFrame:
    """``unfilled`` with ``open``: whether a piece's sequence goes into the pool.

    So do all sequences of a part above its bound, and of every other part the
    ``emptiest`` ones. One row per sequence decides.
    """
    sequences = unfilled.select("part", "bin", "fill", "bins", "bound").distinct()
    place = F.row_number().over(Window.partitionBy("part").orderBy("fill", "bin"))
    opened = (F.col("bins") > F.col("bound")) | (place <= emptiest)
    return unfilled.join(sequences.select("part", "bin", opened.alias("open")), ["part", "bin"])


def packed_sequences(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """For each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, ``certified``.

    A text's ids end with ``end_id``. Only texts of more than ``capacity`` ids
    are cut; a null or empty text is one piece of one id. Ties are broken by id
    and piece; rows that repeat an id, or have none, are packed one by one.
    Further columns are ignored and an empty table gives none. ``certified`` is
    false for the unfilled sequences of a part that stayed above its lower bound.
    """
    spark = docs.sparkSession
    cut_pieces = token_pieces(docs, tokenizer, end_id, capacity, id_column, text_column)
    # Parts are dealt by this number and not by ids, of which many may be equal.
    pieces, pieces_path = staged_at(cut_pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Sequence ids: part and bin; full pieces count on beyond them.
    whole = pieces.where(F.col("length") == capacity).select(
        *columns,
        (F.lit(1 << 62) + F.col("number")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("certified"),
    )
    settled = [staged(whole, "whole")]

    def numbered(packed: DataFrame) -> DataFrame:
        certified = (F.col("bins") <= F.col("bound")) | (F.col("fill") == capacity)
        return packed.select(*columns, (F.col("part") * F.lit(1 << 28) + F.col("bin")).alias("sequence_id"), "offset", certified.alias("certified"))

    full = F.col("fill") == capacity
    pool = pieces.where(F.col("length") < capacity)
    again, again_path = staged_at(_packed(pool, pool.count(), 0, capacity), "packed")
    discard(spark, pieces_path)
    settled.append(staged(numbered(again.where(full)), "full"))
    # Sequences with room left stay in play; the others are done.
    current, current_path = staged_at(again.where(~full), "unfilled")
    discard(spark, again_path)
    failures = 0
    for turn in range(1, EXCHANGES + 1):
        marked, marked_path = staged_at(_with_pool(current, 1 << failures), "marked")
        loose = marked.where("open")
        before, count = loose.select("part", "bin").distinct().count(), loose.count()
        if before < 2:
            discard(spark, marked_path)
            break
        again, again_path = staged_at(_packed(loose.select(*columns, "number"), count, turn, capacity), "packed")
        if again.select("part", "bin").distinct().count() < before:
            settled.append(staged(numbered(again.where(full)), "full"))
            rest = marked.where("not open").select(again.columns).unionAll(again.where(~full))
            discard(spark, current_path)
            current, current_path = staged_at(rest, "unfilled")
            failures = 0
        else:
            failures += 1
        discard(spark, again_path)
        discard(spark, marked_path)
        if failures == PATIENCE:
            break
    settled.append(numbered(current))
    out = settled[0]
    for other in settled[1:]:
        out = out.union(other)
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: ``sequences`` used and the lower ``bound`` of any packing of the same pieces.

    The bound needs only how many pieces there are of each length.
    """
    spark = packed.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").count().collect():  # one row per length, ``capacity`` at most
        counts[row["length"]] = row["count"]
    used = packed.select("sequence_id").distinct().count()
    return spark.createDataFrame([(used, bound_of(counts, capacity))], "sequences long, bound long")
