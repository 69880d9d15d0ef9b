"""Fill-in-middle forms of whole texts, and the way back.

All texts of a batch lie in one buffer of bytes. Two cuts per text, given in code
points, are found by a scan over the bytes that begin one. The order in which a
form puts prefix, middle and suffix is a displacement of each of the three: a
difference array takes it up where a part begins, its cumulative sum gives every
byte its shift, and one scatter writes all outputs of the batch. The way back
scans the outputs for their marks and gathers each byte from where it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import free_name

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of texts that one buffer holds; a longer text has a buffer of its own.
BUFFER = 4 << 20

_MARK = 3
_FORMS = np.array([PLAIN, PSM, SPM], dtype=object)


def draws(id_column: str, seed: str = "1:") -> Column:
    """Four unsigned 32-bit numbers per row, the first of the sha256 of ``seed`` and the decimal id.

    A null id is drawn as an empty one.
    """
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _point_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point; the first byte of a text always does."""
    begins = (data & 0xC0) != 0x80
    begins[starts[starts < len(data)]] = True
    return begins


def _marks(data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the three marks in a buffer, ascending, the letter of each and the text that holds it.

    ``last`` are the ends of the texts; what reaches over one is no mark.
    """
    at = np.flatnonzero(data[: max(0, len(data) - 2)] == ord("<"))
    letter = data[at + 1]
    hit = (data[at + 2] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M")))
    at, letter = at[hit], letter[hit]
    owner = np.searchsorted(last, at, "right")
    whole = at + _MARK <= last[owner]
    return at[whole], letter[whole], owner[whole]


def _shifts(size: int, begins: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The shift of each of ``size`` bytes, when part k begins at ``begins[k]`` and moves by ``shift[k]``.

    Empty parts begin where the next one does; their steps add up to its own.
    """
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, np.diff(shift, prepend=0))
    return np.cumsum(steps[:size])


def scatter(data: np.ndarray, bounds: np.ndarray, drawn: np.ndarray, plain_share: int, spm_share: int) -> tuple[np.ndarray, ...]:
    """Outputs of all texts of a buffer.

    ``bounds`` are the ends of the texts in ``data`` after a first 0, ``drawn``
    four numbers per text. Returns the output buffer and its bounds, the form
    (0 plain, 1 psm, 2 spm), the code points of each text and of its prefix and middle.
    """
    first, last = bounds[:-1], bounds[1:]
    number = len(first)
    point_at = np.flatnonzero(_point_starts(data, first))
    before = np.searchsorted(point_at, bounds)
    points = np.diff(before)
    one, two = drawn[:, 0] % (points + 1), drawn[:, 1] % (points + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    # Byte of each cut; the cut after the last code point is the end of the text.
    point_at = np.append(point_at, len(data))
    cut_low = np.minimum(point_at[before[:-1] + low], last)
    cut_high = np.minimum(point_at[before[:-1] + high], last)

    marked = np.zeros(number, bool)
    marked[_marks(data, last)[2]] = True
    plain = (points == 0) | marked | (drawn[:, 2] % 100 >= plain_share)
    form = np.where(plain, 0, np.where(drawn[:, 3] % 100 < spm_share, 2, 1))

    size = (last - first) + 3 * _MARK * ~plain
    out_bounds = np.concatenate([[0], np.cumsum(size)])
    out_first = out_bounds[:-1]
    n_prefix, n_middle, n_suffix = cut_low - first, cut_high - cut_low, last - cut_high
    psm, spm = form == 1, form == 2
    # Where each part's bytes begin in the output; its mark, if any, is just before.
    to_prefix = out_first + np.where(psm, _MARK, np.where(spm, 2 * _MARK + n_suffix, 0))
    to_suffix = out_first + np.where(psm, 2 * _MARK + n_prefix, np.where(spm, _MARK, n_prefix + n_middle))
    to_middle = out_first + np.where(plain, n_prefix, 3 * _MARK + n_prefix + n_suffix)
    begins = np.stack([first, cut_low, cut_high], 1).ravel()
    shift = np.stack([to_prefix - first, to_middle - cut_low, to_suffix - cut_high], 1).ravel()
    out = np.empty(int(out_bounds[-1]), np.uint8)
    out[np.arange(len(data)) + _shifts(len(data), begins, shift)] = data
    for mark, to in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        places = to[~plain] - _MARK
        out[places[:, None] + np.arange(_MARK)] = np.frombuffer(mark, np.uint8)
    return out, out_bounds, form, points, low, high - low


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts whose outputs are in ``data``: the inverse of ``scatter``, from outputs and forms alone."""
    first, last = bounds[:-1], bounds[1:]
    plain = form == 0
    at, letter, owner = _marks(data, last)
    # An output that is not plain has each mark once, as its text had none.
    keep = ~plain[owner]
    at, letter, owner = at[keep], letter[keep], owner[keep]
    place = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        place[mark] = first.copy()
        chosen = letter == mark[1]
        place[mark][owner[chosen]] = at[chosen] + _MARK
    prefix, suffix, middle = place[PREFIX], place[SUFFIX], place[MIDDLE]
    psm, spm = form == 1, form == 2
    n_prefix = np.where(psm, suffix - _MARK - prefix, np.where(spm, middle - _MARK - prefix, last - first))
    n_suffix = np.where(psm, middle - _MARK - suffix, np.where(spm, prefix - _MARK - suffix, 0))
    n_middle = np.where(plain, 0, last - middle)
    text_bounds = np.concatenate([[0], np.cumsum(n_prefix + n_middle + n_suffix)])
    to = text_bounds[:-1]
    begins = np.stack([to, to + n_prefix, to + n_prefix + n_middle], 1).ravel()
    source = np.stack([prefix, middle, suffix], 1).ravel()
    size = int(text_bounds[-1])
    return data[np.arange(size) + _shifts(size, begins, source - begins)], text_bounds


def _buffers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and bounds of each buffer of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BUFFER, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def _mapped(df: DataFrame, text: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list[pa.Array]], schema: str, out: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in _buffers(batch.column(text)):
                yield pa.RecordBatch.from_arrays(work(batch.slice(row, end - row), data, bounds), schema=out)

    return df.mapInArrow(run, schema)


def fill_in_middle(
    docs: DataFrame, plain_share: int = 90, spm_share: int = 20, seed: str = "1:", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of every text.

    Of 100 texts ``plain_share`` are transformed by their draw, ``spm_share`` of
    those put the suffix first. Empty and null texts, and texts that hold a
    mark, stay plain. Each row is worked on by itself: repeated rows give
    repeated results, rows with a null id share their draw, an empty table gives
    none and further columns are ignored. Long texts are never cut short.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
        draws(id_column, seed).alias("drawn"),
    )
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])

    def work(batch: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
        drawn = np.frombuffer(b"".join(batch.column("drawn").to_pylist()), ">u4").reshape(-1, 4).astype(np.int64)
        output, output_bounds, form, points, prefix, middle = scatter(data, bounds, drawn, plain_share, spm_share)
        plain = form == 0
        return [
            batch.column("doc_id"),
            pa.array(points.astype(np.int64)),
            pa.array(_FORMS[form], pa.string()),
            pa.array(prefix.astype(np.int64), mask=plain),
            pa.array(middle.astype(np.int64), mask=plain),
            _binary(output, output_bounds),
        ]

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return _mapped(rows, "text", work, schema, out).withColumn("output", F.col("output").cast("string"))


def restored(formed: DataFrame, name: str = "restored") -> DataFrame:
    """``formed`` with the texts rebuilt from ``output`` and ``form``, in a column ``name``.

    Rows with a null output or form get an empty text; no other column is read.
    """
    held = free_name(formed, "_bytes")
    rows = formed.withColumn(held, F.coalesce(F.col("output").cast("binary"), F.lit(b"")))
    kept = [column for column in formed.columns if column != name]
    rows = rows.select(*kept, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in _buffers(batch.column(held)):
                part = batch.slice(row, end - row)
                forms = part.column("form").to_pylist()
                form = np.array([{PSM: 1, SPM: 2}.get(f, 0) for f in forms], np.int64)
                columns = [part.column(column) for column in kept] + [_binary(*gather(data, bounds, form))]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    schema = rows.select(*kept).withColumn(name, F.lit(b"")).schema
    return rows.mapInArrow(run, schema).withColumn(name, F.col(name).cast("string"))
