"""What several corpus operators share: tables, row batches, word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a worker remembers the hash of before it starts afresh.
WORD_MEMORY = 300_000
#: Rows a task puts into one batch for the JVM.
OUT_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers are; any other path to a tokenizer file does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Two columns ``doc_id`` and ``text`` (UTF-8 bytes, null as empty); other columns stay behind."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or as many underscores before it as keep it apart from the columns of ``df``."""
    used = {column.lower() for column in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def rows_out(schema: pa.Schema, rows: Iterator[tuple], size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows, so that output never piles up in a worker."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


def map_rows(df: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, out: pa.Schema, size: int = OUT_ROWS) -> DataFrame:
    """``work`` over the rows of each partition, read and written as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        return rows_out(out, work(rows()), size)

    return df.mapInArrow(run, schema)


#: Bytes of texts that are worked on at once.
BUNDLE = 1 << 18


def bundles(rows: Iterable[tuple], text: int) -> Iterator[list[tuple]]:
    """Rows whose texts (column ``text``) make ``BUNDLE`` bytes together; a larger text stands alone or ends its bundle."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[text]) + 1
        if size >= BUNDLE:
            yield held
            held, size = [], 0
    if held:
        yield held


def map_bundles(df: DataFrame, work: Callable[[list[tuple]], list[np.ndarray]], text: int, schema: str, out: pa.Schema) -> DataFrame:
    """As ``map_rows``; ``work`` turns the rows of a bundle to the columns of ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        for bundle in bundles(rows, text):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(work(bundle), out)], schema=out)

    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_MEMORY:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bytes of the longest word whose hash is a sum over its letters, and a factor for each place in it.
LONG_WORD = 64
_FACTORS = mixed(np.arange(8001, 8001 + LONG_WORD, dtype=np.uint64))


class Words(NamedTuple):
    """The words of several texts, one text after the other; places count bytes of the texts joined by line ends."""

    joined: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: First byte of each text, and number of words before each and before the end.
    offsets: np.ndarray
    bounds: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """The words of ``texts`` as ``bytes.lower`` and ``bytes.split`` give them, found and hashed all at once."""
    joined = b"\n".join(texts).lower() + b"\n"
    data = np.frombuffer(joined, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[data], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.r_[np.searchsorted(starts, np.arange(0, len(data), BUNDLE)), len(starts)].tolist()
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            hashes[i:j] = _sums(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : ends[k]])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, hashes, starts, ends, offsets[:-1], np.searchsorted(starts, offsets))


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the mixed sum of its bytes times the factors of their places."""
    place = np.arange(len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    values = (data + np.uint64(1)) * _FACTORS[np.minimum(place, LONG_WORD - 1)]
    total = np.r_[np.uint64(0), np.cumsum(values)]
    return mixed(total[ends] - total[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run, none has none."""
    if not len(words):
        return np.empty(0, np.uint64)
    length = min(size, len(words))
    total = np.full(len(words) - length + 1, np.uint64(length))
    for k in range(length):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(total)])
    return np.unique(total)


#: Bits of a bitmap of hashes: 16 MB, whatever the corpus.
BITS = 27


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """The first ``BITS`` bits of the hashes (long) in ``column``, as a bitmap of fixed size.

    Hashes that share these bits let each other pass: too many, never too few.
    """
    place = F.shiftrightunsigned(column, 64 - BITS) + 1
    maps = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    for row in maps.toLocalIterator():  # 4,096 rows of 4 KB at most
        own = np.frombuffer(row["bits"], np.uint8)
        bitmap[(row["bucket"] - 1) * len(own) :][: len(own)] = own
    return bitmap


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes >> np.uint64(64 - BITS)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def repeated_hashes(rows: DataFrame, hashes_of: Callable[[list[bytes]], np.ndarray], at_once: int = 1 << 21) -> DataFrame:
    """``hash`` of those that the texts of ``rows`` give twice or more.

    Tasks fold their own before the shuffle, ``at_once`` at a time.
    """
    out = pa.schema([("hash", pa.int64()), ("n", pa.int32())])

    def fold(held: list[np.ndarray]) -> pa.RecordBatch:
        found = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        counts = np.minimum(np.diff(starts, append=len(found)), 2)
        return pa.RecordBatch.from_arrays([pa.array(found[starts].view(np.int64)), pa.array(counts.astype(np.int32))], schema=out)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        rows = ((text,) for batch in batches for text in batch.column(0).to_pylist())
        for bundle in bundles(rows, 0):
            held.append(hashes_of([text for text, in bundle]))
            number += len(held[-1])
            if number >= at_once:
                yield fold(held)
                held, number = [], 0
        if number:
            yield fold(held)

    counts = rows.select("text").mapInArrow(counted, "hash long, n int")
    return counts.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is among ``wanted_key``, and few others, so that a join need not move the rest.

    Null is a key like others.
    """
    name = free_name(rows, "_hash")
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64(F.col(wanted_key)).alias("hash")), "hash"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.filter(pa.array(in_bitmap(sent.value, batch.column(0).to_numpy().view(np.uint64))))
            yield few.select(range(1, few.num_columns))

    return rows.select(F.xxhash64(key).alias(name), *rows.columns).mapInArrow(kept, rows.schema)
