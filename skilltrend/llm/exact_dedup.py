"""Exact duplicates by Grace hashing.

A map task folds equal texts of its own rows, so that a text which makes up a
third of the corpus leaves each task once. What is left is dealt out by hash;
there each task partitions its share into spill files, again and again, until a
bucket's distinct contents fit an open-addressing table, which compares complete
contents. Documents find their class by a join on the digest of the content,
whose large keys adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import free_name, map_rows, texts

#: The characters that do not count when texts are compared.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of distinct contents that one table may hold.
TABLE_BYTES = 64 << 20
#: Spill files of one partitioning step.
FAN_OUT = 16

_CLASS = "digest binary, content binary, keep_id long, keep_points long, group_size long"
_CLASS_ARROW = pa.schema(
    [("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("keep_points", pa.int64()), ("group_size", pa.int64())]
)

# A class in the making: digest, content, id and length of its best row, rows.
Entry = tuple[bytes, bytes, "int | None", int, int]


def better(a: tuple, b: tuple) -> bool:
    """Whether row ``a`` (id, code points) is to stay rather than ``b``: longer, then smaller id; null ids last."""
    return (-a[1], a[0] is None, a[0] or 0) < (-b[1], b[0] is None, b[0] or 0)


class ContentTable:
    """Open addressing with linear probing; equality is that of complete contents."""

    def __init__(self, max_bytes: int = TABLE_BYTES) -> None:
        self.max_bytes = max_bytes
        self.entries: list[list] = []
        self.held = 0
        self._slots = np.full(1024, -1, np.int64)

    def _find(self, digest: bytes, content: bytes) -> int:
        mask = len(self._slots) - 1
        slot = int.from_bytes(digest[8:16], "little") & mask
        while (at := self._slots[slot]) >= 0:
            entry = self.entries[at]
            if entry[0] == digest and entry[1] == content:
                return slot
            slot = (slot + 1) & mask
        return slot

    def add(self, entry: Entry) -> bool:
        """Fold ``entry`` in; False if it is new and the table is full."""
        digest, content, doc_id, points, rows = entry
        slot = self._find(digest, content)
        if (at := self._slots[slot]) >= 0:
            known = self.entries[at]
            if better((doc_id, points), (known[2], known[3])):
                known[2], known[3] = doc_id, points
            known[4] += rows
            return True
        if self.entries and self.held + len(content) > self.max_bytes:
            return False
        self._slots[slot] = len(self.entries)
        self.entries.append(list(entry))
        self.held += len(content) + 200
        if 2 * len(self.entries) > len(self._slots):
            self._slots = np.full(2 * len(self._slots), -1, np.int64)
            for k, known in enumerate(self.entries):
                mask = len(self._slots) - 1
                slot = int.from_bytes(known[0][8:16], "little") & mask
                while self._slots[slot] >= 0:
                    slot = (slot + 1) & mask
                self._slots[slot] = k
        return True


def grace(entries: Iterable[Entry], max_bytes: int = TABLE_BYTES, folder: str | None = None, level: int = 0) -> Iterator[list]:
    """The classes of ``entries``, with memory for ``max_bytes`` of contents (or one content, if that is longer).

    Contents that find no room in the table go to spill files by further bits of
    their hash, and each file is treated alike. A full table settles at least
    one content at each step, so this ends whatever the hashes are.
    """
    table, files, paths = ContentTable(max_bytes), {}, {}
    own = None
    try:
        for entry in entries:
            if table.add(entry):
                continue
            if folder is None:
                folder = own = tempfile.mkdtemp(prefix="grace-")
            digest = hashlib.blake2b(entry[0], digest_size=8, salt=level.to_bytes(16, "little")).digest()
            k = digest[0] % FAN_OUT
            if k not in files:
                handle, paths[k] = tempfile.mkstemp(dir=folder)
                files[k] = os.fdopen(handle, "wb")
            pickle.dump(tuple(entry), files[k], pickle.HIGHEST_PROTOCOL)
        yield from table.entries
        del table
        for file in files.values():
            file.close()
        for path in paths.values():
            yield from grace(_read(path), max_bytes, folder, level + 1)
            os.remove(path)
    finally:
        if own:
            shutil.rmtree(own, ignore_errors=True)


def _read(path: str) -> Iterator[Entry]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _fold(max_bytes: int):
    def fold(rows: Iterator[tuple]) -> Iterator[list]:
        """Equal texts of one task as one entry; a full table is sent on and begun anew."""
        table = ContentTable(max_bytes)
        for doc_id, text, points in rows:
            content = text.translate(None, WHITE_SPACE)
            entry = (hashlib.sha256(content).digest(), content, doc_id, points, 1)
            if not table.add(entry):
                yield from table.entries
                table = ContentTable(max_bytes)
                table.add(entry)
        yield from table.entries

    return fold


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, text, points in rows:
        yield doc_id, points, hashlib.sha256(text.translate(None, WHITE_SPACE)).digest()


def exact_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct content: ``digest``, ``keep_id``, ``keep_points``, ``group_size``."""
    rows = texts(docs, id_column, text_column).withColumn("points", F.length(F.col("text").cast("string")).cast("long"))
    folded = map_rows(rows, _fold(table_bytes), _CLASS, _CLASS_ARROW, 500)

    def settle(entries: Iterator[tuple]) -> Iterator[tuple]:
        for digest, _, keep_id, points, size in grace(entries, table_bytes):
            yield digest, None, keep_id, points, size

    return map_rows(folded.repartition("digest"), settle, _CLASS, _CLASS_ARROW).drop("content")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """For each row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical without white space. The row with the most
    code points, then the smallest id, stays. A null text is an empty one and a
    null id comes after all others; if all ids of a group are null, its longest
    rows stay. Rows that repeat id and text cannot be told apart: they share
    their result. Further columns are ignored and an empty table gives none.
    """
    rows = texts(docs, id_column, text_column).withColumn("points", F.length(F.col("text").cast("string")).cast("long"))
    out = pa.schema([("doc_id", pa.int64()), ("points", pa.int64()), ("digest", pa.binary())])
    narrow = map_rows(rows, _digests, "doc_id long, points long, digest binary", out)
    classes = exact_classes(docs, id_column, text_column, table_bytes)
    return narrow.join(classes, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; rows that repeat id and text stay together."""
    name, sha = free_name(docs, "_kept"), free_name(docs, "_sha")
    kept = exact_duplicates(docs, id_column, text_column).where("kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(sha))
    content = F.translate(F.coalesce(F.col(text_column), F.lit("")), WHITE_SPACE.decode(), "")
    same = F.col(id_column).cast("long").eqNullSafe(F.col(name)) & (F.sha2(content.cast("binary"), 256) == F.col(sha))
    return docs.join(kept, same, "left_semi")
