"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A signature has 40 slots of 16 bits. It is split into 8 chunks of 5 slots. Two
signatures that differ in at most 15 slots have, by the pigeonhole principle, a
chunk with at most one differing slot; a key for each chunk and each slot left
out of it meets all such pairs. Links are confirmed on complete shingle sets.

Texts with equal sets form one class first, and only classes are compared. In a
bucket, first every class is compared with one leader, which joins most of what
belongs together. Buckets that still hold several components make families of
components; a family is cut into blocks of bounded size, and a task counts the
common shingles of two blocks at a time and returns no more links than it has
rows. No pair is ever a row before it is known to be a link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltrend.llm.common import WordHashes, free_name, map_rows, mixed, shingle_hashes, texts
from skilltrend.operators.components import components
from skilltrend.plans.checkpoints import staged
from skilltrend.plans.stages import Stages

SLOTS, CHUNK = 40, 5
#: Signature distance up to which the keys meet every pair.
GUARANTEED_DISTANCE = 2 * (SLOTS // CHUNK) - 1
#: Pairs that share a key of a small bucket but differ in more slots make no
#: family; a pair at similarity 0.8 is beyond it with a probability of 5e-6.
FARTHEST = 20
#: Members that one task compares with one leader, rows of a bucket whose
#: signatures one task compares, and rows of a block.
LEADER_SHARE, BUCKET, BLOCK = 1000, 512, 1024
#: Shingles that one product of two blocks counts at once.
COLUMNS = 2048
#: Shingles whose hashes are held at once.
STRIDE = 1 << 13

_ODD = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mixed(np.arange(1001, SLOTS + 1001, dtype=np.uint64))
_PLACE = mixed(np.arange(5001, SLOTS + 5001, dtype=np.uint64))


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The 16-bit minimum of each slot."""
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), STRIDE):
        part = shingles[start : start + STRIDE]
        low = np.minimum(low, (np.multiply.outer(_ODD[:slots], part) + _SHIFT[:slots, None]).min(axis=1))
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def bucket_keys(slots: np.ndarray) -> np.ndarray:
    """Of signatures (a row each), a key for each chunk and slot left out of it."""
    chunks = slots.astype(np.uint64).reshape(len(slots), SLOTS // CHUNK, CHUNK)
    keys = np.empty((len(slots), SLOTS // CHUNK, CHUNK), np.uint64)
    for out in range(CHUNK):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for k in range(CHUNK):
            if k != out:
                packed = (packed << np.uint64(16)) | chunks[:, :, k]
        keys[:, :, out] = packed
    return mixed(keys.reshape(len(slots), SLOTS) ^ _PLACE)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sign(words: int):
    def sign(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        for doc_id, text in rows:
            shingles = shingle_hashes(hashes.of(text.lower().split()), words)
            if len(shingles):
                yield doc_id, len(shingles), xxhash.xxh3_128_digest(shingles.tobytes()), signature(shingles).tobytes()
            else:
                yield doc_id, 0, None, None

    return sign


def keyed(classes: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``key``, ``node``, ``label`` of ``node``, ``label``, ``slots``; ``keys_of`` turns rows of slots to rows of keys."""
    out = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("label", pa.int64())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = keys_of(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(part.num_rows, -1))
                own = [np.repeat(part.column(k).to_numpy(), found.shape[1]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), *map(pa.array, own)], schema=out)

    return classes.select("node", "label", "slots").mapInArrow(keys, "key long, node long, label long")


def forest(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``pairs`` that join what the ones before have not joined."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            yield a, b


def _groups(rows: Iterator[tuple], width: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``width`` columns."""
    held: list[tuple] = []
    for row in rows:
        if held and held[0][:width] != row[:width]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _near_labels(farthest: int):
    """Labels of a bucket that near signatures join."""

    def near(group: list[tuple]) -> Iterator[tuple[int, int]]:
        labels = np.array([g[1] for g in group])
        slots = np.frombuffer(b"".join(g[2] for g in group), np.uint16).reshape(len(group), -1)
        for k in range(len(group) - 1):
            at = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
            for label in np.unique(labels[at[(slots[at] != slots[k]).sum(axis=1) <= farthest]]).tolist():
                yield int(labels[k]), label

    def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
        for group in _groups(rows, 1):
            yield from forest(near(group))

    return joined


def families(classes: DataFrame, keys: DataFrame, farthest: int, stages: Stages) -> DataFrame:
    """``label`` and ``family`` for each label that must be compared with others.

    Buckets of one label are done. In others, near signatures join labels to a
    family; of a bucket too large for one task, all labels make one.
    """
    mixed_keys = keys.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("hi"), F.count("*").alias("n"))
    mixed_keys = mixed_keys.where("least <> hi").select("key", "least", "n")
    rows = stages.put(keys.join(mixed_keys, "key"), "mixed")
    large = rows.where(F.col("n") > BUCKET).where("label <> least").select(F.col("least").alias("a"), F.col("label").alias("b")).distinct()
    small = rows.where(F.col("n") <= BUCKET).join(classes.select("node", "slots"), "node").select("key", "label", "slots")
    small = small.repartition("key").sortWithinPartitions("key")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    joined = components(large.union(map_rows(small, _near_labels(farthest), "a long, b long", out)), stages=stages)
    roots = joined.select(F.col("root").alias("label"), F.col("root").alias("family")).distinct()
    return joined.select(F.col("node").alias("label"), F.col("root").alias("family")).union(roots)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``left`` has in common with each of ``right``."""
    sizes = [len(x) for x in (*left, *right)]
    column, place = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    uses = np.bincount(place, minlength=len(column))
    # A shingle of one row only is common to none.
    rank = np.cumsum(uses > 1) - 1
    held = uses[place] > 1
    owner, at = owner[held], rank[place[held]]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
        here = (at >= start) & (at < start + COLUMNS)
        dense = np.zeros((len(sizes), COLUMNS), np.float32)
        dense[owner[here], at[here] - start] = 1
        total += dense[: len(left)] @ dense[len(left) :].T
    return total.astype(np.int64)


def _block_links(words: int, percent: int):
    def links(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes = WordHashes()
        # family, block i, block j, side, node, label, text
        for group in _groups(rows, 3):
            sides = [[g for g in group if g[3] == side] for side in (0, 1)]
            if group[0][1] == group[0][2]:
                sides[1] = sides[0]
            if not sides[0] or not sides[1]:
                continue
            sets = [[shingle_hashes(hashes.of(g[6].lower().split()), words) for g in side] for side in sides]
            sizes = [np.array([len(x) for x in side], np.int64) for side in sets]
            both = _common(*sets)
            labels = [np.array([g[5] for g in side]) for side in sides]
            linked = 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)
            linked &= labels[0][:, None] != labels[1][None, :]
            found = ((sides[0][k][4], sides[1][m][4], int(labels[0][k]), int(labels[1][m])) for k, m in zip(*map(np.ndarray.tolist, np.nonzero(linked))))
            names = {}
            for a, b, x, y in found:
                names.setdefault((min(x, y), max(x, y)), (a, b))
            for pair in forest(iter(sorted(names))):
                yield names[pair]

    return links


def links_within(members: DataFrame, words: int, percent: int, stages: Stages) -> DataFrame:
    """Links between different labels of a family; ``members`` has ``family``, ``label``, ``node``, ``text``.

    A label of at least ``BLOCK`` rows has blocks of its own, which need not be
    compared with each other; smaller labels share blocks.
    """
    sizes = members.groupBy("family", "label").agg(F.count("*").alias("n"))
    few = sizes.where(F.col("n") < BLOCK).groupBy("family").agg(F.sum("n").alias("few"))
    placed = sizes.join(few, "family", "left").select(
        "family",
        "label",
        F.when(F.col("n") < BLOCK, F.lit(-1).cast("long")).otherwise(F.col("label")).alias("owner"),
        F.ceil(F.when(F.col("n") < BLOCK, F.col("few")).otherwise(F.col("n")) / BLOCK).alias("parts"),
    )
    dealt = members.join(placed, ["family", "label"]).withColumn(
        "part", F.pmod(F.when(F.col("owner") < 0, F.xxhash64("label")).otherwise(F.xxhash64("node")), "parts")
    )
    dealt = stages.put(dealt.select("family", F.concat_ws(":", "owner", "part").alias("block"), "owner", "node", "label", "text"), "blocks")
    blocks = dealt.select("family", "block", "owner").distinct()
    left, right = (blocks.select("family", F.col("block").alias(n), F.col("owner").alias(f"{n}_owner")) for n in ("i", "j"))
    pairs = left.join(right, "family").where("i <= j and (i_owner <> j_owner or i_owner < 0)").select("family", "i", "j")
    sides = [
        pairs.where("i < j" if side else "true").join(dealt.withColumnRenamed("block", name), ["family", name]).select("family", "i", "j", F.lit(side).alias("side"), "node", "label", "text")
        for side, name in enumerate(("i", "j"))
    ]
    rows = sides[0].union(sides[1]).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return map_rows(rows, _block_links(words, percent), "a long, b long", out)


def leader_pairs(keys: DataFrame) -> DataFrame:
    """Distinct pairs of each bucket's smallest node ``a`` and its other nodes ``b``."""
    leaders = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").drop("hi")
    return keys.join(leaders, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _confirm(words: int, percent: int):
    def confirm(rows: Iterator[tuple]) -> Iterator[tuple]:
        hashes, current, leader = WordHashes(), None, None
        for a, share, b, text in rows:
            shingles = shingle_hashes(hashes.of(text.lower().split()), words)
            if b is None:
                current, leader = (a, share), shingles
            elif (a, share) == current and similar(leader, shingles, percent):
                yield a, b

    return confirm


def confirmed(pairs: DataFrame, bodies: DataFrame, words: int, percent: int, stages: Stages) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose complete sets are similar; ``bodies`` has ``node`` and ``text``.

    A leader with many partners is split into shares, each with a copy of its text.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_SHARE).alias("shares"))
    dealt = stages.put(pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), "b"), "pairs")
    members = dealt.join(bodies.withColumnRenamed("node", "b"), "b").select("a", "share", "b", "text")
    heads = dealt.select("a", "share").distinct().join(bodies.withColumnRenamed("node", "a"), "a")
    rows = heads.select("a", "share", F.lit(None).cast("long").alias("b"), "text").union(members)
    rows = rows.repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return map_rows(rows, _confirm(words, percent), "a long, b long", out)


def linked(
    classes: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    words: int,
    percent: int,
    keys_of: Callable[[np.ndarray], np.ndarray],
    farthest: int,
    stages: Stages | None = None,
) -> DataFrame:
    """``node`` and ``root`` of every class in a component of linked classes that is not its root.

    ``classes`` has ``node``, ``slots`` and what ``fetch`` needs to find the
    texts (``node``, ``text``) of some of them. The result's folder goes with
    the run ``stages`` if there is one; all others are gone on return.
    """
    with Stages(classes.sparkSession) as own:
        first = own.put(leader_pairs(keyed(classes.withColumn("label", F.col("node")), keys_of)), "leaders")
        met = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
        met = own.put(classes.join(met, "node"), "met", readers=2)
        bodies = own.put(fetch(met), "bodies", after=[met])
        links = own.put(confirmed(first, bodies, words, percent, own), "links")
        labels = components(links, stages=own)
        labelled = met.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).select("node", "slots", "label")
        labelled = own.put(labelled, "labelled", after=[met])
        found = families(labelled, keyed(labelled, keys_of), farthest, own)
        apart = labelled.join(found, "label").select("family", "label", "node")
        apart = own.put(apart.join(bodies, "node").select("family", "label", "node", "text"), "apart")
        if not apart.isEmpty():
            labels = components(links.union(own.put(links_within(apart, words, percent, own), "links")), stages=own)
        return own.keep(labels, "near-labels") if stages is None else stages.put(labels, "near-labels")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles (A-Z in lower case, words between ASCII white space;
    a shorter text is one shingle). Texts without words, null ones included, are
    linked with nothing. ``component_id`` is the smallest id that links reach;
    null ids are only ever the id of groups in which all ids are null. Repeated
    rows share their result, further columns are ignored, an empty table gives none.
    """
    rows = texts(docs, id_column, text_column)
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("body", pa.binary()), ("slots", pa.binary())])
    signed = staged(map_rows(rows, _sign(words), "doc_id long, n_shingles long, body binary, slots binary", out, 5000), "signed")

    classes = signed.where("n_shingles > 0").groupBy("body").agg(F.min("doc_id").alias("least_id"), F.first("slots").alias("slots"))
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def fetch(met: DataFrame) -> DataFrame:
        # Rows of the representative's id; should the id repeat, only its own text counts.
        found = rows.join(met.select(F.col("least_id"), "node", "body"), F.col("doc_id").eqNullSafe(F.col("least_id")))
        shape = pa.schema([("node", pa.int64()), ("text", pa.binary())])
        return map_rows(found.select("node", "text", "body"), _own(words), "node long, text binary", shape, 500)

    labels = linked(classes, fetch, words, percent, bucket_keys, FARTHEST)
    rooted = classes.join(labels, "node", "left").select("body", "least_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = rooted.join(least, "root").select("body", "component_id")
    return (
        signed.join(found, "body", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of ``docs``, all columns as they are; rows that repeat an id stay or go together."""
    name = free_name(docs, "_kept")
    kept = near_duplicates(docs, words, percent, id_column, text_column).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col(id_column).cast("long").eqNullSafe(F.col(name)), "left_semi")


def _own(words: int):
    def own(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Drops texts of a repeated id that are not the class's, and repeats of those that are."""
        hashes, last = WordHashes(), None
        for node, text, body in rows:
            if node == last:
                continue
            if xxhash.xxh3_128_digest(shingle_hashes(hashes.of(text.lower().split()), words).tobytes()) == body:
                yield node, text
                last = node

    return own
