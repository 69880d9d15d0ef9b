"""Near duplicates among embeddings, by a robust-pruned flat graph.

Equal vectors form one class first. Classes of a label are dealt into shards by
rounds of spherical k-means; a vector at home in one shard is a guest in every
other whose border is so near that a link could cross it. Each shard builds a
graph of its members, home and guests, and keeps of each candidate neighbour
only what a robust pruning leaves; the lists that a vector has in several shards
are united. Every vector then searches its home shard: greedily from medoids and
its own place, and from there over all neighbours within the range. Links are
confirmed in double precision where they are found. A sample is held against
all vectors to measure the recall, and a search that falls short is done again
with a wider beam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skilltrend.operators.components import components
from skilltrend.plans.checkpoints import discard, staged, staged_at

#: Home rows of a shard that need no further split, and rows that its centroids are fitted on.
SHARD, SAMPLE = 2048, 4096
#: Parts of one split at most, and bytes of centroids that are broadcast at once.
PARTS, CENTROID_BYTES = 16, 32 << 20
#: Standard deviations of a link's component across a border, within which rows are guests.
DEVIATIONS = 2.0
#: A split is undone where it makes so many times the rows, or leaves such a share in one part.
GROWTH, LEFT = 4.0, 0.9
#: Neighbours kept per row and direction; nearest and farther candidates; strength of the pruning.
DEGREE, NEAR, FAR, ALPHA = 16, 64, 16, 1.2
#: Rows remembered by a search, medoids, and how far below the range it goes on.
BEAM, MEDOIDS, SLACK = 24, 8, 0.02
#: Rows at work at once, and pairs looked at at once.
CHUNK, PAIRS = 256, 1 << 18
#: Shards with more members are compared by exact products of blocks of them, of this many rows.
CROWD, CROWD_BLOCK = 32_768, 4096
#: Vectors held against all others, the recall they must show, and searches at most.
AUDIT, RECALL, TURNS = 2000, 0.97, 3

_MEMBER = "cell string, home boolean, node long, copies long, unit array<double>"
_MEMBER_ARROW = pa.schema(
    [("cell", pa.string()), ("home", pa.bool_()), ("node", pa.int64()), ("copies", pa.int64()), ("unit", pa.list_(pa.float64()))]
)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, which come one key after the other."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.array(batch.column(key).to_pylist(), dtype=object)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(starts[:-1], starts[1:]):
            if held and keys[a] != current:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component goes first, so that no square overflows."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


# --- Shards ------------------------------------------------------------------


def centroids_of(units: np.ndarray, parts: int) -> np.ndarray:
    """Directions of ``parts`` clusters of unit rows, each as far as may be from those before it at first."""
    centres = [units.mean(0)]
    nearest = np.full(len(units), -np.inf)
    for _ in range(parts):
        centres.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, units @ centres[-1])
    centres = np.array(centres[1:])
    for _ in range(8):
        of = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, units)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _centroids(members: DataFrame, large: DataFrame, shard: int) -> DataFrame:
    """``cell`` and the ``centroids`` of its parts, fitted on a bounded sample of each cell's home rows."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    sample = members.where("home").join(large.select("cell", "homes"), "cell").withColumn("nth", F.row_number().over(order))
    sample = sample.where(F.col("nth") <= SAMPLE).select("cell", "homes", "unit")
    out = pa.schema([("cell", pa.string()), ("centroids", pa.list_(pa.float64())), ("parts", pa.int32())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "cell"):
            homes = rows.column("homes")[0].as_py()
            parts = int(np.clip(-(-2 * homes // shard), 2, PARTS))
            centres = centroids_of(_matrix(_column(rows, "unit")), parts)
            columns = [rows.column("cell")[:1].combine_chunks(), _lists(centres.reshape(1, -1)), pa.array([parts], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return sample.repartition("cell").sortWithinPartitions("cell").mapInArrow(fit, "cell string, centroids array<double>, parts int")


def parts_of(units: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The part of each row, and whether it is a guest of each part.

    Two rows a link apart differ by at most ``reach``. If one is at home across
    a border, the other's lead over that border is at most ``reach`` times the
    distance of the two centroids, and mostly but a few deviations of a random direction.
    """
    dots = units @ centres.T
    best = dots.argmax(1)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold))
    share = min(1.0, DEVIATIONS / np.sqrt(units.shape[1]))
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    lead = dots[np.arange(len(units)), best][:, None] - dots
    guest = lead <= reach * share * gaps[best] + 1e-12
    guest[np.arange(len(units)), best] = False
    return best, guest


def _split(members: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """``members`` of the cells in ``centroids`` dealt to their parts, as ``cell`` with its ``parent``."""
    spark = members.sparkSession
    cells = centroids.agg(F.sum(F.size("centroids") * 8 + 64)).first()[0] or 0
    out = pa.schema([*_MEMBER_ARROW, ("parent", pa.string())])
    blocks = -(-cells // CENTROID_BYTES)
    found = []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("cell"), F.lit(blocks)) == block
        table = {r["cell"]: np.array(r["centroids"]).reshape(r["parts"], -1) for r in centroids.where(mine).collect()}
        sent = spark.sparkContext.broadcast(table)

        def deal(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                names, codes = np.unique(np.array(batch.column("cell").to_pylist(), dtype=object), return_inverse=True)
                for code, name in enumerate(names):
                    rows = batch.take(pa.array(np.flatnonzero(codes == code)))
                    best, guest = parts_of(_matrix(rows.column("unit")), sent.value[name], threshold)
                    home = rows.column("home").to_numpy(zero_copy_only=False)
                    own, part = np.nonzero(guest)
                    at = np.concatenate([np.arange(len(rows)), own])
                    part = np.concatenate([best, part])
                    kept = rows.take(pa.array(at))
                    cell = pa.array([f"{name}/{p}" for p in part.tolist()], pa.string())
                    at_home = pa.array(np.concatenate([home, np.zeros(len(own), bool)]))
                    parent = pa.array([name] * len(at), pa.string())
                    columns = [cell, at_home, kept.column("node"), kept.column("copies"), kept.column("unit"), parent]
                    yield pa.RecordBatch.from_arrays(columns, schema=out)

        names = centroids.where(mine).select("cell")
        found.append(members.join(names, "cell", "left_semi").select(members.columns).mapInArrow(deal, _MEMBER + ", parent string"))
    both = found[0]
    for other in found[1:]:
        both = both.unionAll(other)
    return both


def _shards(classes: DataFrame, threshold: float, shard: int) -> tuple[DataFrame, str]:
    """Members of all shards, and where they are staged."""
    members, path = staged_at(classes.select(F.col("label").alias("cell"), F.lit(True).alias("home"), "node", "copies", "unit"), "members")
    spark = classes.sparkSession
    while True:
        sizes = members.groupBy("cell").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("long")).alias("homes"))
        # A name that ends in "!" is a shard whose split was undone.
        large, large_path = staged_at(sizes.where((F.col("homes") > shard) & ~F.col("cell").endswith("!")), "large-cells")
        if large.isEmpty():
            discard(spark, large_path)
            return members, path
        centroids, centroid_path = staged_at(_centroids(members, large, shard), "centroids")
        split, split_path = staged_at(_split(members, centroids, threshold), "split-cells")
        after = split.groupBy("parent", "cell").agg(F.count("*").alias("rows"), F.sum(F.col("home").cast("long")).alias("homes"))
        after = after.groupBy("parent").agg(F.sum("rows").alias("rows_after"), F.max("homes").alias("most"))
        useful = large.join(after, F.col("cell") == F.col("parent")).where(
            (F.col("rows_after") <= GROWTH * F.col("rows")) & (F.col("most") <= LEFT * F.col("homes"))
        )
        verdict = large.select("cell").join(useful.select("cell", F.lit(True).alias("useful")), "cell", "left")
        verdict, verdict_path = staged_at(verdict, "verdicts")
        done = verdict.where("useful").select("cell")
        undone = verdict.where("useful is null").select("cell")
        same = members.join(verdict.select("cell"), "cell", "left_anti")
        given_up = members.join(undone, "cell", "left_semi").withColumn("cell", F.concat("cell", F.lit("!")))
        dealt = split.join(done.withColumnRenamed("cell", "parent"), "parent", "left_semi")
        columns = ["cell", "home", "node", "copies", "unit"]
        parts = same.select(columns).unionAll(given_up.select(columns)).unionAll(dealt.select(columns))
        members, new_path = staged_at(parts, "members")
        for old in (path, large_path, centroid_path, split_path, verdict_path):
            discard(spark, old)
        path = new_path


# --- Graph -------------------------------------------------------------------


def pruned(units: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """For rows ``own``, up to ``degree`` of their ``candidates``, -1 where there are fewer.

    The nearest candidate stays and removes all that are nearer to it, by the
    factor ``ALPHA``, than to the row itself; then the next one left, and so on.
    """
    near = np.einsum("qd,qcd->qc", units[own], units[candidates])
    near[candidates == own[:, None]] = -np.inf
    order = np.argsort(-near, 1, kind="stable")
    candidates, near = np.take_along_axis(candidates, order, 1), np.take_along_axis(near, order, 1)
    repeated = np.zeros(candidates.shape, bool)
    by_name = np.argsort(candidates, 1, kind="stable")
    names = np.take_along_axis(candidates, by_name, 1)
    np.put_along_axis(repeated, by_name[:, 1:], names[:, 1:] == names[:, :-1], 1)
    left = np.isfinite(near) & ~repeated
    away = 1 - near
    among = units[candidates]
    kept = np.full((len(own), degree), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(degree):
        first = left.argmax(1)
        any_left = left[rows, first]
        if not any_left.any():
            break
        kept[any_left, k] = candidates[any_left, first[any_left]]
        to_first = 1 - np.einsum("qd,qcd->qc", among[rows, first], among)
        left &= ~(ALPHA * ALPHA * to_first <= away)
        left[rows, first] = False
    return kept


def shard_graph(units: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours of each row, -1 where there are none: pruned lists and the nearest that point back."""
    number = len(units)
    near, far = min(NEAR, number), min(FAR, number)
    rng = np.random.default_rng(seed)
    lists = np.empty((number, DEGREE), np.int64)
    for start in range(0, number, CHUNK):
        own = np.arange(start, min(start + CHUNK, number))
        sims = units[own] @ units.T
        nearest = np.argpartition(-sims, near - 1, 1)[:, :near]
        others = rng.integers(0, number, (len(own), far))
        lists[own] = pruned(units, own, np.concatenate([nearest, others], 1), DEGREE)
    source, column = np.nonzero(lists >= 0)
    target = lists[source, column]
    sims = np.einsum("nd,nd->n", units[source], units[target])
    order = np.lexsort((source, -sims, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((number, DEGREE), -1, np.int64)
    within = place < DEGREE
    back[target[within], place[within]] = source[within]
    return np.concatenate([lists, back], 1)


def _graph(members: DataFrame, crowd: int) -> DataFrame:
    """``node`` and its ``neighbours`` in all shards together; crowded shards need none."""
    out = pa.schema([("node", pa.int64()), ("neighbours", pa.list_(pa.int64()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "cell"):
            node = _column(rows, "node").to_numpy()
            names = np.append(node, -1)
            lists = names[shard_graph(_matrix(_column(rows, "unit")))]
            yield pa.RecordBatch.from_arrays([pa.array(node), _lists(lists)], schema=out)

    sizes = members.groupBy("cell").agg(F.count("*").alias("_rows"))
    some = members.join(sizes.where(F.col("_rows") <= crowd), "cell", "left_semi")
    dealt = some.select("cell", "node", "unit").repartition("cell").sortWithinPartitions("cell", "node")
    lists = dealt.mapInArrow(build, "node long, neighbours array<long>")
    united = F.array_remove(F.array_distinct(F.flatten(F.collect_list("neighbours"))), F.lit(-1).cast("long"))
    return lists.groupBy("node").agg(united.alias("neighbours"))


# --- Search ------------------------------------------------------------------


def medoids(units: np.ndarray, number: int = MEDOIDS) -> np.ndarray:
    """The most central row of each of some groups of rows."""
    pivots = units[np.linspace(0, len(units) - 1, min(number, len(units))).astype(int)]
    of = (units @ pivots.T).argmax(1)
    found = []
    for group in np.unique(of):
        inside = np.flatnonzero(of == group)
        found.append(inside[(units[inside] @ units[inside].mean(0)).argmax()])
    return np.array(found)


def range_search(units: np.ndarray, graph: np.ndarray, own: np.ndarray, starts: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``own``, row) found whose cosine reaches ``threshold``, a row with itself left out.

    ``graph`` has the neighbours of each row, -1 for none. All rows ``own`` go
    through their greedy search in step; then whatever is found near the range
    hands on its neighbours until nothing new is within it.
    """
    queries, number = units[own], len(own)
    seen = np.zeros((number, len(units)), bool)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def looked_at(query: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs not seen before, once each, with their cosines."""
        new = ~seen[query, row]
        pair = np.unique(query[new] * len(units) + row[new])
        query, row = pair // len(units), pair % len(units)
        seen[query, row] = True
        cosine = np.einsum("nd,nd->n", queries[query], units[row])
        close = cosine >= threshold - SLACK
        hits.append((query[close], row[close], cosine[close]))
        return query, row, cosine

    rows = np.full((number, beam), -1, np.int64)
    cosines = np.full((number, beam), -np.inf)
    opened = np.zeros((number, beam), bool)

    def merged(query: np.ndarray, row: np.ndarray, cosine: np.ndarray) -> None:
        if not len(query):
            return
        place = np.arange(len(query)) - np.searchsorted(query, query)
        touched = np.unique(query)
        wide = int(place.max()) + 1
        at = np.searchsorted(touched, query)
        new_rows = np.full((len(touched), wide), -1, np.int64)
        new_cosines = np.full((len(touched), wide), -np.inf)
        new_rows[at, place], new_cosines[at, place] = row, cosine
        all_cosines = np.concatenate([cosines[touched], new_cosines], 1)
        order = np.argsort(-all_cosines, 1, kind="stable")[:, :beam]
        rows[touched] = np.take_along_axis(np.concatenate([rows[touched], new_rows], 1), order, 1)
        cosines[touched] = np.take_along_axis(all_cosines, order, 1)
        opened[touched] = np.take_along_axis(np.concatenate([opened[touched], np.zeros(new_rows.shape, bool)], 1), order, 1)

    every = np.arange(number)
    begin = np.concatenate([np.repeat(every, len(starts)), every]), np.concatenate([np.tile(starts, number), own])
    merged(*looked_at(*begin))
    while True:
        closed = ~opened & (rows >= 0)
        active = np.flatnonzero(closed.any(1))
        if not len(active):
            break
        best = np.where(closed[active], cosines[active], -np.inf).argmax(1)
        opened[active, best] = True
        near = graph[rows[active, best]]
        at, column = np.nonzero(near >= 0)
        merged(*looked_at(active[at], near[at, column]))

    done = 0
    while done < len(hits):
        query, row, _ = hits[done]
        done += 1
        for k in range(0, len(query), max(1, PAIRS // graph.shape[1])):
            part = slice(k, k + max(1, PAIRS // graph.shape[1]))
            near = graph[row[part]]
            at, column = np.nonzero(near >= 0)
            looked_at(query[part][at], near[at, column])
    query, row, cosine = (np.concatenate(column) for column in zip(*hits))
    linked = (cosine >= threshold) & (row != own[query])
    return query[linked], row[linked]


def _forest(a: np.ndarray, b: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked row and the smallest row of its component, other than itself."""
    low = np.arange(number)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            rows = np.flatnonzero(low != np.arange(number))
            return rows, low[rows]


# What a shard finds: ``within`` counts linked vectors of the same shard; a pair
# (a, b) says that the two are connected (``copies_b`` null) or linked across shards.
_FOUND = "a long, b long, within long, copies_a long, copies_b long"
_FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("a", "b", "within", "copies_a", "copies_b")])


def _rows(columns: list[np.ndarray | None]) -> pa.RecordBatch:
    size = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], schema=_FOUND_ARROW)


def _found(node: np.ndarray, home: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the links (a, b) of a shard's members; each a is at home, and a link may be given from either side."""
    both = home[a] & home[b]
    pair = np.unique(np.minimum(a[both], b[both]) * len(node) + np.maximum(a[both], b[both]))
    low, high = pair // len(node), pair % len(node)
    within = np.zeros(len(node), np.int64)
    np.add.at(within, low, copies[high])
    np.add.at(within, high, copies[low])
    some = np.flatnonzero(within)
    yield _rows([node[some], None, within[some], None, None])
    rows, roots = _forest(low, high, len(node))
    yield _rows([node[rows], node[roots], None, None, None])
    # Either side of a link between two shards may have found it: the same row twice.
    x, y = a[~both], b[~both]
    swap = node[x] > node[y]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    for k in range(0, len(x), 100_000):
        part = slice(k, k + 100_000)
        yield _rows([node[x[part]], node[y[part]], None, copies[x[part]], copies[y[part]]])


def _searched(members: DataFrame, graph: DataFrame, threshold: float, beam: int, crowd: int) -> DataFrame:
    """The links found by searches in shards that are not crowded."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "cell"):
            node, copies = (_column(rows, name).to_numpy() for name in ("node", "copies"))
            home = _column(rows, "home").to_numpy(zero_copy_only=False)
            units = _matrix(_column(rows, "unit"))
            lists = _column(rows, "neighbours")
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            order = np.argsort(node, kind="stable")
            at = np.minimum(np.searchsorted(node[order], flat), len(node) - 1)
            local = np.where(node[order][at] == flat, order[at], -1)
            sizes = np.diff(bounds)
            near = np.full((len(node), max(1, int(sizes.max()))), -1, np.int64)
            row = np.repeat(np.arange(len(node)), sizes)
            near[row, np.arange(bounds[0], bounds[-1]) - bounds[row]] = local[bounds[0] : bounds[-1]]
            starts, own = medoids(units), np.flatnonzero(home)
            parts = [range_search(units, near, own[k : k + CHUNK], starts, threshold, beam) for k in range(0, len(own), CHUNK)]
            if parts:
                a = np.concatenate([own[k * CHUNK + query] for k, (query, _) in enumerate(parts)])
                yield from _found(node, home, copies, a, np.concatenate([row for _, row in parts]))

    sizes = members.groupBy("cell").agg(F.count("*").alias("_rows"))
    some = members.join(sizes.where(F.col("_rows") <= crowd), "cell", "left_semi")
    some = some.join(graph, "node").select("cell", "home", "node", "copies", "unit", "neighbours")
    return some.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(search, _FOUND)


def _compared(members: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """The links in crowded shards, by exact products of blocks of home rows with blocks of members."""
    sizes = members.groupBy("cell").agg(F.count("*").alias("_rows")).where(F.col("_rows") > crowd)
    some = members.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("_rows") / CROWD_BLOCK).cast("int"))
    some = some.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # A block meets itself and each later one; both sides' rows come together under the pair's name.
    pairs = some.withColumn("other", other).withColumn(
        "pair", F.concat_ws("|", "cell", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "pair"):
            node, copies, own = (_column(rows, name).to_numpy() for name in ("node", "copies", "own"))
            home = _column(rows, "home").to_numpy(zero_copy_only=False)
            units = _matrix(_column(rows, "unit"))
            low, high = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
            same = own.min() == own.max()
            within = np.zeros(len(node), np.int64)
            firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k in range(0, len(low), CHUNK):
                part = low[k : k + CHUNK]
                linked = units[part] @ units[high].T >= threshold
                linked &= home[part][:, None] | home[high][None, :]
                linked &= part[:, None] != high[None, :]
                both = linked & home[part][:, None] & home[high][None, :]
                within[part] += both @ copies[high]
                if not same:
                    within[high] += copies[part] @ both
                across = np.nonzero(linked & ~both)
                firsts.append(part[across[0]])
                seconds.append(high[across[1]])
                a, b = np.nonzero(both)
                connected, roots = _forest(part[a], high[b], len(node))
                yield _rows([node[connected], node[roots], None, None, None])
            some = np.flatnonzero(within)
            yield _rows([node[some], None, within[some], None, None])
            none = np.zeros(len(node), bool)
            yield from _found(node, none, copies, np.concatenate(firsts), np.concatenate(seconds))

    dealt = pairs.select("pair", "own", "home", "node", "copies", "unit").repartition("pair").sortWithinPartitions("pair", "node")
    return dealt.mapInArrow(compare, _FOUND)


# --- Whole -------------------------------------------------------------------


def _audit(classes: DataFrame, numbers: DataFrame, threshold: float, audit: int) -> float:
    """Links of a sample that were found, as a share of those a comparison with all vectors finds."""
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(audit).select("label", "node", "copies", "unit").collect()
    by_label: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for label in {r["label"] for r in sample}:
        own = [r for r in sample if r["label"] == label]
        by_label[label] = np.array([r["node"] for r in own]), np.array([r["unit"] for r in own])
    sent = classes.sparkSession.sparkContext.broadcast(by_label)
    out = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            labels, codes = np.unique(np.array(batch.column("label").to_pylist(), dtype=object), return_inverse=True)
            for code, label in enumerate(labels):
                if label not in sent.value:
                    continue
                nodes, units = sent.value[label]
                rows = batch.take(pa.array(np.flatnonzero(codes == code)))
                copies, own = rows.column("copies").to_numpy(), rows.column("node").to_numpy()
                linked = (units @ _matrix(rows.column("unit")).T >= threshold) & (nodes[:, None] != own[None, :])
                for node, links in zip(nodes.tolist(), (linked @ copies).tolist()):
                    sums[node] = sums.get(node, 0) + links
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], schema=out)

    plain = classes.select("label", "node", "copies", "unit").mapInArrow(count, "node long, links long")
    plain = plain.groupBy("node").agg(F.sum("links").alias("links"))
    both = plain.join(numbers, "node", "left").agg(F.sum("links"), F.sum(F.coalesce("n", F.lit(0)))).first()
    sent.destroy()
    return 1.0 if not both[0] else both[1] / both[0]


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    shard: int = SHARD,
    crowd: int = CROWD,
    beam: int = BEAM,
    audit: int = AUDIT,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
) -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id``, ``kept`` and ``audit_recall``.

    Rows of equal label and length link at a cosine of ``threshold`` or more.
    Null labels, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; nor does a row with a null id,
    which is kept. Repeated rows are copies and link with each other. Further
    columns are ignored and an empty table gives no rows. ``audit_recall`` is
    the share of links found for ``audit`` of the vectors, the same in each row;
    below ``RECALL`` the search is done again with a beam twice as wide.
    """
    spark = vectors.sparkSession
    values = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"), values.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # A sum with zero turns the negative zero into the other one.
    same = F.when(usable, F.transform("v", lambda x: x + F.lit(0.0)))
    digest = F.sha2(F.concat_ws(",", same.cast("array<string>")), 256)
    rows = rows.select(
        "vec_id",
        F.when(usable, F.concat("label", F.lit("|"), F.size("v").cast("string"))).alias("label"),
        F.when(usable, digest).alias("digest"),
        same.alias("v"),
    )
    rows, row_path = staged_at(rows, "vectors")
    grouped = rows.where("digest is not null").groupBy("label", "digest").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("v").alias("v")
    )
    out = pa.schema([("label", pa.string()), ("digest", pa.string()), ("copies", pa.int64()), ("least", pa.int64()), ("unit", pa.list_(pa.float64()))])

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                columns = [part.column(name) for name in ("label", "digest", "copies", "least")]
                yield pa.RecordBatch.from_arrays([*columns, _lists(unit_rows(_matrix(part.column("v"))))], schema=out)

    classes = grouped.mapInArrow(normal, "label string, digest string, copies long, least long, unit array<double>")
    # Stored at once: in another run of the plan the numbers would differ.
    classes, class_path = staged_at(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    members, member_path = _shards(classes, threshold, shard)
    graph, graph_path = staged_at(_graph(members, crowd), "vector-graph")
    compared, compared_path = staged_at(_compared(members, threshold, crowd), "crowded-links")
    for turn in range(TURNS):
        searched, searched_path = staged_at(_searched(members, graph, threshold, beam << turn, crowd), "found-links")
        found = searched.unionAll(compared)
        across = found.where("copies_b is not null").select("a", "b", "copies_a", "copies_b").distinct()
        sides = across.select(F.col("a").alias("node"), F.col("copies_b").alias("n")).unionAll(across.select(F.col("b").alias("node"), F.col("copies_a").alias("n")))
        within = found.where("within is not null").select(F.col("a").alias("node"), F.col("within").alias("n"))
        numbers, number_path = staged_at(sides.unionAll(within).groupBy("node").agg(F.sum("n").alias("n")), "link-numbers")
        recall = _audit(classes, numbers, threshold, audit)
        if recall >= RECALL or turn == TURNS - 1:
            break
        for old in (searched_path, number_path):
            discard(spark, old)
    for old in (member_path, graph_path):
        discard(spark, old)
    roots = components(found.where("b is not null"), "a", "b")
    placed = classes.join(roots, "node", "left").select("label", "digest", "copies", "least", "node", F.coalesce("root", "node").alias("root"))
    placed = staged(placed, "placed-classes")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").join(numbers, "node", "left").select(
        "label", "digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"
    )
    for old in (class_path, searched_path, compared_path):
        discard(spark, old)
    whole = rows.drop("v").join(named, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
        F.lit(float(recall)).alias("audit_recall"),
    )
