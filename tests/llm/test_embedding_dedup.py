"""Links of embeddings against all cosines."""

import numpy as np
import pytest

from skilltrend.llm import embedding_dedup as module
from skilltrend.llm.embedding_dedup import near_vectors, pruned, range_search, shard_graph, unit_rows

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string, copies int, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "c", 2, 3) for i, v, label in rows], SCHEMA)


def brute(rows, threshold=0.98):
    usable = {}
    for k, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        unit = np.array(v, np.float32).astype(float)
        usable[k] = unit / np.linalg.norm(unit)
    links = {k: [] for k in range(len(rows))}
    for a in usable:
        for b in usable:
            if a != b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]):
                same = np.array_equal(usable[a], usable[b])
                if same or usable[a] @ usable[b] >= threshold:
                    links[a].append(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        reached, queue = {k}, [k]
        while queue:
            for other in links[queue.pop()]:
                if other not in reached:
                    reached.add(other)
                    queue.append(other)
        low = None if i is None else min(rows[r][0] for r in reached)
        out.append((i, len(links[k]), low, i is None or i == low))
    return sorted(out, key=str)


def cloud(seed, count, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for _ in range(count):
        label = int(rng.choice([1, 1, 1, 2, 3]))
        base = centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.02, 0.05, 1.0])
        rows.append((len(rows), base.tolist(), label))
        if rng.random() < 0.2:
            rows.append((len(rows), (base * 3 + rng.normal(size=dims) * 0.1).tolist(), label))
    return rows


def edge_rows(start, dims=24):
    one = [1.0] + [0.0] * (dims - 1)
    odd = [(None, one, 1), (None, None, None), (start, None, 1), (start + 1, [0.0] * dims, 1), (start + 2, [*one[1:], None], 1)]
    odd += [(start + 3, [*one[1:], float("nan")], 1), (start + 4, [*one[1:], float("inf")], 1), (start + 5, [], 1), (start + 6, one, None)]
    odd += [(start + 7, [1.0, 0.0], 1), (start + 8, [2.0, 0.0], 1), (start + 9, [1.0] + [-0.0] * (dims - 1), 1)]
    return odd + [(start + 10 + k % 3, one, 1) for k in range(40)] + [(start + 20, [x * 1e-30 for x in one], 1), (start + 21, [x * 1e30 for x in one], 9)]


@pytest.mark.parametrize("shard, crowd", [(2048, 32_768), (60, 32_768), (60, 50)])
def test_equals_all_cosines(spark, monkeypatch, shard, crowd):
    monkeypatch.setattr(module, "CROWD_BLOCK", 40)
    monkeypatch.setattr(module, "PARTS", 4)
    rows = cloud(1, 700) + edge_rows(10_000)
    found = near_vectors(table(spark, rows), shard=shard, crowd=crowd).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found), key=str)
    expected = brute(rows)
    assert [g[0] for g in got] == [e[0] for e in expected] and len({r["audit_recall"] for r in found}) == 1
    # A link can be missed but none is made up, and the audit, here over all vectors, says so.
    links, all_links = sum(g[1] for g in got), sum(e[1] for e in expected)
    assert all(g[1] <= e[1] for g, e in zip(sorted(got, key=str), expected)) or links == all_links
    assert links >= 0.97 * all_links and found[0]["audit_recall"] >= 0.97
    if links == all_links:
        assert got == expected
    assert shard != 2048 or got == expected


def test_empty_table(spark):
    assert near_vectors(table(spark, [])).count() == 0
    assert near_vectors(table(spark, [(1, None, 1)])).first()[:4] == (1, 0, 1, True)


def test_pruning_keeps_the_nearest_of_each_direction():
    units = unit_rows(np.array([[1, 0, 0], [1, 0.1, 0], [1, 0.11, 0], [1, 0, 0.3], [-1, 0, 0.1]], float))
    kept = pruned(units, np.array([0]), np.array([[4, 3, 2, 1, 0, 1]]), 4)
    assert kept.tolist() == [[1, 3, 4, -1]] or kept.tolist() == [[1, 3, -1, -1]]


def test_search_finds_a_dense_ball_and_pairs():
    rng = np.random.default_rng(5)
    ball = rng.normal(size=(1, 32)) + rng.normal(size=(400, 32)) * 0.05
    rest = rng.normal(size=(1500, 32))
    units = unit_rows(np.concatenate([ball, rest, rest[:200] + rng.normal(size=(200, 32)) * 0.05]))
    graph = shard_graph(units)
    own = np.arange(len(units))
    query, row = range_search(units, graph, own, module.medoids(units), 0.98, module.BEAM)
    plain = units @ units.T >= 0.98
    np.fill_diagonal(plain, False)
    assert plain[query, row].all() and len(query) >= 0.97 * plain.sum()
    # Started at the medoids alone, the beam still reaches most rows.
    found = [range_search(units, graph, own[k : k + 1], module.medoids(units), 0.98, 64) for k in range(0, len(units), 50)]
    assert sum(len(f[0]) for f in found) >= 0.97 * plain[::50].sum()
