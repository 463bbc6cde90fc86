"""Neighbour graph, density clusters and connected components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaudit.functions.vectors import is_finite_vector
from plaudit.operators import density as D
from plaudit.operators.components import components
from plaudit.plans.session import durable


def table(spark, rows):
    return spark.createDataFrame(
        [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 3) for i, v in rows],
        "review_id long, embedding array<float>, node string, copies int",
    ).repartition(3)


def nodes_of(spark, rows):
    return durable(D.distinct_vectors(table(spark, rows)), "nodes")


def planted(rng, clusters=30, size=120, noise=600, width=48, spread=0.04):
    """Directions with rows around them, and rows that lie anywhere; label -1 is noise."""
    centres = rng.normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, size, axis=0) + rng.normal(size=(clusters * size, width)) * spread / np.sqrt(width) * 4
    far = rng.normal(size=(noise, width))
    labels = np.r_[np.repeat(np.arange(clusters), size), np.full(noise, -1)]
    return np.r_[x, far].astype(np.float32), labels


def test_finite_vectors(spark):
    rows = [(0, [1, 2]), (1, None), (2, []), (3, [1, None]), (4, [float("nan"), 1]), (5, [float("inf"), 1]), (6, [0, 0])]
    found = table(spark, rows).where(is_finite_vector(F.col("embedding"))).select("review_id")
    assert sorted(r[0] for r in found.collect()) == [0, 6]


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (260, 2))]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(6000, 6100)] + [(7, 7), (None, 3), (9999, 9999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long").repartition(4)
    found = {r.node: r.root for r in components(table).collect()}
    assert found == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph_is_exact_within_a_bucket(spark, rng=np.random.default_rng(1)):
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i + 10, v.tolist()) for i, v in enumerate(x)] + [(500, x[3].tolist()), (501, x[3].tolist()), (600, None), (601, [0.0] * 8)]
    graph = {r.node: r for r in D.neighbour_graph(nodes_of(spark, rows), 5).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    unit = np.r_[unit, np.zeros((1, 8))]
    ids = [*range(10, 210), 601]
    assert sorted(graph) == ids and graph[13].copies == 3
    for i, node in enumerate(ids):
        d = np.linalg.norm(unit - unit[i], axis=1)
        d[i] = np.inf
        order = np.lexsort((ids, np.round(d, 12)))[:5]
        assert [n.other for n in graph[node].near] == [ids[k] for k in order] or np.allclose([n.distance for n in graph[node].near], d[order])
        assert np.allclose([n.distance for n in graph[node].near], d[order], atol=1e-9)
    cores = {r.node: r.core_distance for r in D.with_core_distance(spark.createDataFrame(list(graph.values()), "node long, copies long, near array<struct<distance:double,other:long,copies:long>>"), 3).collect()}
    assert cores[13] == pytest.approx(graph[13].near[0].distance)  # two copies and the nearest other
    assert cores[10] == pytest.approx(graph[10].near[2].distance if 13 not in [n.other for n in graph[10].near[:2]] else cores[10])


def test_recall_over_many_buckets(spark, rng=np.random.default_rng(2)):
    x, labels = planted(rng, clusters=60, size=110, noise=2000)
    nodes = nodes_of(spark, enumerate(x.tolist()))
    graph = {r.node: {n.other for n in r.near} for r in D.neighbour_graph(nodes, 10).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    some = rng.permutation(len(x))[:600]
    near = 2 - 2 * unit[some] @ unit.T
    near[np.arange(len(some)), some] = np.inf
    true = np.argsort(near, axis=1)[:, :10]
    hits = np.array([len(graph[i] & set(t.tolist())) / 10 for i, t in zip(some.tolist(), true)])
    inside = labels[some] >= 0
    assert len(x) > 4 * D.BUCKET
    assert hits[inside].mean() >= 0.98 and hits.mean() >= 0.9


def test_planted_clusters_are_found_and_noise_left(spark, rng=np.random.default_rng(3)):
    x, labels = planted(rng)
    rows = [*enumerate(x.tolist()), (90_000, None), (90_001, [float("nan")] * 48), (90_002, x[0].tolist())]
    found = {r.review_id: r for r in D.density_clusters(table(spark, rows), 10, 60, core_share=0.85).collect()}  # 0.14 is noise
    assert len(found) == len(rows)
    assert found[90_000].cluster is None and found[90_001].core_distance is None and found[90_002].cluster == found[0].cluster
    of = np.array([-1 if found[i].cluster is None else found[i].cluster for i in range(len(x))])
    for label in range(30):
        own = of[labels == label]
        names, counts = np.unique(own[own >= 0], return_counts=True)
        assert len(names) == 1 and counts[0] >= 0.95 * 120
    assert (of[labels == -1] == -1).all()
    assert len(np.unique(of)) == 31
    sizes = {r.cluster: r.cluster_size for r in found.values() if r.cluster is not None}
    assert sizes == {c: sum(r.cluster == c for r in found.values()) for c in sizes}


def test_a_third_of_equal_rows_is_one_node(spark, rng=np.random.default_rng(4)):
    x = rng.normal(size=(400, 6)).astype(np.float32).tolist()
    rows = [*enumerate(x), *((1000 + i, x[0]) for i in range(200))]
    assert nodes_of(spark, rows).count() == 400
    found = {r.review_id: r for r in D.density_clusters(table(spark, rows), 10, 60, radius=1e-4).collect()}
    assert {i for i, r in found.items() if r.cluster is not None} == {0, *range(1000, 1200)}
    assert found[0].core_distance == 0 and found[1100].cluster == 0 and found[1100].cluster_size == 201


def test_clusters_of_few_rows(spark):
    assert D.density_clusters(table(spark, [])).count() == 0
    found = D.density_clusters(table(spark, [(1, [1.0, 0.0]), (2, None)])).collect()
    assert sorted((r.review_id, r.core_distance, r.cluster) for r in found) == [(1, None, None), (2, None, None)]
