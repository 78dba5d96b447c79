import random

import pytest

import brute
from partatlas.operators import cluster_metrics, clustering

NAMES = "row_id long, features array<double>"


def frame(spark, points, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], list(map(float, p))) for k, p in enumerate(points)], NAMES)


def labels_of(spark, points, threshold, least=3):
    found = clustering.dbscan(clustering.VectorIndex(frame(spark, points)), threshold, least)
    return [r.cluster for r in found.orderBy("row_id").collect()]


def test_dbscan_equals_expansion(spark, tiny_limits):
    rng = random.Random(5)
    points = [[rng.gauss(0, 1) for _ in range(2)] for _ in range(30)] + [[0.0, 0.0]]
    points += points[:3] + [points[0]] * 3
    for threshold in (0.999, 0.9):
        assert labels_of(spark, points, threshold) == brute.dbscan(points, threshold, 3)


def test_group_of_two_is_noise_and_of_three_a_cluster(spark):
    points = [[1, 0, 0]] * 2 + [[0, 1, 0]] * 3 + [[0, 0, 0]]
    assert labels_of(spark, points, 0.9) == [-1, -1, 0, 0, 0, -1]


def test_border_point_takes_the_lower_cluster(spark):
    # the middle point reaches one core on each side but has too few neighbours itself
    angles = [0, 0, 0, 20, 40, 60, 60, 60]
    import math

    points = [[math.cos(math.radians(a)), math.sin(math.radians(a))] for a in angles]
    threshold = math.cos(math.radians(21))
    assert labels_of(spark, points, threshold, 4) == brute.dbscan(points, threshold, 4)


def labelled(spark, clusters, points):
    table = frame(spark, points)
    return spark.createDataFrame(list(enumerate(clusters)), "row_id long, cluster int"), table


def test_clique_graph(spark):
    labels, _ = labelled(spark, [0, 1, 1, 2, 2, 2, 2, 2, -1], [[0]] * 9)
    got = cluster_metrics.cluster_graph_metrics(labels).first()
    assert (got.avg_degree, got.num_components, got.largest_component) == (pytest.approx((2 * 1 + 5 * 4) / 7), 2, 5)


def test_no_metrics_for_one_cluster(spark):
    labels, vectors = labelled(spark, [0, 0, -1], [[0, 1], [1, 0], [5, 5]])
    assert cluster_metrics.cluster_metrics(labels, vectors).count() == 0


def test_metrics_by_hand(spark, tiny_limits):
    labels, vectors = labelled(spark, [0, 0, 1, 1, -1], [[0, 0], [0, 2], [4, 0], [4, 2], [9, 9]])
    got = cluster_metrics.cluster_metrics(labels, vectors).first()
    inside, outside = 2.0, (4 + 20**0.5) / 2
    assert got.silhouette == pytest.approx((outside - inside) / outside, abs=1e-6)
    assert got.calinski_harabasz == pytest.approx(16 / 1 / (4 / 2))
    assert got.davies_bouldin == pytest.approx((1 + 1) / 4)


def test_kmeans_labels(spark):
    table = frame(spark, [[0, 0], [0, 0.1], [9, 9], [9, 9.1]])
    found = {r.row_id: r.cluster for r in clustering.kmeans_assign(table, k=2).collect()}
    assert found[0] == found[1] != found[2] == found[3]


def test_silhouette_of_far_clusters_asks_for_few_distances(spark, tiny_limits):
    rng = random.Random(3)
    centres = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(15)]
    points = [(x + rng.gauss(0, 0.5), y + rng.gauss(0, 0.5)) for x, y in centres for _ in range(4)] + [(500, 500), (7, 7)]
    clusters = [k for k in range(15) for _ in range(4)] + [15, -1]
    labels, vectors = labelled(spark, clusters, points)
    open_ = cluster_metrics.open_clusters(cluster_metrics._clustered(labels, vectors)).count()
    assert open_ < 0.25 * 61 * 15
    gap = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
    total = 0.0
    for p, c in zip(points, clusters):
        if c in (15, -1):
            continue
        means = {}
        for other in range(16):
            near = [gap(p, q) for q, d in zip(points, clusters) if d == other]
            means[other] = sum(near) / (len(near) - (other == c))
        inside = means.pop(c)
        total += (min(means.values()) - inside) / max(min(means.values()), inside)
    assert cluster_metrics.silhouette(labels, vectors).first().silhouette == pytest.approx(total / 61, abs=1e-6)


def test_vectors_of_single_precision_are_sent_as_such(spark, monkeypatch):
    """Cells get half the bytes where nothing is lost by it, and the same cosines either way."""
    import numpy as np

    from partatlas.operators import clustering

    rng = np.random.default_rng(2)
    exact = rng.normal(size=(40, 5))
    sent, plain = [], clustering.grid
    monkeypatch.setattr(clustering, "grid", lambda pairs, members, *a: sent.append(members.columns) or plain(pairs, members, *a))
    for rows, expected in ((exact.astype(np.float32).astype(float), ["norm", "single"]), (exact, ["unit"])):
        table = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(rows)], "row_id long, features array<double>")
        found = {(r.row_i, r.row_j): r.cosine for r in clustering.neighbour_pairs(clustering.VectorIndex(table), 0.3).collect()}
        assert sent.pop()[3:] == expected
        units = rows / (np.sqrt((rows * rows).sum(axis=1)) + clustering.NORM_GUARD)[:, None]
        cosines = np.round(units @ units.T, 9)
        assert found.keys() == {(i, j) for i in range(40) for j in range(i + 1, 40) if cosines[i, j] >= 0.3}
        assert all(abs(found[i, j] - cosines[i, j]) < 2e-9 for i, j in found)
