from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from patronmap.operators import clustering as c
from patronmap.operators import density
from patronmap.operators import silhouette as sil
from patronmap.operators.components import connected_components
from patronmap.operators.density import dbscan
from patronmap.operators.features import prepare_features
from patronmap.plans.clusters import segment
from patronmap.settings import AutoK, Settings
from patronmap.storage import shared_folder

XY = ["f", "g"]


def test_standard_scaling(spark):
    """Population deviation: of 3, 7, 11, 15 it is sqrt(20)."""
    frame = spark.createDataFrame([(3, 5.0), (7, 5.0), (11, 9.0), (15, 9.0)], "recency BIGINT, monetary DOUBLE")
    scaled = prepare_features(frame, ["recency", "monetary"], "StandardScaler", {"R": 2, "M": 0.5})
    rows = sorted(map(tuple, scaled.collect()))
    assert [r[1] for r in rows] == [-1.0, -1.0, 1.0, 1.0]
    assert [r[0] * 20**0.5 for r in rows] == pytest.approx([-6.0, -2.0, 2.0, 6.0])


@pytest.mark.parametrize("scaler", ["StandardScaler", "MinMaxScaler"])
def test_constant_column_becomes_zero(spark, scaler):
    frame = spark.createDataFrame([(0.1, 1.0)] * 3 + [(0.1, 2.0)], "recency DOUBLE, other DOUBLE")
    scaled = prepare_features(frame, ["recency", "other"], scaler).collect()
    assert {r.recency for r in scaled} == {0.0}
    assert len({r.other for r in scaled}) == 2


def test_minmax_and_weights(spark):
    frame = spark.createDataFrame(
        [(10, 1, 7), (20, 3, 9), (30, 2, 8)], "recency INT, my_frequency INT, F_score INT"
    )
    names = ["recency", "my_frequency", "F_score"]
    scaled = prepare_features(frame, names, "MinMaxScaler", {"R": 0, "F": 2.5})
    assert [tuple(r) for r in scaled.collect()] == [(0.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.0, 0.5, 0.5)]


def test_nearest_centre_first_of_equals(spark):
    frame = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (10.0, 1.0)], "f DOUBLE, g DOUBLE")
    labelled = c.assign_nearest(frame, XY, [(0, 0), (10, 0)])
    assert [r.cluster for r in labelled.collect()] == [0, 0, 1]


def blobs(seed=0, n=60):
    rng = np.random.default_rng(seed)
    centres = [(0.0, 0.0), (8.0, 0.0), (2.0, 8.0)]
    return np.concatenate([rng.normal(m, 0.3, (n, 2)) for m in centres])


def frame_of(spark, points, seed=0):
    ids = np.random.default_rng(seed).permutation(len(points))
    pdf = pd.DataFrame(points, columns=XY).assign(customer_id=ids)
    return spark.createDataFrame(pdf), pdf.sort_values("customer_id")


def brute_silhouette(points, labels, squared=False):
    gaps = ((points[:, None, :] - points[None]) ** 2).sum(-1)
    gaps = gaps if squared else np.sqrt(gaps)
    values = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            values.append(0.0)
            continue
        inside = gaps[i, mine].sum() / (mine.sum() - 1)
        outside = min(gaps[i, labels == o].mean() for o in set(labels) - {own})
        widest = max(inside, outside)
        values.append((outside - inside) / widest if widest else 0.0)
    return float(np.mean(values))


@pytest.mark.parametrize("metric", [sil.EUCLIDEAN, sil.SQUARED_EUCLIDEAN])
@pytest.mark.parametrize("block", [4096, 50])
def test_silhouette_equals_brute_force(spark, metric, block, monkeypatch):
    monkeypatch.setattr(sil, "BLOCK_POINTS", block)
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(150, 2)), np.repeat([[0.5, 0.5]], 40, axis=0)])
    labels = np.concatenate([rng.integers(0, 3, 189), [7]])
    pdf = pd.DataFrame(points, columns=XY).assign(cluster=labels)
    value = sil.silhouette(spark.createDataFrame(pdf), XY, metric=metric)
    expected = brute_silhouette(points, labels, metric == sil.SQUARED_EUCLIDEAN)
    assert value == pytest.approx(expected, abs=1e-12)


def test_silhouette_of_equal_points(spark):
    rows = [(1.0, 1.0, 0)] * 3 + [(1.0, 1.0, 1)] * 2
    frame = spark.createDataFrame(rows, "f DOUBLE, g DOUBLE, cluster INT")
    assert sil.silhouette(frame, XY) == 0.0


def test_silhouette_needs_two_clusters(spark):
    frame = spark.createDataFrame([(1.0, 1.0, 0)], "f DOUBLE, g DOUBLE, cluster INT")
    with pytest.raises(ValueError):
        sil.silhouette(frame, XY)


@pytest.mark.parametrize("metric", [sil.EUCLIDEAN, sil.SQUARED_EUCLIDEAN])
def test_best_k_of_three_blobs(spark, metric):
    frame, _ = frame_of(spark, blobs())
    sweep = c.auto_k(frame, XY, ks=AutoK(2, 5), metric=metric)
    rows = as_dict(sweep, "k")
    assert sorted(rows) == [2, 3, 4, 5]
    assert rows[2].inertia > rows[3].inertia > rows[5].inertia
    assert c.best_k(sweep).first().k == 3


def test_sweep_stops_below_the_number_of_rows(spark):
    frame = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (5.0, 5.0)], "f DOUBLE, g DOUBLE")
    assert [r.k for r in c.auto_k(frame, XY, ks=AutoK(2, 9)).collect()] == [2]


def test_equal_points_are_merged(spark):
    rows = [(5, 5, 5)] * 10 + [(1, 1, 1)] * 10 + [(1, 1, 2)] * 5
    frame = spark.createDataFrame(rows, "R_score INT, F_score INT, M_score INT")
    points = c.grid_points(frame, c.SCORES)
    assert sorted(r.weight for r in points.collect()) == [5, 10, 10]
    fitted = c.fit_kmeans(points, 2)
    assert fitted.sizes == (15, 10) and fitted.inertia == pytest.approx(10 * 5 / 15)
    swept = c.auto_k(frame, list(c.SCORES), ks=AutoK(2, 2)).first()
    assert (swept.k, swept.metric) == (2, sil.EUCLIDEAN)


def slow_kmeans(points, k):
    """Plain rounds over all rows, from the same starts."""
    def gaps(centres):
        return ((points[:, None, :] - np.array(centres)[None]) ** 2).sum(-1)

    seeds = [points.mean(axis=0)]
    far = gaps(seeds)[:, 0]
    centres = []
    for _ in range(k):
        at = min(range(len(points)), key=lambda i: (-far[i], *points[i]))
        centres.append(points[at])
        far = gaps(centres).min(axis=1)
    while True:
        own = gaps(centres).argmin(axis=1)
        moved = [points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
        if np.allclose(moved, centres, atol=1e-12):
            return sorted(map(tuple, centres)), gaps(centres).min(axis=1).sum()
        centres = moved


@pytest.mark.parametrize("k", [1, 3, 6])
def test_fit_equals_plain_rounds(spark, k):
    points = np.random.default_rng(k).normal(size=(200, 2)).round(6)
    frame, _ = frame_of(spark, points)
    fitted = c.fit_kmeans(c.grid_points(frame, XY), k)
    centres, inertia = slow_kmeans(points, k)
    assert np.allclose(fitted.points, centres, atol=1e-9) and fitted.inertia == pytest.approx(inertia)
    assert sum(fitted.sizes) == 200


def test_fit_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(c, "HELD_POINTS", 10)  # leave the points with Spark
    frame, _ = frame_of(spark, np.random.default_rng(5).normal(size=(500, 2)))
    points = c.grid_points(frame, XY)
    fits = [c.fit_all(points.repartition(n).persist(), [2, 4]) for n in (1, 4, 8)]
    for k in (2, 4):
        assert len({f[k].points for f in fits}) == 1 and len({f[k].rounds for f in fits}) == 1
        assert len({round(f[k].inertia, 9) for f in fits}) == 1
    trees = [c.fit_tree(points.repartition(n).persist(), 4) for n in (1, 4)]
    assert [leaf.centre for leaf in trees[0]] == [leaf.centre for leaf in trees[1]]


def test_points_that_are_held_give_the_same_fit(spark, monkeypatch):
    frame, _ = frame_of(spark, np.random.default_rng(8).normal(0, 3, (900, 2)))
    points = c.grid_points(frame, XY).persist()
    near = c.fit_all(points, [2, 5]), c.fit_tree(points, 4)
    monkeypatch.setattr(c, "HELD_POINTS", 10)
    assert isinstance(c.held(points), type(points))
    far = c.fit_all(points, [2, 5]), c.fit_tree(points, 4)
    for k in (2, 5):
        assert (near[0][k].points, near[0][k].sizes, near[0][k].rounds) == (far[0][k].points, far[0][k].sizes, far[0][k].rounds)
        assert near[0][k].inertia == pytest.approx(far[0][k].inertia, rel=1e-12)
    assert [leaf.centre for leaf in near[1]] == [leaf.centre for leaf in far[1]]


def test_rounds_have_a_told_limit(spark):
    frame, _ = frame_of(spark, np.random.default_rng(5).normal(size=(300, 2)))
    with pytest.raises(RuntimeError, match="still move after 1 rounds"):
        c.fit_kmeans(c.grid_points(frame, XY), 5, max_rounds=1)


def test_large_weights_do_not_overflow(spark):
    rows = [(-40 * 10**9, 3 * 10**9), (40 * 10**9, 10**9), (39 * 10**9, 10**9)]
    points = spark.createDataFrame(rows, "g0 BIGINT, weight BIGINT")
    assert c.fit_kmeans(points, 2).points == ((-40.0,), (39.5,))
    assert c.fit_kmeans(points, 1).points == ((-8.2,),)


def test_fewer_points_than_clusters_and_none(spark):
    frame = spark.createDataFrame([(1.0, 1.0)] * 3 + [(2.0, 2.0)] * 2, "f DOUBLE, g DOUBLE")
    assert c.fit_kmeans(c.grid_points(frame, XY), 4).inertia == 0.0
    assert len(c.fit_tree(c.grid_points(frame, XY), 4)) == 2
    assert c.fit_kmeans(c.grid_points(frame.limit(0), XY), 2).points == ()
    assert c.auto_k(frame.limit(0), XY).collect() == []


def test_squared_silhouette_of_many_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5000, 2)) * 100
    points = np.concatenate([centres, centres + 0.01])
    pdf = pd.DataFrame(points, columns=XY).assign(cluster=np.tile(np.arange(5000), 2))
    value = sil.silhouette(spark.createDataFrame(pdf), XY, metric=sil.SQUARED_EUCLIDEAN)
    assert 0.9 < value <= 1.0
    with pytest.raises(ValueError, match="too many"):
        sil.silhouette(spark.createDataFrame(pdf), XY)


def test_infinite_features_are_an_error(spark):
    frame = spark.createDataFrame([(1.0, 1.0, 1), (float("inf"), 2.0, 2), (3.0, 1.0, 3)], "f DOUBLE, g DOUBLE, customer_id INT")
    for scaler in ("StandardScaler", "MinMaxScaler"):
        with pytest.raises(ValueError, match="infinite values cannot be scaled: f"):
            segment(frame, "DBSCAN", XY, scaler, eps=1.0, min_samples=2)


def test_settings_choose_algorithm_scaler_and_k(spark):
    frame, pdf = frame_of(spark, blobs())
    given = {"default_scaler": "MinMaxScaler", "segmentation_default_algorithm": "Hierarchical (Agglomerative)", "auto_k": {"k_min": 6, "k_max": 2}}
    done = segment(frame, features=XY, settings=Settings.from_dict(given))
    assert done.select("cluster").distinct().count() == 3
    with pytest.raises(ValueError, match="needs k"):
        segment(frame, features=XY)


def folders(spark):
    base = Path(shared_folder(spark).removeprefix("file:")) / "patronmap" / spark.sparkContext.applicationId
    return {p.name for p in base.iterdir()} if base.is_dir() else set()


def test_only_the_result_is_left_behind(spark):
    frame, _ = frame_of(spark, blobs())
    before = folders(spark)
    found = segment(frame, "DBSCAN", XY, eps=0.3, min_samples=4)
    assert len(folders(spark) - before) == 1 and found.count() == 180
    before = folders(spark)
    c.auto_k(frame, XY, ks=AutoK(2, 3))
    assert folders(spark) == before


@pytest.mark.parametrize("algorithm", ["K-Means", "Hierarchical", "Hierarchical (Agglomerative)"])
def test_three_blobs_are_three_clusters(spark, algorithm):
    frame, pdf = frame_of(spark, blobs())
    done = segment(frame, algorithm, XY, k=3)
    assert done.columns == ["f", "g", "customer_id", "cluster"]
    clusters = done.toPandas().sort_values("customer_id")["cluster"].to_numpy()
    truth = np.where(pdf["f"] > 4, 2, np.where(pdf["g"] > 4, 1, 0))
    assert (clusters == truth).all()


def test_segment_checks_its_arguments(spark):
    frame, _ = frame_of(spark, blobs())
    for wrong in ({"algorithm": "K-Means"}, {"algorithm": "DBSCAN"}, {"algorithm": "other", "k": 2}):
        with pytest.raises(ValueError):
            segment(frame, features=XY, **wrong)


def brute_dbscan(points, eps, min_samples):
    near = ((points[:, None, :] - points[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= min_samples
    labels = np.full(len(points), -1)
    found = 0
    for start in range(len(points)):
        if not core[start] or labels[start] >= 0:
            continue
        labels[start], stack = found, [start]
        while stack:
            here = stack.pop()
            for other in np.where(near[here] & core & (labels < 0))[0]:
                labels[other] = found
                stack.append(other)
        found += 1
    for i in np.where(~core)[0]:
        reached = labels[near[i] & core]
        if len(reached):
            labels[i] = reached.min()
    return labels


def check_dbscan(spark, points, eps, min_samples):
    frame, pdf = frame_of(spark, points)
    done = dbscan(frame, XY, eps, min_samples).toPandas().sort_values("customer_id")
    expected = brute_dbscan(pdf[XY].to_numpy(), eps, min_samples)
    assert len(done) == len(points)
    assert (done["cluster"].to_numpy() == expected).all()
    return expected


def test_blobs_and_noise(spark):
    points = np.concatenate([blobs(), [[50.0, 50.0], [-50.0, 3.0]]])
    labels = check_dbscan(spark, points, 1.0, 5)
    assert sorted(set(labels)) == [-1, 0, 1, 2] and (labels == -1).sum() == 2


@pytest.mark.parametrize("direct_pairs", [2500, 8])
def test_dbscan_with_a_hot_cell(spark, direct_pairs, monkeypatch):
    """A third of the points share a cell, many of them are equal."""
    monkeypatch.setattr(density, "DIRECT_PAIRS", direct_pairs)
    rng = np.random.default_rng(5)
    points = np.concatenate(
        [rng.normal(0, 0.02, (250, 2)), np.zeros((100, 2)), rng.normal(0.45, 0.03, (150, 2)),
         rng.uniform(-2, 2, (400, 2))]
    )
    check_dbscan(spark, points, 0.3, 6)


@pytest.mark.parametrize("d", [4, 6])
def test_dbscan_along_many_axes(spark, d):
    """Most cells agree along the widest axes and differ along the narrow ones only."""
    rng = np.random.default_rng(d)
    wide = rng.choice([-20.0, 0.0, 20.0], (300, 3)) * (rng.random((300, 1)) < 0.1)
    points = np.concatenate([wide, rng.uniform(-0.9, 0.9, (300, d - 3))], axis=1)
    points = np.concatenate([points, points[:40], rng.uniform(-20, 20, (30, d))])
    names = [f"f{i}" for i in range(d)]
    rows = [(i, *map(float, p)) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "customer_id BIGINT, " + ", ".join(f"{n} DOUBLE" for n in names))
    for eps, least in ((0.35, 4), (0.8, 10)):
        done = dbscan(frame, names, eps, least).toPandas().sort_values("customer_id")
        expected = brute_dbscan(points, eps, least)
        assert (done["cluster"].to_numpy() == expected).all() and len(set(expected)) > 1


def test_a_key_of_the_tree_has_few_cells(spark):
    grid = density._Grid(5, 1.0)
    columns = ", ".join(f"{side}{i} DOUBLE" for side in ("low", "high") for i in range(5))
    every = [(7, 7, 7, i % 40, i // 40) for i in range(1600)]
    rows = [(list(c), *(2 * [0.0, 0.0, 0.0, c[3] * 0.3, c[4] * 0.3])) for c in every]
    cells = spark.createDataFrame(rows, f"cell ARRAY<BIGINT>, {columns}")
    found = {(tuple(r.a), tuple(r.b)) for r in density._neighbours(grid, cells, cells).collect()}
    assert found == {(a, b) for a in every for b in every if (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 11}
    assert density._neighbours(grid, cells, cells.limit(0)).collect() == []


def test_components_of_a_long_path(spark):
    ids = np.random.default_rng(2).permutation(300)
    pairs = [(int(a), int(b)) for a, b in zip(ids[:199], ids[1:200])]
    pairs += [(int(a), int(b)) for a, b in zip(ids[200:298], ids[201:299])]
    nodes = spark.range(300).withColumnRenamed("id", "node")
    edges = spark.createDataFrame(pairs, "src BIGINT, dst BIGINT")
    labels = {r.node: r.label for r in connected_components(nodes, edges).collect()}
    assert {labels[int(i)] for i in ids[:200]} == {int(ids[:200].min())}
    assert {labels[int(i)] for i in ids[200:299]} == {int(ids[200:299].min())}
    assert labels[int(ids[299])] == ids[299]


@pytest.mark.parametrize("block, pairs", [(7, 20), (64, 10_000), (4096, 300)])
def test_sums_of_tiles_equal_all_pairs(monkeypatch, block, pairs):
    monkeypatch.setattr(sil, "CHUNK_PAIRS", pairs)
    draw = np.random.default_rng(2)
    a, b, m, n = draw.normal(size=(90, 3)), draw.normal(size=(33, 3)), draw.random((90, 4)), draw.random((33, 4))
    far = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    found = sil._sums_of_tiles([a, b], [m, n], block)
    assert np.allclose(found[0], far @ n) and np.allclose(found[1], far.T @ m)
    here = np.sqrt(((a[:, None, :] - a[None, :, :]) ** 2).sum(axis=2))
    assert np.allclose(sil._sums_of_tiles([a], [m], block)[0], here @ m)


def test_small_blocks_take_few_tasks(spark, monkeypatch):
    """Several tiles of many blocks: a task per pair of tiles, and the same value."""
    draw = np.random.default_rng(4)
    points, labels = draw.normal(size=(400, 2)), draw.integers(0, 3, 400)
    pdf = pd.DataFrame(points, columns=list(XY)).assign(cluster=labels)
    tasks, means = [], sil._means

    def seen(found, n):
        plan = found._jdf.queryExecution().toString()
        tasks.extend(int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", plan))
        return means(found, n)

    monkeypatch.setattr(sil, "_means", seen)
    monkeypatch.setattr(sil, "TILE_POINTS", 40)
    value = sil.silhouette(spark.createDataFrame(pdf), XY, block_points=4)
    assert abs(value - brute_silhouette(points, labels)) < 1e-9
    assert tasks and max(tasks) <= 100  # a hundred blocks have 10,000 pairs


def test_blocks_apart_and_near_give_distances_to_the_last_places(monkeypatch):
    """Also far from the origin, where a product of uncentred points would lose them."""
    draw, ways, products = np.random.default_rng(8), [], sil._products

    def seen(*given):
        ways.append(products(*given))
        return ways[-1]

    monkeypatch.setattr(sil, "_products", seen)
    a, b = (np.concatenate([draw.normal((1e6, -1e6, c), 1.0, (200, 3)) for c in (0.0, 3.0, 40.0)]) for _ in range(2))
    m, n = (np.eye(3)[draw.integers(0, 3, 600)] * draw.integers(1, 9, 600)[:, None] for _ in range(2))
    wide = [x.astype(np.longdouble) for x in (a, b)]
    far = np.sqrt(((wide[0][:, None, :] - wide[1][None, :, :]) ** 2).sum(axis=2))
    found = sil._sums_of_tiles([a, b], [m, n], 32)
    assert np.allclose(found[0], far @ n, rtol=1e-14, atol=0) and np.allclose(found[1], far.T @ m, rtol=1e-14, atol=0)
    apart = np.concatenate([way[1] for way in ways])
    assert apart.any() and not apart.all()


def test_pairs_of_large_tiles_have_partitions_of_their_own(spark, monkeypatch):
    """Two pairs by chance in one partition would follow each other, and small tiles send each point too often."""
    assert sil._n_tiles(5_400_000, 3, 256) <= 50
    draw, plans, means = np.random.default_rng(6), [], sil._means

    def seen(found, n):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return means(found, n)

    monkeypatch.setattr(sil, "_means", seen)
    monkeypatch.setattr(sil, "TILE_POINTS", 30)
    points, labels = draw.normal(size=(120, 2)), draw.integers(0, 3, 120)
    pdf = pd.DataFrame(points, columns=list(XY)).assign(cluster=labels)
    assert abs(sil.silhouette(spark.createDataFrame(pdf), XY, block_points=40) - brute_silhouette(points, labels)) < 1e-12
    assert re.search(r"direct_shuffle_partition_id\(part#\d+\), 10\), REPARTITION_BY_NUM", plans[-1])
