"""Customers clustered by the chosen algorithm on scaled features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from patronmap.operators import clustering
from patronmap.operators.cleaning import drop_missing
from patronmap.operators.density import dbscan
from patronmap.operators.features import scaled_columns
from patronmap.schema import CLUSTER, CUSTOMER, RFM_METRICS
from patronmap.settings import DBSCAN, HIERARCHICAL, HIERARCHICAL_LONG, KMEANS, Settings, Weights
from patronmap.storage import scratch, store


def segment(
    customers: DataFrame,
    algorithm: str | None = None,
    features: Sequence[str] = RFM_METRICS,
    scaler: str | None = None,
    weights: Weights | Mapping | None = None,
    k: int | None = None,
    eps: float | None = None,
    min_samples: int | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """Stored `customers` with complete features, plus `cluster`.

    Algorithm, scaler and weights not given are those of `settings`. K-Means and the
    divisive tree number clusters by the order of their centres; without `k` they take the
    best of the settings' range. DBSCAN needs `eps` and `min_samples`, in units of the
    scaled features.
    """
    if settings is not None:
        algorithm = algorithm or settings.segmentation_default_algorithm
        scaler = scaler or settings.default_scaler
        weights = settings.rfm_weights if weights is None else weights
    defaults = settings or Settings()
    algorithm, scaler = algorithm or KMEANS, scaler or defaults.default_scaler
    if algorithm not in (DBSCAN, KMEANS, HIERARCHICAL, HIERARCHICAL_LONG):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    if algorithm == DBSCAN and (eps is None or min_samples is None):
        raise ValueError("DBSCAN needs eps and min_samples")
    if algorithm != DBSCAN and k is None and settings is None:
        raise ValueError(f"{algorithm} needs k, or settings with a range to choose from")
    with scratch(customers.sparkSession) as scope:
        complete = drop_missing(customers, *features)
        scaled = scaled_columns(complete, features, scaler, weights)
        names = [f"_{f}" for f in features]
        table = store(complete.withColumns({f"_{f}": c for f, c in scaled.items()}), "scaled")
        if algorithm == DBSCAN:
            found = dbscan(table, names, eps, min_samples, CUSTOMER)
            scope.release(scope.last())
            return found.drop(*names)
        points = store(clustering.grid_points(table, names), "points").persist()
        try:
            fits: dict[int, clustering.Centroids] = {}
            if k is None:
                if Weights.of(weights) == Weights():  # the sweep's points are the ones to cluster; its fits serve
                    rows, fits = clustering.sweep(points, defaults.auto_k, clustering.default_metric(features))
                else:
                    rows = clustering.auto_k(customers, features, scaler, defaults.auto_k)
                best = clustering.best_k(rows).first()
                if best is None:
                    raise ValueError("too few customers for the range of k")
                k = best.k
            # Rows are placed by the rounded values that the fit has seen.
            rounded = table.withColumns({n: clustering.on_grid(n) / clustering.GRID for n in names})
            if algorithm == KMEANS:
                fitted = fits.get(k) or clustering.fit_kmeans(points, k)
                labelled = clustering.assign_nearest(rounded, names, fitted.points) if fitted.points else rounded.selectExpr("*", f"CAST(NULL AS INT) AS {CLUSTER}")
            else:
                labelled = clustering.assign_tree(rounded, names, clustering.fit_tree(points, k))
            return scope.keep(labelled.drop(*names), "clusters")
        finally:
            points.unpersist()
