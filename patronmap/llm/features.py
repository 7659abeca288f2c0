"""Hashed character and word n-grams of whole texts, and logistic regression on them."""

from __future__ import annotations

import zlib

import numpy as np

SLICE = 1 << 20  # code points or words hashed at a time
ROWS = 64  # texts whose counts are held at a time
# Fixed odd multipliers of the hashes; any would do.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def char_gram_buckets(text: str, orders: tuple[int, ...], bits: int):
    """Bucket numbers of the text's character n-grams, in arrays of limited size."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    for order in orders:
        for start in range(0, max(0, len(points) - order + 1), SLICE):
            part = points[start : start + SLICE + order - 1].astype(np.uint64) + np.uint64(order)
            n = len(part) - order + 1
            mixed = part[:n] * MIX[0]
            for i in range(1, order):
                mixed ^= mixed >> np.uint64(29)
                mixed = (mixed + part[i : i + n]) * MIX[i % len(MIX)]
            mixed ^= mixed >> np.uint64(32)
            yield ((mixed * MIX[1]) >> np.uint64(64 - bits)).astype(np.int64)


def word_buckets(words: list[bytes], bits: int):
    """Bucket numbers of words, in arrays of limited size."""
    mask = (1 << bits) - 1
    for start in range(0, len(words), SLICE):
        part = words[start : start + SLICE]
        yield np.fromiter(map(zlib.crc32, part), dtype=np.int64, count=len(part)) & mask


def counted(buckets, size: int) -> np.ndarray:
    counts = np.zeros(size, dtype=np.float32)
    for part in buckets:
        counts += np.bincount(part, minlength=size)
    return counts


def unit_roots(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a row, in place: rows of length one, or zero rows."""
    counts /= np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    return np.sqrt(counts, out=counts)


def sparse(counts: np.ndarray) -> dict[str, bytes]:
    """A row as bytes, to travel."""
    at = np.flatnonzero(counts)
    return {"at": at.astype("<u4").tobytes(), "n": counts[at].astype("<f4").tobytes()}


class Sparse:
    """A matrix of which the other entries are zero, to be multiplied from either side."""

    def __init__(self, rows: list[np.ndarray], values: list[np.ndarray], size: int):
        """Columns of every row, each once, and their values."""
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        self.shape = len(rows), size
        self.columns = np.concatenate([*rows, np.empty(0)]).astype(np.int32)
        self.values = np.concatenate([*values, np.empty(0)]).astype(np.float32)
        self.filled = np.flatnonzero(counts)  # reduceat has no empty ranges
        self.starts = (np.cumsum(counts) - counts)[self.filled]
        order = np.argsort(self.columns, kind="stable")
        self.row_of = np.repeat(np.arange(len(rows), dtype=np.int32), counts)[order]
        self.turned = self.values[order]
        self.used, self.turned_starts = np.unique(self.columns[order], return_index=True)

    def __matmul__(self, right: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], *right.shape[1:]), np.float32)
        if len(self.columns):
            values = self.values.reshape(-1, *[1] * (right.ndim - 1))
            out[self.filled] = np.add.reduceat(right[self.columns] * values, self.starts, axis=0)
        return out

    def turned_times(self, right: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix with `right`."""
        out = np.zeros((self.shape[1], *right.shape[1:]), np.float32)
        if len(self.columns):
            values = self.turned.reshape(-1, *[1] * (right.ndim - 1))
            out[self.used] = np.add.reduceat(right[self.row_of] * values, self.turned_starts, axis=0)
        return out


def _turned_times(x: np.ndarray | Sparse, right: np.ndarray) -> np.ndarray:
    return x.turned_times(right) if isinstance(x, Sparse) else x.T @ right


def sparse_roots(parts: list, size: int) -> Sparse:
    """Rows made by `sparse` as square roots of shares, like those of `unit_roots`."""
    rows = [np.frombuffer(p["at"], "<u4") for p in parts]
    counts = [np.frombuffer(p["n"], "<f4") for p in parts]
    return Sparse(rows, [np.sqrt(n / max(float(n.sum()), 1.0)) for n in counts], size)


def dense(rows: list, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), dtype=np.float32)
    for i, row in enumerate(rows):
        out[i, np.frombuffer(row["at"], "<u4")] = np.frombuffer(row["n"], "<f4")
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray | Sparse, y: np.ndarray, l2: float = 1e-5, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x outputs) and intercepts of independent logistic regressions.

    Accelerated gradient steps on rows of at most unit length, whose loss has curvature of
    at most a quarter (and another for the intercept), so the step length needs no search.
    """
    n, outputs = x.shape[0], y.shape[1]
    weights, intercepts = np.zeros((x.shape[1], outputs), np.float32), np.zeros(outputs, np.float32)
    old_w, old_b = weights, intercepts
    rate = np.float32(1.0 / (0.5 + l2))
    for step in range(steps):
        push = np.float32(step / (step + 3.0))
        ahead_w, ahead_b = weights + push * (weights - old_w), intercepts + push * (intercepts - old_b)
        error = (sigmoid(x @ ahead_w + ahead_b) - y).astype(np.float32) / n
        old_w, old_b = weights, intercepts
        weights = ahead_w - rate * (_turned_times(x, error) + np.float32(l2) * ahead_w)
        intercepts = ahead_b - rate * error.sum(axis=0)
    return weights, intercepts


def fit_platt(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is a calibrated probability; by Newton's method.

    Targets are drawn in by a count of one on either side, which keeps a perfect separation
    finite.
    """
    up, down = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margins + b)
        slope, curve = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (slope * margins).sum() + 1e-6 * a, slope.sum()
        haa, hab, hbb = (curve * margins**2).sum() + 1e-6, (curve * margins).sum(), curve.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = min(1.0, 4.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - size * da, b - size * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return float(a), float(b)
