"""Agglomerative clustering of the embeddings of one recording, with the number of clusters by silhouette."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from voxframe.functions.arrow import map_group

#: Most embeddings of a group whose distances are all held at once; a larger one goes by the sums of its clusters.
MAX_GROUP = 5000
#: Distances that differ by no more than this are equal to the chain of nearest clusters.
_TIE = 1e-12


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def distances(x: np.ndarray) -> np.ndarray:
    """Cosine distances of all rows."""
    unit = units(x)
    d = np.clip(1.0 - unit @ unit.T, 0.0, 2.0)
    np.fill_diagonal(d, 0.0)
    return d


def average_linkage(d: np.ndarray, ks: set[int]) -> dict[int, np.ndarray]:
    """Labels for each number of clusters in ``ks``, numbered by first member."""
    n = len(d)
    d = d.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, dtype=bool), np.arange(n)
    out: dict[int, np.ndarray] = {}
    nearest = d.argmin(axis=1)
    least = d[np.arange(n), nearest]
    for k in range(n, 0, -1):
        if k in ks:
            out[k] = np.unique(label, return_inverse=True)[1]
        if k == 1:
            break
        i = int(np.where(alive, least, np.inf).argmin())
        j = int(nearest[i])
        a, b = min(i, j), max(i, j)
        row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
        label[label == b] = a
        least[b] = np.inf
        stale = alive & ((nearest == a) | (nearest == b) | (row < least))
        stale[a] = True
        for r in np.flatnonzero(stale):
            nearest[r] = int(d[r].argmin())
            least[r] = d[r, nearest[r]]
    return out


def average_linkage_of_sums(unit: np.ndarray, ks: set[int]) -> dict[int, np.ndarray]:
    """What ``average_linkage`` gives for rows of length 1, without their distances.

    The mean distance of two clusters is 1 less the product of their mean vectors. Clusters that are each other's
    nearest are merged along a chain of nearest ones; average linkage allows that in any order, and the merges by height
    are those of the plain method.
    """
    n = len(unit)
    mean, size, first, height, alive = unit.astype(np.float64), np.ones(n), np.arange(n), np.zeros(n), np.ones(n, dtype=bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(merges) < n - 1:
        if alive.sum() * 2 < len(alive):
            new = np.cumsum(alive) - 1
            chain = [int(new[c]) for c in chain]
            mean, size, first, height, alive = (z[alive] for z in (mean, size, first, height, alive))
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        d = 1.0 - mean @ mean[top]
        d[~alive] = np.inf
        d[top] = np.inf
        near = int(d.argmin())
        if len(chain) < 2 or d[near] < d[chain[-2]] - _TIE:
            chain.append(near)
            continue
        near = chain[-2]
        del chain[-2:]
        a, b = (top, near) if first[top] < first[near] else (near, top)
        height[a] = max(float(d[near]), height[a], height[b])
        merges.append((float(height[a]), int(first[a]), int(first[b])))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    merges.sort(key=lambda m: m[0])  # stable: a cluster is made before it is merged
    out: dict[int, np.ndarray] = {}
    into = np.arange(n)
    for k in range(n, 0, -1):
        if k in ks:
            label = into.copy()
            while (label != into[label]).any():
                label = into[label]
            out[k] = np.unique(label, return_inverse=True)[1]
        if k > 1:
            _, a, b = merges[n - k]
            into[b] = a
    return out


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; a cluster of one counts as 0."""
    ks = np.unique(labels)
    return _silhouette(np.stack([d[:, labels == k].sum(axis=1) for k in ks], axis=1), labels)


def silhouette_of_sums(unit: np.ndarray, labels: np.ndarray) -> float:
    """What ``silhouette`` gives for rows of length 1, without their distances."""
    ks, at, count = np.unique(labels, return_inverse=True, return_counts=True)
    total = count - unit @ np.stack([unit[labels == k].sum(axis=0) for k in ks], axis=1)
    total[np.arange(len(unit)), at] -= 1.0 - (unit * unit).sum(axis=1)  # a row has no distance to itself
    return _silhouette(np.maximum(total, 0.0), labels)


def _silhouette(mean: np.ndarray, labels: np.ndarray) -> float:
    """From the sums of each row's distances to the members of each cluster."""
    ks, at, count = np.unique(labels, return_inverse=True, return_counts=True)
    rows = np.arange(len(mean))
    own = mean[rows, at] / np.maximum(count[at] - 1, 1)
    other = mean / count
    other[rows, at] = np.inf
    b = other.min(axis=1)
    s = np.where(count[at] > 1, (b - own) / np.maximum(np.maximum(own, b), 1e-12), 0.0)
    return float(s.mean())


def choose(x: np.ndarray, k: int | None = None, most: int = 6, least: float = 0.10, held: int = MAX_GROUP) -> np.ndarray:
    """Labels for ``k`` clusters, or for the best of 2 to ``most``; one cluster where none separates well.

    Distances are held for at most ``held`` rows; the result is the same without them.
    """
    n = len(x)
    if n < 2 or k == 1:
        return np.zeros(n, dtype=int)
    d, linkage, score_of = (distances(x), average_linkage, silhouette) if n <= held else (units(x), average_linkage_of_sums, silhouette_of_sums)
    if k:
        return linkage(d, {min(k, n)})[min(k, n)]
    best, score = np.zeros(n, dtype=int), -1.0
    for _, labels in sorted(linkage(d, set(range(2, min(most, max(2, n - 1)) + 1))).items()):
        if len(set(labels)) > 1 and (s := score_of(d, labels)) > score:
            best, score = labels, s
    return best if score >= least else np.zeros(n, dtype=int)


def clusters(df: DataFrame, key: str, item: str, embedding: str, k: int | None = None, most: int = 6) -> DataFrame:
    """``key, item, cluster`` within each group of embeddings."""

    def run(g: dict) -> dict:
        order = sorted(range(len(g[item])), key=lambda i: g[item][i])
        labels = choose(np.array([g[embedding][i] for i in order], dtype=np.float64), k, most)
        return {key: [g[key][i] for i in order], item: [g[item][i] for i in order], "cluster": labels.tolist()}

    return map_group(df.select(key, item, embedding).where(f"{embedding} is not null"), [key], run, f"{key} long, {item} long, cluster int")
