"""Numpy helpers that run inside Arrow functions on the workers.

The module is shipped with the functions that use it, so workers need no copy of
the package.
"""

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 2048


def list_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list array."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)
    return offsets, values


def distinct_rows(
    offsets: np.ndarray, indices: np.ndarray, values: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first copy of each sparse row, and every row's copy number.

    Masked log lines repeat a lot, so models run on the distinct rows of a batch.  Rows of
    one length are compared together, as bytes.
    """
    lengths = np.diff(offsets)
    first = np.empty(len(lengths), dtype=np.int64)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        place = offsets[rows][:, None] + np.arange(length)
        codes = np.concatenate(
            [indices[place].astype(np.int64), values[place].astype(np.float64).view(np.int64)], axis=1
        )
        if length == 0:
            first[rows] = rows[0]
            continue
        codes = np.ascontiguousarray(codes).view(f"V{codes.shape[1] * 8}").ravel()
        _, where, copy = np.unique(codes, return_index=True, return_inverse=True)
        first[rows] = rows[where][copy]
    return np.unique(first, return_inverse=True)


def densify(
    rows: np.ndarray,
    offsets: np.ndarray,
    indices: np.ndarray,
    values: np.ndarray,
    size: int,
) -> np.ndarray:
    dense = np.zeros((len(rows), size))
    starts, ends = offsets[rows], offsets[rows + 1]
    lengths = ends - starts
    target = np.repeat(np.arange(len(rows)), lengths)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat = np.repeat(starts, lengths) + within
    dense[target, indices[flat]] = values[flat]
    return dense


def flat_forest(
    tree: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray
) -> dict:
    """Node arrays of a forest, ordered by tree and node; children are positions in the arrays.

    Nodes of a tree are numbered from 0 without gaps, leaves have feature -1, and ``value`` has
    a number or a row of numbers for every node.
    """
    trees, starts = np.unique(tree, return_index=True)
    base = starts[np.searchsorted(trees, tree)]
    return {
        "roots": starts,
        "feature": np.asarray(feature, dtype=np.int64),
        "threshold": np.asarray(threshold, dtype=float),
        "left": np.asarray(left, dtype=np.int64) + base,
        "right": np.asarray(right, dtype=np.int64) + base,
        "value": np.asarray(value, dtype=float),
    }


def leaf_values(dense: np.ndarray, forest: dict) -> np.ndarray:
    """Leaf value reached in every tree: one matrix of rows by trees (by classes, where values are rows)."""
    node = np.repeat(forest["roots"][None, :], len(dense), axis=0)
    row = np.arange(len(dense))[:, None]
    while True:
        feature = forest["feature"][node]
        inner = feature >= 0
        if not inner.any():
            return forest["value"][node]
        goes_left = dense[row, np.where(inner, feature, 0)] <= forest["threshold"][node]
        step = np.where(goes_left, forest["left"][node], forest["right"][node])
        node = np.where(inner, step, node)


def flat_lists(indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets from 0, indices and values of a batch of sparse rows without nulls."""
    offsets, flat_indices = list_parts(indices)
    value_offsets, flat_values = list_parts(values)
    # Both lists of a row have one length, but slices may start elsewhere.
    n = offsets[-1] - offsets[0]
    flat_indices = flat_indices[offsets[0] : offsets[-1]]
    flat_values = flat_values[value_offsets[0] : value_offsets[0] + n]
    return offsets - offsets[0], flat_indices, flat_values


def mean_leaf_values(indices: pa.Array, values: pa.Array, forest: dict) -> np.ndarray:
    """Forest average for a batch of sparse rows."""
    offsets, flat_indices, flat_values = flat_lists(indices, values)
    firsts, copy = distinct_rows(offsets, flat_indices, flat_values)
    means = [np.empty((0, *forest["value"].shape[1:]))]
    for start in range(0, len(firsts), BLOCK_ROWS):
        block = firsts[start : start + BLOCK_ROWS]
        dense = densify(block, offsets, flat_indices, flat_values, forest["size"])
        means.append(leaf_values(dense, forest).mean(axis=1))
    return np.concatenate(means)[copy]


def both_forests(
    indices: pa.Array, values: pa.Array, model: dict, only_odd: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(decision, class number, confidence) of a batch of sparse rows; class -1 where the second forest was not asked.

    With ``only_odd`` the class forest sees only rows that the isolation forest calls odd.
    """
    offsets, flat_indices, flat_values = flat_lists(indices, values)
    firsts, copy = distinct_rows(offsets, flat_indices, flat_values)
    decision, number, confidence = np.empty(len(firsts)), np.full(len(firsts), -1), np.zeros(len(firsts))
    for start in range(0, len(firsts), BLOCK_ROWS):
        part = slice(start, start + BLOCK_ROWS)
        dense = densify(firsts[part], offsets, flat_indices, flat_values, model["size"])
        paths = leaf_values(dense, model["iso"]).mean(axis=1)
        decision[part] = -np.exp2(-paths / model["norm"]) - model["offset"]
        asked = np.flatnonzero(decision[part] < 0) if only_odd else np.arange(len(dense))
        if len(asked):
            shares = leaf_values(dense[asked], model["forest"]).mean(axis=1)
            best = shares.argmax(axis=1)
            number[start + asked], confidence[start + asked] = best, shares[np.arange(len(best)), best]
    return decision[copy], number[copy], confidence[copy]


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    usual = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, usual))


def grow_isolation_tree(dense: np.ndarray, depth_limit: int, rng) -> list[tuple]:
    """Nodes ``(id, feature, threshold, left, right, path)``; leaves have feature -1."""
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(dense)), 0)]
    next_id = 1
    while waiting:
        node, rows, depth = waiting.pop()
        part = dense[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(varying) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        goes_left = part[:, feature] <= threshold
        waiting.append((left, rows[goes_left], depth + 1))
        waiting.append((right, rows[~goes_left], depth + 1))
    return nodes


# Rows and leaves of which all combinations are held at a time.
SHAP_ROWS = 16
SHAP_LEAVES = 1 << 11


def padded_leaves(table: pa.Table) -> dict:
    """Matrices of leaves by places on their paths; unused places hold a feature that every row passes."""
    offsets, feature = list_parts(table["feature"])
    lengths = np.diff(offsets)
    width = max(1, int(lengths.max()))
    shape = (len(lengths), width)
    used = np.arange(width) < lengths[:, None]
    leaves = {"feature": np.zeros(shape, dtype=np.int64), "low": np.full(shape, -np.inf), "high": np.full(shape, np.inf), "cover": np.ones(shape)}
    leaves["feature"][used] = feature[offsets[0] : offsets[-1]]
    for name in ("low", "high", "cover"):
        starts, values = list_parts(table[name])
        leaves[name][used] = values[starts[0] : starts[-1]]
    starts, values = list_parts(table["value"])
    leaves["value"] = values[starts[0] : starts[-1]].reshape(len(lengths), -1)
    # n nodes integrate degree 2n - 1 exactly; the degree here is width - 1.
    points, weights = np.polynomial.legendre.leggauss(-(-width // 2))
    leaves["points"], leaves["weights"] = (points + 1.0) / 2.0, weights / 2.0
    return leaves


def shap_rows(indices: pa.ChunkedArray, values: pa.ChunkedArray, leaves: dict, size: int, trees: int):
    """(features, matrix of features by classes) for every sparse row: the leaves' part of its attributions.

    A leaf pays its value when the row passes all its features' intervals.  The
    Shapley weight of a coalition is the integral of t^k (1-t)^(d-1-k), so a
    feature's share of a leaf is an integral of a product over its other features,
    which Gauss-Legendre nodes give exactly for these low-degree polynomials.
    """
    offsets, flat_indices, flat_values = flat_lists(indices, values)
    for start in range(0, len(offsets) - 1, SHAP_ROWS):
        rows = np.arange(start, min(start + SHAP_ROWS, len(offsets) - 1))
        dense = densify(rows, offsets, flat_indices, flat_values, size)
        phi = np.zeros((len(rows) * size, leaves["value"].shape[1]))
        for at in range(0, len(leaves["feature"]), SHAP_LEAVES):
            _add_shares(phi, dense, {k: leaves[k][at : at + SHAP_LEAVES] for k in ("feature", "low", "high", "cover", "value")}, leaves)
        phi = phi.reshape(len(rows), size, -1) / trees
        for row in phi:
            used = np.flatnonzero(row.any(axis=1))
            yield used.astype(np.int32), row[used]


def _add_shares(phi: np.ndarray, dense: np.ndarray, part: dict, rule: dict) -> None:
    x = dense[:, part["feature"]]
    one = ((part["low"] < x) & (x <= part["high"])).astype(float)
    cover = part["cover"]
    share = np.zeros_like(one)
    for t, weight in zip(rule["points"], rule["weights"]):
        factor = cover * (1.0 - t) + one * t
        share += weight * factor.prod(axis=2, keepdims=True) / factor
    share *= one - cover
    size = dense.shape[1]
    place = (np.arange(len(dense))[:, None, None] * size + part["feature"]).ravel()
    for c in range(phi.shape[1]):
        paid = (share * part["value"][:, c, None]).ravel()
        phi[:, c] += np.bincount(place, weights=paid, minlength=len(phi))
