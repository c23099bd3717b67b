"""Dense, cell-by-cell versions of what the operators compute, for small inputs."""

from __future__ import annotations

import numpy as np


def popularity_weights(matrix: np.ndarray, total: float, exponent: float) -> np.ndarray:
    share = matrix.sum(axis=0) / matrix.sum()
    powered = share**exponent
    return total * powered / powered.sum()


def cell_weights(matrix: np.ndarray, item_weights: np.ndarray, c_obs: float) -> np.ndarray:
    return np.where(matrix > 0, c_obs, item_weights[None, :])


def dense_loss(matrix, weights, p, q, reg) -> float:
    error = (matrix - p @ q.T) ** 2
    return float((weights * error).sum() + reg * ((p**2).sum() + (q**2).sum()))


def _side(target, weights, own, other, reg):
    """Minimise over one coordinate at a time, visiting every cell of the row."""
    for row in range(len(own)):
        if not target[row].any():
            continue
        for f in range(own.shape[1]):
            rest = own[row] @ other.T - own[row, f] * other[:, f]
            upper = (weights[row] * (target[row] - rest) * other[:, f]).sum()
            own[row, f] = upper / ((weights[row] * other[:, f] ** 2).sum() + reg)


def dense_training(matrix, item_weights, c_obs, target, p, q, reg, iterations):
    weights = cell_weights(matrix, item_weights, c_obs)
    p, q, losses = p.copy(), q.copy(), []
    for _ in range(iterations):
        _side(matrix * target, weights, p, q, reg)
        _side((matrix * target).T, weights.T, q, p, reg)
        losses.append(dense_loss(matrix, weights, p, q, reg))
    return p, q, losses


def ranking(p, q, seen: set[tuple[int, int]], user: int) -> list[int]:
    """Unseen items of a user, best first, ties to the smaller number."""
    scored = []
    for item in range(len(q)):
        if (user, item) not in seen:
            score = 0.0
            for f in range(p.shape[1]):
                score += p[user, f] * q[item, f]
            scored.append((-score, item))
    return [item for _, item in sorted(scored)]


def core(rows: list[tuple], min_user: int, min_item: int) -> list[tuple]:
    while True:
        users, items = {}, {}
        for user, item, *_ in rows:
            users[user] = users.get(user, 0) + 1
            items[item] = items.get(item, 0) + 1
        kept = [r for r in rows if users[r[0]] >= min_user and items[r[1]] >= min_item]
        if len(kept) == len(rows):
            return rows
        rows = kept
