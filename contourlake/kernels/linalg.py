"""Principal components, generalised eigenpairs and rigid alignment."""

from __future__ import annotations

import numpy as np


def with_sign(v: np.ndarray) -> np.ndarray:
    """Rows whose component of largest size is positive."""
    at = np.argmax(np.abs(v), axis=1)
    return v * np.where(v[np.arange(len(v)), at] < 0, -1.0, 1.0)[:, None]


def principal_components(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components by row, variances), largest first; through the smaller of the scatter and the Gram matrix."""
    mean = x.mean(axis=0)
    c = x - mean
    k = min(k, *c.shape)
    if len(c) < c.shape[1]:
        values, left = np.linalg.eigh(c @ c.T)
        values, left = values[::-1][:k], left[:, ::-1][:, :k]
        rows = (c.T @ left / np.sqrt(np.maximum(values, 1e-300))).T
    else:
        values, right = np.linalg.eigh(c.T @ c)
        values, rows = values[::-1][:k], right[:, ::-1][:, :k].T
    return mean, with_sign(rows), np.maximum(values, 0) / max(len(x) - 1, 1)


def generalised_eigenpairs(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of A x = l B x for symmetric A and a positive diagonal B (given as a vector), with vectors by row."""
    s = 1 / np.sqrt(b)
    values, vectors = np.linalg.eigh(a * s[:, None] * s[None])
    return values[::-1][:k], with_sign((vectors * s[:, None]).T[::-1][:k])


def lanczos(src, dst, w, n: int, k: int, tolerance: float = 1e-12, restarts: int = 200) -> np.ndarray:
    """The k largest eigenvalues of the symmetric n x n matrix of entries (src, dst, w), by Lanczos with thick restarts and whole reorthogonalisation; memory for a few dozen vectors."""
    k = min(k, n)
    size, rng = min(n, max(2 * k + 20, 40)), np.random.default_rng(5)
    basis, projected, count = np.zeros((size, n)), np.zeros((size, size)), 1
    basis[0] = rng.normal(size=n)
    basis[0] /= np.linalg.norm(basis[0])
    for _ in range(restarts):
        while True:
            x = np.bincount(src, w * basis[count - 1][dst], n)
            shares = basis[:count] @ x
            projected[:count, count - 1] = projected[count - 1, :count] = shares
            x -= shares @ basis[:count]
            x -= (basis[:count] @ x) @ basis[:count]
            beta = np.linalg.norm(x)
            if count == size:
                break
            if beta <= 1e-13:
                # The space is closed: begin anew beside it, so that repeated values are found too.
                x, beta = rng.normal(size=n), 0.0
                x -= (basis[:count] @ x) @ basis[:count]
                x -= (basis[:count] @ x) @ basis[:count]
            basis[count] = x / np.linalg.norm(x)
            count += 1
        values, vectors = np.linalg.eigh(projected)
        values, vectors = values[::-1], vectors[:, ::-1]
        if size == n or (beta * np.abs(vectors[-1, :k]) <= tolerance * max(abs(values[0]), 1e-300)).all():
            return values[:k]
        keep = min(k + 6, size - 2)
        basis[:keep] = vectors[:, :keep].T @ basis
        basis[keep] = x / max(beta, 1e-300)
        projected = np.zeros((size, size))
        projected[range(keep), range(keep)] = values[:keep]
        count = keep + 1
    raise RuntimeError(f"eigenvalues did not settle in {restarts} restarts")


def align(moving: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The rotation of centred ``moving`` (m, 3) nearest to centred ``fixed`` (Kabsch); reflections are not used."""
    u, _, vt = np.linalg.svd(moving.T @ fixed)
    flip = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    return moving @ (u * flip) @ vt


def procrustes(shapes: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(consensus, aligned, rmsd) of shapes (s, m, 3): all centred, aligned to the mean of the round before, the first as the start."""
    x = shapes - shapes.mean(axis=1, keepdims=True)
    target = x[0]
    for _ in range(rounds):
        x = np.stack([align(s, target) for s in x])
        target = x.mean(axis=0)
        target = target - target.mean(axis=0)
    return target, x, np.sqrt(((x - target) ** 2).sum(-1).mean(-1))
