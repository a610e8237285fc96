"""Singular values and right singular vectors of a small matrix, to high relative accuracy.

Householder reflections make the matrix bidiagonal, the dqds iteration finds the singular values of the
bidiagonal, and each vector comes from a twisted factorisation of its shifted Gram matrix.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
# A shift found by a sweep that broke down is cut by this before the next try.
CUT = 0.25
# Eigenvalues closer than this, relative to their size, have their vectors made orthogonal to each other.
CLOSE = 1e-3


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor V of a square matrix = U B V^T with B upper bidiagonal."""
    work = np.array(matrix, float)
    n = len(work)
    right = np.eye(n)
    for k in range(n):
        _reflect(work[k:, k:])
        if k < n - 2:
            mirror = _reflect(work[k:, k + 1 :].T)
            right[:, k + 1 :] -= np.outer(right[:, k + 1 :] @ mirror, 2 * mirror)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def _reflect(view: np.ndarray) -> np.ndarray:
    """Mirrors the columns of a view, in place, so that its first column keeps only its first entry."""
    column = view[:, 0]
    mirror = column.copy()
    size = np.linalg.norm(column)
    mirror[0] += np.copysign(size, column[0])
    length = np.linalg.norm(mirror)
    if length > 0:
        mirror /= length
        view -= np.outer(2 * mirror, mirror @ view)
        view[1:, 0] = 0
    return mirror


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Singular values of an upper bidiagonal matrix by shifted quotient differences, largest first."""
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if scale == 0:
        return np.zeros(n)
    found: list[float] = []
    parts = [((np.asarray(diagonal) / scale) ** 2, (np.asarray(above) / scale) ** 2, 0.0)]
    while parts:
        q, e, moved = parts.pop()
        if len(q) == 0:
            continue
        if len(q) == 1:
            found.append(moved + q[0])
            continue
        cut = _negligible(q, e, moved)
        if cut is not None:
            parts += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
            continue
        if q[0] < q[-1]:
            # Read from the other end, where the small values belong.
            q, e = q[::-1].copy(), e[::-1].copy()
        parts.append(_sweep(q, e, moved))
    return scale * np.sqrt(np.sort(np.maximum(found, 0))[::-1])


def _negligible(q: np.ndarray, e: np.ndarray, moved: float) -> int | None:
    """The last place where the matrix falls apart, if there is one."""
    # sqrt(e) against sqrt of what stands beside it: e counts in squares.
    small = e <= EPS * EPS * (moved + np.minimum(q[:-1], q[1:]))
    small |= e <= np.finfo(float).tiny
    (places,) = np.nonzero(small)
    return int(places[-1]) if len(places) else None


def _sweep(q: np.ndarray, e: np.ndarray, moved: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One transform with a shift that keeps all quotients positive."""
    shift = _guess(q, e)
    while True:
        done = _transform(q, e, shift)
        if done is not None:
            return *done, moved + shift
        shift = shift * CUT if shift > EPS * q[-1] else 0.0


def _guess(q: np.ndarray, e: np.ndarray) -> float:
    """The smaller eigenvalue of the last two rows, an upper bound that the sweep tests."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-2] * e[-1], q[-1] + e[-1]
    half, mean = (a - c) / 2, (a + c) / 2
    root = np.hypot(half, np.sqrt(b))
    return max((a * c - b) / (mean + root) if mean + root > 0 else 0.0, 0.0) * (1 - 4 * EPS)


def _transform(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The quotients and remainders of L L^T - shift, or None if a quotient turns negative."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    rest = q[0] - shift
    for k in range(len(e)):
        if rest < 0:
            return None
        new_q[k] = rest + e[k]
        if new_q[k] == 0:
            new_e[k], rest = 0.0, q[k + 1] - shift
            continue
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        rest = rest * ratio - shift
    if rest < 0:
        return None
    new_q[-1] = rest
    return new_q, new_e


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B^T B for the given singular values, as columns; their signs are free."""
    n = len(diagonal)
    vectors = np.zeros((n, len(values)))
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0)) or 1.0
    a, b, values = diagonal / scale, above / scale, values / scale
    rng = np.random.default_rng(n)
    for k, value in enumerate(values):
        twisted = _Twisted(a, b, value * value)
        vector = twisted.vector()
        near = [
            i for i in range(k) if values[i] ** 2 - value**2 <= CLOSE * max(value**2, EPS * values[0] ** 2)
        ]
        if near:
            vector = _apart(vector, vectors[:, near], twisted, rng)
        vectors[:, k] = vector
    return vectors


def _apart(vector: np.ndarray, others: np.ndarray, twisted: _Twisted, rng: np.random.Generator) -> np.ndarray:
    """The vector made orthogonal to its close neighbours; a new start if nothing of it is left."""
    for attempt in range(8):
        rest = vector - others @ (others.T @ vector)
        size = np.linalg.norm(rest)
        if size > 0.1:
            rest -= others @ (others.T @ rest)
            return rest / np.linalg.norm(rest)
        # Inverse iteration, orthogonal to the neighbours all the way.
        vector = rng.standard_normal(len(vector))
        for _ in range(4):
            vector -= others @ (others.T @ vector)
            vector = twisted.solve(vector / np.linalg.norm(vector))
            vector /= np.linalg.norm(vector)
    rest = vector - others @ (others.T @ vector)
    return rest / np.linalg.norm(rest)


class _Twisted:
    """Factorisations of B^T B - shift from the top and from the bottom, joined where both meet best."""

    def __init__(self, a: np.ndarray, b: np.ndarray, shift: float):
        self.n, self.shift = len(a), shift
        self.off = a[:-1] * b
        tiny = EPS * EPS * max(np.square(a).max(initial=0), 1e-300)
        # From the top: B^T B = L D L^T with D = a^2 and L = b / a, written with a^2 and b^2 alone.
        self.top, rest = np.empty(self.n), -shift
        tops = np.empty(self.n)
        for i in range(self.n):
            tops[i] = rest
            self.top[i] = self._away(a[i] ** 2 + rest, tiny)
            if i < self.n - 1:
                rest = b[i] ** 2 * (rest / self.top[i]) - shift
        # From the bottom.
        self.bottom, rest = np.empty(self.n), a[-1] ** 2 - shift
        rests = np.empty(self.n)
        for i in range(self.n - 1, -1, -1):
            rests[i] = rest
            if i:
                self.bottom[i] = self._away(b[i - 1] ** 2 + rest, tiny)
                rest = a[i - 1] ** 2 * (rest / self.bottom[i]) - shift
        self.gamma = tops + rests + shift

    @staticmethod
    def _away(pivot: float, tiny: float) -> float:
        """A pivot that can be divided by."""
        return pivot if abs(pivot) > tiny else np.copysign(tiny, pivot)

    def vector(self) -> np.ndarray:
        """The vector that solves all rows but the one of the smallest twist."""
        twist = int(np.argmin(np.abs(self.gamma)))
        z = np.zeros(self.n)
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -self.off[i] / self.top[i] * z[i + 1]
        for i in range(twist + 1, self.n):
            z[i] = -self.off[i - 1] / self.bottom[i] * z[i - 1]
        return z / np.linalg.norm(z)

    def solve(self, right: np.ndarray) -> np.ndarray:
        """Solves with the factorisation from the top."""
        z = right.copy()
        for i in range(1, self.n):
            z[i] -= self.off[i - 1] / self.top[i - 1] * z[i - 1]
        z /= self.top
        for i in range(self.n - 2, -1, -1):
            z[i] -= self.off[i] / self.top[i] * z[i + 1]
        return z


def principal(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` singular values, largest first, and their right singular vectors as columns.

    Values that are zero to double precision, against the largest, have no vector and are left out.
    """
    diagonal, above, right = bidiagonalise(matrix)
    values = singular_values(diagonal, above)[:most]
    values = values[values > len(matrix) * EPS * values[0]]
    return values, right @ right_vectors(diagonal, above, values)
