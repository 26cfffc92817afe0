"""Leading eigenvectors of a symmetric matrix by spectrum slicing.

Inertia counts of LDLᵀ factorisations of the shifted matrix isolate each eigenvalue, Rayleigh
quotient iteration converges to it, and counts on both sides certify its number.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
# Growth bound of Bunch and Kaufman's pivoting: (1 + sqrt(17)) / 8.
_PIVOT = (1 + 17**0.5) / 8
_STEPS = 12


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive ones of D in the LDLᵀ factorisation of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size, pivot = 1, a[0, 0]
        column = np.abs(a[1:, 0])
        most = column.max(initial=0.0)
        if abs(pivot) < _PIVOT * most:
            r = int(column.argmax()) + 1
            row = np.abs(a[r])
            row[r] = 0
            if abs(pivot) * row.max() < _PIVOT * most * most:
                size = 1 if abs(a[r, r]) >= _PIVOT * row.max() else 2
                _swap(a, size - 1, r)
        block, side = a[:size, :size], a[size:, :size]
        if size == 2:
            above += 1  # such a block has one eigenvalue of each sign
        elif block[0, 0] == 0:
            a = a[1:, 1:]  # the whole column is zero: an eigenvalue equal to the shift
            continue
        else:
            above += int(block[0, 0] > 0)
        a = a[size:, size:] - side @ np.linalg.solve(block, side.T)
    return above


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


class _Slices:
    """Shifts with their counts; each is counted once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) or 1.0
        self.room = 256 * _EPS * self.norm  # beyond the rounding of a value
        self.counts = {-self.norm * 1.01: len(matrix), self.norm * 1.01: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = eigenvalues_above(self.matrix, shift)
        return self.counts[shift]

    def bounds(self, number: int) -> tuple[float, float]:
        """The closest known shifts around the eigenvalue of this number (1: the largest)."""
        low = max(s for s, n in self.counts.items() if n >= number)
        high = min(s for s, n in self.counts.items() if n < number)
        return low, high

    def halve(self, number: int) -> bool:
        low, high = self.bounds(number)
        middle = (low + high) / 2
        if not low < middle < high or high - low <= _EPS * self.norm:
            return False
        self.above(middle)
        return True

    def isolate(self, number: int) -> tuple[float, float]:
        """An interval with this eigenvalue alone, or as narrow as numbers allow if others are equal to it."""
        while True:
            low, high = self.bounds(number)
            if (self.counts[low] == number and self.counts[high] == number - 1) or not self.halve(number):
                return self.bounds(number)


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that are above rounding, falling, and their unit vectors as columns.

    Equal eigenvalues get orthogonal vectors of their common space. Raises if the counts
    on both sides of a value don't confirm its number.
    """
    slices = _Slices(matrix)
    draws = np.random.default_rng(5)
    values: list[float] = []
    vectors = np.zeros((len(matrix), 0))
    for number in range(1, min(most, len(matrix)) + 1):
        slices.isolate(number)
        value, vector = _iterate(slices, number, vectors, draws)
        if value <= len(matrix) * _EPS * slices.norm * 4:
            break
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    _certify(slices, values)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


def _iterate(slices: _Slices, number: int, known: np.ndarray, draws: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of the interval; the interval is halved until it ends inside."""
    matrix, floor = slices.matrix, 32 * _EPS * slices.norm
    while True:
        low, high = slices.bounds(number)
        vector = draws.standard_normal(len(matrix))
        shift, value = (low + high) / 2, np.nan
        for step in range(_STEPS):
            vector = _solve(matrix, shift, vector - known @ (known.T @ vector), slices.norm)
            vector -= known @ (known.T @ vector)
            vector /= np.linalg.norm(vector)
            image = matrix @ vector
            value = float(vector @ image)
            residual = float(np.linalg.norm(image - value * vector))
            inside = low - floor <= value <= high + floor
            if inside and residual <= floor:
                if slices.above(value - slices.room) >= number > slices.above(value + slices.room):
                    return value, vector
                break  # a neighbour at the edge of the interval
            if step:
                shift = min(max(value, low), high)
        if not slices.halve(number):
            raise ArithmeticError(f"no vector found for eigenvalue {number}")


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray, norm: float) -> np.ndarray:
    eye = np.eye(len(matrix))
    for nudge in (0.0, _EPS * norm, 4 * _EPS * norm):
        try:
            out = np.linalg.solve(matrix - (shift + nudge) * eye, vector)
        except np.linalg.LinAlgError:
            continue
        size = np.abs(out).max()
        if np.isfinite(size) and size > 0:
            return out / size
    raise ArithmeticError("no shift near the eigenvalue can be solved")


def _certify(slices: _Slices, values: list[float]) -> None:
    """Counts just above and just below each group of values that rounding cannot tell apart must frame its numbers."""
    room = slices.room
    falling = sorted(values, reverse=True)
    first = 0
    for i, value in enumerate(falling):
        last = i + 1 == len(falling)
        if not last and value - falling[i + 1] <= 2 * room:
            continue
        high, low = slices.above(falling[first] + room), slices.above(value - room)
        if high != first or low < i + 1 or (low > i + 1 and not last):
            raise ArithmeticError(f"eigenvalues {first + 1} to {i + 1} are not those of these numbers")
        first = i + 1
