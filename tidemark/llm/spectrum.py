"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The number of eigenvalues above a shift is the number of positive pivots of an LDLᵀ factorisation of the shifted matrix
(Sylvester). Bisection over such counts isolates the j-th largest eigenvalue; inverse and then Rayleigh quotient iteration find its
vector, converging cubically; counts on both sides of the result certify that it is the j-th and no other.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Larger elements are pivots of their own, else two rows go at once; bounds the growth of the rest.
_ALPHA = (1 + np.sqrt(17)) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of an LDLᵀ factorisation with 1 x 1 and 2 x 2 pivots."""
    a, found = matrix - shift * np.eye(len(matrix)), 0
    while len(a):
        size = np.abs(a)
        own = size.diagonal().copy()
        np.fill_diagonal(size, 0)
        i = int(own.argmax())
        r, s = divmod(int(size.argmax()), len(a))
        if own[i] == 0 and size[r, s] == 0:
            break
        gone = [i] if own[i] >= _ALPHA * size[r, s] else [r, s]
        pivot = a[np.ix_(gone, gone)]
        # A 2 x 2 pivot of this choice has a negative determinant: one eigenvalue of either sign.
        found += int(pivot[0, 0] > 0) if len(gone) == 1 else 1
        rest = np.delete(np.arange(len(a)), gone)
        side = a[np.ix_(rest, gone)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return found


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    for step in range(4):
        try:
            y = np.linalg.solve(matrix - (shift + step * _EPS * scale) * np.eye(len(matrix)), x)
            if np.isfinite(y).all() and y.any():
                return y
        except np.linalg.LinAlgError:
            pass
    return x


def _orthogonal(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for b in basis:
            x = x - (b @ x) * b
    return x / np.linalg.norm(x)


def leading_pairs(matrix: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """Up to ``most`` pairs of eigenvalue and unit vector by falling eigenvalue, as far as eigenvalues are positive beyond rounding.

    Where eigenvalues agree to rounding, the vectors are an orthonormal basis of their space. A vector's largest entry is positive.
    """
    d = len(matrix)
    scale = float(np.linalg.norm(matrix)) if d else 0.0
    slack, pairs = 8 * d * _EPS * scale, []
    top = scale * (1 + 4 * _EPS) + np.finfo(float).tiny
    while len(pairs) < min(most, d) and scale > 0:
        j, low, high, basis = len(pairs) + 1, slack, top, [v for _, v in pairs]
        at_low, at_high = count_above(matrix, low), 0
        if at_low < j:
            break
        while True:
            # Alone in the interval, and narrow enough for the iteration to stay in it.
            while high - low > slack and (at_low > j or at_high < j - 1 or high - low > 0.01 * high):
                middle = (low + high) / 2
                if (n := count_above(matrix, middle)) >= j:
                    low, at_low = middle, n
                else:
                    high, at_high = middle, n
            x = _orthogonal(np.random.default_rng(j).standard_normal(d), basis)
            for _ in range(3):
                x = _orthogonal(_solve(matrix, (low + high) / 2, x, scale), basis)
            value, error = float(x @ matrix @ x), np.inf
            for _ in range(12):
                new = _orthogonal(_solve(matrix, value, x, scale), basis)
                value = float(new @ matrix @ new)
                left = float(np.linalg.norm(matrix @ new - value * new))
                if left >= error:
                    break
                x, error = new, left
            value = float(x @ matrix @ x)
            near = max(slack, 2 * error)
            inside = low - near <= value <= high + near
            if inside and count_above(matrix, value - near) >= j and count_above(matrix, value + near) <= j - 1:
                break
            if high - low <= slack:
                raise ArithmeticError(f"eigenvalue {j} could not be certified")
            middle = (low + high) / 2
            if (n := count_above(matrix, middle)) >= j:
                low, at_low = middle, n
            else:
                high, at_high = middle, n
        if value <= slack:
            break
        pairs.append((value, x * np.sign(x[np.abs(x).argmax()])))
    return pairs
