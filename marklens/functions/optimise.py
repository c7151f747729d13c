"""L-BFGS on the driver for a few parameters; each value of the function is a distributed sum."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def minimum(loss: Loss, x: np.ndarray, max_iter: int, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Where ``loss`` (value and gradient) is least, or as far as ``max_iter`` steps come."""
    value, grad = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(max_iter):
        if np.linalg.norm(grad) <= max(tolerance * value, 1e-8):
            break
        direction = _direction(grad, steps)
        found = _line(loss, x, value, grad, direction, 1 / np.linalg.norm(direction) if n == 0 else 1.0)
        if found is None and steps:  # once more without what is remembered
            steps, direction = [], -grad
            found = _line(loss, x, value, grad, direction, 1.0)
        if found is None:
            break
        new, value, new_grad = found
        steps = [(new - x, new_grad - grad), *steps][:memory]
        x, grad = new, new_grad
    return x


def _direction(grad: np.ndarray, steps: list) -> np.ndarray:
    out, shares = grad.copy(), []
    for s, g in steps:
        shares.append(s @ out / (s @ g))
        out = out - shares[-1] * g
    if steps:
        s, g = steps[0]
        out = out * (s @ g) / (g @ g)
    for (s, g), share in zip(reversed(steps), reversed(shares)):
        out = out + (share - g @ out / (s @ g)) * s
    return -out


def _line(loss: Loss, x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, t: float, c1: float = 1e-4, c2: float = 0.9):
    """A step along ``direction`` that fulfils the strong Wolfe conditions, with the value and gradient there; None if none is found."""
    slope = grad @ direction
    if slope > 0:
        return None

    def at(t: float) -> tuple:
        v, g = loss(x + t * direction)
        return t, v, g @ direction, g

    def zoom(low: tuple, high: tuple):
        for _ in range(10):
            left, right = (high, low) if low[0] > high[0] else (low, high)
            c = at(_between(left, right))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= c2 * abs(slope):
                return c
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low, found = (0.0, value, slope, grad), None
    for i in range(10):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            found = zoom(low, c)
        elif abs(c[2]) <= c2 * abs(slope):
            found = c
        elif c[2] >= 0:
            found = zoom(c, low)
        else:
            low, t = c, t * 1.5
            continue
        break
    return None if found is None else (x + found[0] * direction, found[1], found[3])


def _between(a: tuple, b: tuple) -> float:
    """Where the cubic through both ends is least, a tenth of the way from either at least."""
    d = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    root = max(d * d - a[2] * b[2], 0) ** 0.5
    width, below = b[0] - a[0], b[2] - a[2] + 2 * root
    t = b[0] - width * (b[2] + root - d) / below if below else a[0] + width / 2
    return min(max(t, a[0] + 0.1 * width), a[0] + 0.9 * width)
