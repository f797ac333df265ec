"""A small 32-bit generator with a fixed stream, and a bounded search.

A stream is sequential. In plans use F.rand(seed); this serves tests and
per-group functions that need the very same numbers each time.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, sqrt

_M = 0xFFFFFFFF


class Stream:
    """Four xor-shifted words and a counter; any seed, 0 too."""

    def __init__(self, seed: int = 0):
        self.words = [seed & _M]
        for _ in range(3):
            self.words.append((5 * self.words[-1] + 3) & _M)
        self.counter, self.spare = 0, None

    def next(self) -> int:
        a, b, c, d = self.words
        s, v = a, d
        v ^= v >> 2
        v ^= (v << 1) & _M
        v ^= (s ^ (s << 4)) & _M
        self.words = [v, s, b, c]
        self.counter = (self.counter + 362437) & _M
        return (v + self.counter) & _M

    def uniform(self, low: float = 0.0, high: float = 1.0) -> float:
        return low + (high - low) * self.next() / _M

    def normal(self, mean: float = 0.0, sd: float = 1.0) -> float:
        """By the polar method; of each pair the second coordinate comes first, and the next call gives the other."""
        if self.spare is not None:
            z, self.spare = self.spare, None
            return mean + sd * z
        while True:
            u, v = self.uniform(-1, 1), self.uniform(-1, 1)
            s = u * u + v * v
            if 0 < s <= 1:
                k = sqrt(-2 * log(s) / s)
                self.spare = u * k
                return mean + sd * v * k


def minimise(low: list[float], high: list[float], start: list[float], f: Callable[[list[float]], float], rounds: int = 50) -> tuple[list[float], float]:
    """Coordinate search in a box: try a step down and up in each coordinate, and halve its step where neither helps."""
    x, best = list(start), f(start)
    steps = [(b - a) / 4 for a, b in zip(low, high)]
    for _ in range(rounds):
        for i in range(len(x)):
            helped = False
            for to in (x[i] - steps[i], x[i] + steps[i]):
                y = [*x[:i], min(max(to, low[i]), high[i]), *x[i + 1 :]]
                if (v := f(y)) < best:
                    x, best, helped = y, v, True
                    break
            if not helped:
                steps[i] /= 2
    return x, best
