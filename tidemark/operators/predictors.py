"""Predictors with a state of whole numbers: one protocol for batch kernels, streams and a user's own.

A predictor has `start()`, the state before the first value, and `step(state, x)`, the residual of
x and the next state; `back(state, r)` gives the value of a residual and the next state. States are flat
tuples of ints, so a stream can keep them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np


class Predictor(Protocol):
    def start(self) -> tuple[int, ...]: ...

    def guess(self, state: tuple[int, ...]) -> int: ...

    def learn(self, state: tuple[int, ...], x: int) -> tuple[int, ...]: ...


class Difference:
    """The value from the last ones by differences of an order: 1 delta, 2 double delta, 3 triple delta."""

    WEIGHTS = {1: (1,), 2: (2, -1), 3: (3, -3, 1)}

    def __init__(self, order: int = 1) -> None:
        self.weights = self.WEIGHTS[order]

    def start(self):
        return (0,) * len(self.weights)

    def guess(self, state):
        return sum(w * v for w, v in zip(self.weights, state, strict=True))

    def learn(self, state, x):
        return (x, *state[:-1])


class MovingAverage:
    """A fourth of the sum of all errors so far."""

    def start(self):
        return (0,)

    def guess(self, state):
        return state[0] >> 2

    def learn(self, state, x):
        return (state[0] + x - self.guess(state),)


def wrap(x: int, bits: int) -> int:
    half = 1 << (bits - 1)
    return ((x + half) & ((1 << bits) - 1)) - half


class Adaptive:
    """The adaptive forecast of `recurrences.forecast`. State: last value, last step, counter, coefficient, pull, place in the block."""

    def __init__(self, bits: int = 16, shift: int = 1, truncate: bool = True) -> None:
        self.bits, self.shift, self.low = bits, shift, bits - 4 if truncate else 0

    def start(self):
        return (0,) * 6

    def _slope(self, state):
        return (state[2] >> (self.shift + self.low)) << self.low if state[5] == 0 else state[3]

    def guess(self, state):
        return state[0] + ((state[1] * self._slope(state)) >> self.bits)

    def learn(self, state, x):
        prev, step, counter, _, pull, place = state
        slope, pull = self._slope(state), 0 if place == 0 else pull
        move = wrap(x - prev, self.bits)
        err = wrap(move - ((step * slope) >> self.bits), self.bits)
        if place % 2:
            pull = wrap(pull + ((err > 0) - (err < 0)) * step, self.bits)
        if place == 7:
            counter += pull >> 2
        return (x, move, counter, slope, pull, (place + 1) % 8)


def encode(p: Predictor, x: Sequence[int], state: tuple[int, ...] | None = None, bits: int | None = None) -> tuple[np.ndarray, tuple[int, ...]]:
    """Residuals (modulo 2**bits, if given) and the state after them."""
    state, out = p.start() if state is None else state, []
    for v in x:
        r = int(v) - p.guess(state)
        out.append(r if bits is None else wrap(r, bits))
        state = p.learn(state, int(v))
    return np.array(out, np.int64), state


def decode(p: Predictor, r: Sequence[int], state: tuple[int, ...] | None = None, bits: int | None = None) -> np.ndarray:
    state, out = p.start() if state is None else state, []
    for e in r:
        v = int(e) + p.guess(state)
        out.append(v if bits is None else v & ((1 << bits) - 1))
        state = p.learn(state, out[-1])
    return np.array(out, np.int64)


class OnlineMean:
    """Sums over the last n rows of some columns: `start`, `add` (one row in, the oldest out), `means` (rounded down), `reset`."""

    def __init__(self, n: int, columns: int) -> None:
        self.n, self.columns = n, columns
        self.reset()

    def reset(self) -> None:
        self.rows: list[np.ndarray] = []
        self.sums = np.zeros(self.columns, np.int64)

    def start(self, rows: np.ndarray) -> None:
        self.reset()
        for row in np.asarray(rows)[-self.n :]:
            self.add(row)

    def add(self, row) -> None:
        self.rows.append(np.asarray(row, np.int64))
        self.sums = self.sums + self.rows[-1] - (self.rows.pop(0) if len(self.rows) > self.n else 0)

    def means(self) -> np.ndarray:
        return self.sums // max(1, len(self.rows))
