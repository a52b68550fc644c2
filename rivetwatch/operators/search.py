"""Search of model settings: Parzen proposals, tried cheaply first.

Settings are proposed from what earlier trials have shown.  Trials are split
into a good share and the rest; for both a density is laid over every setting
(one kernel per trial and one flat part), and of a few draws from the good
density the one is taken whose ratio of densities is largest.  Trials start
with a small share of their trees; per rung only the best third goes on to
three times as many, so most of the effort goes into settings that last.
Trials of one batch are evaluated side by side.

Only settings and losses stay on the driver, one pair per trial; what a trial
costs on the table is up to ``evaluate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np


class Axis(NamedTuple):
    """One setting: its range, and whether it is a whole number or counted by factors."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    def value(self, u: float) -> float:
        if self.whole:
            return int(min(self.high, self.low + math.floor(u * (self.high - self.low + 1))))
        return float(self.low * (self.high / self.low) ** u) if self.log else float(self.low + u * (self.high - self.low))


Space = Mapping[str, Mapping[str, Axis]]  # model -> setting -> axis


class Trial(NamedTuple):
    """One evaluation: settings as places in [0, 1], as values, and the loss at a rung."""

    number: int
    model: str
    places: dict[str, float]
    settings: dict[str, float]
    rung: int
    loss: float


def _density(u: float, centres: np.ndarray) -> float:
    """Gaussian kernels reflected at both ends, and one flat part."""
    if not len(centres):
        return 1.0
    h = _width(len(centres))
    z = np.concatenate([u - centres, -u - centres, 2 - u - centres]) / h
    return (1.0 + float(np.exp(-0.5 * z * z).sum()) / (h * math.sqrt(2 * math.pi))) / (len(centres) + 1)


def _width(n: int) -> float:
    return max(0.05, 0.4 * n ** -0.5)


def _draw(rng: np.random.Generator, centres: np.ndarray) -> float:
    if rng.random() * (len(centres) + 1) < 1:
        return float(rng.random())
    u = abs(float(rng.normal(rng.choice(centres), _width(len(centres)))) % 2)
    return 2 - u if u > 1 else u


class Parzen:
    """Proposes the settings of the next trial; the same seed and history give the same proposals."""

    def __init__(self, space: Space, seed: int, startup: int = 6, draws: int = 24, good_share: float = 0.25):
        self.space, self.rng = space, np.random.default_rng(seed)
        self.startup, self.draws, self.good_share = startup, draws, good_share

    def propose(self, history: list[Trial]) -> tuple[str, dict[str, float]]:
        last: dict[int, Trial] = {}
        for t in history:  # a trial counts by the highest rung it has reached
            if t.number not in last or t.rung > last[t.number].rung:
                last[t.number] = t
        ranked = sorted(last.values(), key=lambda t: (-t.rung, t.loss, t.number))
        names = list(self.space)
        if len(ranked) < self.startup:
            model = names[int(self.rng.integers(len(names)))]
            return model, {a: float(self.rng.random()) for a in self.space[model]}
        cut = max(2, math.ceil(self.good_share * len(ranked)))
        good, rest = ranked[:cut], ranked[cut:]

        def share(trials: list[Trial], model: str) -> float:
            return (sum(t.model == model for t in trials) + 1) / (len(trials) + len(names))

        def centres(trials: list[Trial], model: str, axis: str) -> np.ndarray:
            return np.array([t.places[axis] for t in trials if t.model == model])

        weights = np.array([share(good, m) for m in names])
        best = None
        for _ in range(self.draws):
            model = names[int(self.rng.choice(len(names), p=weights / weights.sum()))]
            score = math.log(share(good, model) / share(rest, model))
            places = {}
            for axis in self.space[model]:
                near, far = centres(good, model, axis), centres(rest, model, axis)
                places[axis] = _draw(self.rng, near)
                score += math.log(_density(places[axis], near) / _density(places[axis], far))
            if best is None or score > best[0]:
                best = (score, model, places)
        return best[1], best[2]


def search(
    space: Space,
    evaluate: Callable[[str, dict[str, float], float], float],
    trials: int,
    seed: int = 0,
    rungs: int = 3,
    keep: int = 3,
    side_by_side: int = 4,
    wrap: Callable = lambda f: f,
) -> list[Trial]:
    """All evaluations, in order.  ``evaluate(model, settings, share)`` gives the loss with ``share`` of the effort.

    ``wrap`` prepares a function for another thread.  A loss that is no number counts as infinite.
    """
    if trials < 1:
        raise ValueError("need at least one trial")
    sampler, history = Parzen(space, seed), []

    def run(batch: list[tuple[int, str, dict[str, float]]], rung: int) -> list[Trial]:
        share = float(keep) ** (rung - rungs + 1)

        def one(item):
            number, model, places = item
            settings = {a: axis.value(places[a]) for a, axis in space[model].items()}
            loss = evaluate(model, settings, share)
            return Trial(number, model, places, settings, rung, math.inf if loss is None or math.isnan(loss) else float(loss))

        with ThreadPoolExecutor(side_by_side) as pool:
            done = list(pool.map(wrap(one), batch))
        history.extend(done)
        return done

    started = 0
    while started < trials:
        size = min(trials - started, keep ** (rungs - 1))
        entered: list[Trial] = []
        while len(entered) < size:
            width = min(side_by_side, size - len(entered))
            entered += run([(started + len(entered) + i, *sampler.propose(history)) for i in range(width)], 0)
        started += size
        for rung in range(1, rungs):
            entered.sort(key=lambda t: (t.loss, t.number))
            entered = run([(t.number, t.model, t.places) for t in entered[: math.ceil(len(entered) / keep)]], rung)
    return history


def winner(history: list[Trial]) -> Trial:
    """Least loss among the trials that got the whole effort."""
    top = max(t.rung for t in history)
    return min((t for t in history if t.rung == top), key=lambda t: (t.loss, t.number))
