"""Parzen proposals and successive halving on losses that are known in closed form."""

import math

import numpy as np
import pytest

from rivetwatch.operators.search import Axis, Parzen, search, winner

SPACE = {
    "flat": {"x": Axis(0.0, 1.0), "n": Axis(1, 50, whole=True)},
    "steep": {"x": Axis(0.0, 1.0), "rate": Axis(0.001, 1.0, log=True), "n": Axis(1, 50, whole=True)},
}


def loss(model, s, share=1.0):
    base = (s["x"] - 0.31) ** 2 + ((s["n"] - 17) / 50) ** 2 + 0.02 / share
    return base + (0.3 if model == "flat" else (math.log10(s["rate"]) + 2) ** 2 / 9)


def test_values_stay_in_their_range():
    for axis in (*SPACE["steep"].values(), Axis(5, 5, whole=True)):
        got = [axis.value(u) for u in np.linspace(0, 1, 101)]
        assert min(got) == axis.low and max(got) <= axis.high and got == sorted(got)
    assert {Axis(1, 3, whole=True).value(u) for u in np.linspace(0, 1, 50)} == {1, 2, 3}
    assert Axis(0.01, 1, log=True).value(0.5) == pytest.approx(0.1)


def test_proposals_beat_random_ones_at_equal_numbers():
    """Forty trials each, twelve seeds: the mean of the best loss must be lower, and most seeds must win."""
    parzen, chance = [], []
    for seed in range(12):
        parzen.append(winner(search(SPACE, loss, 40, seed, rungs=1, side_by_side=1)).loss)
        sampler = Parzen(SPACE, seed, startup=10**9)
        tries = [sampler.propose([]) for _ in range(40)]
        chance.append(min(loss(m, {a: SPACE[m][a].value(u) for a, u in p.items()}) for m, p in tries))
    assert np.mean(parzen) < 0.8 * np.mean(chance)
    assert sum(p < c for p, c in zip(parzen, chance)) >= 8


def test_only_the_best_third_goes_on():
    history = search(SPACE, loss, 9, seed=4, side_by_side=3)
    rungs = [[t for t in history if t.rung == r] for r in range(3)]
    assert [len(r) for r in rungs] == [9, 3, 1]
    for lower, upper in zip(rungs, rungs[1:]):
        best = sorted(lower, key=lambda t: (t.loss, t.number))[: len(upper)]
        assert {t.number for t in upper} == {t.number for t in best}
    shares = {t.rung: 0.02 / (t.loss - loss(t.model, t.settings, 1e9)) for t in history}
    assert shares == pytest.approx({0: 1 / 9, 1: 1 / 3, 2: 1.0})
    assert winner(history) is rungs[2][0]


def test_same_seed_same_search_and_odd_losses():
    one, two = (search(SPACE, loss, 14, seed=2, side_by_side=4) for _ in range(2))
    assert one == two and {t.number for t in one} == set(range(14))
    failing = search(SPACE, lambda m, s, share: math.nan if m == "flat" else loss(m, s, share), 9, seed=1)
    assert winner(failing).model == "steep"
    assert len(search(SPACE, loss, 1)) == 3
    with pytest.raises(ValueError):
        search(SPACE, loss, 0)
