"""Rewards of signals and eviction on small histories."""

import math

import numpy as np
import pytest

from panelforge.operators import ledger as L
from panelforge.operators import records as K


def reward(history, max_corr, state_multiplier):
    """The rule for one history, its mean added."""
    m, s = np.mean(history), np.std(history)
    full = [*history, m] if m != 0 else list(history)
    ok = [(t, math.log(abs(v))) for t, v in enumerate(full) if abs(v) > 1e-8]
    rate = -np.polyfit(*zip(*ok, strict=True), 1)[0] if len(ok) >= 4 else None
    decay = 0.5 if len(full) < 4 else 1.0 if rate is None or rate <= 0 else min(1.0, math.log(2) / rate / 30)
    up = np.mean([v > 0 for v in full])
    capacity = (0.5 * up + 0.25 * min(len(full) / 20, 1) + 0.175) * state_multiplier
    sat = lambda x: 1 - math.exp(-max(x, 0))
    total = 0.4 * sat(m / 0.05) + 0.2 * sat(m / (s + 1e-6) if s > 0 else 0) + 0.15 * decay + 0.15 * (1 - max_corr) + 0.1 * capacity
    return min(1, total) * state_multiplier


HISTORIES = {
    "one": ([0.03], 0.0),
    "zero mean": ([0.02, -0.02], 0.2),
    "steady": ([0.02, 0.03, 0.025, 0.04, 0.03, 0.035, 0.02], 0.1),
    "fading": ([0.2 * 0.5**k for k in range(6)], 0.0),
    "faded": ([0.2 * 0.5**k for k in range(8)], 0.0),  # five epochs in decay are over
    "losing": ([-0.01, 0.001, -0.02, -0.03], 0.4),
}


def test_rewards(spark):
    facts = spark.createDataFrame([(f, e, ic) for f, (h, _) in HISTORIES.items() for e, ic in enumerate(h)], "formula_id string, epoch long, ic double")
    novelty = spark.createDataFrame([(f, c) for f, (_, c) in HISTORIES.items() if c], "formula_id string, max_corr double")
    got = {r.formula_id: r for r in K.signal_rewards(facts, novelty).collect()}
    assert set(got) == set(HISTORIES)
    assert got["losing"].state == "RETIRED" and got["losing"].reward == 0
    assert got["faded"].state == "RETIRED"
    assert got["fading"].state == "DECAYING" and got["steady"].state == "PRODUCTION" and got["one"].state == "EXPERIMENTAL"
    for f, (h, c) in HISTORIES.items():
        assert got[f].reward == pytest.approx(reward(h, c, got[f].multiplier), abs=1e-9), f
    # smoothed over two epochs, both experimental
    a, b = (reward(HISTORIES["zero mean"][0][:k], 0.2, 0.3) for k in (1, 2))
    assert got["zero mean"].smoothed == pytest.approx(0.8 * a + 0.2 * b, abs=1e-9)
    assert got["one"].smoothed == got["one"].reward


def test_eviction_takes_retired_only(spark):
    rows = [("a", 5, "RETIRED"), ("b", 3, "RETIRED"), ("c", 1, "PRODUCTION"), ("d", 3, "RETIRED"), ("e", 9, "DECAYING")]
    entries = spark.createDataFrame(rows, "formula_id string, last_epoch long, state string")
    left = lambda cap: sorted(r.formula_id for r in L.evict(entries, cap).collect())
    assert left(5) == left(9) == ["a", "b", "c", "d", "e"]
    assert left(4) == ["a", "c", "d", "e"]
    assert left(3) == ["a", "c", "e"]
    assert left(0) == ["c", "e"]


def test_regime_component(spark):
    rows = [("x", "calm", 0.05)] * 3 + [("x", "stress", 0.01)] * 3 + [("x", "normal", -0.9)] * 2 + [("y", "calm", 0.05)] * 5 + [("z", "calm", None)]
    got = {r.formula_id: r for r in K.regime_component(spark.createDataFrame(rows, "formula_id string, regime string, ic double")).collect()}
    assert got["x"].worst == pytest.approx(0.01) and got["x"].score == pytest.approx(1 - math.exp(-0.2))
    assert got["y"].worst is None and got["y"].score == 0.5 and "z" not in got
