"""Search, clustering and optimisers by their properties."""

import numpy as np
import pytest

from panelforge.operators import search as X
from panelforge.plans.formula import encode, parse, safe_formula

NAMES = ["a", "b", "c", "momentum"]


def test_generated_formulas_are_safe_and_repeat():
    g, h = X.Generator(NAMES, 3), X.Generator(NAMES, 3)
    first = [g.formula() for _ in range(50)]
    assert first == [h.formula() for _ in range(50)]
    for f in first:
        assert safe_formula(f) and len(f) <= 180 and parse(f).features() <= set(NAMES)
    for f, k in zip(first, first[1:], strict=False):
        for new in (g.mutated(f), g.crossed(f, k)):
            assert safe_formula(new) and parse(new).features() <= set(NAMES)


def test_duplicates_by_weights_go():
    out = X.distinct_formulas(["a", "rank(a)", "a - b", "b - a", "a + 0 * b", "zscore(a - b)"], NAMES)
    assert out == ["a", "a - b"] or out[:2] == ["a", "a - b"]
    assert len({tuple(sorted(encode(f, NAMES).items())) for f in out}) == len(out)


def test_ward_finds_blocks():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 400))
    x = np.concatenate([base[[i]] + 0.2 * rng.normal(size=(4, 400)) for i in range(3)])
    labels = X.ward(np.corrcoef(x), 3)
    assert [len(set(labels[4 * i : 4 * i + 4])) for i in range(3)] == [1, 1, 1] and len(set(labels)) == 3


@pytest.mark.parametrize("method", ["mean_variance", "risk_parity"])
def test_optimisers(method):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) * [1, 2, 3, 4, 5]
    w = X.optimise(rng.normal(size=5), np.cov(x.T), method, 0.5)
    assert w.sum() == pytest.approx(1) and (w >= -1e-12).all() and w.max() <= 0.5 + 1e-9
    if method == "risk_parity":
        risk = w * (np.cov(x.T) @ w)
        assert risk.max() / risk.min() < 1.2


def test_orthogonal_selection():
    m = np.array([[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]])
    assert X.orthogonal(["x", "y", "z"], m, {"y": 2.0, "x": 1.0, "z": 0.5}) == ["y", "z"]


def test_capped_weights():
    w = X.capped(np.array([10.0, 1.0, 1.0, 0.0]), 0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-9
