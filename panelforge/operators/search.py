"""Search, clustering, ensembles and models.

Search runs on the driver over formula trees; every generation is scored in one Spark job.
Clustering, selection and optimisers work on matrices between formulas, which are small; the
moments that they need come from grouped aggregates over the panel.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import scoring as S
from panelforge.plans.formula import Node, encode, linear_signals, parse

UNARY = ("rank", "zscore", "neutralize", "decay", "sign")


# ---- formulas --------------------------------------------------------------------------------
class Generator:
    """Random formulas and their variations, from one seed."""

    def __init__(self, names: Iterable[str], seed: int = 0, max_depth: int = 3, max_length: int = 180):
        self.names, self.rng, self.max_depth, self.max_length = sorted(names), random.Random(seed), max_depth, max_length

    def tree(self, depth: int | None = None) -> Node:
        depth = self.max_depth if depth is None else depth
        x = self.rng.random()
        if depth == 0 or x < 0.3:
            return Node("feature", name=self.rng.choice(self.names))
        if x < 0.6:
            k = self.rng.choice(UNARY)
            return Node(k, (self.tree(depth - 1),), params=(("halflife", 10.0),) if k == "decay" else ())
        return Node(self.rng.choice("+-"), (self.tree(depth - 1), self.tree(depth - 1)))

    def formula(self) -> str:
        while len(f := self.tree().text()) > self.max_length:
            pass
        return f

    def _swap(self, n: Node, at: int, new: Node) -> tuple[Node, int]:
        """The tree with its ``at``-th node (in preorder) replaced."""
        if at == 0:
            return new, -1
        args, at = [], at - 1
        for a in n.args:
            if at >= 0:
                a, at = self._swap(a, at, new)
            args.append(a)
        return Node(n.kind, tuple(args), n.name, n.params), at

    def _part(self, n: Node, at: int) -> tuple[Node | None, int]:
        if at == 0:
            return n, -1
        at -= 1
        for a in n.args:
            found, at = self._part(a, at)
            if found is not None:
                return found, at
        return None, at

    def mutated(self, f: str) -> str:
        n = parse(f)
        out = self._swap(n, self.rng.randrange(n.size()), self.tree(1))[0].text()
        return out if len(out) <= self.max_length else f

    def crossed(self, f: str, g: str) -> str:
        a, b = parse(f), parse(g)
        part, _ = self._part(b, self.rng.randrange(b.size()))
        out = self._swap(a, self.rng.randrange(a.size()), part)[0].text()
        return out if len(out) <= self.max_length else f


def fingerprint(formula: str, names: Iterable[str]) -> str:
    """Weights at three decimals: formulas with the same are the same to the linear scorer."""
    return ",".join(f"{k}:{v:.3f}" for k, v in sorted(encode(formula, names).items()))


def distinct_formulas(formulas: Iterable[str], names: Iterable[str]) -> list[str]:
    seen: dict[str, str] = {}
    names = list(names)
    for f in formulas:
        if k := fingerprint(f, names):
            seen.setdefault(k, f)
    return list(seen.values())


def scores(table: DataFrame, panel: DataFrame, formulas: list[str], names: Iterable[str]) -> DataFrame:
    """formula and weighted horizon IC of all formulas, in one job."""
    ids = {f"g{i}": f for i, f in enumerate(formulas)}
    sig = linear_signals(table, ids, names)
    w = S.weighted_ic(S.ic_horizons(sig, panel, {1: 0.6, 7: 0.4}))
    rows = table.sparkSession.createDataFrame(list(ids.items()), "formula_id string, formula string")
    return w.join(F.broadcast(rows), "formula_id").select("formula", F.round("weighted_ic", 6).alias("fitness"))


def evolve(table: DataFrame, panel: DataFrame, names: Iterable[str], population: int = 30, generations: int = 2, elite: int = 6, explore: float = 0.25, tournament: int = 4, seed: int = 0) -> DataFrame:
    """Genetic search: elite, tournament crossover and mutation, and fresh formulas."""
    names = list(names)
    g = Generator(names, seed)
    known: dict[str, float] = {}
    pool = distinct_formulas([g.formula() for _ in range(population * 2)], names)[:population]
    for generation in range(generations + 1):
        new = [f for f in pool if f not in known]
        if new:
            known |= {r.formula: r.fitness for r in scores(table, panel, new, names).collect()}  # one row a formula
        ranked = sorted((f for f in pool if f in known), key=lambda f: (-known[f], f))
        if generation == generations:
            break
        pick = lambda: min(g.rng.sample(ranked, min(tournament, len(ranked))), key=lambda f: (-known[f], f))
        children = [g.mutated(g.crossed(pick(), pick())) if g.rng.random() < 0.55 else g.crossed(pick(), pick()) for _ in range(population)]
        fresh = [g.formula() for _ in range(int(population * explore))]
        pool = distinct_formulas([*ranked[:elite], *children, *fresh], names)[:population]
    top = sorted(known.items(), key=lambda x: (-x[1], x[0]))
    return table.sparkSession.createDataFrame([(i + 1, f, v) for i, (f, v) in enumerate(top[:elite])], "place int, formula string, fitness double")


# ---- matrices between formulas ---------------------------------------------------------------
def correlation_matrix(values: DataFrame, unit: str, obs: list[str], value: str) -> tuple[list[str], np.ndarray]:
    pairs = S.pairwise_correlation(values, unit, obs, value).collect()
    names = sorted({x for r in pairs for x in (r.a, r.b)})
    m = np.eye(len(names))
    at = {n: i for i, n in enumerate(names)}
    for r in pairs:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r["corr"] if r["corr"] is not None else 0.0
    return names, m


def orthogonal(names: list[str], m: np.ndarray, score: dict[str, float], most: float = 0.9) -> list[str]:
    """Best first, each not too correlated with those taken before."""
    at, out = {n: i for i, n in enumerate(names)}, []
    for n in sorted(names, key=lambda x: (-score.get(x, 0.0), x)):
        if all(abs(m[at[n], at[k]]) <= most for k in out):
            out.append(n)
    return out


def ward(m: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters: agglomeration by Ward's update on distances 1 - |corr|."""
    n = len(m)
    d = (1 - np.abs(m)).astype(float) ** 2
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n), {i: [i] for i in range(n)}
    while len(group) > k:
        live = sorted(group)
        sub = d[np.ix_(live, live)]
        i, j = (live[x] for x in np.unravel_index(np.argmin(sub), sub.shape))
        i, j = min(i, j), max(i, j)
        for h in live:
            if h not in (i, j):
                t = size[i] + size[j] + size[h]
                d[i, h] = d[h, i] = ((size[i] + size[h]) * d[i, h] + (size[j] + size[h]) * d[j, h] - size[h] * d[i, j]) / t
        size[i] += size[j]
        group[i] += group.pop(j)
        d[j, :] = d[:, j] = np.inf
    labels = np.empty(n, int)
    for c, (_, members) in enumerate(sorted(group.items())):
        labels[members] = c
    return labels


def clusters(values: DataFrame, sharpe: DataFrame, k: int) -> DataFrame:
    """formula_id, cluster, and whether it has the best Sharpe of its cluster."""
    names, m = correlation_matrix(values, "formula_id", ["dt", "asset"], "val")
    labels = values.sparkSession.createDataFrame(list(zip(names, ward(m, min(k, len(names))).tolist(), strict=True)), "formula_id string, cluster int")
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("sharpe"), "formula_id"))
    return labels.join(sharpe.select("formula_id", "sharpe"), "formula_id").withColumn("representative", best == 1)


# ---- weights ---------------------------------------------------------------------------------
def ensemble_weights(metrics: DataFrame) -> DataFrame:
    """Three weightings of formulas: equal, by inverse deviation, and softmax of the Sharpe."""
    every = Window.partitionBy()
    e = F.exp(F.col("sharpe") - F.max("sharpe").over(every))
    inv = 1 / (F.col("std") + 1e-8)
    return metrics.select("formula_id", (1.0 / F.count("*").over(every)).alias("equal"), (inv / F.sum(inv).over(every)).alias("risk_parity"), (e / F.sum(e).over(every)).alias("sharpe"))


def moments(pnl: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, mean and covariance (both annual) of the formulas' profits."""
    wide = pnl.groupBy("dt").pivot("formula_id").agg(F.first("pnl")).drop("dt").dropna()
    names = wide.columns
    x = wide.agg(*[F.avg(c).alias(c) for c in names]).first()
    cov = np.zeros((len(names), len(names)))
    r = wide.agg(*[F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    for i in range(len(names)):
        for j in range(i, len(names)):
            cov[i, j] = cov[j, i] = (r[f"{i}_{j}"] or 0.0) * 252
    return names, np.array([x[c] for c in names]) * 252, cov


def capped(w: np.ndarray, most: float) -> np.ndarray:
    """Weights of sum 1 with none above the cap."""
    w = np.maximum(w, 0)
    w = w / w.sum() if w.sum() else np.full(len(w), 1 / len(w))
    most = max(most, 1 / len(w))
    for _ in range(50):
        over = w > most + 1e-12
        if not over.any():
            break
        spare = (w[over] - most).sum()
        w[over] = most
        rest = w < most - 1e-12
        w[rest] += spare * (w[rest] / w[rest].sum() if w[rest].sum() else 1 / rest.sum())
    return w


def optimise(mean: np.ndarray, cov: np.ndarray, method: str, most: float = 0.4) -> np.ndarray:
    """mean_variance by projected gradient, or risk_parity by multiplicative updates."""
    n = len(mean)
    w = np.full(n, 1 / n)
    if method == "mean_variance":
        step = 0.5 / (np.linalg.eigvalsh(cov).max() + 1e-12)
        for _ in range(500):
            w = w + step * (mean - 2 * cov @ w)
            u = np.sort(w)[::-1]
            k = np.nonzero(u * np.arange(1, n + 1) > np.cumsum(u) - 1)[0][-1]
            w = np.maximum(w - (u[: k + 1].sum() - 1) / (k + 1), 0)
    elif method == "risk_parity":
        for _ in range(500):
            risk = np.maximum(w * (cov @ w), 1e-12 * np.trace(cov))
            w = w * np.sqrt((risk.sum() / n + 1e-18) / (risk + 1e-18))
            w = w / w.sum()
    else:
        raise ValueError(method)
    return capped(w, most)


def optimised(pnl: DataFrame, most: float = 0.4) -> DataFrame:
    names, mean, cov = moments(pnl)
    rows = [(m, n, float(x)) for m in ("mean_variance", "risk_parity") for n, x in zip(names, optimise(mean, cov, m, most), strict=True)]
    return pnl.sparkSession.createDataFrame(rows, "method string, formula_id string, weight double")


def attribution(pnl: DataFrame) -> DataFrame:
    """Share of each formula in variance and return of the equal-weight portfolio, and the Sharpe
    without it."""
    names, mean, cov = moments(pnl)
    n = len(names)
    w = np.full(n, 1 / n)
    var = w @ cov @ w
    rows = []
    for i, name in enumerate(names):
        u = np.delete(np.full(n, 1 / max(n - 1, 1)), i)
        keep = [j for j in range(n) if j != i]
        out = float(u @ mean[keep] / (np.sqrt(u @ cov[np.ix_(keep, keep)] @ u) + 1e-8)) if keep else 0.0
        rows.append((name, float(w[i] * (cov @ w)[i] / (var + 1e-18)), float(w[i] * mean[i]), out))
    return pnl.sparkSession.createDataFrame(rows, "formula_id string, variance_share double, return_share double, sharpe_without double")


def covariance_accuracy(returns: DataFrame, assets: list[str]) -> DataFrame:
    """How well shrinkage, factor and diagonal models of the first half's covariance give the
    volatility of the equal-weight portfolio in the second half."""
    wide = returns.groupBy("dt").pivot("asset", assets).agg(F.first("ret")).dropna().orderBy("dt")
    half = wide.withColumn("late", (F.percent_rank().over(Window.orderBy("dt")) >= 0.5).cast("int"))
    pairs = [(i, j) for i in range(len(assets)) for j in range(i, len(assets))]
    rows = {r.late: r for r in half.groupBy("late").agg(*[F.covar_samp(assets[i], assets[j]).alias(f"{i}_{j}") for i, j in pairs]).collect()}
    cov = {}
    for late, r in rows.items():
        m = np.zeros((len(assets), len(assets)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"{i}_{j}"]
        cov[late] = m
    a = cov[0]
    val, vec = np.linalg.eigh(a)
    top = vec[:, -3:] @ np.diag(val[-3:]) @ vec[:, -3:].T
    models = {"shrinkage": 0.8 * a + 0.2 * np.trace(a) / len(a) * np.eye(len(a)), "factor": top + np.diag(np.diag(a - top)), "diagonal": np.diag(np.diag(a))}
    w = np.full(len(a), 1 / len(a))
    real = np.sqrt(w @ cov[1] @ w)
    out = [(k, float(max(0.0, 1 - abs(np.sqrt(w @ m @ w) - real) / real))) for k, m in models.items()]
    return returns.sparkSession.createDataFrame(out, "model string, accuracy double")


# ---- models ----------------------------------------------------------------------------------
def latent_features(table: DataFrame, names: list[str], k: int = 3) -> DataFrame:
    """dt and latent_1..k: principal components of the date means of standardised features."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = table.groupBy("dt").agg(*[F.avg(n).alias(n) for n in names]).dropna()
    v = VectorAssembler(inputCols=names, outputCol="v").transform(d)
    s = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(v).transform(v)
    p = PCA(k=k, inputCol="s", outputCol="p").fit(s).transform(s).select("dt", vector_to_array("p").alias("p"))
    return p.select("dt", *[F.element_at("p", i + 1).alias(f"latent_{i + 1}") for i in range(k)])


def regime_forecast(series: DataFrame, labels: DataFrame, names: list[str], steps: int = 5, gap: int = 20) -> DataFrame:
    """Probabilities of the label ``steps`` dates ahead: a multinomial model on the readings and
    their changes, fitted on the first 70 % of dates and purged by a gap before the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    w = Window.orderBy("dt")
    x = series.join(labels, "dt").withColumn("i", F.row_number().over(w)).withColumn("target", F.lead("regime", steps).over(w))
    for n in names:
        x = x.withColumn(f"{n}_d5", F.coalesce(F.col(n) - F.lag(n, 5).over(w), F.lit(0.0)))
    cols = [*names, *(f"{n}_d5" for n in names)]
    v = VectorAssembler(inputCols=cols, outputCol="v", handleInvalid="skip").transform(x.fillna(0.0, cols))
    cut = int(v.count() * 0.7)
    fit = v.where((F.col("i") <= cut - gap - steps) & F.col("target").isNotNull())
    index = StringIndexer(inputCol="target", outputCol="y", stringOrderType="alphabetAsc").fit(fit)
    model = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.1, maxIter=30).fit(index.transform(fit))
    p = model.transform(v.where(F.col("i") > cut)).select("dt", vector_to_array("probability").alias("p"))
    return p.select("dt", *[F.element_at("p", k + 1).alias(f"p_{n}") for k, n in enumerate(index.labels)])


def meta_model(facts: DataFrame) -> DataFrame:
    """Next-epoch IC of each formula from its history: ridge regression on its last value, mean,
    deviation and age.  The target is the epoch after, never the same."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    w = Window.partitionBy("formula_id").orderBy("epoch")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = facts.select("formula_id", "epoch", "ic", F.avg("ic").over(run).alias("mean"), F.coalesce(F.stddev_pop("ic").over(run), F.lit(0.0)).alias("std"), F.count("ic").over(run).cast("double").alias("age"), F.lead("ic").over(w).alias("next"))
    v = VectorAssembler(inputCols=["ic", "mean", "std", "age"], outputCol="v").transform(x)
    s = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(v).transform(v)
    model = LinearRegression(featuresCol="s", labelCol="next", regParam=0.5, elasticNetParam=0.0).fit(s.where("next is not null"))
    return model.transform(s.where("next is null")).select("formula_id", "epoch", F.col("prediction").alias("predicted_ic"))
