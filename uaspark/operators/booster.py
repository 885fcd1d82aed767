"""Training-set preparation and the quantile booster.

Spark ML's gradient-boosted trees have squared and absolute loss only, so the
p10 / p50 / p90 models are boosted here on the pinball loss with Spark ML trees:

* F0 = exact alpha-percentile of the label;
* every round fits a ``DecisionTreeRegressor`` on the negative pinball gradient (alpha
  where y > F, alpha - 1 elsewhere);
* the tree is read into flat arrays and its splits of least gain are collapsed until
  ``max_leaves`` leaves remain (leaf-limited trees);
* each remaining leaf's step is the alpha-percentile of the residual y - F of its rows
  (``percentile_approx`` with relative rank error 1 / LEAF_ACCURACY: a sketch per leaf is
  merged map-side, no leaf is gathered into one task);
* F += learning_rate * step, an expression over the tree's few splits.

Models that share a frame (quantiles, horizons, folds) are boosted side by side: the
frame is stored once, with one F column a model; the fits of a round run at the same
time, one aggregate finds the steps of all of them, and one reliable checkpoint every
``checkpoint_every`` rounds serves them all.  Nothing of a fitted tree stays in the JVM.

A model is a ``Forest``: the splits of all its trees in flat arrays.  Scoring passes Arrow
batches once through all trees, so the plan has the same size for any number of rounds.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .clean import numeric_columns
from .quantiles import exact_percentiles

#: The parameter sets: app, memory-saving app, service (rate and leaves only, depth as Spark allows).
PRESETS = {
    "standard": {"n_rounds": 100, "learning_rate": 0.05, "max_depth": 6, "max_leaves": 31, "min_instances": 20},
    "light": {"n_rounds": 50, "learning_rate": 0.1, "max_depth": 4, "max_leaves": 15, "min_instances": 20},
    "service": {"n_rounds": 100, "learning_rate": 0.05, "max_depth": 10, "max_leaves": 31, "min_instances": 20},
}
LEAF_ACCURACY = 10_000
#: Rows of the stored frame that a task takes at least, about: a fit is many small jobs of one task a partition.
ROWS_PER_TASK = 20_000
FAMILY_PATTERNS = [r"^roas_d(\d+)", r"^retention(?:_rate)?_d(\d+)", r"^level_(\d+)_events$", r"^d(\d+)_retention"]


def nonnull_target(df: DataFrame, target: str) -> DataFrame:
    """rows with a non-null target."""
    return df.where(F.col(target).isNotNull())


def leakage_safe_columns(columns: Sequence[str], target_day: int, strict: bool = True) -> list[str]:
    """drop ROAS / retention / level columns whose day is >= the target day
    (``strict`` = the G1 rule; ``strict=False`` = ROAS only, the G2 rule)."""
    pats = FAMILY_PATTERNS if strict else FAMILY_PATTERNS[:1]
    keep = []
    for c in columns:
        leak = False
        for p in pats:
            m = re.match(p, c)
            if m and int(m.group(1)) >= target_day:
                leak = True
        if not leak:
            keep.append(c)
    return keep


def prepare_training(df: DataFrame, target: str, target_day: int, exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """M8 = F2 + F4 + P16 + P12: non-null target, leakage guard, numeric
    features only, nulls filled with 0.  Returns (frame, feature names)."""
    d = nonnull_target(df, target)
    ex = set(exclude) | {target}
    feats = [c for c in leakage_safe_columns(numeric_columns(d), target_day) if c not in ex]
    out = d.select(*[F.col(c) for c in df.columns if c in ex or c in feats])
    return out.na.fill(0, subset=feats), feats


def split_column(key: Column, holdout_bucket: int = 0) -> Column:
    """T5: deterministic 80/20 split, engine-independent: md5(key) mod 5."""
    b = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 5
    return F.when(b == holdout_bucket, F.lit("test")).otherwise(F.lit("train"))


# ---- forests ------------------------------------------------------------------

@dataclass
class Forest:
    """Trees in flat arrays: node i goes ``left[i]`` where feature ``feature[i]`` is at most
    ``threshold[i]``, else ``right[i]``; a leaf has feature -1 and adds ``step[i]``.  A
    missing value counts as 0, as in the prepared training set.  ``gain`` is what a split gains over all its rows."""
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    step: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, tree: Tree, steps: dict[int, float], rate: float) -> None:
        """``tree`` with its leaves' steps, times ``rate``."""
        base = len(self.feature)
        place = {node: base + i for i, node in enumerate(tree.nodes())}
        self.roots.append(place[0])
        for node in place:
            leaf = node in tree.leaves
            f, t, low, high, gain = (-1, 0.0, 0, 0, 0.0) if leaf else tree.splits[node]
            self.feature.append(f)
            self.threshold.append(t)
            self.left.append(place.get(low, 0) if not leaf else 0)
            self.right.append(place.get(high, 0) if not leaf else 0)
            self.step.append(rate * steps.get(node, 0.0) if leaf else 0.0)
            self.gain.append(gain)

    def leaves(self) -> list[int]:
        """Number of leaves of each tree."""
        ends = [*self.roots[1:], len(self.feature)]
        return [sum(f < 0 for f in self.feature[a:z]) for a, z in zip(self.roots, ends)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The sum of all steps for each row of ``x``."""
        feature, threshold, left, right, step = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right, self.step))
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while len(inner := np.flatnonzero(feature[node] >= 0)):
                at = node[inner]
                low = x[rows[inner], feature[at]] <= threshold[at]
                node[inner] = np.where(low, left[at], right[at])
            out += step[node]
        return out


@dataclass
class Tree:
    """One fitted tree: ``splits[node]`` is (feature, threshold, left, right, gain)."""
    splits: dict[int, tuple[int, float, int, int, float]]
    leaves: set[int]

    @staticmethod
    def of(model: DecisionTreeRegressionModel) -> Tree:
        """Reads a Spark ML tree node by node (``2 ** (depth + 1)`` of them at most)."""
        splits, leaves, todo, many = {}, set(), [(0, model._java_obj.rootNode())], 1
        while todo:
            i, node = todo.pop()
            if node.subtreeDepth() == 0:
                leaves.add(i)
                continue
            split = node.split()
            splits[i] = (split.featureIndex(), split.threshold(), many, many + 1, node.gain() * node.impurityStats().count())
            todo += [(many, node.leftChild()), (many + 1, node.rightChild())]
            many += 2
        return Tree(splits, leaves)

    def nodes(self) -> list[int]:
        out, todo = [], [0]
        while todo:
            i = todo.pop()
            out.append(i)
            if i not in self.leaves:
                todo += [self.splits[i][3], self.splits[i][2]]
        return out

    def collapsed(self, max_leaves: int) -> Tree:
        """The tree without its splits of least gain: again and again the one of least gain
        whose children are both leaves becomes a leaf, until ``max_leaves`` remain."""
        splits, leaves = dict(self.splits), set(self.leaves)
        parent = {child: i for i, s in splits.items() for child in s[2:4]}
        ends = lambda i: i in splits and splits[i][2] in leaves and splits[i][3] in leaves
        heap = [(s[4], i) for i, s in splits.items() if ends(i)]
        heapq.heapify(heap)
        while len(leaves) > max(1, max_leaves):
            _, i = heapq.heappop(heap)
            leaves -= set(splits.pop(i)[2:4])
            leaves.add(i)
            if i in parent and ends(parent[i]):
                heapq.heappush(heap, (splits[parent[i]][4], parent[i]))
        return Tree(splits, leaves)

    def expression(self, names: Sequence[str], value: Callable[[int], str], node: int = 0) -> str:
        """SQL that gives ``value`` of the leaf of a row; ``names`` are the features."""
        if node in self.leaves:
            return value(node)
        f, threshold, low, high, _ = self.splits[node]
        below, above = (self.expression(names, value, n) for n in (low, high))
        return f"IF({names[f]} <= {threshold!r}D, {below}, {above})"


@dataclass
class QuantileBoosterModel:
    alpha: float
    f0: float
    learning_rate: float
    features: list[str]
    forest: Forest = field(default_factory=Forest)

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """M2: F0 + the steps of all trees, in one pass over Arrow batches."""
        return score_all({output: self}, df)

    def feature_importances(self) -> dict[str, float]:
        """M7: what the splits of each feature gain in all, as a share."""
        total = [0.0] * len(self.features)
        for f, gain in zip(self.forest.feature, self.forest.gain):
            if f >= 0:
                total[f] += gain
        s = sum(total)
        return {name: (v / s if s else 0.0) for name, v in zip(self.features, total)}


def score_all(models: dict[str, QuantileBoosterModel], df: DataFrame) -> DataFrame:
    """``df`` plus one column for each model, all scored in the same pass."""
    names = sorted({f for m in models.values() for f in m.features})
    place = {f: i for i, f in enumerate(names)}
    share = df.sparkSession.sparkContext.broadcast(
        [(m.f0, [place[f] for f in m.features], m.forest) for m in models.values()])

    @F.pandas_udf("array<double>")
    def scored(x: pd.DataFrame) -> pd.Series:
        values = np.nan_to_num(x.to_numpy(dtype=float, na_value=np.nan), nan=0.0, posinf=np.inf, neginf=-np.inf)
        found = [f0 + forest.score(values[:, own]) for f0, own, forest in share.value]
        return pd.Series(list(np.stack(found, 1)) if len(x) else [], dtype=object)

    given = F.struct(*[F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(names)])
    out = df.withColumn("_scores", scored(given))
    return out.select(*df.columns, *[F.col("_scores")[i].alias(name) for i, name in enumerate(models)])


@dataclass
class ModelSpec:
    """One model of a joint fit: its quantile, its features and the rows it learns from."""
    name: str
    alpha: float
    features: Sequence[str]
    rows: Column | None = None


def fit_models(df: DataFrame, label: str, specs: Sequence[ModelSpec], n_rounds: int = 100, learning_rate: float = 0.05,
               max_depth: int = 6, max_leaves: int = 31, min_instances: int = 20, max_bins: int = 32, seed: int = 42,
               checkpoint_every: int = 2) -> dict[str, QuantileBoosterModel]:
    """M1: boosts all models of ``specs`` in step, over one stored frame."""
    every = sorted({f for s in specs for f in s.features})
    place = {f: f"c{i}" for i, f in enumerate(every)}
    many = range(len(specs))
    takes = [F.lit(True) if s.rows is None else F.coalesce(s.rows, F.lit(False)) for s in specs]
    base = df.where(F.col(label).isNotNull()).select(
        *[F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for f, c in place.items()],
        F.col(label).cast("double").alias("y"), *[t.alias(f"m{i}") for i, t in enumerate(takes)])
    state = cut_lineage(base.where(reduce(Column.__or__, [F.col(f"m{i}") for i in many])))
    # the partitions follow the rows, not the tables that the frame was reduced from
    state = cut_lineage(state.coalesce(max(1, -(-state.count() // ROWS_PER_TASK))))

    def each(make: Callable[[int], Column]) -> Column:
        """One row for each model that learns from a row."""
        return F.explode(F.filter(F.array(*[F.when(F.col(f"m{i}"), make(i)) for i in many]), lambda e: e.isNotNull()))

    alphas = sorted({s.alpha for s in specs})
    labels = state.select(each(lambda i: F.struct(F.lit(i).alias("i"), F.col("y"))).alias("e")).select("e.i", "e.y")
    firsts = {r["i"]: r for r in exact_percentiles(labels, ["i"], "y", alphas, [f"q{k}" for k in range(len(alphas))]).collect()}
    models = {}
    for i, s in enumerate(specs):
        f0 = float(firsts[i][f"q{alphas.index(s.alpha)}"]) if i in firsts else 0.0
        models[s.name] = QuantileBoosterModel(s.alpha, f0, learning_rate, list(s.features))
    state = state.withColumns({f"f{i}": F.lit(models[s.name].f0) for i, s in enumerate(specs)})
    live = [i for i in many if i in firsts]

    def fit(i: int, state: DataFrame, r: int) -> Tree:
        own, a = specs[i], specs[i].alpha
        grad = F.when(F.col("y") > F.col(f"f{i}"), F.lit(a)).otherwise(F.lit(a - 1.0))
        rows = VectorAssembler(inputCols=[place[f] for f in own.features], outputCol="x", handleInvalid="keep").transform(
            state.where(F.col(f"m{i}"))).select("x", grad.alias("g"))
        return Tree.of(DecisionTreeRegressor(featuresCol="x", labelCol="g", maxDepth=max_depth, minInstancesPerNode=min_instances,
                                             maxBins=max_bins, seed=seed + r).fit(rows)).collapsed(max_leaves)

    for r in range(n_rounds if live else 0):
        trees = dict(zip(live, together([partial(fit, i, state, r) for i in live])))
        names = {i: [place[f] for f in specs[i].features] for i in live}
        leaf = {i: F.expr(trees[i].expression(names[i], str)) for i in live}
        residuals = state.select(each(lambda i: F.struct(F.lit(i).alias("i"), leaf[i].alias("leaf"), (F.col("y") - F.col(f"f{i}")).alias("e"))
                                      if i in leaf else F.lit(None)).alias("e")).select("e.*")
        steps: dict[int, dict[int, float]] = {i: {} for i in live}
        for row in residuals.groupBy("i", "leaf").agg(F.percentile_approx("e", alphas, LEAF_ACCURACY).alias("q")).collect():
            steps[row["i"]][row["leaf"]] = float(row["q"][alphas.index(specs[row["i"]].alpha)])
        moves = {}
        for i in live:
            models[specs[i].name].forest.add(trees[i], steps[i], learning_rate)
            move = trees[i].expression(names[i], lambda n: f"{learning_rate * steps[i].get(n, 0.0)!r}D")
            moves[f"f{i}"] = F.col(f"f{i}") + F.expr(move)
        state = state.withColumns(moves)
        if (r + 1) % checkpoint_every == 0 and r + 1 < n_rounds:
            state = cut_lineage(state)
    return models


class QuantileBooster:
    """M1: pinball-loss boosting of Spark ML regression trees, one model."""

    def __init__(self, alpha: float, **parameters):
        self.alpha, self.parameters = alpha, parameters

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> QuantileBoosterModel:
        return fit_models(df, label, [ModelSpec("m", self.alpha, features)], **self.parameters)["m"]


def pinball_loss(df: DataFrame, label: str, pred: str, alpha: float) -> DataFrame:
    d = F.col(label) - F.col(pred)
    return df.agg(F.avg(F.greatest(F.lit(alpha) * d, F.lit(alpha - 1.0) * d)).alias("pinball"))


def together(calls: Sequence[Callable]) -> list:
    """Results of independent calls, run side by side: a fit is many small jobs, one
    after the other, that leave most of a cluster idle."""
    with ThreadPoolExecutor(max(1, len(calls))) as pool:
        return [f.result() for f in [pool.submit(call) for call in calls]]


QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def fit_quantile_triple(train: DataFrame, features: Sequence[str], label: str, **kw) -> dict[str, QuantileBoosterModel]:
    """M1 for alpha .1 / .5 / .9."""
    return fit_models(train, label, [ModelSpec(n, a, features) for n, a in QUANTILES.items()], **kw)


def predict_quantiles(models: dict[str, QuantileBoosterModel], df: DataFrame, sort_quantiles: bool = False) -> DataFrame:
    """M2: p10 / p50 / p90, point = p50, width = p90 - p10.  ``sort_quantiles``
    (off by default, an addition) enforces p10 <= p50 <= p90."""
    out = score_all(models, df)
    if sort_quantiles:
        arr = F.array_sort(F.array("p10", "p50", "p90"))
        out = out.select(*[c for c in out.columns if c not in ("p10", "p50", "p90")],
                         arr[0].alias("p10"), arr[1].alias("p50"), arr[2].alias("p90"))
    return out.select("*", (F.col("p90") - F.col("p10")).alias("width"))


def multi_horizon(per_horizon: dict[int, DataFrame], keys: Sequence[str]) -> DataFrame:
    """M3: one row per (row, target day); a missing quantile falls back to p50."""
    out = None
    for day, pred in per_horizon.items():
        p50 = F.col("p50")
        d = pred.select(*keys, F.lit(day).alias("target_day"),
                        F.coalesce(F.col("p10"), p50).alias("p10"), p50.alias("p50"),
                        F.coalesce(F.col("p90"), p50).alias("p90"))
        out = d if out is None else out.unionByName(d)
    return out


def fold_of(key: str, folds: int) -> Column:
    """M5: md5(key) mod ``folds``, the same on every engine."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % folds


def cross_validate_median(df: DataFrame, features: Sequence[str] | dict[str, Sequence[str]], label: str, key: str, folds: int = 5,
                          by: str | None = None, **kw) -> DataFrame:
    """M5: k folds by md5(key) mod k; fit the median model on k-1 folds; on the
    held-out fold RMSE over all rows and MAPE over those whose label isn't 0.

    With ``by``, each of its values has models and folds of its own, and ``features`` maps
    the value (as text) to its features; all models are boosted together."""
    groups = {"": list(features)} if by is None else {k: list(v) for k, v in features.items()}
    d = df.select("*", fold_of(key, folds).alias("_fold"), (F.lit("") if by is None else F.col(by).cast("string")).alias("_by"))
    specs = [ModelSpec(f"{g}|{k}", 0.5, own, (F.col("_by") == g) & (F.col("_fold") != k)) for g, own in groups.items() for k in range(folds)]
    models = fit_models(d, label, specs, **kw)
    # each row is scored by the models of its group, and judged by the one that didn't see it
    out = None
    for g in groups:
        own = {f"_p{k}": models[f"{g}|{k}"] for k in range(folds)}
        part = score_all(own, d.where(F.col("_by") == g)).withColumn("_pred", F.element_at(F.array(*own), (F.col("_fold") + 1).cast("int")))
        out = part if out is None else out.unionByName(part)
    err = F.col(label) - F.col("_pred")
    ape = F.when(F.col(label) != 0, F.abs(err) / F.abs(F.col(label)))
    keys = ["_fold"] if by is None else [by, "_fold"]
    return (out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ape).alias("mape"), F.sqrt(F.avg(err * err)).alias("rmse"))
            .withColumnRenamed("_fold", "fold"))


def importance_frame(spark, importances: dict[str, float], top: int | None = None) -> DataFrame:
    """Importance ranking as a small DataFrame (top ``n`` when given)."""
    df = spark.createDataFrame(sorted(importances.items()), "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


# ---- S17 / M9: persistence ---------------------------------------------------

_RECORD = ("model string, alpha double, f0 double, learning_rate double, features array<string>, roots array<int>, feature array<int>, "
           "threshold array<double>, `left` array<int>, `right` array<int>, step array<double>, gain array<double>, info string")


def save_models(models: dict[str, QuantileBoosterModel], path: str, spark: SparkSession, info: dict | None = None) -> None:
    """A bundle of models under ``path``, one record a model: parameters, features, the
    flat arrays of the forest, and ``info`` (metrics, training datasets ...)."""
    rows = [(name, m.alpha, m.f0, m.learning_rate, m.features, m.forest.roots, m.forest.feature, m.forest.threshold, m.forest.left,
             m.forest.right, m.forest.step, m.forest.gain, json.dumps(info or {}, sort_keys=True)) for name, m in models.items()]
    spark.createDataFrame(rows, _RECORD).coalesce(1).write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, QuantileBoosterModel], dict]:
    """The bundle that ``save_models`` wrote, and its ``info``."""
    models, info = {}, {}
    for r in spark.read.parquet(path).collect():               # one row a model
        models[r["model"]] = QuantileBoosterModel(r["alpha"], r["f0"], r["learning_rate"], list(r["features"]), Forest(
            *(list(r[c]) for c in ("roots", "feature", "threshold", "left", "right", "step", "gain"))))
        info = json.loads(r["info"])
    return models, info
