"""Goal models: preprocessing, grouped folds, five model families, nested cross-validation, contributions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.scratch import written
from . import metrics
from .quantiles import column_quantiles, ranked
from .shots import FREEZE_FEATURES, feature_columns

MODELS = ("constant_rate", "logreg_distance", "logreg_all", "gbt", "mlp")
#: Inverse strengths of the penalty that selection tries.
STRENGTHS = (0.01, 0.1, 1.0, 10.0)


class Scaler:
    """Median for missing values with an indicator, then mean 0 and population deviation 1; fitted by one aggregation."""

    def __init__(self, columns: tuple[str, ...]) -> None:
        self.columns = columns

    def fit(self, rows: DataFrame) -> Scaler:
        missing = rows.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in self.columns]).first()
        self.missing = [c for c in self.columns if missing[c]]
        # Medians only matter where values are missing; exact ones, by refined histograms of those columns together.
        found = column_quantiles(rows, tuple(self.missing), (0.5,)).first() if self.missing else None
        self.medians = {c: float(found[c][0]) if found and c in self.missing and found[c] else 0.0 for c in self.columns}
        filled = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c) for c in self.columns])
        stats = filled.agg(*[f(c).alias(f"{c}_{n}") for c in self.columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.means = {c: float(stats[f"{c}_m"] or 0.0) for c in self.columns}
        self.scales = {c: float(stats[f"{c}_s"] or 0.0) or 1.0 for c in self.columns}
        return self

    @property
    def outputs(self) -> list[str]:
        return [f"z_{c}" for c in self.columns] + [f"na_{c}" for c in self.missing]

    def transform(self, rows: DataFrame) -> DataFrame:
        z = {f"z_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) - self.means[c]) / self.scales[c] for c in self.columns}
        return rows.withColumns(z | {f"na_{c}": F.col(c).isNull().cast("double") for c in self.missing})


class GoalModel:
    """A fitted scaler and classifier; transform adds p, the goal probability."""

    def __init__(self, name: str, scaler: Scaler | None, model: Model | None, rate: float, params: dict) -> None:
        self.name, self.scaler, self.model, self.rate, self.params = name, scaler, model, rate, params

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("p", F.lit(self.rate))
        scored = self.model.transform(self.scaler.transform(rows))
        return scored.select(*rows.columns, vector_to_array("probability")[1].alias("p"))


#: What selection tries for each family: inverse strengths of the penalty; depth, least rows of a leaf and rounds; hidden layers and iterations.
GRIDS: dict[str, list[dict]] = {
    "logreg_all": [{"strength": c} for c in STRENGTHS],
    "gbt": [{"depth": d, "leaf": n, "rounds": r} for d in (2, 3, 4) for n in (20, 60) for r in (10, 20)],
    "mlp": [{"hidden": h, "iterations": i} for h in ([16], [32, 16]) for i in (20, 40, 80)],
}
#: Used without selection.
DEFAULTS: dict[str, dict] = {"logreg_distance": {"strength": 1.0}, "logreg_all": {"strength": 1.0}, "gbt": {"depth": 3, "leaf": 20, "rounds": 20}, "mlp": {"hidden": [16], "iterations": 40}}
#: Fits that selection has under way at a time.
AT_ONCE = 4
#: Vectors of a task: an optimizer's rounds are jobs, and small tables in many tasks would be all overhead. Larger tables keep their tasks.
PART_ROWS = 50_000


def _classifier(name: str, params: dict, n_rows: int, n_features: int, seed: int):
    if name.startswith("logreg"):
        return LogisticRegression(featuresCol="features", labelCol="y", regParam=1.0 / (params["strength"] * max(1, n_rows)), elasticNetParam=0.0, standardization=False, maxIter=50)
    if name == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="y", maxIter=params["rounds"], maxDepth=params["depth"], minInstancesPerNode=params["leaf"], stepSize=0.1, seed=seed)
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[n_features, *params["hidden"], 2], maxIter=params["iterations"], seed=seed)


class Prepared:
    """What all models of a family share on some rows: scaler and encoders that learnt from them alone, and the rows as vectors, kept until ``release``."""

    def __init__(self, rows: DataFrame, name: str, freeze: bool = False) -> None:
        self.name = name
        self.n, self.rate = rows.agg(F.count(F.lit(1)), F.avg(F.col("is_goal").cast("double"))).first()
        self.scaler, self.stages = _encoded(rows, name, freeze)
        self.rows = self.vectors(rows).coalesce(1 + self.n // PART_ROWS).persist()
        self.width = self.rows.schema["features"].metadata["ml_attr"]["num_attrs"]

    def vectors(self, rows: DataFrame) -> DataFrame:
        return PipelineModel(stages=self.stages).transform(self.scaler.transform(rows)).select(F.col("is_goal").cast("double").alias("y"), "features")

    def fitted(self, params: dict, seed: int = 42) -> GoalModel:
        model = _classifier(self.name, params, self.n, self.width, seed).fit(self.rows)
        return GoalModel(self.name, self.scaler, PipelineModel(stages=[*self.stages, model]), float(self.rate or 0.0), params)

    def release(self) -> None:
        self.rows.unpersist()


def _encoded(rows: DataFrame, name: str, freeze: bool) -> tuple[Scaler, list]:
    numeric, categories = (("distance",), ()) if name == "logreg_distance" else feature_columns(freeze)
    scaler = Scaler(numeric).fit(rows)
    scaled = scaler.transform(rows)
    # Categories that are unseen later are zero in all columns.
    encoders = [StringIndexer(inputCols=list(categories), outputCols=[f"i_{c}" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"i_{c}" for c in categories], outputCols=[f"o_{c}" for c in categories], dropLast=True)] if categories else []
    prepared = Pipeline(stages=[*encoders, VectorAssembler(inputCols=scaler.outputs + [f"o_{c}" for c in categories], outputCol="features")]).fit(scaled)
    return scaler, prepared.stages


def fit_with(rows: DataFrame, name: str, params: dict, freeze: bool = False, seed: int = 42) -> GoalModel:
    """Fit a model family with given parameters: scaler, encoders and classifier all learn from these rows alone."""
    if name == "constant_rate":
        return GoalModel(name, None, None, float(rows.agg(F.avg(F.col("is_goal").cast("double"))).first()[0] or 0.0), {})
    prepared = Prepared(rows, name, freeze)
    try:
        return prepared.fitted(params, seed)
    finally:
        prepared.release()


def _fitted_together(name: str, grid: list[dict]) -> dict[int, list[int]]:
    """Places of the grid to fit, each with all places that its fit tells of."""
    if name != "gbt":
        return {at: [at] for at in range(len(grid))}
    alike: dict[tuple, list[int]] = {}
    for at, params in enumerate(grid):
        alike.setdefault(tuple(sorted((k, v) for k, v in params.items() if k != "rounds")), []).append(at)
    return {max(places, key=lambda at: grid[at]["rounds"]): places for places in alike.values()}


#: Passes over the rows that selection's logistic models take at most, and the gain of a step, of the mean loss, from which on they go on.
PASSES, LEAST_GAIN = 50, 1e-13
#: Probabilities are scored as 1e-15 at least, which bounds the logit.
MOST_LOGIT = float(np.log((1 - 1e-15) / 1e-15))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of numbers for each fold of a batch of (fold, y, features): rows of y, the features and 1. Folds differ in their number of features."""
    for batch in batches:
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        for f in np.unique(fold):
            part = batch.filter(pa.array(fold == f))
            x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            block = np.column_stack([part.column(1).to_numpy(zero_copy_only=False), x, np.ones(len(x))])
            yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([block.tobytes()], pa.binary())], ["fold", "block"])


def _packs(parts: list[DataFrame]) -> DataFrame:
    """(fold, block), kept; parts are the folds' vectors, in order."""
    named = [part.select(F.lit(fold).cast("long").alias("fold"), "y", vector_to_array("features").alias("x")) for fold, part in enumerate(parts)]
    return reduce(DataFrame.unionByName, named).mapInArrow(_packed, "fold long, block binary").persist()


def _summed(packs: DataFrame, points: dict[int, np.ndarray], learning: bool) -> dict[int, np.ndarray]:
    """For each fold that has rows and each of its points (weights, the intercept last): number of rows and log loss, and in learning its gradient and second derivatives. One pass for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if fold not in points:
                    continue
                at = points[fold]
                rows = np.frombuffer(block.as_buffer()).reshape(-1, at.shape[1] + 1)
                y, x = rows[:, :1], rows[:, 1:]
                logit = x @ at.T if learning else np.clip(x @ at.T, -MOST_LOGIT, MOST_LOGIT)
                sums = [np.full((len(at), 1), float(len(x))), (np.logaddexp(0.0, logit) - y * logit).sum(axis=0)[:, None]]
                if learning:
                    p = np.exp(-np.logaddexp(0.0, -logit))
                    sums += [(p - y).T @ x, np.stack([((x * v[:, None]).T @ x).ravel() for v in (p * (1 - p)).T])]
                total[fold] = total.get(fold, 0.0) + np.concatenate(sums, axis=1)
        for fold, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, fold)), pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["fold", "place", "value"])

    found = packs.mapInArrow(run, "fold long, place long, value double").groupBy("fold", "place").agg(F.sum("value").alias("value")).collect()  # some hundred numbers a model
    by_fold: dict[int, list[tuple[int, float]]] = {}
    for fold, place, value in found:
        by_fold.setdefault(fold, []).append((place, value))
    return {fold: np.array([v for _, v in sorted(values)]).reshape(len(points[fold]), -1) for fold, values in by_fold.items()}


def _logistic_points(packs: DataFrame, folds: list[Prepared], strengths: list[float]) -> dict[int, np.ndarray]:
    """Weights and intercept of each fold's model of each strength, by Newton's method for all of them side by side.

    The objective is the classifier's: mean log loss and penalty / 2 times the squared weights, with a penalty of 1 / (strength n). A step that doesn't
    gain is halved. Where all rows have one class, the intercept is infinite; a fold without rows has no models.
    """
    size = {f: p.width + 1 for f, p in enumerate(folds) if p.n}
    best = {f: np.zeros((len(strengths), d)) for f, d in size.items()}
    active: dict[tuple[int, int], np.ndarray] = {}  # a model's step to try
    least: dict[tuple[int, int], float] = {}
    for f in size:
        rate = float(folds[f].rate)
        best[f][:, -1] = np.log(rate / (1 - rate)) if 0 < rate < 1 else np.inf if rate else -np.inf
        if 0 < rate < 1:
            active |= {(f, k): np.zeros(size[f]) for k in range(len(strengths))}
    for _ in range(PASSES):
        if not active:
            break
        trial = {f: np.stack([best[f][k] + active.get((f, k), 0.0) for k in range(len(strengths))]) for f in {f for f, _ in active}}
        sums = _summed(packs, trial, True)
        for (f, k), step in list(active.items()):
            n, d, at = folds[f].n, size[f], trial[f][k]
            penalty = np.append(np.full(d - 1, 1.0 / (strengths[k] * n)), 0.0)
            loss = sums[f][k][1] / n + float(penalty @ (at * at)) / 2
            if not loss <= least.get((f, k), np.inf) + LEAST_GAIN:
                active[f, k] = step / 2
                continue
            best[f][k], least[f, k] = at, loss
            gradient = sums[f][k][2 : 2 + d] / n + penalty * at
            step = -np.linalg.lstsq(sums[f][k][2 + d :].reshape(d, d) / n + np.diag(penalty), gradient, rcond=None)[0]
            if -(gradient @ step) / 2 < LEAST_GAIN:
                del active[f, k]
            else:
                active[f, k] = step
    return best


def _logistic_losses(folds: list[tuple[Prepared, DataFrame]], grid: list[dict]) -> list[dict[int, float | None]]:
    """For each fold its mean log loss under each place of the grid; a fold without rows has none.

    All strengths and folds learn side by side, a pass over the rows for a step of all of them: an optimizer's rounds for each would be a job each.
    """
    learnt, held = _packs([p.rows for p, _ in folds]), _packs([h for _, h in folds])
    try:
        points = _logistic_points(learnt, [p for p, _ in folds], [params["strength"] for params in grid])
        scores = _summed(held, points, False)
    finally:
        learnt.unpersist()
        held.unpersist()
    return [{k: float(s[k][1] / s[k][0]) for k in range(len(grid))} for s in scores.values()]


def select(rows: DataFrame, name: str, grid: list[dict], inner: int = 3, freeze: bool = False, seed: int = 42) -> dict:
    """The parameters of the least mean log loss over grouped folds; each fold is scored by models that saw nothing of it.

    A fold's scaler, encoders and vectors are made once for the whole grid. Of boosted trees that differ in their rounds only the longest are fitted: the
    shorter ones are their first trees, and all are scored in one pass. Logistic models all learn side by side (``_logistic_losses``).
    """
    folded = rows.join(grouped_folds(rows, inner), "match_id").persist()

    def prepare(fold: int) -> tuple[Prepared, DataFrame]:
        prepared = Prepared(folded.where(F.col("fold") != fold), name, freeze)
        held = prepared.vectors(folded.where(F.col("fold") == fold)).coalesce(1 + prepared.n // PART_ROWS)
        if name.startswith("logreg"):  # these are packed at once, and the packs are kept
            prepared.release()
            return prepared, held
        return prepared, held.persist()

    def loss(job: tuple[int, int]) -> dict[int, float | None]:
        at, fold = job
        prepared, held = folds[fold]
        model = prepared.fitted(grid[at], seed).model.stages[-1]
        if len(alike[at]) > 1:
            # Twice the log loss after each round; a fold without rows has none.
            by_round = model.evaluateEachIteration(held) if held.head(1) else None
            return {k: by_round and by_round[grid[k]["rounds"] - 1] / 2 for k in alike[at]}
        scored = model.transform(held).select("y", vector_to_array("probability")[1].alias("p"))
        return {at: metrics.score_all(scored).first()["log_loss"]}

    alike = _fitted_together(name, grid)
    jobs = [(at, fold) for at in alike for fold in range(inner)]
    folds: list[tuple[Prepared, DataFrame]] = []
    on_session = inheritable_thread_target(rows.sparkSession)
    try:
        folded.count()
        with ThreadPool(AT_ONCE) as pool:
            folds = pool.map(on_session(prepare), range(inner))
            losses = _logistic_losses(folds, grid) if name.startswith("logreg") else pool.map(on_session(loss), jobs)
    finally:
        folded.unpersist()
        for prepared, held in folds:
            prepared.release()
            held.unpersist()
    by_grid = [[x[k] for x in losses if x.get(k) is not None] for k in range(len(grid))]
    means = [sum(x) / len(x) if x else float("inf") for x in by_grid]
    return grid[means.index(min(means))]


def fit(rows: DataFrame, name: str, params: dict | None = None, inner: int = 5, freeze: bool = False, seed: int = 42) -> GoalModel:
    """Fit a model family on rows with is_goal; without ``params``, they are selected by ``inner`` grouped folds."""
    if params is None:
        params = select(rows, name, GRIDS[name], inner, freeze, seed) if name in GRIDS else DEFAULTS.get(name, {})
    return fit_with(rows, name, params, freeze, seed)


def save(model: GoalModel, path: str) -> None:
    """The classifier, and beside it a JSON line with what the scaler learnt."""
    spark = SparkSession.active()
    model.model.write().overwrite().save(f"{path}/model")
    meta = {"name": model.name, "rate": model.rate, "params": model.params, "columns": model.scaler.columns, "medians": model.scaler.medians, "missing": model.scaler.missing, "means": model.scaler.means, "scales": model.scaler.scales}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark, path: str) -> GoalModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    scaler = Scaler(tuple(meta["columns"]))
    scaler.medians, scaler.missing, scaler.means, scaler.scales = meta["medians"], meta["missing"], meta["means"], meta["scales"]
    return GoalModel(meta["name"], scaler, PipelineModel.load(f"{path}/model"), meta["rate"], meta["params"])


# What a shot has if nothing is said of it.
SHOT_DEFAULTS = {"body_part": "Foot", "shot_type": "Open Play", "play_pattern": "Regular Play", "first_time": 0, "follows_through_ball": 0, "follows_cross": 0, "under_pressure": 0, "minute": 45.0, "score_diff": 0}


def predict_xg(shots: DataFrame, model: GoalModel) -> DataFrame:
    """``shots`` with p. Only x and y are needed: distance and angle come from them, whatever the rows say, and columns that are missing get their defaults."""
    kept = [c for c in shots.columns if c != "p"]
    placed = shots.withColumns({c: F.lit(v) for c, v in SHOT_DEFAULTS.items() if c not in shots.columns})
    placed = placed.withColumns({c: F.lit(None).cast("double") for c in FREEZE_FEATURES if c not in shots.columns})
    placed = placed.withColumns({"distance": g.shot_distance(F.col("x"), F.col("y")), "angle": g.shot_angle(F.col("x"), F.col("y"))})
    return model.transform(placed).select(*kept, "p")


def grouped_folds(rows: DataFrame, k: int, key: str = "match_id") -> DataFrame:
    """(key, fold): each group to the lightest fold so far, the largest groups first, of equal ones the least key.

    The driver takes how many groups there are of each size, and deals all groups of a size at once; which group of a size is the
    how-manieth is counted where the groups are.
    """
    sizes = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    loads, dealt = [0] * k, []
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups")).orderBy(F.desc("n")).collect():  # a row for each size
        parts, loads = dealt_by_size(loads, r["n"], r["groups"])
        dealt.append((r["n"], parts))
    spark = rows.sparkSession
    table = spark.createDataFrame(dealt, "size long, parts array<struct<start:long,folds:array<int>>>")
    part = F.element_at(F.filter("parts", lambda p: p["start"] <= F.col("rank")), -1)
    fold = F.get(part["folds"], ((F.col("rank") - part["start"]) % F.size(part["folds"])).cast("int"))
    return ranked(sizes, ("n",), (key,)).join(table, F.col("n") == F.col("size")).select(key, fold.alias("fold"))


def dealt_by_size(loads: list[int], n: int, groups: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How ``groups`` groups of n rows go to the folds with the given loads, each to the lightest, of equal ones the first.

    Returns (start, folds) parts, where from the start-th group on the folds take turns, and the loads afterwards. A fold takes its j-th
    group when no load is under its own of then, load + j * n; so turns are taken by the loads' remainders, among the folds whose
    quotient has been reached, and a part begins where a further quotient is.
    """
    quotient, rest = zip(*(divmod(x, n) for x in loads))
    order = sorted(range(len(loads)), key=lambda f: (rest[f], f))
    parts, taken, start = [], [0] * len(loads), 0
    levels = sorted(set(quotient))
    for level, following in zip(levels, [*levels[1:], None]):
        turn = [f for f in order if quotient[f] <= level]
        take = groups - start if following is None else min(groups - start, (following - level) * len(turn))
        parts.append((start, turn))
        for place, f in enumerate(turn):
            taken[f] += take // len(turn) + (place < take % len(turn))
        start += take
        if start == groups:
            break
    return parts, [x + t * n for x, t in zip(loads, taken)]


def competition_folds(rows: DataFrame) -> DataFrame:
    """(match_id, fold): a fold for each competition's season, in order; the driver never sees them. A match of two competitions is an error."""
    seasons = rows.select("competition_id", "season_id").distinct()
    numbered = seasons.withColumn("fold", F.row_number().over(Window.orderBy("competition_id", "season_id")) - 1)  # one row a tournament
    matches = rows.select("match_id", "competition_id", "season_id").distinct()
    if matches.groupBy("match_id").count().where("count > 1").head(1):
        raise ValueError("a match belongs to two competitions")
    same = F.col("m.competition_id").eqNullSafe(F.col("s.competition_id")) & F.col("m.season_id").eqNullSafe(F.col("s.season_id"))
    return matches.alias("m").join(F.broadcast(numbered.alias("s")), same).select("m.match_id", "s.fold")


def nested_cv(rows: DataFrame, name: str, k: int = 5, scheme: str = "match", params: dict | None = None, inner: int = 3, freeze: bool = False) -> DataFrame:
    """Out-of-fold predictions (match_id, idx, fold, y, p, params): each fold is predicted by a model of the others.

    Parameters are selected inside each fold's training rows, by folds of their matches, unless they are given. The scheme is ``match`` (k folds) or
    ``competition`` (each tournament in turn).
    """
    folds = grouped_folds(rows, k) if scheme == "match" else competition_folds(rows)
    folded = rows.join(folds, "match_id").persist()
    parts: list[DataFrame] = []
    for fold in sorted(r["fold"] for r in folded.select("fold").distinct().collect()):  # k rows, or a row a tournament
        model = fit(folded.where(F.col("fold") != fold).drop("fold"), name, params, inner, freeze)
        scored = model.transform(folded.where(F.col("fold") == fold))
        parts.append(scored.select("match_id", "idx", "fold", F.col("is_goal").alias("y"), "p", F.lit(json.dumps(model.params)).alias("params")))
    try:
        return written(reduce(DataFrame.unionByName, parts), "out-of-fold")
    finally:
        folded.unpersist()


def fold_scores(oof: DataFrame) -> DataFrame:
    return metrics.score_all(oof, ("fold",)).join(metrics.auc(oof, ("fold",)), "fold")


def linear_contributions(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(feature, importance): mean of |w (x - mean)|, what each feature moves a linear model's logit on average."""
    means = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in weights])
    moved = rows.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.col(f"m_{c}")))).alias(c) for c, w in weights.items()])
    return moved.unpivot([], list(weights), "feature", "importance")


def shuffled(rows: DataFrame, column: str, seed: int, keys: tuple[str, ...] = ("match_id", "idx")) -> DataFrame:
    """``rows`` with the values of ``column`` dealt anew over the whole table.

    Rows and values are each numbered in a random order and joined by number. The orders are hashes of the keys, so that a repeated task
    gives the same; numbers run within a bucket of the hash, behind those of the buckets before it.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8

    def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
        hashed = df.withColumn("__h", F.xxhash64(*keys, F.lit(f"{order}{seed}"))).withColumn("__b", F.pmod("__h", F.lit(buckets)))
        sizes = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = F.broadcast(sizes.select(F.col("__b").alias("__o"), before.alias("__before")))  # a row for each bucket
        within = F.row_number().over(Window.partitionBy("__b").orderBy("__h", *keys))
        return hashed.withColumn("__i", within).join(offsets, F.col("__b") == F.col("__o")).withColumn(name, F.col("__before") + F.col("__i")).drop("__h", "__b", "__o", "__before", "__i")

    places = numbered(rows.drop(column), "place", "__place")
    values = numbered(rows.select(*keys, column), "value", "__value").drop(*keys)
    return places.join(values, F.col("__place") == F.col("__value")).select(*rows.columns)


def permutation_importance(model: GoalModel, rows: DataFrame, columns: tuple[str, ...], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, increase): how much the log loss grows when a column's values are dealt anew, the mean of ``repeats`` deals."""
    loss = lambda df: metrics.score_all(model.transform(df).withColumn("y", F.col("is_goal"))).first()["log_loss"]
    base, out = loss(rows), []
    for i, c in enumerate(columns):
        losses = [loss(shuffled(rows, c, seed + i * repeats + k)) for k in range(repeats)]
        out.append((c, float(sum(losses) / repeats - base)))
    return rows.sparkSession.createDataFrame(out, "feature string, increase double")


def linear_weights(model: GoalModel) -> dict[str, float]:
    """The numeric features' weights of a fitted logistic model, on the features' own scales."""
    weights = model.model.stages[-1].coefficients
    return {c: float(weights[i]) / model.scaler.scales[c] for i, c in enumerate(model.scaler.columns)}
