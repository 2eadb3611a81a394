"""Experiment grids (M16-M21) over the caller's own splits.

``run_grid`` takes settings (named train / val / test frames, the test rows from any
source), cells (one dict of axis values each) and a function that builds the algorithm of
a cell. Cells run from a small thread pool so Spark runs the jobs of several side by
side. Each cell writes its test predictions and then one result row under its own folder,
so a run that stops is taken up where it was: finished cells are skipped (S10), a cell
written again replaces itself (S11). The runners below are the experiments' grids with
their published parameters as defaults.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label
from ..operators import metrics as M
from ..operators import splits as S
from ..operators.detectors import KNNDetector
from ..operators.results import pivot_results
from ..session import materialize, scratch_path
from ..sources.tables import path_exists
from .base import KNeighbours, dot_plus, make_classifier
from .claims import Ledger
from .models import NonNegativePU, NonStop, ProbTagging, TwoStep
from .parallel import run_parallel
from .stacked import Cell, Settings, StackedNonNegativePU
from .tables import table

# Grid cells submitted at once; Spark schedules their jobs side by side.
PARALLEL_CELLS = 4

# rows of a mini-batch in the published experiments
BATCH_ROWS = 32

KEYS = "setting string, extractor string, reliable_positive_threshold double, classifier string, detector string"
METRICS = "balanced_accuracy double, accuracy double, f1 double, aul double"
RESULT_SCHEMA = f"{KEYS}, {METRICS}"
NAMES = [c.split()[0] for c in KEYS.split(", ")]


@dataclass(frozen=True)
class Setting:
    """Data of a cell: frames with id, features, ``y_pu`` and ``y_true``. ``splits`` gives
    train, validation and test; the test rows may come from another source."""

    name: str
    splits: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]
    extractor: str = ""
    threshold: float | None = None


def cross(**axes: Sequence) -> list[dict]:
    """Cells of the cartesian product of the axes."""
    return [dict(zip(axes, values)) for values in product(*axes.values())]


def lock_step(**axes: Sequence) -> list[dict]:
    """Cells that walk the axes together, to the end of the shortest."""
    return [dict(zip(axes, values)) for values in zip(*axes.values())]


def run_cells(cells: list, fn, parallel: int | None = None) -> list:
    """Run independent grid cells from a small thread pool; results keep cell order."""
    return run_parallel(cells, fn, parallel or PARALLEL_CELLS)


def cell_name(key: Sequence) -> str:
    """A folder name for the key values of a cell."""
    return hashlib.md5(repr(tuple(key)).encode()).hexdigest()


def finished_cells(spark: SparkSession, path: str) -> set[str]:
    """Cells whose result row is written (one small row per cell)."""
    if not path_exists(spark, f"{path}/results"):
        return set()
    return {r["cell"] for r in spark.read.parquet(f"{path}/results").select("cell").distinct().collect()}


def _cell_key(by_name: dict[str, Setting], cell: dict) -> tuple:
    s = by_name[cell["setting"]]
    return (s.name, s.extractor, s.threshold, cell.get("classifier", ""), cell.get("detector", ""))


def _finish(spark: SparkSession, algorithm, test: DataFrame, key: tuple, id_col: str, where: str, features: str = "features") -> None:
    """Write the predictions of a trained cell, then its result row; ``where`` is a pattern."""
    labelled = algorithm.predict(test, features, "y_pred").select(id_col, "y_true", "y_pu", F.col("y_pred").cast("int"))
    labelled.write.mode("overwrite").parquet(where.format("predictions"))
    scores = evaluate_predictions(spark.read.parquet(where.format("predictions")))
    row = spark.createDataFrame([key + tuple(scores[m.split()[0]] for m in METRICS.split(", "))], RESULT_SCHEMA)
    row.coalesce(1).write.mode("overwrite").parquet(where.format("results"))


def run_grid(
    spark: SparkSession,
    settings: Sequence[Setting],
    cells: Sequence[dict],
    build: Callable[[dict], object],
    path: str | None = None,
    id_col: str = "vec_id",
    features: str = "features",
    parallel: int | None = None,
    train_together: Callable[[list[dict], DataFrame, DataFrame | None], list] | None = None,
    together: Callable[[dict], object] = lambda cell: None,
) -> DataFrame:
    """Run every cell that has no result under ``path`` yet; the results of all its cells.

    A cell is a dict with ``setting`` (a name) and optionally ``classifier`` and
    ``detector`` labels; ``build(cell)`` returns an algorithm with ``fit(train, val)`` and
    ``predict``. With ``train_together`` the cells of a setting are trained in one program
    instead: it gets them with the train and validation rows and returns their models. Where
    ``together`` tells cells of a setting apart, each of its values is a program of its own.
    Predictions (id, ``y_true``, ``y_pu``, ``y_pred``) are under
    ``path/predictions`` by cell, see ``predictions``.
    """
    path = path or scratch_path(spark, "grid")
    by_name = {s.name: s for s in settings}
    done = finished_cells(spark, path)
    splits: dict[str, tuple] = {}

    def key(cell: dict) -> tuple:
        return _cell_key(by_name, cell)

    todo = [c for c in cells if cell_name(key(c)) not in done]
    for name in dict.fromkeys(c["setting"] for c in todo):
        splits[name] = tuple(materialize(f, "split") for f in by_name[name].splits())

    def run(group: list[dict]) -> None:
        train, val, test = splits[group[0]["setting"]]
        models = train_together(group, train, val) if train_together else [build(c).fit(train, val) for c in group]
        for cell, model in zip(group, models, strict=True):
            finish(cell, model, test)

    def finish(cell: dict, algorithm, test: DataFrame) -> None:
        _finish(spark, algorithm, test, key(cell), id_col, f"{path}/{{}}/cell={cell_name(key(cell))}", features)

    groups: dict = {}
    for i, c in enumerate(todo):
        groups.setdefault((c["setting"], together(c)) if train_together else i, []).append(c)
    run_cells(list(groups.values()), run, parallel)
    # what this grid asked for, of all that is there
    wanted = spark.createDataFrame([(cell_name(key(c)),) for c in cells], "cell string").distinct()
    stored = spark.read.schema(f"{RESULT_SCHEMA}, cell string").parquet(f"{path}/results")
    return stored.join(wanted, "cell", "left_semi").drop("cell")


def run_shared_grid(
    spark: SparkSession,
    settings: Sequence[Setting],
    cells: Sequence[dict],
    build: Callable[[dict], object],
    path: str,
    lease: float = 3600.0,
    id_col: str = "vec_id",
    owner: str | None = None,
    pause: float = 1.0,
) -> DataFrame:
    """``run_grid`` for several drivers on one ``path``: each cell is run by the driver that
    claims it, and every driver returns the results of all cells.

    A driver goes through the cells, claims what is free, and when nothing is, waits for the
    others to commit theirs or for their leases to run out (see ``plans.claims``). ``lease``
    is to be longer than a cell takes; if it is not, work may be done twice, but counts once.
    """
    ledger = Ledger(spark, f"{path}/ledger", lease, owner)
    by_name = {s.name: s for s in settings}
    splits: dict[str, tuple] = {}
    names = {cell_name(_cell_key(by_name, c)): c for c in cells}

    def run(cell: dict, where: str) -> None:
        if cell["setting"] not in splits:
            splits[cell["setting"]] = tuple(materialize(f, "split") for f in by_name[cell["setting"]].splits())
        train, val, test = splits[cell["setting"]]
        _finish(spark, build(cell).fit(train, val), test, _cell_key(by_name, cell), id_col, f"{path}/{{}}/{where}")

    while True:
        done = ledger.committed()
        left = [n for n in names if n not in done]
        if not left:
            break
        mine = 0
        for name in left:
            attempt = ledger.claim(name)
            if attempt is not None:
                mine += 1
                run(names[name], f"cell={name}/attempt={attempt}")
                ledger.commit(name, attempt)
        if not mine:
            time.sleep(pause)
    return _committed(spark, f"{path}/results", {n: done[n] for n in names}, f"{RESULT_SCHEMA}, cell string, attempt int").drop("cell", "attempt")


def _committed(spark: SparkSession, path: str, cells: dict[str, int], schema: str) -> DataFrame:
    """The files of the committed attempts alone."""
    folders = [f"{path}/cell={n}/attempt={a}" for n, a in sorted(cells.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def shared_predictions(spark: SparkSession, path: str, id_col: str = "vec_id", id_type: str = "long") -> DataFrame:
    """Test predictions of all committed cells of a shared grid with the key columns of their cell."""
    done = Ledger(spark, f"{path}/ledger", 0.0).committed()
    keys = _committed(spark, f"{path}/results", done, f"{RESULT_SCHEMA}, cell string, attempt int").select("cell", *NAMES)
    schema = f"{id_col} {id_type}, y_true int, y_pu int, y_pred int, cell string, attempt int"
    return _committed(spark, f"{path}/predictions", done, schema).join(keys, "cell").drop("cell", "attempt")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Test predictions of all finished cells with the key columns of their cell."""
    keys = spark.read.schema(f"{RESULT_SCHEMA}, cell string").parquet(f"{path}/results").select("cell", *NAMES)
    return spark.read.parquet(f"{path}/predictions").join(keys, "cell").drop("cell")


def feature_splits(spark: SparkSession, sf_dir: str, threshold: int, seed: int = S.DEFAULT_SEED, positive_below: int = 5):
    """Train / val / test of the benchmark's feature table for a known-positive threshold."""
    e = table(spark, sf_dir, "embeddings")
    pu = e.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        label(F.col("label") < threshold).alias("y_pu"),
        label(F.col("label") < positive_below).alias("y_true"),
    )
    sp = S.stratified_split(pu, "vec_id", "y_true", 0.25, seed)
    test = sp.where("split = 'val'").drop("split")
    rest = sp.where("split = 'train'").drop("split")
    tv = S.stratified_split(rest, "vec_id", "y_pu", 0.2, seed)
    return tv.where("split = 'train'").drop("split"), tv.where("split = 'val'").drop("split"), test


def threshold_settings(spark: SparkSession, sf_dir: str, thresholds: Sequence[int], seed: int = S.DEFAULT_SEED) -> list[Setting]:
    """The benchmark's feature table under several known-positive thresholds."""
    return [
        Setting(f"embeddings-{t}", lambda t=t: feature_splits(spark, sf_dir, t, seed), "embeddings", float(t)) for t in thresholds
    ]


def evaluate_predictions(pred: DataFrame) -> dict:
    """balanced accuracy, accuracy, F1 against the truth; AUL of hard predictions
    against the known-positive flag (B8)."""
    m = M.classification_metrics(pred, "y_true", "y_pred").collect()[0]
    a = M.aul_binary(pred, "y_pu", "y_pred").collect()[0]["aul"]
    return {
        "balanced_accuracy": float(m["balanced_accuracy"]),
        "accuracy": float(m["accuracy"]),
        "f1": float(m["f1"]),
        "aul": None if a is None else float(a),
    }


class Supervised:
    """A base classifier on the true labels of train and validation rows."""

    def __init__(self, classifier, y: str = "y_true"):
        self.classifier, self.y = classifier, y

    def fit(self, train: DataFrame, val: DataFrame | None = None):
        return self.classifier.fit(train if val is None else train.unionByName(val), self.y)


# the seven classifiers of the published baselines
BASELINES = ["logistic", "kneighbours-5", "kneighbours-9", "kneighbours-19", "naivebayes", "rf", "svm"]


def pn_baselines(
    spark: SparkSession, settings: Sequence[Setting], classifiers: Sequence[str] = BASELINES, path: str | None = None
) -> DataFrame:
    """PN baselines (M16): every classifier trained on the true label, per setting. The kNN
    classifiers of a setting ask for their neighbours once, for the largest k."""
    cells = cross(setting=[s.name for s in settings], classifier=classifiers)
    by_name = {name: make_classifier(name) for name in classifiers}

    def train_together(group: list[dict], train: DataFrame, val: DataFrame | None) -> list:
        found = [by_name[c["classifier"]] for c in group]
        if isinstance(found[0], KNeighbours):
            rows = train if val is None else train.unionByName(val)
            return found[0].fit_many(rows, "y_true", [f.k for f in found])
        return [Supervised(f).fit(train, val) for f in found]

    def together(cell: dict) -> object:
        return KNeighbours if isinstance(by_name[cell["classifier"]], KNeighbours) else cell["classifier"]

    out = run_grid(spark, settings, cells, lambda c: None, path, train_together=train_together, together=together)
    return out.select("setting", "classifier", "balanced_accuracy", "accuracy", "f1")


def experiment_grid(
    spark: SparkSession,
    settings: Sequence[Setting],
    classifiers: Sequence[str],
    detectors: dict[str, Callable[[], object]],
    frac_to_move: float = 0.01,
    max_iterations: int = 20,
    path: str | None = None,
) -> DataFrame:
    """Setting x classifier x detector grid of two-step runs."""

    def build(c: dict) -> TwoStep:
        return TwoStep(detectors[c["detector"]](), NonStop("aul"), make_classifier(c["classifier"]), frac_to_move, max_iterations)

    cells = cross(setting=[s.name for s in settings], classifier=classifiers, detector=list(detectors))
    return run_grid(spark, settings, cells, build, path)


def make_algorithm(name: str, rounds: int = 20, epochs: int = 200, members: int = 50):
    """The three algorithms compared in the article setting (M18), with its parameters."""
    if name == "tsa":
        return TwoStep(KNNDetector(frac=0.1, k=1), NonStop("aul"), make_classifier("logistic"), 0.01, rounds)
    if name == "nnpu":
        return NonNegativePU([1], 0.7, epochs=epochs, reduce_lr_on_plateau=True, batch_rows=BATCH_ROWS)
    if name == "pt":
        return ProbTagging(18, lambda: make_classifier("logistic"), members, positive_prior=0.7)
    raise ValueError(name)


def algorithm_comparison(
    spark: SparkSession, settings: Sequence[Setting], algorithms: Sequence[str], path: str | None = None, **work
) -> DataFrame:
    """Algorithms over settings whose axes walk in lock-step (M18); ``work`` goes to ``make_algorithm``."""
    cells = cross(setting=[s.name for s in settings], classifier=algorithms)
    for c in cells:
        c["detector"] = "knn-1" if c["classifier"] == "tsa" else ""
    return run_grid(spark, settings, cells, lambda c: make_algorithm(c["classifier"], **work), path)


def k_selection(
    spark: SparkSession,
    settings: Sequence[Setting],
    ks: Sequence[int] = (9, 13, 15, 17, 21),
    max_iterations: int = 20,
    frac_to_move: float = 0.01,
    path: str | None = None,
) -> DataFrame:
    """k of the kNN detector over settings (one per seed), scored by AUL on the validation
    rows and pivoted detector x setting (M19, A15)."""
    on_val = [Setting(s.name, lambda s=s: _test_on_val(*s.splits()), s.extractor, s.threshold) for s in settings]

    def build(c: dict) -> TwoStep:
        k = int(c["detector"].split("-")[1])
        return TwoStep(KNNDetector(0.1, k), NonStop("aul"), make_classifier("logistic"), frac_to_move, max_iterations)

    cells = cross(setting=[s.name for s in settings], detector=[f"knn-{k}" for k in ks])
    long = run_grid(spark, on_val, cells, build, path)
    return pivot_results(long.select("detector", "setting", "aul"), "detector", "setting", "aul", values=[s.name for s in settings])


def _test_on_val(train: DataFrame, val: DataFrame, test: DataFrame):
    return train, val, val.withColumn("y_true", F.col("y_pu"))


def prior_threshold_grid(
    spark: SparkSession, settings: Sequence[Setting], priors: Sequence[float], epochs: int = 200, path: str | None = None
) -> DataFrame:
    """nnPU over prior x setting (M20): the priors of a setting are one stack of weights."""
    cells = cross(setting=[s.name for s in settings], classifier=[str(p) for p in priors])

    def train_together(group: list[dict], train: DataFrame, val: DataFrame | None) -> list:
        stack = [Cell(float(c["classifier"])) for c in group]
        return StackedNonNegativePU(stack, [1], epochs, settings=Settings(BATCH_ROWS)).fit(train, val).models

    out = run_grid(spark, settings, cells, lambda c: None, path, train_together=train_together)
    return out.select(
        F.col("reliable_positive_threshold").alias("quantile"), F.col("classifier").cast("double").alias("prior"),
        "balanced_accuracy", "accuracy", "f1",
    )


def pca_projection(df: DataFrame, id_col: str, features: str = "features", k: int = 2) -> DataFrame:
    """Centered PCA projection (M21), each component's largest loading made positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    v = df.select(id_col, F.col(features).cast("array<double>").alias("_x"))
    dim = len(v.select("_x").first()["_x"])
    mean = np.array(v.select(F.array(*[F.avg(F.col("_x")[i]) for i in range(dim)])).first()[0])
    centered = v.withColumn("_c", F.zip_with("_x", F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b))
    model = PCA(k=k, inputCol="_vec", outputCol="_pc").fit(centered.select(array_to_vector("_c").alias("_vec")))
    pcs = model.pc.toArray()
    cols = []
    for j in range(k):
        comp = pcs[:, j]
        if comp[np.argmax(np.abs(comp))] < 0:
            comp = -comp
        cols.append(dot_plus("_c", comp, 0.0).alias(f"pc{j + 1}"))
    return centered.select(id_col, *cols)
