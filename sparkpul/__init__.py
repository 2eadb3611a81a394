"""sparkpul: positive-unlabeled learning as Spark DataFrame plans.

Sub-packages:

* ``functions``  Column helpers (labels, paths, list parsing, distances).
* ``sources``    CSV / feature-store / result readers and writers.
* ``operators``  splits, ranking, kNN, metrics, detectors, result tables, statistics.
* ``plans``      PU algorithms (two-step, ProbTagging, nnPU), base classifiers, grids.
"""

__version__ = "0.1.0"
