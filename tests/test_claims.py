"""Several drivers on one grid: every cell once, leases, late finishers, the manifest."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkpul.plans import grid as G
from sparkpul.plans.claims import Ledger
from sparkpul.session import scratch_path


class Constant:
    """A stand-in for an algorithm: predicts one label, and tells that it ran."""

    def __init__(self, label, told, name, work=lambda: None):
        self.label, self.told, self.name, self.work = label, told, name, work

    def fit(self, train, val=None):
        self.told.append(self.name)
        self.work()
        return self

    def predict(self, df, features="features", out="prediction"):
        return df.withColumn(out, F.lit(self.label))


def settings(spark):
    rows = [(i, [float(i)], i % 2, i % 3 == 0) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, y_true int, p boolean")
    df = df.select("vec_id", "features", "y_true", F.col("p").cast("int").alias("y_pu"))
    return [G.Setting("s", lambda: (df, df, df))]


CELLS = G.cross(setting=["s"], classifier=[f"c{i}" for i in range(8)])


def test_one_of_many_gets_each_attempt(spark):
    path = scratch_path(spark, "ledger")
    won = []

    def race(owner):
        ledger = Ledger(spark, path, 60, owner)
        for cell in "abcdef":
            if ledger.claim(cell) == 1:
                won.append((cell, owner))

    threads = [threading.Thread(target=race, args=(str(i),)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(c for c, _ in won) == list("abcdef")


def test_leases_and_late_finishers(spark):
    path = scratch_path(spark, "ledger")
    a, b = Ledger(spark, path, 0.2, "a"), Ledger(spark, path, 60, "b")
    assert a.claim("x") == 1 and b.claim("x") is None and a.claim("x") is None
    time.sleep(0.3)
    assert b.claim("x") == 2 and a.claim("x") is None
    assert a.committed() == {}
    assert b.commit("x", 2) and not a.commit("x", 1)  # a comes late
    assert a.committed() == b.committed() == {"x": 2}
    # the first to commit counts, even if its lease is over
    assert a.claim("y") == 1
    time.sleep(0.3)
    assert b.claim("y") == 2 and a.commit("y", 1) and not b.commit("y", 2)
    assert b.committed() == {"x": 2, "y": 1}


def test_two_sessions_run_every_cell_once(spark):
    path, told = scratch_path(spark, "grid"), []

    def fill(session, out):
        build = lambda c: Constant(int(c["classifier"][1:]) % 2, told, c["classifier"], lambda: time.sleep(0.05))
        out.append(G.run_shared_grid(session, settings(session), CELLS, build, path, 600, pause=0.1).collect())

    outs = [[], []]
    threads = [threading.Thread(target=fill, args=(s, o)) for s, o in zip((spark, spark.newSession()), outs)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(told) == [f"c{i}" for i in range(8)]
    assert sorted(outs[0][0]) == sorted(outs[1][0]) and len(outs[0][0]) == 8
    # a later driver finds all done
    again = G.run_shared_grid(spark, settings(spark), CELLS, lambda c: pytest.fail("run again"), path)
    assert sorted(again.collect()) == sorted(outs[0][0])
    preds = G.shared_predictions(spark, path)
    assert preds.count() == 8 * 12 and preds.where("classifier = 'c3'").select("y_pred").distinct().count() == 1


def test_a_killed_driver_loses_its_claimed_cell_only(spark):
    path, told = scratch_path(spark, "grid"), []

    def dies(c):
        def work():
            if c["classifier"] == "c3":
                raise KeyboardInterrupt

        return Constant(0, told, c["classifier"], work)

    with pytest.raises(KeyboardInterrupt):
        G.run_shared_grid(spark, settings(spark), CELLS, dies, path, lease=2.0)
    assert told == ["c0", "c1", "c2", "c3"]
    # half-written files of the dead attempt are never read
    half = f"{path}/results/cell={G.cell_name(('s', '', None, 'c3', ''))}/attempt=1"
    spark.createDataFrame([("s", "", None, "c3", "", 9.0, 9.0, 9.0, 9.0)], G.RESULT_SCHEMA).write.parquet(half)
    rerun = []
    build = lambda c: Constant(0, rerun, c["classifier"])
    out = G.run_shared_grid(spark, settings(spark), CELLS, build, path, lease=600, pause=0.1).collect()
    assert sorted(rerun) == ["c3", "c4", "c5", "c6", "c7"]
    assert sorted(r["classifier"] for r in out) == [f"c{i}" for i in range(8)] and all(r["accuracy"] <= 1 for r in out)


def test_empty_grid(spark):
    assert G.run_shared_grid(spark, settings(spark), [], lambda c: None, scratch_path(spark, "grid")).collect() == []
