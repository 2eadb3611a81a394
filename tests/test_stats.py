"""Friedman / Holm against the published comparison numbers.

The inputs are the published per-method result tables, stated below as fixed values;
the expected statistics are the published report figures.
"""

import pandas as pd
import pytest

from sparkpul.operators import stats as ST

# Published results, one row per method, one column per setting.
SETTINGS = ["ava_ava", "ava_aadb", "aadb_ava", "aadb_aadb"]
METHODS = ["logistic", "kneighbours-5", "kneighbours-9", "kneighbours-19", "naivebayes", "rf", "svm"]
PUBLISHED = {
    "balanced_accuracy": [
        [0.604423330348314, 0.541773099530667, 0.5843651298281516, 0.6209406402836564],
        [0.5735626718041735, 0.5466659262641345, 0.5239567833101437, 0.5838855502219151],
        [0.5768403320677344, 0.5485642360896874, 0.5218290495245741, 0.5443089782033721],
        [0.5730060105159752, 0.5328018888491265, 0.5178918615664095, 0.545008247261539],
        [0.5302009855737865, 0.5161448885488522, 0.5701217206658059, 0.5085763293310464],
        [0.6009772293708425, 0.5947859208345159, 0.50643225334136, 0.5718025922315321],
        [0.6143602978449396, 0.5515649230187034, 0.5994451717937714, 0.630691330297683],
    ],
    "aul": [
        [0.5302745663540922, 0.5174193825042882, 0.5244592631975487, 0.5504322469982847],
        [0.5213273985927391, 0.5194596912521441, 0.5069455860441753, 0.5349802744425386],
        [0.522277662703301, 0.5202512864493997, 0.5063287103186052, 0.5184768439108062],
        [0.521166010528883, 0.5136783876500858, 0.505187234963525, 0.5187684391080617],
        [0.5087559143982745, 0.5067324185248714, 0.5203297929502815, 0.5035763293310463],
        [0.5292754676626661, 0.5395257289879931, 0.5018648484006378, 0.5299416809605488],
        [0.5331555066653386, 0.5215025728987993, 0.52883129126434, 0.5544982847341338],
    ],
    "accuracy": [
        [0.4635884783332354, 0.488, 0.7352797195950577, 0.603],
        [0.5651961072274766, 0.557, 0.7114100530654605, 0.6],
        [0.5722062307857996, 0.562, 0.7096085687990757, 0.565],
        [0.5725782764495095, 0.548, 0.7112534022596879, 0.569],
        [0.3366425816052791, 0.441, 0.4002036460475043, 0.427],
        [0.5257788482249506, 0.594, 0.7122324697957665, 0.609],
        [0.4808788110203842, 0.503, 0.7313830308014647, 0.608],
    ],
    "f1": [
        [0.41615515771526, 0.3315926892950391, 0.8350355700357531, 0.6010050251256281],
        [0.6439166760211036, 0.6157849089332177, 0.8268073704992008, 0.6649916247906199],
        [0.6525770080943976, 0.6262798634812287, 0.8257139499353626, 0.6419753086419752],
        [0.6552312357846853, 0.6169491525423729, 0.8279025255590308, 0.6510121457489878],
        [0.1295511189907243, 0.1169036334913112, 0.2817885530727567, 0.0337268128161888],
        [0.5582591565737633, 0.6288848263254113, 0.8309833237492813, 0.7035633055344958],
        [0.4479980011243676, 0.3779724655819775, 0.8284563825530212, 0.5950413223140497],
    ],
}

# Published AUL of the kNN detector per k (rows) over seeds 0-9 (columns).
K_DETECTORS = ["knn-13", "knn-15", "knn-17", "knn-21", "knn-9"]
K_PUBLISHED = [
    [0.6994879583594571, 0.7026409485123255, 0.7012672525739077, 0.7003760255241568, 0.7026726004924734,
     0.7021349697600993, 0.7034634470660306, 0.7036479344111678, 0.7018306578205399, 0.7010515661787623],
    [0.7006468737630093, 0.7042805210839856, 0.7019572657411314, 0.6998944624957693, 0.7030709625121969,
     0.7016543125919913, 0.7030836233042561, 0.7041236199736656, 0.7020386550292363, 0.7016669733840504],
    [0.701026244594644, 0.7031347194026325, 0.7004189795059446, 0.7006862149296059, 0.7037605227492809,
     0.7014517399190449, 0.7026404955821858, 0.7031482860549711, 0.7024067238592313, 0.7008245777819772],
    [0.6996905310324035, 0.7015589037214078, 0.7012093731493619, 0.7016294439380127, 0.7018939617808356,
     0.7019816814649702, 0.703558855936614, 0.7033133292818798, 0.7035968383127915, 0.701418276218338],
    [0.6988160305200426, 0.7014824860389132, 0.7016534067317117, 0.7014901752253621, 0.7044265731228057,
     0.7033820577779256, 0.7049782234376583, 0.703976662074566, 0.702070759939524, 0.7011465221192059],
]


def _long(spark, methods, datasets, values):
    rows = [(m, str(d), float(v)) for m, row in zip(methods, values) for d, v in zip(datasets, row)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["method", "dataset", "score"]))


@pytest.mark.parametrize(
    "metric,chi2,p",
    [("balanced_accuracy", 14.142857, 0.028080), ("aul", 14.142857, 0.028080),
     ("accuracy", 10.821429, 0.094055), ("f1", 13.607143, 0.034346)],
)
def test_friedman_published_reports(spark, metric, chi2, p):
    df = _long(spark, METHODS, SETTINGS, PUBLISHED[metric])
    r = ST.friedman(df, "method", "dataset", "score").first()
    assert r["chi2"] == pytest.approx(chi2, abs=1e-6)
    assert r["pvalue"] == pytest.approx(p, abs=1e-6)
    assert r["dof"] == 6


def test_k_selection_report_friedman_and_control(spark):
    df = _long(spark, K_DETECTORS, range(10), K_PUBLISHED)
    r = ST.friedman(df, "method", "dataset", "score").first()
    assert r["chi2"] == pytest.approx(3.68, abs=1e-9)
    assert r["pvalue"] == pytest.approx(0.451041490143654, abs=1e-9)
    ctl = {x["method"]: x for x in ST.control_posthoc(df, "method", "dataset", "score").collect()}
    assert {x["control"] for x in ctl.values()} == {"knn-9"}
    assert ctl["knn-15"]["mean_rank"] == pytest.approx(2.6)
    assert ctl["knn-13"]["p_holm"] == pytest.approx(0.6292, abs=1e-4)
    assert ctl["knn-21"]["p_holm"] == pytest.approx(1.0)
    assert (ctl["knn-13"]["win"], ctl["knn-13"]["tie"], ctl["knn-13"]["loss"]) == (8, 0, 2)
    assert (ctl["knn-15"]["win"], ctl["knn-15"]["tie"], ctl["knn-15"]["loss"]) == (5, 0, 5)


def test_chi2_tail_values():
    assert ST.chi2_sf(3.68, 4) == pytest.approx(0.451041490143654, abs=1e-12)
    assert ST.chi2_sf(3.84145882, 1) == pytest.approx(0.05, abs=1e-7)
    assert ST.chi2_sf(7.81472790, 3) == pytest.approx(0.05, abs=1e-7)


def test_holm_step_down():
    assert ST.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def test_incomplete_blocks_are_refused(spark):
    rows = [("a", "x", 1.0), ("b", "x", 2.0), ("a", "y", 3.0)]
    for bad in (rows, rows + [("b", "y", None)], rows + [("b", "y", 1.0), ("b", "y", 2.0)]):
        df = spark.createDataFrame(bad, "method string, dataset string, score double")
        for test in (ST.friedman, ST.control_posthoc, ST.pairwise_posthoc):
            with pytest.raises(ValueError, match="incomplete blocks"):
                test(df, "method", "dataset", "score")


def test_tails_as_expressions(spark):
    from pyspark.sql import functions as F

    cases = [(x, d) for x in (0.0, 0.3, 3.68, 14.2, 40.0) for d in (1, 2, 3, 4, 7, 10)]
    df = spark.createDataFrame(cases, "x double, d long")
    for r in df.select("x", "d", ST.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect():
        assert r["p"] == pytest.approx(ST.chi2_sf(r["x"], r["d"]), abs=1e-12)
    zs = spark.createDataFrame([(z,) for z in (-9.0, -2.5, 0.0, 0.01, 1.96, 4.0)], "z double")
    for r in zs.select("z", ST.normal_tail(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(ST.normal_two_sided(r["z"]), abs=1e-12)


def test_shaffer_counts_and_order(spark):
    assert ST.shaffer_counts(4) == [0, 1, 2, 3, 6]
    assert ST.shaffer_counts(5) == [0, 1, 2, 3, 4, 6, 10]
    df = _long(spark, METHODS, SETTINGS, PUBLISHED["balanced_accuracy"])
    rows = ST.pairwise_posthoc(df, "method", "dataset", "score").orderBy("pvalue", "method_a", "method_b").collect()
    assert len(rows) == 21
    assert ST.holm([r["pvalue"] for r in rows]) == pytest.approx([r["p_holm"] for r in rows])
    run = 0.0
    for j, r in enumerate(rows, 1):
        run = max(run, min(1.0, max(t for t in ST.shaffer_counts(7) if t <= 21 - j + 1) * r["pvalue"]))
        assert r["p_shaffer"] == pytest.approx(run) and r["p_shaffer"] <= r["p_holm"] + 1e-12


def partitions(items):
    """All partitions of a list into groups."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def plain_most_true(k, false_pairs):
    best = 0
    for groups in partitions(list(range(k))):
        true = {(a, b) for g in groups for a in g for b in g if a < b}
        if not true & false_pairs:
            best = max(best, len(true))
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 6, 7])
def test_exhaustive_sets_against_all_partitions(k):
    """The search equals brute force while pairs are rejected one by one, in random orders."""
    import random

    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    for seed in range(3):
        random.Random(seed).shuffle(pairs)
        for n in range(0, len(pairs) + 1, 1 if k < 7 else 4):
            assert ST.most_true_pairs(k, set(pairs[:n])) == plain_most_true(k, set(pairs[:n]))
        # the counts of the static procedure hold them all
        assert ST.most_true_pairs(k, set()) == k * (k - 1) // 2


def test_shaffer_dynamic_on_published_ranks(spark):
    df = _long(spark, METHODS, SETTINGS, PUBLISHED["balanced_accuracy"])
    rows = ST.pairwise_posthoc(df, "method", "dataset", "score", adjust="shaffer-dynamic").orderBy("pvalue", "method_a", "method_b").collect()
    names = sorted({r["method_a"] for r in rows} | {r["method_b"] for r in rows})
    run, rejected = 0.0, set()
    for r in rows:
        run = max(run, min(1.0, max(1, plain_most_true(7, rejected)) * r["pvalue"]))
        assert r["p_shaffer_dynamic"] == pytest.approx(run)
        # at least as sharp as the static procedure, which is as sharp as Holm's
        assert r["pvalue"] <= r["p_shaffer_dynamic"] <= r["p_shaffer"] + 1e-12 <= r["p_holm"] + 2e-12
        rejected.add((names.index(r["method_a"]), names.index(r["method_b"])))
    with pytest.raises(ValueError, match="unknown adjustment"):
        ST.pairwise_posthoc(df, "method", "dataset", "score", adjust="other")


def test_shaffer_dynamic_ties(spark):
    """Equal ranks give equal p-values; the order of names decides and nothing breaks."""
    rows = [(m, f"d{i}", 1.0) for m in "abcd" for i in range(3)]
    df = spark.createDataFrame(rows, "method string, dataset string, score double")
    got = ST.pairwise_posthoc(df, "method", "dataset", "score", adjust="shaffer-dynamic").collect()
    assert len(got) == 6 and {r["p_shaffer_dynamic"] for r in got} == {1.0}
