import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.errors import MetricError
from cohortloom.operators import confusion as cf
from cohortloom.operators import metrics as mx
from cohortloom.operators import scores as sc
from cohortloom.operators.labels import index_tiles, label_cooccurrence, pair_counts

CELLS = "hadm_id long, icd_code string, prob double, y int"


def table(spark, y, p, names=None):
    names = names or [f"L{j}" for j in range(y.shape[1])]
    data = [(i, names[j], float(p[i, j]), int(y[i, j])) for i in range(len(y)) for j in range(y.shape[1])]
    return spark.createDataFrame(data, CELLS)


def wide(scored):
    cells = F.collect_list(F.struct("icd_code", "prob", "y"))
    return scored.groupBy("hadm_id").agg(cells.alias("cells"))


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random((60, 3)), 2)
    p[:20, 0] = 0.25  # a third of one label's scores are equal
    y = (p + rng.normal(0, 0.3, p.shape) > 0.6).astype(int)
    return y, p, table(spark, y, p).cache()


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    won = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    return won / (len(pos) * len(neg))


def ap(y, p):
    total, last, out = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / total
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


def f1(y, pred):
    tp = (y * pred).sum()
    return 2 * tp / (y.sum() + pred.sum()) if y.sum() + pred.sum() else 0.0


def test_ranking_metrics_brute_force(sample):
    y, p, scored = sample
    got = mx.ranking_metrics(scored).first()
    assert got.micro_auc == pytest.approx(auc(y.ravel(), p.ravel()))
    assert got.macro_auc == pytest.approx(np.mean([auc(y[:, j], p[:, j]) for j in range(3)]))
    assert got.micro_auprc == pytest.approx(ap(y.ravel(), p.ravel()))
    assert got.macro_auprc == pytest.approx(np.mean([ap(y[:, j], p[:, j]) for j in range(3)]))


def test_one_class_label_makes_all_null(spark):
    y = np.array([[1, 0], [0, 0]])
    got = mx.ranking_metrics(table(spark, y, np.array([[0.9, 0.1], [0.2, 0.3]]))).first()
    assert list(got) == [None] * 4


@pytest.mark.parametrize("metric", ["f1", "youden"])
def test_thresholds_brute_force(sample, metric):
    y, p, scored = sample
    got = {r.icd_code: r.threshold for r in mx.tune_thresholds(scored, metric, min_support=1).collect()}
    for j in range(3):
        best, at = -9.0, None
        for t in sorted(set(p[:, j])):
            pred = (p[:, j] >= t).astype(int)
            tp = (y[:, j] * pred).sum()
            precision, recall = tp / pred.sum(), tp / y[:, j].sum()
            value = f1(y[:, j], pred) if metric == "f1" else recall - (1 - precision)
            if value > best + 1e-12:
                best, at = value, t
        assert got[f"L{j}"] == at


def test_thresholds_default_and_unknown_metric(sample):
    scored = sample[2]
    rows = mx.tune_thresholds(scored, min_support=10_000).collect()
    assert {r.threshold for r in rows} == {0.5} and not any(r.tuned for r in rows)
    with pytest.raises(MetricError):
        mx.tune_thresholds(scored, "accuracy")


def test_f1_and_report(spark, sample):
    y, p, scored = sample
    cut = np.array([0.5, 0.6, 2.0])  # nothing reaches the last one
    thresholds = spark.createDataFrame([(f"L{j}", float(cut[j])) for j in range(3)], "icd_code string, threshold double")
    pred = (p >= cut).astype(int)
    per = {r.icd_code: r for r in mx.per_label_metrics(scored, thresholds).collect()}
    for j in range(3):
        assert per[f"L{j}"].f1 == pytest.approx(f1(y[:, j], pred[:, j]))
        assert per[f"L{j}"].support == y[:, j].sum()
    assert per["L2"].precision == 0.0
    assert mx.micro_f1(scored, thresholds).first()[0] == pytest.approx(f1(y, pred))
    assert mx.macro_f1(scored, thresholds).first()[0] == pytest.approx(np.mean([f1(y[:, j], pred[:, j]) for j in range(3)]))
    rows = {r.metric: r.value for r in mx.evaluate_multilabel(wide(scored), thresholds, 3, (1, 2)).collect()}
    assert set(rows) == {"micro_f1", "macro_f1", "micro_auc", "macro_auc", "micro_auprc", "macro_auprc", "p_at_1", "p_at_2"}
    with pytest.raises(MetricError):
        mx.evaluate_multilabel(wide(scored), thresholds.limit(2), 3, (1,))


def test_precision_at_k(spark):
    y = np.array([[1, 1, 0, 0], [0, 0, 1, 1]])
    p = np.array([[0.9, 0.8, 0.1, 0.2], [0.1, 0.2, 0.9, 0.8]])
    got = {r.k: r.precision_at_k for r in mx.precision_at_k(wide(table(spark, y, p)), (2, 4), 4).collect()}
    assert got == {2: 1.0, 4: 0.5}
    with pytest.raises(MetricError):
        mx.precision_at_k(wide(table(spark, y, p)), (5,), 2)


def test_calibration(sample):
    y, p, scored = sample
    got = {r.bin: r for r in mx.reliability_curve(scored).collect()}
    edges = np.linspace(0, 1, 11)
    for i in range(10):
        mask = (p >= edges[i]) & ((p < edges[i + 1]) if i < 9 else (p <= edges[i + 1]))
        if mask.any():
            assert got[i].n == mask.sum()
            assert got[i].observed_rate == pytest.approx(y[mask].mean())
        else:
            assert i not in got
    brier = {r.icd_code: r.brier for r in mx.brier_per_label(scored).collect()}
    assert brier["L1"] == pytest.approx(((p[:, 1] - y[:, 1]) ** 2).mean())


def test_confusion_brute_force(sample):
    y, p, scored = sample
    names = ["L0", "L1", "L2"]
    counts = cf.substitution_counts(wide(scored), dict.fromkeys(names, 0.5), names)
    got = {(r.true_code, r.wrong_code): r["count"] for r in counts.collect()}
    pred = p >= 0.5
    for a in range(3):
        for b in range(3):
            if a != b:
                want = int(((y[:, a] == 1) & (y[:, b] == 0) & pred[:, b]).sum())
                assert got[names[a], names[b]] == want
    support = scored.groupBy("icd_code").agg(F.sum("y").alias("support"))
    pairs = cf.confusion_pairs(counts, support, top_n=3).collect()
    assert len(pairs) == 3 and all(r.true_code != r.wrong_code for r in pairs)


def test_aligned_scores_fill_zeros(spark):
    pred = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.4), (2, "A", 0.3)], "hadm_id long, icd_code string, prob double")
    truth = spark.createDataFrame([(1, "A"), (1, "A"), (9, "B")], "hadm_id long, icd_code string")
    got = {(r.hadm_id, r.icd_code): r.y for r in sc.join_pred_truth(pred, truth).collect()}
    assert got == {(1, "A"): 1, (1, "B"): 0, (2, "A"): 0}


def test_cells_of_a_label_without_threshold_fail(spark, sample):
    _, _, scored = sample
    two = spark.createDataFrame([("L0", 0.5), ("L1", 0.5)], "icd_code string, threshold double")
    with pytest.raises(Exception, match="no threshold for label L2"):
        sc.threshold_predict(scored, two).collect()


def test_metrics_of_one_side_and_gates_without_metric_stay(spark):
    rows = "metric string, value double"
    val = spark.createDataFrame([("micro_f1", 0.6), ("only_val", 0.1), ("macro_f1", None)], rows)
    test = spark.createDataFrame([("micro_f1", 0.5), ("only_test", 0.2)], rows)
    got = {r.metric: (r.val, r.test, r.drift) for r in mx.split_drift(val, test).collect()}
    assert got["only_val"] == (0.1, None, None) and got["only_test"] == (None, 0.2, None)
    assert got["micro_f1"][2] == pytest.approx(0.1) and set(got) == {"micro_f1", "macro_f1", "only_val", "only_test"}
    gates = {r.metric: (r.value, r.meets_target, r.meets_floor) for r in mx.metric_gates(val).collect()}
    assert gates == {
        "micro_f1": (0.6, False, True), "macro_f1": (None, False, False),
        "p_at_5": (None, False, True), "p_at_8": (None, False, True),
    }


def test_undefined_metrics_are_null_rows(spark):
    y, p = np.zeros((6, 2), int), np.linspace(0, 1, 12).reshape(6, 2)
    cuts = spark.createDataFrame([("L0", 0.5), ("L1", 0.5)], "icd_code string, threshold double")
    got = {r.metric: r.value for r in mx.evaluate_multilabel(wide(table(spark, y, p)), cuts, 2, (1,)).collect()}
    assert got["micro_auc"] is None and got["macro_auc"] is None and got["micro_f1"] == 0.0 and got["p_at_1"] == 0.0


def test_pairs_of_many_labels(spark):
    rng = np.random.default_rng(5)
    names = [f"c{i:03d}" for i in range(300)]
    # the last labels never occur, one row is empty and one holds a hot label twice
    sets = [sorted(rng.choice(290, 6, replace=False).tolist()) for _ in range(200)] + [[], [7, 7, 289]]
    other = [sorted(rng.choice(300, 4, replace=False).tolist()) for _ in sets[:-1]] + [None]
    rows = spark.createDataFrame(list(zip(sets, other)), "x array<int>, y array<int>")
    tiled = rows.select(index_tiles(F.col("x"), 300).alias("x"), index_tiles(F.col("y"), 300).alias("y"))
    got = pair_counts(tiled, F.col("x"), F.col("y"), names)
    want = {(a, b): 0 for a in {i for s in sets for i in s} for b in range(300)}
    for s, o in zip(sets, other):
        for a in set(s):
            for b in set(o or []):
                want[a, b] += 1
    assert {(int(r.a[1:]), int(r.b[1:])): r.n for r in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_cooccurrence_aggregates_are_plain(rows):
    found = [(h, f"A{(h * j) % 40:02d}", 10) for h in range(1, 60) for j in range(1, 5)] + [(None, "A01", 10)]
    codes = rows(found, "hadm_id long, icd_code string, icd_version int")
    got = {(r.code_a, r.code_b): r.n for r in label_cooccurrence(codes, 40).collect()}
    held = {h: {c for g, c, _ in found if g == h} for h in range(1, 60)}
    names = sorted({c for s in held.values() for c in s})
    assert got == {(a, b): sum(a in s and b in s for s in held.values()) for a in names for b in names}
    assert "ObjectHashAggregate" not in label_cooccurrence(codes, 40)._jdf.queryExecution().toString()


def test_a_product_holds_what_a_cache_does():
    import tracemalloc

    import numpy as np

    from cohortloom.operators import model as md

    rng = np.random.default_rng(0)
    n, per, width, labels = 400, 1000, 5000, 25
    terms = rng.integers(0, width, n * per)
    block = md._Block(np.arange(n + 1) * per, terms, rng.random(n * per))
    matrix = rng.random((width, labels))
    tracemalloc.start()
    got = block.product(matrix)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dense = np.zeros((n, width))
    np.add.at(dense, (np.repeat(np.arange(n), per), terms), block.values)
    assert np.allclose(got, dense @ matrix)
    assert peak < 32e6
