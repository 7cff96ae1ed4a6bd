"""Raw gzipped files to test metrics, reports and streams."""

import csv
import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import data
from cohortloom import schemas
from cohortloom.errors import SourceError, StageError
from cohortloom.operators import features as fx
from cohortloom.operators import model as md
from cohortloom.params import CohortParams, EvalParams, FeatureParams, ModelParams, RawPaths, RunParams, SplitParams
from cohortloom.plans import error_analysis as ea
from cohortloom.plans import profiling as pp
from cohortloom.plans import stages as ps
from cohortloom.session import cut_lineage, discard
from cohortloom.sources import raw
from cohortloom.sources import stages as st
from cohortloom.sources.stages import StagePaths

PARAMS = RunParams(
    cohort=CohortParams(10, 50, 5, ("DS",)),
    split=SplitParams(0.7, 0.15, 0.15, 42),
    features=FeatureParams((1, 1), 1, 5000),
    model=ModelParams(class_weight=None, max_iter=60),
    evaluation=EvalParams(k_list=(1, 3, 5)),
)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    paths = {}
    for name, rows in zip(("notes", "diagnoses", "admissions", "patients"), data.make(80)):
        path = root / f"{name}.csv.gz"
        with gzip.open(path, "wt", encoding="utf-8", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(data.HEADERS[name])
            writer.writerows(rows)
        paths[name] = str(path)
    return RawPaths(**paths)


@pytest.fixture(scope="module")
def run(spark, files, tmp_path_factory):
    stages = StagePaths(str(tmp_path_factory.mktemp("stages")))
    metrics = {r.metric: r.value for r in ps.run_all(spark, files, PARAMS, stages).collect()}
    return stages, metrics


def test_reader_keeps_multiline_text(spark, files):
    notes = raw.read_notes(spark, files.notes)
    want = data.make(80)[0]
    assert notes.columns == [f.name for f in schemas.NOTES]
    got = {r.note_id: r.text for r in notes.collect()}
    assert got == {n[0]: n[-1] for n in want}


def test_reader_keeps_demographics(spark, files):
    df = raw.read_admissions(spark, files.admissions)
    assert {"race", "insurance", "language", "discharge_location"} <= set(df.columns)
    assert df.first().race == "WHITE" and len(df.columns) == 11


def test_reader_errors(spark, tmp_path):
    with pytest.raises(SourceError):
        raw.read_notes(spark, str(tmp_path / "absent.csv.gz"))
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(SourceError, match="no column"):
        raw.read_patients(spark, str(bad))
    assert raw.read_code_dictionary(spark, None) is None


def test_stage_order_is_enforced(spark, tmp_path):
    with pytest.raises(StageError, match="bronze"):
        ps.run_silver(spark, PARAMS, StagePaths(str(tmp_path)))


def test_run_learns(run):
    _, metrics = run
    assert metrics["micro_f1"] > 0.5
    assert 0 <= metrics["p_at_1"] <= 1 and metrics["macro_auc"] > 0.7


def test_run_is_repeatable(spark, run):
    stages, _ = run
    before = st.load_splits(spark, stages).collect()
    ps.run_silver(spark, PARAMS, stages)
    ps.run_gold(spark, PARAMS, stages)
    ps.run_splits(spark, PARAMS, stages)
    assert sorted(before) == sorted(st.load_splits(spark, stages).collect())


def test_reports(spark, run):
    stages, _ = run
    names = ea.run_error_analysis(spark, stages)
    assert {"per_label", "confusion_pairs", "reliability", "macro_brier"} <= set(names)
    assert st.read_stage(spark, stages.report("per_label"), "x").count() == 5
    eda = pp.run_eda(spark, stages)
    assert "join_coverage" in eda and "top_codes" not in eda
    venn = {r.slice: r["count"] for r in st.read_stage(spark, stages.report("eda_join_coverage"), "x").collect()}
    assert venn["all_three"] == venn["total_notes"]
    los = st.read_stage(spark, stages.report("eda_length_of_stay"), "x").first()
    assert los.mean == pytest.approx(4.0)


def dense(features, size):
    rows = {r.hadm_id: np.zeros(size) for r in features}
    for r in features:
        for f in r.features:
            rows[r.hadm_id][f.term_idx] = f.weight
    return rows


@pytest.mark.parametrize("pass_bytes", [256 << 20, 5 * 8 * 7, 1])
def test_scores_in_passes_equal_the_product(spark, run, monkeypatch, pass_bytes):
    stages, _ = run
    model, idf = md.load_model(spark, stages)
    terms = st.read_stage(spark, stages.gold("terms"), "train").drop("split").limit(12)
    idf = idf.filter("term_idx < 20")
    model = model.withColumn("coefficients", F.slice("coefficients", 1, 20))
    empty = spark.createDataFrame([(0, [])], terms.schema)
    features = fx.tfidf(terms.unionByName(empty), idf)
    monkeypatch.setattr(md, "PASS_BYTES", pass_bytes)
    got = {r.hadm_id: {s.icd_code: s.prob for s in r.scores} for r in md.predict_proba(features, model, 20).collect()}
    rows = dense(features.collect(), 20)
    assert set(got) == set(rows) and 0 in got
    for r in model.collect():
        for key, x in rows.items():
            want = 1 / (1 + np.exp(-(x @ np.array(r.coefficients) + r.intercept)))
            assert got[key][r.icd_code] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("class_weight", [None, "balanced"])
def test_joint_fit_agrees_with_single_fits(spark, monkeypatch, class_weight):
    from pyspark.ml.classification import LogisticRegression

    draw = np.random.default_rng(3)
    n, size, width = 200, 30, 4
    x = draw.random((n, size)) * (draw.random((n, size)) < 0.2)
    x[5] = 0
    true = draw.normal(size=(size, width)) * 3
    y = (x @ true + draw.normal(size=(n, width)) > 0.8).astype(int)
    features = spark.createDataFrame(
        [(i, [(j, float(v)) for j, v in enumerate(row) if v]) for i, row in enumerate(x)],
        "hadm_id long, features array<struct<term_idx:int,weight:double>>",
    ).repartition(3)
    vectors = spark.createDataFrame([(i, row) for i, row in enumerate(y.tolist())], "hadm_id long, y array<int>")
    labels = spark.createDataFrame([(k, f"L{k}") for k in range(width)], "label_idx int, icd_code string")
    params = ModelParams(c=2.0, class_weight=class_weight, tol=1e-7)
    scans = []
    at = md._Losses.at
    monkeypatch.setattr(md._Losses, "at", lambda self, chosen, points: scans.append(len(chosen)) or at(self, chosen, points))
    monkeypatch.setattr(md, "BLOCK_CELLS", 500)
    monkeypatch.setattr(md, "PRODUCT_CELLS", 700)
    monkeypatch.setattr(md, "RANGE_CELLS", 64)
    model = md.fit_ovr_logistic(features, vectors, labels, size, params).orderBy("label_idx").collect()
    assert scans[0] == width and len(scans) < 150  # all labels in each scan
    vec = fx.assemble_sparse_vectors(features.join(vectors, "hadm_id"), size)
    for k, got in enumerate(model):
        pos = int(y[:, k].sum())
        weight = F.when(F.col("y")[k] == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
        rows = vec.select("features", F.col("y")[k].cast("double").alias("label"), (weight if class_weight else F.lit(1.0)).alias("w"))
        single = LogisticRegression(
            maxIter=500, tol=1e-12, regParam=1.0 / (2.0 * n), standardization=False, weightCol="w"
        ).fit(rows)
        assert got.icd_code == f"L{k}"
        assert np.allclose(got.coefficients, single.coefficients.toArray(), atol=2e-4)
        assert got.intercept == pytest.approx(single.intercept, abs=2e-4)
    if class_weight:
        return
    monkeypatch.setattr(md, "STATE_BYTES", 1)  # one label after the other
    again = md.fit_ovr_logistic(features, vectors, labels, size, params).orderBy("label_idx").collect()
    assert all(np.allclose(a.coefficients, b.coefficients, atol=1e-4) for a, b in zip(model, again))


def test_dictionary_finds_all_terms(spark, monkeypatch):
    import random

    monkeypatch.setattr(fx, "BLOCK_TERMS", 7)
    monkeypatch.setattr(fx, "DECODED_BLOCKS", 3)
    draw = random.Random(2)
    terms = sorted({"".join(draw.choice("ab é\U0001d400z") for _ in range(draw.randrange(1, 9))) for _ in range(400)})
    idf = spark.createDataFrame([(i, t, i / 7) for i, t in enumerate(terms)], "term_idx int, term string, idf double")
    known = fx.term_dictionary(idf.repartition(4))
    asked = sorted({*terms, "", "zzzzzzzzzzz", *(t + "b" for t in terms)})
    numbers, weights = known.search(asked)
    place = {t: i for i, t in enumerate(terms)}
    assert numbers.tolist() == [place.get(t, -1) for t in asked]
    assert weights.tolist() == [place[t] / 7 if t in place else 0.0 for t in asked]
    nothing = fx.term_dictionary(idf.limit(0)).search(["a"])
    assert nothing[0].tolist() == [-1]


def test_tfidf_brute_force(spark):
    docs = [(1, "apple apple pear"), (2, "pear plum"), (3, "plum plum plum fig"), (4, "")]
    df = spark.createDataFrame(docs, "hadm_id long, text string")
    terms = fx.document_terms(df, 1, 1)
    vocab = fx.vocabulary(terms, 1, 3)
    assert [r.term for r in vocab.orderBy("term_idx").collect()] == ["apple", "pear", "plum"]
    got = {r.hadm_id: {f.term_idx: f.weight for f in r.features} for r in fx.tfidf(terms, fx.inverse_frequency(vocab, 4)).collect()}
    names, n = ["apple", "pear", "plum"], 4
    for key, text in docs:
        words = text.split()
        raw_w = {}
        for i, t in enumerate(names):
            tf, df_ = words.count(t), sum(t in d.split() for _, d in docs)
            if tf:
                raw_w[i] = (1 + np.log(tf)) * (np.log((1 + n) / (1 + df_)) + 1)
        norm = np.sqrt(sum(w * w for w in raw_w.values()))
        assert got[key] == pytest.approx({i: w / norm for i, w in raw_w.items()})


def test_constant_labels(spark):
    features = spark.createDataFrame([(i, [(0, 1.0)]) for i in range(6)], "hadm_id long, features array<struct<term_idx:int,weight:double>>")
    vectors = spark.createDataFrame([(i, [0, 1, i % 2]) for i in range(6)], "hadm_id long, y array<int>")
    labels = spark.createDataFrame([(0, "N"), (1, "A"), (2, "M")], "label_idx int, icd_code string")
    model = md.fit_ovr_logistic(features, vectors, labels, 1, ModelParams(max_iter=5))
    got = {r.icd_code: r.prob for r in md.predict_proba(features.limit(1), model, 1).select(F.inline("scores")).collect()}
    assert got["N"] == 0.0 and got["A"] == 1.0 and 0.4 < got["M"] < 0.6


@pytest.mark.parametrize("bad", [
    lambda: CohortParams(code_version=8), lambda: CohortParams(top_k=0), lambda: SplitParams(train=1.0),
    lambda: FeatureParams(ngram_range=(2, 1)), lambda: ModelParams(c=0), lambda: ModelParams(class_weight="x"),
    lambda: ModelParams(tol=0), lambda: ModelParams(max_iter=0),
])
def test_parameter_ranges(bad):
    with pytest.raises(ValueError):
        bad()


def test_training_refuses_foreign_labels(spark, run):
    from cohortloom.operators import labels as lb

    stages, _ = run
    cohort, cells, _ = st.load_gold(spark, stages)
    lb.check_alignment(cohort, cells, dense=False)
    with pytest.raises(StageError, match="rebuild"):
        lb.check_alignment(cohort.filter("hadm_id > 1010"), cells, dense=False)


def test_k_above_the_label_count_is_an_error(spark, run):
    from dataclasses import replace

    from cohortloom.errors import MetricError

    stages, _ = run
    with pytest.raises(MetricError, match="outside"):
        ps.run_evaluate_test(spark, replace(PARAMS, evaluation=EvalParams(k_list=(1, 6))), stages)
    ps.run_evaluate_test(spark, PARAMS, stages)


def test_reader_takes_the_header_of_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("icd_code,icd_version,long_title\nA1,10,one\n")
    (tmp_path / "b.csv").write_text('﻿LONG_TITLE,extra,"icd_version",icd_code\n"two, ""q""",x,9,B2\n')
    (tmp_path / "_ignored.csv").write_text("nothing\n")
    got = raw.read_code_dictionary(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("A1", 10, "one"), ("B2", 9, 'two, "q"')]
    (tmp_path / "c.csv").write_text("icd_code,long_title\nC3,three\n")
    with pytest.raises(SourceError, match="no column icd_version"):
        raw.read_code_dictionary(spark, str(tmp_path))


def test_unreadable_values_are_the_fault_of_the_source(spark, files, tmp_path):
    bad = tmp_path / "patients.csv"
    bad.write_text("subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod\nnot-a-number,F,4,2150,x,\n")
    paths = RawPaths(files.notes, files.diagnoses, files.admissions, str(bad))
    with pytest.raises(SourceError, match="patients"):
        st.write_bronze(spark, paths, StagePaths(str(tmp_path / "stages")))


def test_discard_removes_only_written_tables(spark, tmp_path):
    given = spark.range(5)
    given.write.parquet(str(tmp_path / "given"))
    kept = spark.read.parquet(str(tmp_path / "given"))
    written = cut_lineage(kept, "discarded")
    place = written.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(place)
    discard(written, kept, given)
    discard(written)
    assert not os.path.exists(place) and kept.count() == 5


def test_gradient_sums_of_many_files_come_from_one_task_a_core(spark, monkeypatch):
    cells = "array<struct<term_idx:int,weight:double>>"
    data = [(i, [(i % 7, 1.0 + i % 3), (7 + i % 5, 0.5)] if i % 11 else [], [int(i % 7 < 3), int(i % 5 == 0)]) for i in range(400)]
    rows = spark.createDataFrame(data, f"hadm_id long, features {cells}, y array<int>").repartition(40).cache()
    labels = spark.createDataFrame([(0, "A"), (1, "B")], "label_idx int, icd_code string")
    tasks, scanned = [], md._Losses.at
    monkeypatch.setattr(
        md._Losses, "at", lambda self, *a: tasks.append(self.blocks.rdd.getNumPartitions()) or scanned(self, *a)
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # the written rows come in many pieces
    try:
        model = md.fit_ovr_logistic(rows.select("hadm_id", "features"), rows.select("hadm_id", "y"), labels, 12).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert tasks and max(tasks) <= spark.sparkContext.defaultParallelism
    x, y = np.zeros((400, 13)), np.array([r[2] for r in data])
    x[:, 12] = 1.0
    for i, (_, features, _) in enumerate(data):
        for term, weight in features:
            x[i, term] = weight
    for r in model:
        on, w = y[:, r.label_idx] == 1, np.array([*r.coefficients, r.intercept])
        weight = np.where(on, 400 / (2 * on.sum()), 400 / (2 * (~on).sum()))
        slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - on)) / 400
        slope[:12] += w[:12] / 400
        assert np.abs(slope).max() <= 1e-4  # the tolerance of the fit


def test_weights_of_documents_taken_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(fx, "WEIGHED_TERMS", 7)
    docs = {i: [f"w{j:02}" for j in range(i % 13)] for i in range(60)}  # some without terms, some above the limit
    kind = "hadm_id long, terms array<struct<term:string,tf:int>>"
    table = spark.createDataFrame([(i, [(t, 1 + k % 3) for k, t in enumerate(ts)]) for i, ts in docs.items()] + [(99, None)], kind)
    idf = spark.createDataFrame([(k, f"w{k + 1:02}", 1.0 + k / 10) for k in range(10)], "term_idx int, term string, idf double")
    got = {r.hadm_id: r.features for r in fx.tfidf(table.coalesce(1), idf).collect()}
    assert got.pop(99) == [] and len(got) == len(docs)
    for i, ts in docs.items():
        want = {k - 1: (1 + np.log(1 + k % 3)) * (1 + (k - 1) / 10) for k in range(1, min(len(ts), 11))}
        norm = np.sqrt(sum(w * w for w in want.values()))
        assert [f.term_idx for f in got[i]] == list(want)
        assert np.allclose([f.weight for f in got[i]], [w / norm for w in want.values()])


def test_codes_are_counted_once_for_all_reports(spark, rows, monkeypatch):
    notes = rows([("n1", 1, 10, "en", 0, "some words"), ("n2", 2, 20, "en", 0, None)],
                 "note_id string, subject_id long, hadm_id long, note_type string, note_seq int, text string")
    codes = rows([(1, 10, "A1", 10), (1, 10, "B2", 10), (2, 20, "A1", 10), (2, 20, None, 10), (2, 20, "C3", 9)],
                 "subject_id long, hadm_id long, icd_code string, icd_version int")
    stays = rows([(1, 10, "2020-01-01 00:00:00", "2020-01-03 00:00:00", 0), (2, 20, "2021-01-01 00:00:00", None, 1)],
                 "subject_id long, hadm_id long, admittime string, dischtime string, hospital_expire_flag int")
    people = rows([(1, "F", 40, 2020, "2020 - 2022"), (2, None, 50, 2020, "2020 - 2022")],
                  "subject_id long, gender string, anchor_age int, anchor_year int, anchor_year_group string")
    titles = rows([("A1", 10, "first"), ("B2", 10, "second")], "icd_code string, icd_version int, long_title string")
    called, count = [], pp.pf.code_counts
    monkeypatch.setattr(pp.pf, "code_counts", lambda *a, **k: (called.append(1), count(*a, **k))[1])
    report = pp.profile_tables(notes, codes, stays, people, titles)
    assert len(called) == 1
    assert [(r.icd_code, r.n_codes, r.rank) for r in report["frequency"].orderBy("rank").limit(2).collect()] == [
        ("A1", 2, 1), ("B2", 1, 2)
    ]
    assert [(r.rank, r.n_admissions) for r in report["top_codes"].limit(2).collect()] == [(1, 2), (2, 1)]


def test_products_of_blocks(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(5)
    n, size, width = 60, 40, 3
    x = draw.random((n, size)) * (draw.random((n, size)) < draw.random(size) ** 2)
    x[[0, 7, n - 1]] = 0
    rows = [[{"term_idx": j, "weight": float(v)} for j, v in enumerate(row) if v] for row in x]
    kind = pa.list_(pa.struct([("term_idx", pa.int32()), ("weight", pa.float64())]))
    matrix, slopes = draw.normal(size=(size, width)), draw.normal(size=(n, width))
    whole = md._sparse(pa.array(rows, kind))
    own, terms, uses = np.unique(whole.terms, return_inverse=True, return_counts=True)
    rare = np.argsort(uses, kind="stable")
    terms = np.argsort(rare)[terms]
    block = md._Block(whole.starts, terms, whole.values, own[rare], np.argsort(terms, kind="stable"))
    for cells in (1, 5, 4_000):
        monkeypatch.setattr(md, "GROUP_CELLS", cells)
        monkeypatch.setattr(md, "PRODUCT_CELLS", cells)
        assert np.allclose(whole.product(matrix), x @ matrix) and np.allclose(block.product(matrix), x @ matrix)
        sums = np.ones((size, width))
        block.add_transposed(slopes, sums)
        assert np.allclose(sums, 1 + x.T @ slopes)


def test_tasks_of_a_scan_have_as_many_blocks(spark, monkeypatch):
    features = spark.createDataFrame(
        [(i, [(j, 1.0 + i) for j in range(1 + i % 5)]) for i in range(90)], "hadm_id long, features array<struct<term_idx:int,weight:double>>"
    ).coalesce(1)
    vectors = spark.createDataFrame([(i, [i % 2]) for i in range(90)], "hadm_id long, y array<int>")
    labels = spark.createDataFrame([(0, "A")], "label_idx int, icd_code string")
    dealt, made = [], md._Losses.__init__

    def init(self, blocks, *rest):
        dealt.extend(r["count"] for r in blocks.groupBy(F.spark_partition_id().alias("p")).count().collect())
        made(self, blocks, *rest)

    monkeypatch.setattr(md._Losses, "__init__", init)
    monkeypatch.setattr(md, "BLOCK_CELLS", 3)
    md.fit_ovr_logistic(features, vectors, labels, 5, ModelParams(max_iter=2))
    cores = spark.sparkContext.defaultParallelism
    assert len(dealt) == min(cores, sum(dealt)) and max(dealt) <= 3 * sum(dealt) / cores


def test_texts_are_scored_in_one_worker(spark, run):
    from cohortloom.session import cut_lineage

    stages, _ = run
    model, idf = md.load_model(spark, stages)
    size = idf.count()
    texts = [(i, t) for i, t in enumerate(["", None, "x", *[r.term for r in idf.limit(20).collect()]])]
    notes = spark.createDataFrame([(i, f"{t} {t} pain" if t else t) for i, t in texts], "hadm_id long, text string")
    terms = fx.document_terms(notes)
    scored = md.predict_proba(fx.tfidf(terms, idf), model, size)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    written = fx.tfidf(cut_lineage(terms, "terms"), idf)
    apart = md.predict_proba(cut_lineage(written, "features"), model, size)
    got, want = ({r.hadm_id: {s.icd_code: s.prob for s in r.scores} for r in df.collect()} for df in (scored, apart))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
