import pytest
from pyspark.sql import functions as F

from cohortloom.errors import LabelError, SplitError, StageError
from cohortloom.operators import chunks as ch
from cohortloom.operators import coverage as cv
from cohortloom.operators import curate as cu
from cohortloom.operators import labels as lb
from cohortloom.operators import ordered as od
from cohortloom.session import cut_lineage
from cohortloom.operators import profile as pf
from cohortloom.operators import splits as sp
from cohortloom.sources import views

DX = "hadm_id long, icd_code string, icd_version int"


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "hadm_id long")


def test_silver_keeps_one_long_latest_note(rows):
    long = "word " * 120
    notes = rows(
        [("a", 1, 10, "DS", 1, long), ("b", 1, 10, "DS", 2, long + "last"), ("c", 2, 20, "DS", 1, "short"),
         ("d", 3, 30, "RR", 1, long), ("e", 4, None, "DS", 1, long), ("f", 4, None, "DS", 2, long)],
        "note_id string, subject_id long, hadm_id long, note_type string, note_seq int, text string",
    )
    got = cu.build_silver_notes(notes).collect()
    assert sorted(r.note_id for r in got) == ["b", "f"]
    assert got[0].asDict().keys() == set(cu.SILVER_COLUMNS)


def test_version_filter_needs_its_column(rows):
    with pytest.raises(LabelError):
        cu.filter_code_version(rows([(1, "A")], "hadm_id long, icd_code string"))


def test_top_k_needs_enough_codes(rows):
    codes = rows([(1, "A"), (2, "A"), (3, "B")], "hadm_id long, icd_code string")
    with pytest.raises(LabelError, match="distinct"):
        lb.top_k_codes(codes, 50)


def test_top_k_is_alphabetical(rows):
    codes = rows([(i, c) for i, c in enumerate("CCCAABB")], "hadm_id long, icd_code string")
    assert [r.icd_code for r in lb.top_k_codes(codes, 2).orderBy("label_idx").collect()] == ["A", "C"]


def test_labels_come_from_the_cohort(spark, rows):
    dx = rows([(100, "A", 10), (101, "a ", 10)] + [(200, "Z", 10)] * 5, DX)
    out = lb.build_labels(ids(spark, [100, 101]), dx, 1)
    assert lb.label_list(out.labels) == ["A"]
    assert out.cells.count() == 2
    dx = rows([(100, "A", 10)] + [(999, "A", 10)] * 9, DX)
    assert lb.build_labels(ids(spark, [100]), dx, 1).cells.count() == 1


def test_label_gate(spark, rows):
    dx = rows([(1, "A", 10)], DX)
    with pytest.raises(LabelError, match="none of the top"):
        lb.build_labels(ids(spark, [1, 2, 3]), dx, 1)
    assert lb.build_labels(ids(spark, [1, 2, 3]), dx, 1, gate=0.9).cells.count() == 1


def test_matrix_is_dense_and_repeats_collapse(spark, rows):
    dx = rows([(1, "A", 10), (1, "A", 10), (2, "B", 10)], DX)
    cohort = ids(spark, [1, 2, 3])
    out = lb.build_labels(cohort, dx, 2)
    cells = {(r.hadm_id, r.icd_code): r.present for r in lb.build_label_matrix(cohort, out.cells, out.labels).collect()}
    assert cells == {(1, "A"): 1, (1, "B"): 0, (2, "A"): 0, (2, "B"): 1, (3, "A"): 0, (3, "B"): 0}
    assert lb.label_density(cohort, out.cells, 2).first().density == pytest.approx(2 / 6)
    assert lb.zero_label_count(cohort, out.cells).first().n_zero_label == 1
    lb.check_alignment(cohort, lb.label_vectors(cohort, out.cells, 2))
    with pytest.raises(StageError):
        lb.check_alignment(cohort, out.cells)


def test_cooccurrence_brute_force(rows):
    import random

    rng = random.Random(1)
    data = [(h, c, 10) for h in range(80) for c in rng.sample("ABCDEF", rng.randint(1, 5))]
    # one admission with a third of all rows
    data += [(7, rng.choice("ABCDEF"), 10) for _ in range(200)]
    got = {(r.code_a, r.code_b): r.n for r in lb.label_cooccurrence(rows(data, DX), 5).collect()}
    sets = {}
    for h, c, _ in data:
        sets.setdefault(h, set()).add(c)
    top = {a for a, _ in got}
    assert len(top) == 5
    for a in top:
        for b in top:
            assert got[a, b] == sum(a in s and b in s for s in sets.values())


def test_venn_covers_all_regions(spark, rows):
    notes, adm = ids(spark, [1, 2, 3, 4, None]), ids(spark, [2, 3, 5, 6])
    dx = rows([(3, "A", 10), (4, "A", 10), (6, "A", 10), (7, "A", 10), (5, "A", 9)], DX)
    got = {r.slice: r["count"] for r in cv.join_coverage(notes, adm, dx).collect()}
    assert got == {
        "notes_only": 1, "adm_only": 1, "dx_only": 1, "notes_and_adm": 1, "notes_and_dx": 1,
        "adm_and_dx": 1, "all_three": 1, "total_notes": 4, "total_adm": 4, "total_dx_v10": 4,
    }


def test_reconciliation_and_coverage(spark):
    r = cv.version_reconciliation(ids(spark, [1, 2, 3, 4]), ids(spark, [1, 2])).first()
    assert (r.n_notes_missing_from_hosp, r.pct_notes_missing_from_hosp) == (2, 50.0)
    c = cv.cohort_coverage(ids(spark, [1, 2, 3, 4, 5]), ids(spark, [1, 2, 3]), ids(spark, [1])).first()
    assert (c.n_notes, c.n_retained, c.n_drift_loss, c.n_cohort_filter_loss) == (5, 1, 2, 2)
    assert c.pct_retained + c.pct_drift_loss + c.pct_cohort_filter_loss == pytest.approx(100)


def test_split_contract(rows):
    data = [(h, h % 37) for h in range(200)] + [(1000 + h, 5) for h in range(100)]
    notes = rows(data, "hadm_id long, subject_id long")
    manifest = sp.patient_split(notes, 0.7, 0.15, 0.15, seed=3)
    assert sp.split_disjoint_check(manifest).count() == 0
    counts = {r.split: r.n_patients for r in sp.split_counts(manifest).collect()}
    assert counts == {"train": round(0.7 * 37), "val": round(0.15 * 37), "test": 37 - round(0.7 * 37) - round(0.15 * 37)}
    again = sp.patient_split(notes, 0.7, 0.15, 0.15, seed=3)
    assert manifest.exceptAll(again).count() == 0
    other = sp.patient_split(notes, 0.7, 0.15, 0.15, seed=4)
    assert manifest.exceptAll(other).count() > 0
    with pytest.raises(SplitError):
        sp.patient_split(notes, 0.9, 0.2, 0.1)


def test_split_of_very_few_subjects(rows):
    one = rows([(1, 1)], "hadm_id long, subject_id long")
    assert sp.patient_split(one).first().split == "train"


def test_null_rates(rows):
    df = rows([(1.0, 1), (2.0, 2), (float("nan"), 3), (4.0, 4)], "a double, b int")
    got = {r.column: r.null_rate for r in pf.null_rate_by_column(df, "t").collect()}
    assert got == {"a": 0.25, "b": 0.0}


def test_date_range(rows):
    got = pf.date_range(rows([("2020-01-01",), ("2020-06-15",), ("2020-12-31",)], "d string"), "d").first()
    assert (got.span_days, got.n_non_null) == (365, 3)
    got = pf.date_range(rows([(None,), ("?",)], "d string"), "d").first()
    assert (got["min"], got.span_days, got.n_non_null) == (None, 0, 0)


def test_truncation(rows):
    df = rows([(n,) for n in (100, 400, 800, 1200, 2000)], "n_tokens int")
    got = {r.max_tokens: r for r in pf.truncation_impact(df, (512, 4096)).collect()}
    assert (got[512].n_total, got[512].n_exceeds, got[512].pct_exceeds) == (5, 3, 60.0)
    assert got[512].median_tokens_lost_for_exceeders == 1200 - 512
    assert got[4096].median_tokens_lost_for_exceeders == 0.0


def test_exact_quantiles_brute_force(rows):
    import numpy as np

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=300), np.repeat(0.25, 150)])  # a third is one value
    df = rows([(float(v),) for v in values] + [(None,)], "x double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = od.exact_quantiles(df, ["x"], qs).first()
    for i, q in enumerate(qs):
        assert got[f"q{i}"] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_ranks_are_global(rows):
    data = [(f"c{i:03d}", (i * 7) % 5) for i in range(200)]
    df = rows(data, "code string, n int").repartition(6)
    got = {r.code: r["rank"] for r in od.ranked(df, [F.desc("n"), F.col("code")]).collect()}
    want = sorted(data, key=lambda x: (-x[1], x[0]))
    assert got == {code: i for i, (code, _) in enumerate(want, 1)}


def test_mortality_without_flag(rows):
    got = pf.mortality_rate(rows([(1,)], "hadm_id long")).first()
    assert (got.n_admissions, got.n_deaths, got.rate) == (1, None, None)


def test_chunks(rows):
    words = [f"w{i}" for i in range(180)]
    notes = rows([(1, " ".join(words)), (2, "one two"), (3, ""), (4, None)], "hadm_id long, text string")
    for window, stride in ((64, 0), (64, 8), (64, 63), (200, 0), (180, 0)):
        got = {}
        for r in ch.chunk_tokens(notes, window, stride).collect():
            got.setdefault(r.hadm_id, {})[r.chunk_idx] = r.tokens
        step, want, at = window - stride, [], 0
        while True:
            want.append(words[at:at + window])
            if at + window >= len(words):
                break
            at += step
        assert [got[1][i] for i in range(len(want))] == want and len(got[1]) == len(want)
        assert got[2] == {0: ["one", "two"]}
        assert set(got) == {1, 2}
    with pytest.raises(ValueError):
        ch.chunk_tokens(notes, 8, 8)


def test_maxpool_fills_missing_documents(spark, rows):
    labels = rows([(0, "A"), (1, "B")], "label_idx int, icd_code string")
    scores = rows([(1, "A", 0.2), (1, "A", 0.7), (1, "B", 0.1)], "hadm_id long, icd_code string, prob double")
    got = {(r.hadm_id, r.icd_code): r.prob for r in ch.maxpool_chunks(scores, ids(spark, [1, 2]), labels).collect()}
    assert got == {(1, "A"): 0.7, (1, "B"): 0.1, (2, "A"): 0.0, (2, "B"): 0.0}


@pytest.mark.parametrize("n", [1, 50, 399, 400, 900])
def test_sample_is_the_head_of_the_hash_order(rows, n):
    import hashlib

    ids = [f"n{i}" for i in range(400)]
    got = cu.sample_fixed_n(rows([(i,) for i in ids], "note_id string").repartition(5), n, seed=7)
    order = sorted(ids, key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert sorted(r.note_id for r in got.collect()) == sorted(order[:n])


def test_split_subset_sizes(rows):
    manifest = rows([(i, "train" if i % 3 else "val") for i in range(3000)], "hadm_id long, split string")
    got = cu.sample_split_subset(manifest, {"train": 20, "val": 5, "test": 4})
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 20, "val": 5}
    assert got.exceptAll(cu.sample_split_subset(manifest, {"train": 20, "val": 5})).count() == 0


def test_samples_are_exact_with_repeated_and_null_keys(rows):
    data = [(f"n{i % 50}", i) for i in range(400)] + [(None, i) for i in range(200)] + [("hot", 7)] * 300
    table = rows(data, "note_id string, x int").repartition(7)
    for n in (0, 1, 37, 299, 450, 899, 900, 2000):
        got = cu.sample_fixed_n(table, n, seed=1)
        assert got.columns == ["note_id", "x"]
        drawn = [tuple(r) for r in got.collect()]
        assert len(drawn) == min(n, 900)
        left = sorted(data, key=repr)
        for r in drawn:  # no row more often than it is there
            left.remove(r)
        again = cu.sample_fixed_n(table.repartition(3), n, seed=1).collect()
        assert sorted(map(repr, drawn)) == sorted(repr(tuple(r)) for r in again)
    nulls = sum(r.note_id is None for r in cu.sample_fixed_n(table, 899, seed=1).collect())
    assert nulls >= 199


def test_split_subset_of_repeated_keys(rows):
    manifest = rows([(5, "train")] * 40 + [(None, "train")] * 40 + [(i, "val") for i in range(9)] + [(1, None)], "hadm_id long, split string")
    got = cu.sample_split_subset(manifest, {"train": 55, "val": 20})
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 55, "val": 9}


def test_rows_without_subject_stay_together(rows):
    data = [(h, h % 20) for h in range(100)] + [(1000 + h, None) for h in range(30)]
    manifest = sp.patient_split(rows(data, "hadm_id long, subject_id long"), 0.5, 0.25, 0.25)
    assert manifest.filter("split IS NULL").count() == 0 and manifest.count() == 130
    assert manifest.filter("subject_id IS NULL").select("split").distinct().count() == 1
    assert sp.split_disjoint_check(manifest).count() == 0
    assert sum(r.n_patients for r in sp.split_counts(manifest).collect()) == 21


def test_ranges_grow_with_rows(rows, monkeypatch):
    found = []

    def spy(df, label):
        table = cut_lineage(df, label)
        if label == "ranged":
            found.append(table.select("_range").distinct().count())
        return table

    monkeypatch.setattr(od, "cut_lineage", spy)
    monkeypatch.setattr(od, "RANGE_ROWS", 25)
    for n in (20, 100, 400):
        data = rows([(i % 3, i, i * i % 7) for i in range(n)], "g int, k int, v long")
        out = od.running_sums(data, [F.col("k")], {"v": "upto"}, by=["g"], totals={"v": "total"}).collect()
        for r in out:
            mine = [(i, i * i % 7) for i in range(n) if i % 3 == r.g]
            assert (r.upto, r.total) == (sum(v for i, v in mine if i <= r.k), sum(v for _, v in mine))
        assert len(out) == n
    assert found == [1, 4, 16]


def test_the_join_of_the_codes_is_dealt_by_its_rows(spark, rows, tmp_path, monkeypatch):
    orders = rows([(i, i % 7, "F" if i % 3 else "O") for i in range(200)] + [(None, 1, "F")], "o_orderkey long, o_custkey long, o_orderstatus string")
    lines = [(i // 3, i, i % 3 + 1) for i in range(600)] + [(None, 1, 1), (9999, 2, 1)]
    lines = rows(lines, "l_orderkey long, l_partkey long, l_linenumber int")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))

    def tasks(df):
        found = df.groupBy(F.spark_partition_id()).count().collect()
        return len(found), max(r["count"] for r in found)

    plain = views.view(spark, str(tmp_path), "diagnoses")
    whole = sorted(plain.collect())
    monkeypatch.setattr(views, "TASK_ROWS", 20)
    dealt = views.view(spark, str(tmp_path), "diagnoses")
    assert sorted(dealt.collect()) == whole and len(whole) == 600
    n, most = tasks(dealt)
    assert n > 8 and most < 80  # no coalescing by bytes; many small keys to a task
