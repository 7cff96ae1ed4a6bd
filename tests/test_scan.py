import re

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import drift as dr
from cohortloom.operators import rules as rl
from cohortloom.operators import scan as sn
from cohortloom.session import fresh_path
from cohortloom.streaming import jobs

TEXTS = [
    (1, "Chief Complaint: chest pain\nMRN: 12345 seen"),
    (2, "nothing to see"),
    (3, "call (617) 555-1234 or 617-555-9999, 82 year-old"),
    (4, "left ______ and [**Hospital 12**] here"),
    (5, "read /data/physionet/x then pd.set_option('display.max_colwidth', None)"),
    (6, "éDOB is no word start, dobro is"),
    (7, None),
    (8, "Di\u017fcharge Diagnos\u0131s: P\u0130NK, \u212anown; ALLERG\u0130E: x; Diſcharge Date :"),
]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def brute(location, kind):
    out = set()
    for doc, text in TEXTS:
        for r in rl.phi_rules():
            m = re.search(r.pattern, text or "", re.I)
            if m and location in r.locations and kind in r.kinds:
                out.add((doc, r.rule_id, m.start() + 1, m.end() - m.start()))
    return out


def test_required_literals():
    of = {r.pattern: rl.required_literal(r.pattern) for r in rl.phi_rules()}
    assert of[r"Allergies?\s*:"] == "allergie"
    assert of[r"\[\*\*Known\s+(?:first|last)name[^\]]*\*\*\]"] == "known"
    assert of[r"\b\d+\s*(?:yo|y\.?o\.?|year[- ]old)\b"] == ""
    assert of[r"mimic-iv[/\\]hosp[/\\]"] == "mimic-iv"
    assert of[r"_{4,}"] == ""
    assert all(of[p] in p.lower() for p in of)


def test_rule_counts():
    rules = rl.phi_rules()
    by = {c: sum(r.category == c for r in rules) for c in {r.category for r in rules}}
    assert by == {
        "clinical_text": 17, "phi_marker": 7, "mimic_redaction_leak": 4, "raw_data_path": 6,
        "dangerous_display_setting": 3,
    }


@pytest.mark.parametrize("location,kind", [("source", "code"), ("output", "code"), ("source", "raw"), ("source", "markdown")])
def test_scan_brute_force(spark, location, kind):
    found = sn.phi_scan(docs(spark), location, kind).collect()
    assert {(r.doc_id, r.rule_id, r.start, r.length) for r in found} == brute(location, kind)
    assert all("[REDACTED]" in r.context for r in found)


def test_verdict(spark):
    found = sn.phi_scan(docs(spark))
    assert not sn.phi_verdict(found).first().passed
    clean = sn.phi_scan(docs(spark).filter("doc_id = 2"))
    assert sn.phi_verdict(clean).first().passed
    assert {r.severity for r in sn.phi_summary(found).collect()} == {"CRITICAL", "HIGH"}


def test_audit_order_line_and_allowlist(spark):
    df = spark.createDataFrame([("a.md", "x\ny DOB: 1\nPast Medical History"), ("b.md", "/data/physionet/z")], "doc_id string, text string")
    got = {r.doc_id: r for r in sn.audit_first_finding(df).collect()}
    assert got["a.md"].category == "clinical_section_header" and got["a.md"].line_no == 3
    assert got["b.md"].category == "raw_data_path"
    left = sn.audit_first_finding(df, {"raw_data_path": ["b.md"]}, excluded=["a.md"])
    assert left.count() == 0


def test_prose(spark):
    body = "He was admitted and reported pain. She denied fever and tolerated food. " * 40
    table = "admitted reported denied tolerated presented\n" * 60
    df = spark.createDataFrame([(1, body), (2, table), (3, body[:200])], "doc_id long, text string")
    got = {r.doc_id: r.is_prose for r in sn.clinical_prose_flag(df).collect()}
    assert got == {1: True, 2: False, 3: False}
    assert [r.doc_id for r in sn.prose_findings(df).collect()] == [1]


def test_stream_equals_batch(spark):
    path = fresh_path(spark, "stream-docs")
    docs(spark).repartition(4).write.parquet(path)
    stream = jobs.read_files(spark, path, docs(spark).schema, files_per_batch=1)
    got = jobs.drain(jobs.stream_phi_scan(stream), "scan")
    want = sn.phi_scan(docs(spark))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_windowed_stream_equals_batch(spark):
    from pyspark.sql import types as T

    rows = [(f"2024-01-{1 + i % 9:02d} 0{i % 5}:00:00", "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    path = fresh_path(spark, "events")
    df.coalesce(1).write.parquet(path)
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType())])
    stream = jobs.windowed_counts(jobs.read_files(spark, path, schema), "kind")
    got = {(r.window_start, r.bin): r.n for r in jobs.drain(stream, "windows").collect()}
    want = {(r.window_start, r.bin): r.n for r in jobs.windowed_counts(df, "kind").collect()}
    closed = {k: v for k, v in want.items() if k in got}
    assert got and got == closed  # windows the watermark has passed; the last ones stay open


def test_drift(spark):
    rows = [("reference", "f", "a", 50), ("reference", "f", "b", 50), ("current", "f", "a", 50), ("current", "f", "b", 50)]
    counts = spark.createDataFrame(rows, "period string, feature string, bin string, n long")
    assert dr.drift_report(counts).first().psi == 0.0
    moved = spark.createDataFrame(rows[:2] + [("current", "f", "a", 90), ("current", "f", "c", 10)], counts.schema)
    assert dr.drift_report(moved).first().psi > 0.25


def test_scan_reports_prose_of_outputs(spark):
    body = "He was admitted and reported pain. She denied fever and tolerated food. " * 40
    df = spark.createDataFrame([(1, body + "MRN: 12345"), (2, body[:300]), (3, None), (4, "")], "doc_id long, text string")
    found = sn.phi_scan(df).collect()
    prose = [r for r in found if r.category == "long_clinical_prose"]
    assert [(r.doc_id, r.severity, r.start, r.length) for r in prose] == [(1, "HIGH", 1, len(body) + 10)]
    assert "admitted" not in prose[0].context and any(r.rule_id != sn.PROSE_RULE for r in found)
    assert not [r for r in sn.phi_scan(df, location="source").collect() if r.category == "long_clinical_prose"]
    one = df.filter("doc_id = 1").select("doc_id", F.lit(body).alias("text"))
    assert not sn.phi_verdict(sn.phi_scan(one)).first().passed
    assert sn.phi_summary(sn.prose_findings(one)).collect()[0].severity == "HIGH"


def test_stream_drift_of_closed_windows(spark):
    import math

    from pyspark.sql import types as T

    path = fresh_path(spark, "drift-events")
    arrivals = [
        [("2024-01-01 05:00:00", "a")] * 3 + [("2024-01-02 05:00:00", None)] * 2 + [("2024-01-03 05:00:00", "b")],
        [("2024-01-08 05:00:00", "a")] * 2,
        [("2024-01-01 06:00:00", "b"), ("2024-01-07 09:00:00", "b"), ("2024-01-20 00:00:00", "a")],
    ]
    for i, rows in enumerate(arrivals):
        df = spark.createDataFrame(rows, "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
        df.coalesce(1).write.parquet(f"{path}/nth={i}")
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("kind", T.StringType())])
    events = jobs.read_files(spark, f"{path}/nth=*", schema, files_per_batch=1)
    got = {str(r.window_start)[:10]: (r.n, r.n_bins, r.psi) for r in jobs.drain(jobs.stream_drift(events, "kind", {"a": 0.5, "b": 0.5}), "drift").collect()}
    term = lambda c, r: (c - r) * math.log(c / r)
    assert got["2024-01-01"] == (3, 2, pytest.approx(term(1, 0.5) + term(1e-6, 0.5)))  # the late row came after its window
    assert got["2024-01-02"] == (2, 3, pytest.approx(term(1, 1e-6) + 2 * term(1e-6, 0.5)))
    assert got["2024-01-07"][0] == 1 and "2024-01-20" not in got
    with pytest.raises(ValueError):
        jobs.reference_shares(spark.range(5).select(F.col("id").cast("string").alias("bin"), F.lit(1).alias("n")), limit=3)


def test_registered_streams_read_a_table_of_one_or_of_many_files(spark, tmp_path):
    from cohortloom.catalog import QUERIES

    table = spark.createDataFrame([(d, f"MRN: {d} seen") for d in range(6)], "doc_id long, text string")
    (tmp_path / "many").mkdir()
    table.repartition(3).write.parquet(str(tmp_path / "many/documents.parquet"))
    table.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "one/documents.parquet")
    for folder in ("one", "many"):
        for name, batch in (("stream_score_documents", "score_documents"), ("stream_phi_scan", "phi_scan")):
            streamed = QUERIES[name](spark, str(tmp_path / folder))
            want = QUERIES[batch](spark, str(tmp_path / folder)).select(streamed.columns)
            assert streamed.count() and streamed.exceptAll(want).count() == want.exceptAll(streamed).count() == 0
